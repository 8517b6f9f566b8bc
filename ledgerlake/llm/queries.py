"""The queries of the training-data operators, over the tables of a folder, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm import bpe, decontam, html, katz, langid, neardup, pii, quality, secrets, substring
from ledgerlake.llm import words as W
from ledgerlake.llm.lasting import lasting

#: crc32 remainders: held out from language learning (of 4), and from the language model (of 10).
LANG_HELD_OUT, LM_HELD_OUT = (4, 2), (10, 0)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _held_out(doc_id: Column, rule: tuple[int, int]) -> Column:
    return W.crc_mod(doc_id, rule[0]) == rule[1]


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(_table(spark, sf_dir, "documents"), lasting)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(_table(spark, sf_dir, "documents"))
    n = F.when(F.col("ids") == "", 0).otherwise(F.length("ids") - F.length(F.replace("ids", F.lit(" "), F.lit(""))) + 1)
    return coded.select("doc_id", n.cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = _held_out(F.col("doc_id"), LANG_HELD_OUT)
    out = langid.predict(docs, langid.learn(docs, ~held_out))
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "accepted")


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages"))


def op5_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.remove_repeats(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(_table(spark, sf_dir, "documents"), LM_HELD_OUT)


def op7_benchmark_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(_table(spark, sf_dir, "documents"), lasting)
    base = [(k, F.col(k)) for k in pii.BASE]
    added = [(k, F.transform(F.filter("added", _of_kind(k)), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))) for k in pii.ADDED]
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in pii.BASE],
        F.sha2(pii.joined(*base), 256).alias("base_sha256"), pii.joined(*base, *added).alias("spans"), F.size("added").cast("long").alias("n_added"),
    )


def _of_kind(kind: str):
    return lambda x: x["kind"] == kind


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), lasting)


def queries() -> dict:
    return {f.__name__: f for f in (op1_near_duplicates, op2_byte_bpe, op3_language_id, op4_html_extract, op5_repeated_passages, op6_language_model, op7_benchmark_overlap, op8_personal_data, op9_secret_scan, op10_quality_rules)}


#: Windows of 13 words by text, their least doc_id, the words that later documents' windows cover.
_PASSAGES = r"""
with docs as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
windows as (select doc_id, p, array_to_string(ws[p : p + 12], ' ') as k from (select doc_id, ws, unnest(range(1, len(ws) - 11)) as p from docs where len(ws) > 12)),
firsts as (select k, min(doc_id) as first from windows group by k),
gone as (select distinct doc_id, p + o as q from windows join firsts using (k) cross join (select unnest(range(13)) as o) where first < doc_id),
words as (select doc_id, unnest(ws) as w, generate_subscripts(ws, 1) as q from docs),
kept as (select doc_id, count(gone.q) as n_removed, string_agg(w, ' ' order by q) filter (where gone.q is null) as text from words left join gone using (doc_id, q) group by doc_id)
select doc_id, len(ws)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(text, '')) as kept_sha256 from docs left join kept using (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_repeated_passages": _PASSAGES}

"""From raw documents to encoded training text: STAGES, each written as Parquet and read by the next; run() applies them.

A stage takes (spark, docs, sf_dir). All but the last return the columns of their input, also those whose
names the operators use themselves. Rows that a stage does not reject pass whole; an empty table passes as
one. Null and empty texts have no words, so quality rules drop them; the other stages keep them. Texts of
any length are read whole. Near duplicates keep the row of the least doc_id of a group, and one row of those
that share it; a row without a doc_id is in no group and stays. The other stages judge every row by its text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ledgerlake.llm import bpe, decontam, neardup, quality, secrets
from ledgerlake.llm.lasting import lasting, shared_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the fixed rule or the isolation forest rejects."""
    return quality.passing(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), lasting)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the least doc_id, of each group of near duplicates."""
    return neardup.one_of_each(docs, lasting)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark passage, substitutions allowed."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets by their kind."""
    return secrets.redacted(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds n_tokens and ids; text is what the ids decode to."""
    return bpe.encoded(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scans),
    ("byte-level BPE", byte_bpe),
]

#: Near-duplicate classes, forests and spaced seeds are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of sf_dir through all stages."""
    shared_folder(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            _remove(spark, f"{folder}/{k - 1}")
    return docs


def _remove(spark: SparkSession, folder: str) -> None:
    """A stage's output, once the next one's is written; the last one's holds the result and stays."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

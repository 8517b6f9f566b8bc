"""Language identification by compression (operator 3).

Each language has a raw-content zstandard dictionary of training text. A text is compressed against
every dictionary; the language whose dictionary leaves the fewest bytes is predicted. Where the margin
over the next one is narrow, the prediction stands but ``accepted`` is false.

Training uses a bounded sample of labelled rows: SAMPLE_ROWS different texts a language, or all if it has
fewer, chosen by hash of the text. Each is taken whole: its letters are cut into pieces of PIECE bytes, and
of all pieces of a language's texts as many as fill its dictionary are chosen by hash, wherever in a text
they lie. A dictionary's size depends on its own language only. Texts to be classified are taken whole, in
blocks, by one rule whatever their length.

Defined results. Null text, or one without a letter (numerals such as ½ are none): ``und``, score 0, not
accepted. Ties: the language first in alphabetical order. No training rows: ``und`` everywhere. Null
doc_id: held_out is null and the row is not learnt from. Repeated rows: one result each. Columns but
doc_id, text and lang are not read.
"""

from __future__ import annotations

import re
import sys
import unicodedata

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlake.llm import words as W

#: Texts that a language learns from, and bytes of the pieces that these are cut into.
SAMPLE_ROWS, PIECE = 256, 1024
#: Bytes of a language's dictionary; bytes compressed at once, so that every part of a text meets it.
DICTIONARY, BLOCK = 240_000, 4096
#: Levels whose sizes are added up, as a few bytes decide on a short text.
LEVELS = (3, 6)
#: Least relative saving over the next language.
MARGIN = 0.02

_NOT_LETTERS = re.compile(r"[\W\d_]+")
#: Numerals that are neither letters nor decimal digits, which the pattern leaves.
_NUMERALS = {c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) in ("Nl", "No")}
_NO_NUMERALS = dict.fromkeys(map(ord, _NUMERALS), " ")


def normal(text: str) -> bytes:
    """Lower-case letters, with one space for whatever lies between."""
    if not text.isascii() and not _NUMERALS.isdisjoint(text):
        text = text.translate(_NO_NUMERALS)
    return _NOT_LETTERS.sub(" ", text.lower()).strip().encode("utf-8", "replace")


def learn(docs: DataFrame, trains: Column) -> dict[str, bytes]:
    """Dictionary text by language, from a bounded sample of the rows for which ``trains`` holds."""
    rows = docs.where(trains & F.col("text").isNotNull() & F.col("lang").isNotNull()).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    key = F.xxhash64("text")
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.approx_count_distinct(key).alias("n")).collect()}
    if not counts:
        return {}
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, 4 * SAMPLE_ROWS / max(1, n)))) for k, n in sorted(counts.items())])
    few = rows.withColumn("k", key).where(F.pmod("k", F.lit(1_000_003)) <= share * 1_000_003).distinct()
    best = few.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("k", "text"))).where(F.col("n") <= SAMPLE_ROWS)
    pieces = W.map_batches(best.select("lang", "text"), "lang string, k long, piece binary", _cut)
    fit = pieces.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("k", "piece"))).where(F.col("n") <= DICTIONARY // PIECE)
    held: dict[str, list[bytes]] = {k: [] for k in counts}
    for r in fit.orderBy("lang", "n").collect():
        held[r.lang].append(bytes(r.piece))
    return {k: b" ".join(v) for k, v in sorted(held.items())}


def _cut():
    """Pieces of whole texts, with a hash that says which are taken."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            letters = normal(text)
            rows += [(lang, letters[i : i + PIECE - 1]) for i in range(0, len(letters), PIECE - 1)]
        keys = [xxhash.xxh3_64_intdigest(piece) >> 1 for _, piece in rows]
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.string()), pa.array(keys, pa.int64()), pa.array([x for _, x in rows], pa.binary())], ["lang", "k", "piece"])

    return step


def _compressor(content: bytes, level: int) -> zstandard.ZstdCompressor:
    own = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    own.precompute_compress(level=level)
    return zstandard.ZstdCompressor(level=level, dict_data=own, write_content_size=False, write_checksum=False, write_dict_id=False)


class Classifier:
    """Compressors by language, made once a task."""

    def __init__(self, dictionaries: dict[str, bytes]) -> None:
        self.by = {}
        for lang, content in dictionaries.items():
            self.by[lang] = [_compressor(content or b" " * 8, level) for level in LEVELS]

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        letters = normal(text) if text else b""
        if not letters or not self.by:
            return "und", 0.0, False
        blocks = [letters[i : i + BLOCK] for i in range(0, len(letters), BLOCK)]
        sizes = sorted((sum(len(c.compress(b)) for c in own for b in blocks), lang) for lang, own in self.by.items())
        if len(sizes) == 1:
            return sizes[0][1], 1.0, True
        saved = 1 - sizes[0][0] / sizes[1][0]
        return sizes[0][1], min(1.0, 0.5 + 2.5 * saved), saved >= MARGIN


def predict(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """Per row: doc_id, lang_pred, score, accepted. Only the text is looked at."""

    def make():
        classify = Classifier(dictionaries)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = [classify(t.as_py()) for t in batch.column("text")]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64()), pa.array([x[2] for x in out], pa.bool_())], ["doc_id", "lang_pred", "score", "accepted"])

        return step

    return W.map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), "doc_id long, lang_pred string, score double, accepted boolean", make)

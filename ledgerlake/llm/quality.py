"""Quality rules (operator 10): rule statistics, an isolation forest over them, a calibrated threshold.

Each text gives counts (``STATS``). From them come a fixed rule (``base_failed``) and, as ratios, the
features of an isolation forest (``FEATURES``): random splits isolate odd documents after few steps, so
short mean path lengths mark anomalies. Many oddities are harmless (a long text, a short line twice), so a
split's feature is drawn with a weight: how far labelled good and bad documents differ in it (the largest
gap between their distribution functions, LEAST_WEIGHT at least, and 1 for all without both labels). No
feature is cut or floored. The forest is grown on a bounded sample of documents (``SAMPLE``, different
ones, by hash of the text); weights and threshold come from all labelled rows, through quantiles and a
histogram of scores by label.

Defined results. Null or empty text: all counts 0, base_failed true, kept false. Repeated rows, ties
and repeated doc_ids: one result a row. No rows: no rows. No labelled rows: the threshold is 1, so the
forest rejects nothing. Labels that disagree for a document: it counts as good if any row says so.
Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm import words as W

#: Documents that the forest is grown on, at most about this many; trees; documents a tree.
SAMPLE, TREES, LEAF_SAMPLE = 4096, 64, 256
#: Share of the labelled good documents, base failures aside, that the threshold may reject.
GOOD_LOST = 0.005
#: Bins of the score histogram that the threshold is read from.
BINS = 1000

STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
FEATURES = ("word_length", "dup_line_share", "repeat_word_share", "symbol_share", "shout_share", "mark_share", "log_words")
#: Weight of a feature in which labelled good and bad documents do not differ; quantiles by which they are compared.
LEAST_WEIGHT, QUANTILES = 0.02, 200
_OUT = f"doc_id long, {STATS}, x array<float>, sample_key long"

_WHITE = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"


def _table(members: bytes) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[list(members)] = 1
    return out


_UPPER = _table(bytes(range(65, 91)))
_LEAD = np.array([(b & 0xC0) != 0x80 for b in range(256)], np.uint8)
_CLASSES = {
    "points": _LEAD - _table(_WHITE),
    "symbols": _table(_SYMBOLS),
    "marks": _table(b"!?^~"),
}


def repeated_words(hashes: np.ndarray, offsets: np.ndarray, n: int = 3) -> np.ndarray:
    """Per text: words covered by an n-word window that its text holds twice or more."""
    inside = W.starts_within(offsets, n)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    covered = np.zeros(len(hashes) + n, np.int32)
    at = np.flatnonzero(inside)
    if len(at):
        keys = W.grams(hashes, n)[at] ^ W.mix(owner[at].astype(np.uint64) + np.uint64(1))
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        hit = at[twice]
        np.add.at(covered, hit, 1)
        np.add.at(covered, hit + n, -1)
    on = np.cumsum(covered)[: len(hashes)] > 0
    return np.bincount(owner[on], minlength=len(offsets) - 1)


def _stats(batch: pa.RecordBatch, cache: W.WordHashes) -> pa.RecordBatch:
    texts = W.text_bytes(batch.column("text"))
    rows = len(texts)
    counts = {k: np.zeros(rows) for k in (*_CLASSES, "shout", "words", "repeat", "dup", "lines")}
    for i, text in enumerate(texts):
        if not text:
            continue
        held = np.frombuffer(text, np.uint8)
        by = np.bincount(held, minlength=256)
        for k, table in _CLASSES.items():
            counts[k][i] = by @ table if k != "points" else (by * table.astype(np.int8)).sum()
        upper = _UPPER[held]
        counts["shout"][i] = (upper[1:] & upper[:-1]).sum()
        lines = [x for x in text.split(b"\n") if x.strip()]
        counts["lines"][i] = len(lines)
        counts["dup"][i] = len(lines) - len(set(lines))
    for first, held in W.batches(texts):
        hashes, offsets = W.flat(held, cache)
        here = slice(first, first + len(held))
        counts["words"][here] = np.diff(offsets)
        counts["repeat"][here] = repeated_words(hashes, offsets)
    chars, words, lines = (np.maximum(counts[k], 1) for k in ("points", "words", "lines"))
    x = np.stack(
        [counts["points"] / words, counts["dup"] / lines, counts["repeat"] / words, counts["symbols"] / chars, counts["shout"] / chars, counts["marks"] / chars, np.log1p(counts["words"])], axis=1
    ).astype(np.float32)
    whole = lambda k: pa.array(counts[k].astype(np.int64))
    lists = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), whole("words"), whole("points"), whole("symbols"), whole("dup"), whole("repeat"), lists, batch.column("sample_key")],
        ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "x", "sample_key"],
    )


def statistics(docs: DataFrame) -> DataFrame:
    """Counts and forest features of every document."""

    def make():
        cache = W.WordHashes()
        return lambda batch: _stats(batch, cache)

    return W.map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("sample_key")), _OUT, make)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Forest:
    """Isolation trees as flat arrays: split feature (-1 at a leaf), split value, left child, path length at a leaf."""

    feature: np.ndarray
    value: np.ndarray
    left: np.ndarray
    length: np.ndarray
    norm: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 to the power of minus the mean path length over its expectation; towards 1 for odd rows."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for t in range(len(self.feature)):
            at = np.zeros(len(x), np.int64)
            live = rows
            while len(live):
                f = self.feature[t, at[live]]
                live = live[f >= 0]
                f = f[f >= 0]
                here = at[live]
                at[live] = self.left[t, here] + (x[live, f] >= self.value[t, here])
            total += self.length[t, at]
        return np.exp2(-total / len(self.feature) / self.norm)


def _expected(n: int) -> float:
    """Mean path length of an unsuccessful search among n points."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n


def grow(x: np.ndarray, weights: np.ndarray | None = None, trees: int = TREES, sample: int = LEAF_SAMPLE, seed: int = 7) -> Forest:
    """weights: how often a feature is split, against the others that vary; None: all alike."""
    weights = np.ones(x.shape[1]) if weights is None else weights
    rng = np.random.default_rng(seed)
    sample = min(sample, len(x))
    depth = max(1, int(np.ceil(np.log2(max(2, sample)))))
    size = 2 ** (depth + 1)
    feature, value = np.full((trees, size), -1, np.int64), np.zeros((trees, size), np.float32)
    left, length = np.zeros((trees, size), np.int64), np.zeros((trees, size))
    for t in range(trees):
        todo, free = [(0, x[rng.choice(len(x), sample, replace=False)], 0)], 1
        while todo:
            at, own, level = todo.pop()
            low, high = own.min(axis=0), own.max(axis=0)
            spread = np.flatnonzero(high > low)
            if level == depth or len(own) < 2 or not len(spread):
                length[t, at] = level + _expected(len(own))
                continue
            f = rng.choice(spread, p=weights[spread] / weights[spread].sum())
            v = np.float32(rng.uniform(low[f], high[f]))
            right = own[:, f] >= v
            if right.all() or not right.any():
                v = high[f]
                right = own[:, f] >= v
            feature[t, at], value[t, at], left[t, at] = f, v, free
            todo += [(free, own[~right], level + 1), (free + 1, own[right], level + 1)]
            free += 2
    return Forest(feature, value, left, length, max(_expected(sample), 1e-9))


def _quality(labels: DataFrame) -> DataFrame:
    own = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality is not null")
    return own.groupBy("doc_id").agg(F.max("quality").alias("quality"))


def separation(stats: DataFrame, labels: DataFrame) -> np.ndarray | None:
    """By feature, the largest gap between the distribution functions of labelled good and bad documents that
    pass the fixed rule; None unless there are both. The driver gets two rows of quantiles."""
    known = stats.where(~base_failed()).join(_quality(labels).select("doc_id", (F.col("quality") != 0).alias("good")), "doc_id")
    shares = [k / QUANTILES for k in range(QUANTILES + 1)]
    rows = known.groupBy("good").agg(*[F.percentile_approx(F.col("x")[k], shares, 50 * QUANTILES).alias(name) for k, name in enumerate(FEATURES)]).collect()
    if len(rows) < 2:
        return None
    one, other = (np.sort(np.array(r[1:], np.float64), axis=1) for r in rows)
    gaps = [np.abs(np.searchsorted(a, v, "right") - np.searchsorted(b, v, "right")).max() for a, b in zip(one, other, strict=True) for v in [np.concatenate([a, b])]]
    return np.maximum(np.array(gaps) / (QUANTILES + 1), LEAST_WEIGHT)


def fit(stats: DataFrame, labels: DataFrame) -> Forest | None:
    """A forest over a bounded sample of the documents that pass the fixed rule; None if there are none."""
    passing = stats.where(~base_failed())
    n = passing.agg(F.approx_count_distinct("sample_key").alias("n")).first().n
    share = min(1.0, 2 * SAMPLE / max(1, n))
    picked = passing.where(F.pmod(F.xxhash64("sample_key"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1) if share < 1 else passing
    rows = picked.select("x", "sample_key").distinct().orderBy("sample_key", "x").limit(SAMPLE).collect()
    return grow(np.array([r.x for r in rows], np.float32), separation(stats, labels)) if rows else None


def scored(stats: DataFrame, forest: Forest | None) -> DataFrame:
    """Adds anomaly, from 0 to 1; 0 without a forest."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = np.array(batch.column("x").flatten(), np.float32).reshape(-1, len(FEATURES))
            s = forest.score(x) if forest is not None and len(x) else np.zeros(len(x))
            kept = [k for k in batch.schema.names if k not in ("x", "sample_key")]
            return pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), pa.array(s)], [*kept, "anomaly"])

        return step

    return W.map_batches(stats, f"doc_id long, {STATS}, anomaly double", make)


def threshold(scores: DataFrame, labels: DataFrame, good_lost: float = GOOD_LOST) -> float:
    """The score from which on documents are rejected: of those that reject at most ``good_lost`` of the
    labelled good documents, the middle of those that reject most labelled bad ones.

    All labelled rows count; what reaches the driver is a histogram of at most 2 * BINS rows.
    """
    bins = (
        scores.where(~base_failed()).join(_quality(labels), "doc_id")
        .groupBy(F.least(F.floor(F.col("anomaly") * BINS), F.lit(BINS - 1)).alias("bin"), "quality").count().collect()
    )
    good, bad = np.zeros(BINS), np.zeros(BINS)
    for r in bins:
        (good if r.quality else bad)[r["bin"]] += r["count"]
    if not good.sum():
        return 1.0
    lost, caught = (np.concatenate([np.cumsum(n[::-1])[::-1], [0]]) for n in (good, bad))
    best = np.flatnonzero((lost <= good_lost * good.sum()) & (caught == caught[lost <= good_lost * good.sum()].max()))
    return float(best[0] + best[-1]) / 2 / BINS


def _fitted(docs: DataFrame, labels: DataFrame, lasting) -> tuple[DataFrame, Forest | None, float]:
    """(statistics, forest, threshold). ``lasting`` cuts the lineage: the statistics are used several times."""
    stats = lasting(statistics(docs))
    forest = fit(stats, labels)
    return stats, forest, threshold(scored(stats, forest), labels)


def judge(docs: DataFrame, labels: DataFrame, lasting) -> DataFrame:
    """Per document: its counts, base_failed, anomaly, and whether it is kept."""
    stats, forest, limit = _fitted(docs, labels, lasting)
    scores, failed = scored(stats, forest), base_failed()
    return scores.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (F.col("anomaly") < limit)).alias("kept"), "anomaly")


def passing(docs: DataFrame, labels: DataFrame, lasting) -> DataFrame:
    """The rows of docs, whole, that are kept."""
    _, forest, limit = _fitted(docs, labels, lasting)

    def make():
        cache = W.WordHashes()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), batch.column("text"), pa.nulls(batch.num_rows, pa.int64())], ["doc_id", "text", "sample_key"])
            stats = _stats(rows, cache)
            n, again = (stats.column(k).to_numpy() for k in ("n_words", "n_repeat_words"))
            x = np.array(stats.column("x").flatten(), np.float32).reshape(-1, len(FEATURES))
            odd = forest.score(x) >= limit if forest is not None and len(x) else np.zeros(len(x), bool)
            return batch.filter(pa.array(~((n < 50) | (100 * again > 50 * n) | odd)))

        return step

    return W.map_batches(docs, docs.schema, make)

"""Benchmark decontamination by spaced-seed hashing (operator 7).

Words are compared in lower case and without ASCII punctuation. A seed is a fixed mask of word positions,
some of them ignored; benchmark and training windows with equal hashes at the others are hits, however
the ignored words differ. Around each hit, text and item are aligned and their words compared one by
one: a stretch counts as an overlap if at least MATCHED of its words match, and a share of AGREEMENT of
them. Of an alignment the longest stretch with that share is taken, without substitutions at its ends;
no stretch with that share has more matching words.

The benchmark's seeds go to the tasks in blocks of at most about BLOCK_WORDS words; documents are passed
over once a block, so that a task holds a bounded table however large the benchmark is. No document, hit
or item is left out: a block is a part of the benchmark, and the results of all blocks are united.

Defined results. One row per document and item that overlap, with the best overlap (ties: the first).
Null or empty text, on either side: no overlap. An item of fewer than MATCHED words must be there whole,
without substitutions; one shorter than the masks has a mask of its own length. Repeated rows: a result
each. Other columns are not read; ``clean`` keeps all columns of its input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ledgerlake.llm import words as W

#: Fixed masks: 1 is compared, 0 ignored.
MASKS = ("111011", "1101101", "11001011", "101011001")
MATCHED, AGREEMENT = 12, 0.8
#: What a substitution costs against a match of 1, so that the sums not below 0 are the stretches that agree.
SUBSTITUTION = round(AGREEMENT / (1 - AGREEMENT))
BLOCK_WORDS = 200_000

_PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_ODD = np.uint64(0x9E3779B97F4A7C15)

Hit = tuple[int, int, int, int, int]


def tokens(text: str | None) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(None, _PUNCTUATION).split() if text else []


def _hash(ids: np.ndarray, at: np.ndarray, offsets: list[int]) -> np.ndarray:
    out = np.full(len(at), len(offsets), np.uint64)
    for o in offsets:
        out = out * _ODD + ids[at + o].astype(np.uint64)
    return W.mix(out)


class Seeds:
    """Words, seeds and texts of one block of items."""

    def __init__(self, items: list[tuple[int, str | None]]) -> None:
        held = [(item, words) for item, text in items if (words := tokens(text))]
        self.items = [item for item, _ in held]
        self.vocabulary: dict[bytes, int] = {}
        self.texts = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.int64) for _, words in held]
        self.tables = []
        shortest = min(len(m) for m in MASKS)
        masks = {m: [i for i, t in enumerate(self.texts) if len(t) >= len(m)] for m in MASKS} | {"1" * n: [i for i, t in enumerate(self.texts) if len(t) == n] for n in range(1, shortest)}
        for mask, own in masks.items():
            offsets = [k for k, c in enumerate(mask) if c == "1"]
            keys, where, item = [], [], []
            for i in own:
                at = np.arange(len(self.texts[i]) - len(mask) + 1)
                keys.append(_hash(self.texts[i], at, offsets))
                where.append(at)
                item.append(np.full(len(at), i))
            if own:
                keys, where, item = np.concatenate(keys), np.concatenate(where), np.concatenate(item)
                order = np.argsort(keys, kind="stable")
                self.tables.append((len(mask), offsets, keys[order], where[order], item[order]))

    def overlaps(self, held: list[list[bytes]]) -> Iterator[tuple[int, Hit]]:
        """(index of the text, (item_id, start, end, matching, compared)) for the texts' words."""
        sizes = np.array([len(w) for w in held], np.int64)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        ids = np.fromiter((self.vocabulary.get(w, 0) for words in held for w in words), np.int64, int(offsets[-1]))
        found = []
        for span, places, keys, where, item in self.tables:
            n = len(ids) - span + 1
            if n <= 0:
                continue
            on = np.ones(n, bool)
            for o in places:
                on &= ids[o : o + n] > 0
            at = np.flatnonzero(on)
            h = _hash(ids, at, places)
            low, high = np.searchsorted(keys, h, "left"), np.searchsorted(keys, h, "right")
            hit = high > low
            at, low, count = at[hit], low[hit], (high - low)[hit]
            entry = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum()) if len(at) else low
            found.append(np.stack([np.repeat(at, count) - where[entry], item[entry], np.repeat(at, count)], axis=1))
        if not found:
            return
        hits = np.concatenate(found)
        text = np.searchsorted(offsets, hits[:, 2], "right") - 1
        lines = np.unique(np.stack([text, hits[:, 1], hits[:, 0]], axis=1), axis=0)
        best: dict[tuple[int, int], Hit] = {}
        for t, i, start in lines.tolist():
            got = self._overlap(ids, int(offsets[t]), int(offsets[t + 1]), start, i)
            if got and (best.get((t, i)) is None or got[3] > best[t, i][3]):
                best[t, i] = got
        for (t, _), got in sorted(best.items()):
            yield t, got

    def _overlap(self, ids: np.ndarray, first: int, last: int, start: int, i: int) -> Hit | None:
        """The longest stretch that agrees, of the text ids[first:last] with item i, whose first word aligns with position start."""
        item = self.texts[i]
        low, high = max(0, first - start), min(len(item), last - start)
        same = ids[start + low : start + high] == item[low:high]
        if len(item) < MATCHED:
            return (self.items[i], start - first, start - first + len(item), len(item), len(item)) if len(same) == len(item) and same.all() else None
        if np.count_nonzero(same) < MATCHED:
            return None
        score = np.concatenate([[0], np.cumsum(np.where(same, 1, -SUBSTITUTION))])
        floor = np.minimum.accumulate(score)
        begins = np.searchsorted(-floor, -score, "left")
        end = int(np.argmax(np.arange(len(score)) - begins))
        begin = int(begins[end])
        matches = np.flatnonzero(same[begin:end])
        matching = len(matches)
        if matching < MATCHED:
            return None
        begin, end = begin + int(matches[0]), begin + int(matches[-1]) + 1
        compared = end - begin
        return self.items[i], start + low + begin - first, start + low + end - first, matching, compared


def blocks(benchmark: DataFrame) -> Iterator[list[Row]]:
    """The items in blocks of about BLOCK_WORDS words, as (item_id, text)."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    words = items.select(F.sum(F.size(F.split("text", r"\s+"))).alias("n")).first().n or 0
    n = -(-words // BLOCK_WORDS)
    for k in range(n):
        yield items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, list[list[bytes]]]]:
    first, held, n = 0, [], 0
    texts = batch.column("text").to_pylist()
    for i, text in enumerate(texts):
        held.append(tokens(text))
        n += len(held[-1])
        if n >= W.BATCH_WORDS or i == len(texts) - 1:
            yield first, held
            first, held, n = i + 1, [], 0


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start_word, end_word, n_matching, n_compared) of documents and items that overlap."""
    schema = "doc_id long, item_id long, start_word long, end_word long, n_matching long, n_compared long"
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = None
    for block in blocks(benchmark):
        one = W.map_batches(rows, schema, _finder([(r.item_id, r.text) for r in block]))
        out = one if out is None else out.union(one)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def _finder(items: list[tuple[int, str]]) -> Callable:
    def make():
        seeds = Seeds(items)

        def step(batch: pa.RecordBatch):
            ids = batch.column("doc_id").to_pylist()
            for first, held in _texts(batch):
                found = [(ids[first + t], *hit) for t, hit in seeds.overlaps(held)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["doc_id", "item_id", "start_word", "end_word", "n_matching", "n_compared"])

        return step

    return make


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, whole, whose text overlaps no item."""
    out = docs
    for block in blocks(benchmark):
        out = W.map_batches(out, docs.schema, _sieve([(r.item_id, r.text) for r in block]))
    return out


def _sieve(items: list[tuple[int, str]]) -> Callable:
    def make():
        seeds = Seeds(items)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            keep = np.ones(batch.num_rows, bool)
            for first, held in _texts(batch):
                for t, _ in seeds.overlaps(held):
                    keep[first + t] = False
            return batch.filter(pa.array(keep))

        return step

    return make

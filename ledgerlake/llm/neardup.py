"""Near-duplicate classes by BagMinHash (operator 1).

A text is the multiset of its five-word shingles. BagMinHash draws, for every shingle and every dyadic
block of its multiplicity, one Poisson process that is the same in all texts; a process's points are
split among the block's halves down to single units, so a text sees those up to its own multiplicity.
The earliest point of each of M marks is the signature: two texts agree in a mark with the probability
of their weighted Jaccard similarity. Late points are cut off by a bound on the signature's maximum, so
most shingles cost one draw.

Signatures are banded. Texts that share a band are compared exactly: all pairs of small buckets; in
larger ones every text with the bucket's most copied one. Large buckets that still hold several classes after
that go through a prefix filter (rarest shingles first), of which only pairs of different classes remain.
Verified links are joined to classes. Exact copies are one text from the start.

Missing a pair at the least similarity 0.8 takes all but one of the BANDS bands to differ, which happens
with a probability below 1e-4 (below 1e-9 at 0.9); the prefix filter loses no pair.

Defined results. One row per input row. Null doc_id, or a text without words (null, empty, white space):
a class of its own, with class_id = doc_id, class_size = 1 and n_links = 0. Texts of 1 to 4 words have one shingle, all
their words. Repeated rows and ties: the class id is the least doc_id. Columns but doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.llm import words as W
from ledgerlake.llm.components import components

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 20, 3
#: Bands that two texts of small buckets share at least.
SHARED = 2
MARKS = BANDS * ROWS
#: Texts of a bucket, or of a prefix shingle's list, up to which all its pairs are compared.
SMALL = 12
#: Earlier elements that a prefix's element is kept with: texts that share one of them have met there.
EARLIER = 4
#: Texts, and shingles of each, from which common shingles are told; that orders the prefix filter, and never decides.
COMMON_TEXTS, COMMON_SHINGLES = 256, 2048

_STEP = np.uint64(0xD1342543DE82EF95)
_STEP_INT = int(_STEP)
_BLOCK = np.uint64(0xA0761D6478BD642F)

Lasting = Callable[[DataFrame], DataFrame]


def shingles(hashes: np.ndarray, offsets: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, multiplicity) of the distinct shingles of each text, by text."""
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    at = np.flatnonzero(W.starts_within(offsets, n))
    texts, keys = owner[at], W.grams(hashes, n)[at]
    sizes = np.diff(offsets)
    short = np.flatnonzero((sizes > 0) & (sizes < n))
    if len(short):
        whole = [W.grams(hashes[offsets[i] : offsets[i + 1]], int(sizes[i]))[0] for i in short]
        texts, keys = np.concatenate([texts, short]), np.concatenate([keys, np.array(whole, np.uint64)])
    if not len(keys):
        return texts.astype(np.int64), keys, np.zeros(0, np.int64)
    order = np.lexsort((keys, texts))
    texts, keys = texts[order], keys[order]
    new = np.concatenate([[True], (texts[1:] != texts[:-1]) | (keys[1:] != keys[:-1])])
    starts = np.flatnonzero(new)
    return texts[starts], keys[starts], np.diff(np.append(starts, len(keys)))


def bagminhash(texts: np.ndarray, keys: np.ndarray, weights: np.ndarray, n_texts: int, marks: int = MARKS) -> np.ndarray:
    """Signatures (n_texts, marks) as floats: the time of the earliest point of each mark; inf for an empty text."""
    out = np.full(n_texts * marks, np.inf)
    if not len(keys):
        return out.reshape(n_texts, marks)
    total = np.bincount(texts, weights=weights, minlength=n_texts)
    levels = np.ceil(np.log2(np.maximum(weights, 1))).astype(np.int64)
    streams = [np.flatnonzero(levels >= j) for j in range(int(levels.max()) + 1)]
    block = np.concatenate([np.full(len(s), j) for j, s in enumerate(streams)])
    of = np.concatenate(streams)
    width = np.where(block == 0, 1.0, np.exp2(block - 1))
    lowest = np.where(block == 0, 0.0, width)
    state = W.mix(keys[of] ^ (block.astype(np.uint64) * _BLOCK))
    own, covered = texts[of], weights[of]
    limit = np.where(total > 0, marks / np.maximum(total, 1) * (np.log(marks) + 6), 0.0)
    todo = np.ones(n_texts, bool)
    while todo.any():
        live = np.flatnonzero(todo[own])
        time, drawn = np.zeros(len(live)), 0
        while len(live):
            drawn = (drawn + _STEP_INT) % 2**64
            draw = W.mix(state[live] + np.uint64(drawn))
            time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / width[live]
            on = time <= limit[own[live]]
            live, time, draw = live[on], time[on], draw[on]
            place = W.mix(draw)
            unit = lowest[live] + np.floor((place >> np.uint64(40)).astype(np.float64) * 2.0**-24 * width[live])
            seen = unit < covered[live]
            mark = ((place & np.uint64(0xFFFFFFFF)) * np.uint64(marks)) >> np.uint64(32)
            np.minimum.at(out, own[live][seen] * marks + mark[seen].astype(np.int64), time[seen])
        unfilled = np.isinf(out.reshape(n_texts, marks)).any(axis=1) & (total > 0)
        limit = np.where(unfilled, limit * 2, limit)
        todo = unfilled
    return out.reshape(n_texts, marks)


def bands(signatures: np.ndarray, n: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key per band."""
    bits = signatures.view(np.uint64).reshape(len(signatures), n, rows)
    key = np.broadcast_to(W.mix(np.arange(1, n + 1, dtype=np.uint64)), bits.shape[:2]).copy()
    for r in range(rows):
        key = W.mix(key * _STEP + bits[:, :, r])
    return key


def multiset(text: bytes, cache: W.WordHashes) -> tuple[np.ndarray, np.ndarray]:
    words = text.split()
    _, keys, counts = shingles(cache.of(words), np.array([0, len(words)]))
    return keys, counts


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets given as sorted keys and counts."""
    if len(a[0]) > len(b[0]):
        a, b = b, a
    at = np.minimum(np.searchsorted(b[0], a[0]), max(0, len(b[0]) - 1))
    if not len(a[0]) or not len(b[0]):
        return 0.0
    common = np.minimum(a[1], b[1][at])[b[0][at] == a[0]].sum()
    return common / (a[1].sum() + b[1].sum() - common)


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, fp (of the exact text; null if it has no words or no doc_id) and band keys of every row."""

    def make():
        cache = W.WordHashes()

        def step(batch: pa.RecordBatch):
            texts = W.text_bytes(batch.column("text"))
            for first, held in W.batches(texts):
                hashes, offsets = W.flat(held, cache)
                keys = bands(bagminhash(*shingles(hashes, offsets), len(held)))
                full = np.diff(offsets) > 0
                part = batch.slice(first, len(held))
                known = [x if ok else None for x, ok in zip(part.column("fp").to_pylist(), full, strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(held) + 1) * BANDS, pa.int32()), pa.array(keys.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(known, pa.binary()), lists], ["doc_id", "fp", "bands"])

        return step

    return W.map_batches(_rows(docs), "doc_id long, fp binary, bands array<long>", make)


def _rows(docs: DataFrame) -> DataFrame:
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return docs.select(doc_id.alias("doc_id"), text.alias("text"), F.when(doc_id.isNotNull(), F.unhex(F.md5(text.cast("binary")))).alias("fp"))


def with_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(fp, text) for wanted(fp, doc_id): the rows with that doc_id and text."""
    rows = _rows(docs).where("fp is not null")
    return rows.join(wanted, ["doc_id", "fp"]).dropDuplicates(["doc_id", "fp"]).select("fp", "text")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs(a, b) whose texts are similar."""
    left = texts.select(F.col("fp").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("fp").alias("b"), F.col("text").alias("text_b"))
    # In a star, a is its centre: its text is joined last, so that no shuffle carries it once a member.
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b")

    def make():
        cache, kept = W.WordHashes(), {}

        def known(fp: bytes, text: bytes):
            if fp not in kept:
                if len(kept) > 64:
                    kept.clear()
                kept[fp] = multiset(text, cache)
            return kept[fp]

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            ta, tb = W.text_bytes(batch.column("text_a")), W.text_bytes(batch.column("text_b"))
            similar = [overlap(known(b[i], tb[i]), known(a[i], ta[i])) >= SIMILAR for i in range(len(a))]
            return pa.RecordBatch.from_arrays([pa.array([x for x, s in zip(k, similar, strict=True) if s], pa.binary()) for k in (a, b)], ["a", "b"])

        return step

    return W.map_batches(both, "a binary, b binary", make)


def _all_pairs(lists: str) -> Column:
    """Every pair a < b of a short sorted list."""
    return F.flatten(F.transform(lists, lambda x, i: F.transform(F.slice(lists, i + 2, F.size(lists)), lambda y: F.struct(x.alias("a"), y.alias("b")))))


def candidates(buckets: DataFrame) -> DataFrame:
    """Pairs to compare: (a, b), distinct. Texts of small buckets must share SHARED bands; those of large ones meet the bucket's first."""
    small = buckets.where(F.col("n") <= SMALL).groupBy("key").agg(F.array_sort(F.collect_set("fp")).alias("fps"))
    pairs = small.select(F.explode(_all_pairs("fps")).alias("x")).groupBy("x.a", "x.b").count().where(F.col("count") >= SHARED).select("a", "b")
    large = buckets.where(F.col("n") > SMALL)
    first = large.groupBy("key").agg(F.max_by("fp", F.struct("copies", "fp")).alias("first"))
    stars = large.join(first, "key").where(F.col("fp") != F.col("first")).select(F.col("first").alias("a"), F.col("fp").alias("b")).distinct()
    return pairs.union(stars).distinct()


def _prefixes(texts: DataFrame, common: dict[int, int]) -> DataFrame:
    """(fp, size, at, keys): the rarest elements of each text and their places, among which any similar text must share one.

    An element is a shingle with its how-manieth occurrence, so that sets of elements overlap as multisets do.
    Of sets of size n, those that share 80 % of their union lack at most n / 5 of it, so a shared element is
    among the first n / 5 + 1, and the m-th one they share is m places later at most, in either.
    """
    ranked = np.array(sorted(common), np.uint64)
    weight = np.array([common[k] for k in sorted(common)], np.int64)

    def make():
        cache = W.WordHashes()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            keys, places, sizes = [], [], []
            for text in W.text_bytes(batch.column("text")):
                each = _elements(*multiset(text, cache))
                n = len(each)
                rank = np.zeros(n, np.int64)
                if len(ranked):
                    at = np.minimum(np.searchsorted(ranked, each), len(ranked) - 1)
                    rank = np.where(ranked[at] == each, weight[at], 0)
                order = np.lexsort((each, rank))[: n // 5 + 1]
                keys.append(each[order].view(np.int64))
                places.append(np.arange(len(order)))
                sizes.append(n)
            return pa.RecordBatch.from_arrays([batch.column("fp"), pa.array(sizes, pa.int64()), pa.array(places, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64()))], ["fp", "size", "at", "keys"])

        return step

    return W.map_batches(texts.select("fp", "text"), "fp binary, size long, at array<long>, keys array<long>", make)


def _elements(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    which = np.concatenate([np.arange(c) for c in counts]) if len(counts) and counts.max() > 1 else np.zeros(len(keys), np.int64)
    return W.mix(np.repeat(keys, counts) + which.astype(np.uint64) * _BLOCK)


def _common(texts: DataFrame) -> dict[int, int]:
    """Elements that several of a bounded sample of texts share, with how many do."""
    cache, seen = W.WordHashes(), {}
    for r in texts.select("fp", F.substring("text", 1, 8 * COMMON_SHINGLES).alias("text")).orderBy(F.xxhash64("fp")).limit(COMMON_TEXTS).collect():
        for k in _elements(*multiset(r.text.encode(), cache))[:COMMON_SHINGLES].tolist():
            seen[k] = seen.get(k, 0) + 1
    return {k: n for k, n in seen.items() if n > 1}


def _listed(places: str, keys: str) -> Column:
    """The elements of a prefix with their places and the few elements before each."""
    return F.transform(keys, lambda k, i: F.struct(k.alias("k"), F.get(places, i).alias("at"), F.slice(keys, F.greatest(i - EARLIER, F.lit(0)) + 1, F.least(i, F.lit(EARLIER))).alias("before")))


def _crossing(buckets: DataFrame, parts: DataFrame, docs: DataFrame, distinct: DataFrame, lasting: Lasting) -> DataFrame | None:
    """Pairs of different classes that large buckets may still hide, with their classes; None if every large bucket is one class."""
    large = buckets.where(F.col("n") > SMALL).select("key", "fp").join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("part", F.coalesce("part", "fp"))
    mixed = large.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").select("key")
    family = lasting(large.join(mixed, "key").select("fp", "part").distinct())
    if family.isEmpty():
        return None
    texts = lasting(with_texts(docs, family.join(distinct, "fp").select("fp", "doc_id")))
    listed = lasting(_prefixes(texts, _common(texts)).join(family, "fp").select("fp", "part", "size", F.explode(_listed("at", "keys")).alias("x")).select("fp", "part", "size", "x.*"))
    several = listed.groupBy("k").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").select("k")
    listed = lasting(listed.join(several, "k"))
    main = listed.groupBy("k", "part").count().groupBy("k").agg(F.max_by("part", F.struct("count", "part")).alias("main"))
    one = listed.join(main, "k").where(F.col("part") != F.col("main")).select("k", *[F.col(c).alias(f"{c}_a") for c in ("fp", "part", "size", "at", "before")])
    other = listed.select("k", *[F.col(c).alias(f"{c}_b") for c in ("fp", "part", "size", "at", "before")])
    least = F.ceil(SIMILAR / (1 + SIMILAR) * (F.col("size_a") + F.col("size_b")) - 1e-6)
    least_size = F.least("size_a", "size_b")
    near = (least_size >= SIMILAR * F.greatest("size_a", "size_b")) & (F.col("at_a") <= F.col("size_a") - least) & (F.col("at_b") <= F.col("size_b") - least)
    met = one.join(other, "k").where((F.col("part_a") != F.col("part_b")) & near & ~F.arrays_overlap("before_a", "before_b"))
    swap = F.col("fp_a") > F.col("fp_b")
    ends = [F.when(swap, F.col(f"{c}_{y}")).otherwise(F.col(f"{c}_{x}")).alias(k) for c, x, y, k in (("fp", "a", "b", "a"), ("fp", "b", "a", "b"), ("part", "a", "b", "part_a"), ("part", "b", "a", "part_b"))]
    return met.select(*ends).distinct()


def classes(docs: DataFrame, lasting: Lasting) -> DataFrame:
    """Per row: doc_id, class_id (the least doc_id among its near duplicates), class_size (rows of the class), n_links
    (different texts with which its text was compared and found similar; they tie the class together)."""
    rows = lasting(signed(docs))
    distinct = lasting(rows.where("fp is not null").groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("bands").alias("bands")))
    keys = distinct.select("fp", "copies", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    buckets = lasting(keys.join(shared, "key"))
    known = distinct.select("fp", "doc_id")

    def texts_of(pairs: DataFrame) -> DataFrame:
        return with_texts(docs, pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct().join(known, "fp"))

    pairs = lasting(candidates(buckets))
    links = lasting(verified(pairs, texts_of(pairs)))
    parts = components(links, lasting)
    rest = _crossing(buckets, parts, docs, known, lasting)
    if rest is not None:
        rest = lasting(rest)
        # The classes are the nodes now: their links are far fewer than the texts'.
        crossing = lasting(verified(rest.select("a", "b"), texts_of(rest)))
        links = links.union(crossing)
        between = crossing.join(rest, ["a", "b"]).select(F.col("part_a").alias("a"), F.col("part_b").alias("b")).distinct()
        merged = components(between, lasting).select(F.col("node").alias("part"), F.col("part").alias("whole"))
        alone = merged.select(F.col("part").alias("node"), "part")
        parts = parts.union(alone).distinct().join(merged, "part", "left").select("node", F.coalesce("whole", "part").alias("part"))
    named = distinct.select("fp", "doc_id", "copies").join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("part", F.coalesce("part", "fp"))
    whole = named.groupBy("part").agg(F.min("doc_id").alias("class_id"), F.sum("copies").alias("class_size"))
    degrees = links.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count("*").alias("n_links"))
    by_text = named.select("fp", "part").join(whole, "part").join(degrees, "fp", "left").select("fp", "class_id", "class_size", "n_links")
    out = rows.select("doc_id", "fp").join(by_text, "fp", "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def one_of_each(docs: DataFrame, lasting: Lasting) -> DataFrame:
    """docs with one row of each class, that of the least doc_id; repeated rows of it count as one."""
    first = classes(docs, lasting).where(F.col("doc_id").isNull() | (F.col("doc_id") == F.col("class_id"))).select("doc_id").where("doc_id is not null").distinct()
    kept = docs.join(first, "doc_id", "left_semi")
    again = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    names = docs.columns
    hidden = "_row_of_doc"
    while hidden in names:
        hidden += "_"
    kept = kept.withColumn(hidden, F.row_number().over(again)).where(F.col(hidden) == 1).drop(hidden)
    return kept.select(*names).unionByName(docs.where("doc_id is null"))

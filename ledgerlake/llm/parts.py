"""Documents in parts, and questions that parts ask each other through arrays of sorted keys.

A part is a bounded set of documents (by hash of doc_id) that one task handles. Each part sends the
sorted distinct keys of its documents, cut into buckets by key; a bucket sees every part's keys and
answers each part. A hot key is thus one entry a part and bucket, however often it occurs, and what
is shuffled is a few bytes a key. Every step names the same exchange of the documents, so that Spark
shuffles their texts once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAIL = "to long, of long, keys binary, more binary"


def n_parts(df: DataFrame) -> int:
    """One part a shuffle partition, whose number is set so that a partition fits a task's memory."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def in_parts(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, text, part); rows without a doc_id are spread by their text."""
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return docs.select(doc_id.alias("doc_id"), text.alias("text"), F.pmod(F.xxhash64(doc_id, F.when(doc_id.isNull(), text)), F.lit(n)).alias("part"))


def each_part(parts: DataFrame, ask: Callable[[int, pa.Table], pa.Table], schema: str) -> DataFrame:
    def run(key: tuple, docs: pa.Table) -> pa.Table:
        return ask(key[0].as_py(), docs)

    return parts.groupBy("part").applyInArrow(run, schema)


def each_bucket(mail: DataFrame, answer: Callable[[int, pa.Table], pa.Table], schema: str = MAIL) -> DataFrame:
    """``answer`` gets all mail to one bucket."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        return answer(key[0].as_py(), rows)

    return mail.groupBy("to").applyInArrow(run, schema)


def with_mail(parts: DataFrame, mail: DataFrame, step: Callable[[int, pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``step`` gets a part's documents and all mail to the part; parts without documents get none."""

    def run(key: tuple, docs: pa.Table, rows: pa.Table) -> pa.Table:
        return step(key[0].as_py(), docs, rows)

    return parts.groupBy("part").cogroup(mail.groupBy("to")).applyInArrow(run, schema)


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    """Buckets 0 to n - 1 in the order of the keys."""
    return ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def squeeze(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, in as many bytes each as the largest takes, less the low bits that are 0 in all."""
    if not len(keys):
        return b""
    used = int(np.bitwise_or.reduce(keys))
    shift = (used & -used).bit_length() - 1 if used else 0
    keys = keys >> np.uint64(shift)
    steps = np.diff(keys)
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    return bytes([width, shift]) + keys[:1].tobytes() + np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unsqueeze(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    width, shift = data[0], data[1]
    steps = np.zeros((1 + (len(data) - 10) // width, 8), np.uint8)
    steps[0] = np.frombuffer(data, np.uint8, 8, 2)
    steps[1:, :width] = np.frombuffer(data, np.uint8, -1, 10).reshape(-1, width)
    return np.cumsum(steps.view(np.uint64).ravel(), dtype=np.uint64) << np.uint64(shift)


def short(counts: np.ndarray) -> bytes:
    """Counts that are mostly small: a byte each, and eight more for one of 255 or above."""
    small = np.minimum(counts, 255).astype(np.uint8)
    return small.tobytes() + counts[small == 255].astype(np.uint64).tobytes()


def unshort(data: bytes, n: int, offset: int = 0) -> tuple[np.ndarray, int]:
    """n counts from an offset on, and the bytes that they take."""
    out = np.frombuffer(data, np.uint8, n, offset).astype(np.uint64)
    large = np.flatnonzero(out == 255)
    out[large] = np.frombuffer(data, np.uint8, 8 * len(large), offset + n).view(np.uint64)
    return out, n + 8 * len(large)


def send(part: int, n: int, keys: np.ndarray, *more: np.ndarray, first: int = 0) -> pa.Table:
    """Mail from a part: its sorted keys, by bucket (numbered from ``first``), and arrays of the same length that go with them."""
    buckets = bucket_of(keys, n)
    cuts = np.flatnonzero(np.diff(buckets)) + 1
    starts, ends = np.concatenate([[0], cuts]).astype(int), np.append(cuts, len(keys)).astype(int)
    rows = [(first + int(buckets[a]), part, squeeze(keys[a:b]), pack(*(x[a:b] for x in more))) for a, b in zip(starts, ends, strict=True) if b > a]
    return table(rows)


def table(rows: Iterable[tuple[int, int, bytes, bytes]]) -> pa.Table:
    to, of, keys, more = zip(*rows, strict=True) if (rows := list(rows)) else ((), (), (), ())
    return pa.table({"to": pa.array(to, pa.int64()), "of": pa.array(of, pa.int64()), "keys": pa.array(keys, pa.binary()), "more": pa.array(more, pa.binary())})


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays one after the other; unsigned 64-bit ones hold counts."""
    return b"".join(short(x) if x.dtype == np.uint64 else np.ascontiguousarray(x).tobytes() for x in arrays)


def received(rows: pa.Table, *kinds: type) -> tuple[np.ndarray, ...]:
    """(sender, key, more...) of all mail, flat, in the order of the rows."""
    of, keys, more = rows["of"].to_numpy(), rows["keys"].to_pylist(), rows["more"].to_pylist()
    parsed = [unsqueeze(k) for k in keys]
    sizes = np.array([len(k) for k in parsed], np.int64)
    out = [np.repeat(of, sizes), np.concatenate(parsed) if parsed else np.zeros(0, np.uint64)]
    columns: list[list[np.ndarray]] = [[] for _ in kinds]
    for m, n in zip(more, sizes.tolist(), strict=True):
        offset = 0
        for kind, column in zip(kinds, columns, strict=True):
            if kind is np.uint64:
                values, width = unshort(m, n, offset)
            else:
                values, width = np.frombuffer(m, kind, n, offset), n * np.dtype(kind).itemsize
            column.append(values)
            offset += width
    return (*out, *(np.concatenate(c) if c else np.zeros(0, kind) for c, kind in zip(columns, kinds, strict=True)))


def member(keys: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Which keys are among the sorted held ones."""
    if not len(held):
        return np.zeros(len(keys), bool)
    return held[np.minimum(np.searchsorted(held, keys), len(held) - 1)] == keys

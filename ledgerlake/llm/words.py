"""Words, word hashes and hashed word windows of whole texts, over flat numpy arrays.

A word is a maximal run of characters other than space and the controls 9 to 13, which is what
``bytes.split()`` yields on UTF-8. A batch of texts becomes one array of word hashes and one array
of offsets, so that windows of every text in a batch are hashed together.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Distinct words whose hash a Python worker remembers; it starts afresh beyond that.
CACHED_WORDS = 400_000
#: Words handled at once; a longer text makes a batch of its own.
BATCH_WORDS = 400_000

_ODD = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)


class WordHashes(dict):
    """64-bit hashes by word; a missing word is hashed and remembered."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > CACHED_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive words; windows across texts are the caller's to drop."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = hashes[: len(hashes) - n + 1].copy()
    for k in range(1, n):
        out *= _ODD
        out += hashes[k : len(hashes) - n + 1 + k]
    return mix(out)


def starts_within(offsets: np.ndarray, n: int) -> np.ndarray:
    """For each window of n words over the flat array: does it lie in one text?"""
    total = int(offsets[-1])
    inside = np.ones(max(0, total - n + 1), bool)
    for k in range(1, n):
        cut = offsets[1:-1] - k
        cut = cut[(cut >= 0) & (cut < len(inside))]
        inside[cut] = False
    return inside


def text_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def batches(texts: list[bytes | None], most: int = BATCH_WORDS) -> Iterator[tuple[int, list[list[bytes]]]]:
    """(index of the first text, words of each text) for consecutive texts of about ``most`` words."""
    first, held, n = 0, [], 0
    for i, text in enumerate(texts):
        words = text.split() if text else []
        held.append(words)
        n += len(words)
        if n >= most:
            yield first, held
            first, held, n = i + 1, [], 0
    if held:
        yield first, held


def flat(held: list[list[bytes]], cache: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of several texts in one array, and the offsets of the texts in it."""
    offsets = np.zeros(len(held) + 1, np.int64)
    np.cumsum([len(w) for w in held], out=offsets[1:])
    return cache.of([w for words in held for w in words]), offsets


_kept: dict = {}


def kept(key: tuple, build: Callable[[], object]) -> object:
    """What a Python worker keeps from task to task, such as a vocabulary; one thing at a time, and gone once another operator runs."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = build()
    return _kept[key]


def forget() -> None:
    _kept.clear()


def release() -> None:
    """Gives a finished task's memory back, which a Python worker would else hold while other operators run in others."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def map_batches(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | Iterable[pa.RecordBatch] | None]], keeps: bool = False) -> DataFrame:
    """``mapInArrow`` with state: ``make`` runs once a task and returns the function of a batch.

    That function returns a batch, several, or None. keeps: it uses what ``kept`` holds from earlier tasks.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            forget()
        step = make()
        for batch in it:
            out = step(batch)
            if isinstance(out, pa.RecordBatch):
                yield out
            elif out is not None:
                yield from out
        step = batch = out = None
        release()

    return df.mapInArrow(run, schema)


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the decimal doc_id modulo n; null where doc_id is null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n

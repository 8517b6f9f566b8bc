"""Byte-level BPE encoding and decoding with DuckDB recursive queries (operator 2).

Every task holds a DuckDB connection with the merge table: a row for each pair of tokens whose bytes
together are a token, with that token's rank (which is its id). Distinct pieces of text start as one
token a byte. A recursive query joins each piece's token positions to the merge table and contracts the
leftmost pair of least rank, until no pair is left. An ordered aggregation over the vocabulary decodes.
Pieces are encoded once a batch and remembered by the word they occur in.

Quadratic growth bounds the recursion to pieces of LONGEST bytes; a longer one (a run of thousands of
letters without a space) goes through ``merged_long``, which makes the same contractions with a heap.

Defined results. Null text: as an empty one, no tokens. Repeated rows and doc_ids: one result a row. No
rows: no rows. Special tokens' strings are ordinary text. Columns but doc_id and text are not read.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterable, Iterator

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake.llm import words as W

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Bytes of a piece that the recursive query takes; squared bytes of all pieces of one query.
LONGEST, QUERY_WORK = 256, 8_000_000
#: Words that a Python worker remembers (twice as many at most), and characters of text that it encodes at once.
CACHED, BATCH_CHARS = 300_000, 6_000_000

#: White space that the short cut by words does not handle: runs, ends of text, anything but space and newline.
_UNUSUAL = re.compile(r"\s(?:\s|\Z)|[^\S \n]|\A\s")
#: Marks the word that begins a text; a word that begins a later line has its newline before it.
_START = "\x00"


def _usual(text: str) -> bool:
    """Single spaces and newlines only, between words: each word, with the white space before it, is then split by itself."""
    if text.replace("\n", "").isprintable():
        return text[:1] not in " \n" and text[-1:] not in " \n" and not ("  " in text or "\n\n" in text or " \n" in text or "\n " in text)
    return not _UNUSUAL.search(text) and _START not in text

_ENCODE = """
with recursive step(w, toks) as (
    select w, toks from pieces
    union all
    select s.w, list_concat(list_concat(toks[: best % 65536 - 1], [(best // 65536)::int]), toks[best % 65536 + 2 :])
    from step s
    join (
        select w, min(rank * 65536 + p) as best
        from (select w, unnest(toks[:-2]) as l, unnest(toks[2:]) as r, unnest(range(1, len(toks))) as p from step)
        join merges on pair = l::bigint * 1048576 + r
        group by w
    ) b on s.w = b.w
)
select w, arg_min(toks, len(toks)) as toks from step group by w order by w
"""
_DECODE = """
select w, string_agg(hex, '' order by p) as hex
from (select w, unnest(toks) as id, generate_subscripts(toks, 1) as p from coded)
join vocabulary using (id)
group by w order by w
"""


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merged_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same contractions for one long piece, in n log n: a heap of (rank, position) over linked tokens."""
    n = len(piece)
    end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n
    heap: list[tuple[int, int, int, int]] = []

    def offer(a: int) -> None:
        b = after[a]
        if b < n and (rank := ranks.get(piece[a : end[b]])) is not None:
            heapq.heappush(heap, (rank, a, end[a], end[b]))

    for a in range(n - 1):
        offer(a)
    while heap:
        _, a, mid, stop = heapq.heappop(heap)
        b = after[a]
        if not alive[a] or end[a] != mid or b >= n or end[b] != stop:
            continue
        alive[b], end[a], after[a] = False, stop, after[b]
        if after[b] < n:
            before[after[b]] = a
        offer(a)
        if before[a] >= 0:
            offer(before[a])
    return [ranks[piece[a : end[a]]] for a in range(n) if alive[a]]


class Coder:
    """DuckDB tables of one vocabulary, and what its words came to."""

    def __init__(self, path: str, pattern: str) -> None:
        self.ranks = ranks_of(path)
        self.pattern = regex.compile(pattern)
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB"})
        pairs = [(a * 1048576 + b, rank) for token, rank in self.ranks.items() for i in range(1, len(token)) if (a := self.ranks.get(token[:i])) is not None and (b := self.ranks.get(token[i:])) is not None]
        self._table("merges", pair=pa.array([x[0] for x in pairs], pa.int64()), rank=pa.array([x[1] for x in pairs], pa.int64()))
        self._table("vocabulary", id=pa.array(self.ranks.values(), pa.int32()), hex=pa.array([k.hex() for k in self.ranks], pa.string()))
        #: By word: ids joined by a space, and the bytes decoded from them.
        self.ids: dict[str, str] = {}
        self.bytes: dict[str, bytes] = {}
        self.old_ids, self.old_bytes = {}, {}
        self.ends = {c: (str(self.ranks[c.encode()]), c.encode()) for c in ",."}

    def _table(self, name: str, **columns: pa.Array) -> None:
        self.db.register("given", pa.table(columns))
        self.db.execute(f"create table {name} as select * from given")
        self.db.unregister("given")

    def _ask(self, sql: str, name: str, toks: pa.Array) -> pa.Table:
        """The answer to sql, which reads ``toks``, numbered, under that name."""
        self.db.register(name, pa.table({"w": pa.array(np.arange(len(toks), dtype=np.int32)), "toks": toks}))
        got = self.db.sql(sql).to_arrow_table()
        self.db.unregister(name)
        return got

    def _decoded(self, toks: pa.Array) -> list[tuple[str, bytes]]:
        """(ids, bytes) of each list of ids, none of them empty."""
        ids = self._ask("select array_to_string(toks, ' ') as ids from coded order by w", "coded", toks)["ids"]
        return [(i, bytes.fromhex(x)) for i, x in zip(ids.to_pylist(), self._ask(_DECODE, "coded", toks)["hex"].to_pylist(), strict=True)]

    def encode_pieces(self, pieces: list[bytes]) -> list[tuple[str, bytes]]:
        """Token ids (decimal, joined by a space) of each piece, not empty, and the bytes decoded from them."""
        out: list[tuple[str, bytes]] = [("", b"")] * len(pieces)
        long = [i for i, piece in enumerate(pieces) if len(piece) > LONGEST]
        for i, got in zip(long, self.decode([merged_long(pieces[i], self.ranks) for i in long]), strict=True):
            out[i] = got
        short = sorted((i for i, piece in enumerate(pieces) if len(piece) <= LONGEST), key=lambda i: len(pieces[i]))
        sizes = np.array([len(pieces[i]) for i in short], np.int64)
        query = np.cumsum(sizes**2) // QUERY_WORK
        for k in np.unique(query):
            here = np.flatnonzero(query == k)
            own = short[here[0] : here[-1] + 1]
            offsets = np.concatenate([[0], np.cumsum(sizes[here])]).astype(np.int32)
            toks = self.byte[np.frombuffer(b"".join([pieces[i] for i in own]), np.uint8)]
            coded = self._ask(_ENCODE, "pieces", pa.ListArray.from_arrays(pa.array(offsets), pa.array(toks)))["toks"].combine_chunks()
            for i, got in zip(own, self._decoded(coded), strict=True):
                out[i] = got
        return out

    def decode(self, coded: list[list[int]]) -> list[tuple[str, bytes]]:
        """(ids, bytes) of each list of token ids, by ordered aggregation; ("", b"") for an empty one."""
        full = [x for x in coded if x]
        got = iter(self._decoded(pa.array(full, pa.list_(pa.int32()))) if full else [])
        return [next(got) if x else ("", b"") for x in coded]

    def _learn(self, strings: list[str]) -> list[tuple[str, bytes]]:
        """ids and decoded bytes of each string, whose pieces are encoded together."""
        split = [[s] if s[1:].isalpha() and (s[0] == " " or s[0].isalpha()) else self.pattern.findall(s) for s in strings]
        distinct = {p: i for i, p in enumerate(dict.fromkeys(p for pieces in split for p in pieces))}
        coded = self.encode_pieces([p.encode() for p in distinct])
        return [coded[distinct[pieces[0]]] if len(pieces) == 1 else (" ".join([coded[distinct[p]][0] for p in pieces]), b"".join([coded[distinct[p]][1] for p in pieces])) for pieces in split]

    def _know(self, words: set[str]) -> None:
        """Learns words, given as in a text: after a space unless marked. A letter followed by a comma or full stop ends a piece, so such a word adds to the one without."""
        missing = words - self.ids.keys()
        for w in missing & self.old_ids.keys():
            self.ids[w], self.bytes[w] = self.old_ids[w], self.old_bytes[w]
        missing -= self.ids.keys()
        ends = [w for w in missing if w[-1] in self.ends and w[-2:-1].isalpha()]
        rest = list((missing.difference(ends) | {w[:-1] for w in ends}) - self.ids.keys())
        for w, (ids, text) in zip(rest, self._learn([w[1:] if w[0] == _START else w if w[0] == "\n" else " " + w for w in rest]), strict=True):
            self.ids[w], self.bytes[w] = ids, text
        for w in ends:
            mark, sign = self.ends[w[-1]]
            self.ids[w], self.bytes[w] = f"{self.ids[w[:-1]]} {mark}", self.bytes[w[:-1]] + sign

    def encode(self, texts: list[str]) -> list[tuple[str, bytes]]:
        """(ids joined by a space, decoded bytes) of each text."""
        if len(self.ids) > CACHED:
            self.old_ids, self.old_bytes, self.ids, self.bytes = self.ids, self.bytes, {}, {}
        split = [(_START + t).replace("\n", " \n").split(" ") if _usual(t) else None for t in texts]
        self._know(set().union(*(x for x in split if x)))
        odd = [i for i, x in enumerate(split) if x is None]
        whole = dict(zip(odd, self._learn_whole([texts[i] for i in odd]), strict=True))
        ids, text = self.ids.__getitem__, self.bytes.__getitem__
        return [whole[i] if x is None else (" ".join(map(ids, x)), b"".join(map(text, x))) for i, x in enumerate(split)]

    def _learn_whole(self, texts: list[str]) -> list[tuple[str, bytes]]:
        return [got if t else ("", b"") for t, got in zip(texts, self._learn([t or " " for t in texts]), strict=True)]


def _parts(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    first, held, n = 0, [], 0
    for i, text in enumerate(texts):
        held.append(text or "")
        n += len(held[-1])
        if n >= BATCH_CHARS:
            yield first, held
            first, held, n = i + 1, [], 0
    if held:
        yield first, held


def _coder(path: str, pattern: str) -> Coder:
    return W.kept(("bpe", path, pattern), lambda: Coder(path, pattern))


def encode(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Per row: doc_id, ids (decimal, joined by one space) and the bytes decoded from them."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)

    def make():
        coder = _coder(path, public_tokenizers.PATTERN)

        def step(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
            for first, texts in _parts(batch.column("text").to_pylist()):
                out = coder.encode(texts)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(texts)), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.binary())], ["doc_id", "ids", "decoded"])

        return step

    return W.map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), "doc_id long, ids string, decoded binary", make, keeps=True)


def decode(coded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Per row: doc_id and the bytes of its ids (decimal, joined by one space; null: none)."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)

    def make():
        coder = _coder(path, public_tokenizers.PATTERN)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x[1] for x in coder.decode([[int(x) for x in (ids or "").split()] for ids in batch.column("ids").to_pylist()])], pa.binary())], ["doc_id", "decoded"])

        return step

    return W.map_batches(coded.select(F.col("doc_id").cast("long"), F.col("ids").cast("string")), "doc_id long, decoded binary", make, keeps=True)


def encoded(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """docs with n_tokens and ids added (replacing columns of those names), and text as decoded from the ids; a null text stays null."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    docs = docs.select([c for c in docs.columns if c.lower() not in ("n_tokens", "ids")])
    schema = T.StructType([*docs.schema.fields, T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.StringType())])

    def make():
        coder = _coder(path, public_tokenizers.PATTERN)

        def step(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
            given = batch.column("text").to_pylist()
            for first, texts in _parts(given):
                out = coder.encode(texts)
                rows = batch.slice(first, len(texts))
                columns = {k: rows.column(k) for k in batch.schema.names}
                columns["text"] = pa.array([None if given[first + i] is None else x[1].decode() for i, x in enumerate(out)], pa.string())
                columns["n_tokens"] = pa.array([x[0].count(" ") + 1 if x[0] else 0 for x in out], pa.int64())
                columns["ids"] = pa.array([x[0] for x in out], pa.string())
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

        return step

    return W.map_batches(docs, schema, make, keeps=True)

"""Secret scans (operator 9): fixed patterns, and a token-efficiency test for what they miss.

Fixed patterns find assignments, access keys and long hex runs. Besides, each long unbroken string is
encoded by a tiktoken vocabulary: ordinary names take few tokens for their length, random strings many.
Those with few characters a token are reported as ``random``, unless they are digests of a known length,
UUIDs, plain numbers, or touch a span already found.

How few is few is measured on the corpus's own long words that occur more than once, as keys seldom do: per form
(small letters, with a capital first or not; capital letters) the limit is the ratio that a share of RARE of
them reaches, MOST at most. Strings of
digits or mixed letters have no ordinary words to compare with and take the limit of small letters, LEAST_LIMIT
at least. All documents count; what reaches the driver is a histogram of ratios.

Defined results. Null or empty text: no spans. Repeated rows and doc_ids: one result a row. No rows: no
rows. Spans of one kind never overlap; those of different kinds may, and order by start, then kind.
Columns other than doc_id and text are not read; ``redacted`` keeps every column of its input.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections import Counter
from functools import cache

import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm import words as W

KINDS = ("assign", "access", "hex", "random")
#: Characters from which on a string is tested, and letters from which on a word is compared with.
LEAST, WORD = 20, 16
#: Share of the ordinary words at or below the limit; bins a unit of the ratio.
RARE, BINS = 0.001, 100
#: Bounds of the limits. Of random strings of 20 characters, 95 % have a ratio up to 1.54 (letters and digits), 1.67
#: (letters) or 2.0 (small letters); of 1,036 words of 16 to 19 letters in invented prose, 0.1 % have one up to 1.89.
LEAST_LIMIT, MOST = 1.6, 1.9
VOCABULARY = "byte_bpe_50k.tiktoken"

_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_LONG = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST)
_WORD = re.compile(r"(?<![A-Za-z0-9+/_=-])(?:[A-Z]?[a-z]{%d,}|[A-Z]{%d,})(?![A-Za-z0-9+/_=-])" % (WORD - 1, WORD))
_UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
#: Hex digits of common digests: MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512.
_DIGESTS = {32, 40, 56, 64, 96, 128}
_PLAIN_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")

Span = tuple[int, int, str]


@cache
def encoding(path: str, pattern: str = public_tokenizers.PATTERN) -> tiktoken.Encoding:
    """A vocabulary of ranks as an encoder, loaded once a worker."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[Span]:
    found = []
    found += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return found


def form(s: str) -> str:
    """small, capital or mixed."""
    return "mixed" if not s.isalpha() else "small" if s[1:].islower() else "capital" if s.isupper() else "mixed"


def calibrated(docs: DataFrame, vocabulary: str | None = None) -> dict[str, float]:
    """Most characters a token of a random string, by form, from all long words of the corpus."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)

    def make():
        coder = encoding(path)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            found = Counter(s for text in batch.column("text").to_pylist() for s in _WORD.findall(text or ""))
            if not found:
                return None
            bins = [int(BINS * len(s) / len(coder.encode_ordinary(s))) for s in found]
            return pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(map(form, found), pa.string()), pa.array(bins, pa.int64()), pa.array(found.values(), pa.int64())], ["word", "form", "bin", "n"])

        return step

    each = W.map_batches(docs.select(F.col("text").cast("string").alias("text")), "word string, form string, bin long, n long", make)
    common = each.groupBy("word", "form", "bin").agg(F.sum("n").alias("n")).where("n > 1")
    return limits_of([tuple(r) for r in common.groupBy("form", "bin").agg(F.sum("n").alias("n")).collect()])


def limits_of(histogram: list[tuple[str, int, int]]) -> dict[str, float]:
    """The limits by form, from (form, bin, words)."""
    out = {}
    for kind in ("small", "capital"):
        own = sorted((k, n) for f, k, n in histogram if f == kind)
        below, total, limit = 0, sum(n for _, n in own), MOST
        for k, n in own:
            below += n
            if below > RARE * total:
                limit = min(MOST, k / BINS)
                break
        out[kind] = limit
    return out | {"mixed": max(LEAST_LIMIT, out["small"])}


def random_spans(text: str, taken: list[Span], coder: tiktoken.Encoding, limits: dict[str, float]) -> list[Span]:
    found, k, upto = [], 0, 0
    taken = sorted(taken)
    for m in _LONG.finditer(text):
        a, b = m.span()
        while k < len(taken) and taken[k][0] < b:
            upto = max(upto, taken[k][1])
            k += 1
        s = m[0]
        if upto > a or not any(map(str.isalpha, s)) or _UUID.fullmatch(s) or (len(s) in _DIGESTS and _PLAIN_HEX.fullmatch(s)):
            continue
        if len(s) < limits[form(s)] * len(coder.encode_ordinary(s)):
            found.append((a, b, "random"))
    return found


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1])))


def spans_of(text: str | None, coder: tiktoken.Encoding, limits: dict[str, float]) -> tuple[list[Span], list[Span]]:
    """(spans of the fixed patterns, spans that the efficiency test adds)."""
    if not text:
        return [], []
    base = base_spans(text)
    return base, random_spans(text, base, coder, limits)


def scan(docs: DataFrame, vocabulary: str | None = None, limits: dict[str, float] | None = None) -> DataFrame:
    """Per row: counts of the fixed patterns, digest of their spans, and all spans as text. limits: as ``calibrated`` gives; None: from docs."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    limits = limits or calibrated(docs, path)

    def make():
        coder = encoding(path)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            both = [spans_of(text.as_py(), coder, limits) for text in batch.column("text")]
            count = lambda kind: pa.array([sum(x[2] == kind for x in base) for base, _ in both], pa.int64())
            digests = [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in both]
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), count("assign"), count("access"), count("hex"), pa.array(digests), pa.array([joined(base + more) for base, more in both], pa.string()), pa.array([len(more) for _, more in both], pa.int64())],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"],
            )

        return step

    return W.map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long", make)


def redact(text: str | None, spans: list[Span]) -> str | None:
    """text with each run of overlapping spans replaced by its first kind in angle brackets."""
    if not text or not spans:
        return text
    out, at, upto = [], 0, 0
    for a, b, kind in sorted(spans):
        if a >= upto:
            out += [text[at:a], f"<{kind}>"]
        upto = at = max(upto, b)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, vocabulary: str | None = None, limits: dict[str, float] | None = None) -> DataFrame:
    """docs with every span in ``text`` replaced; other columns stay, n_chars (if there) follows the text."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    limits = limits or calibrated(docs, path)
    columns = docs.columns

    def make():
        coder = encoding(path)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = {k: batch.column(k) for k in columns}
            texts = [redact(t, sum(spans_of(t, coder, limits), [])) for t in batch.column("text").to_pylist()]
            out["text"] = pa.array(texts, pa.string())
            if "n_chars" in out:
                out["n_chars"] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(out["n_chars"].type)
            return pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

        return step

    return W.map_batches(docs, docs.schema, make)

"""Removal of passages that earlier documents hold, by repeated-phrase automata (operator 5).

1. Every part of the documents sends the minimizers of its WINDOW-word windows (the least hash among
   the GRAM-word runs in a window: equal windows have equal ones). Those in two documents come back.
2. Windows with such a minimizer are candidates; the hash and the least doc_id of each go out. The
   first document of a window that others hold too learns which parts hold it.
3. It sends them the words: its longest runs of such windows, the recurring passages.
4. Each part compiles the passages it received into Aho-Corasick automata, at most SHARD anchors
   each: of each window the run of ANCHOR words that fewest passages hold.
   All documents of the part stream through; at each anchor, text and passage are compared word by
   word, both ways, and stretches of a whole window or more are occurrences. Hashes thus only say
   where to look; words decide. Of places with the same words around one is kept, and what is known to
   be held is not compared again, so that a word said a million times takes no longer than other words.

Defined results. One row per input row. Null or empty text, or fewer words than a window: nothing is
removed. Null doc_id: nothing is removed, and its windows are nobody's first. Rows of one doc_id are one
document (its repeats do not remove each other). Ties can't arise: the least doc_id is first. Columns
other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ledgerlake.llm import parts as P
from ledgerlake.llm import words as W

WINDOW, GRAM, ANCHOR = 13, 5, 7
#: Anchors of one automaton.
SHARD = 60_000
#: Characters of a word's code: enough for 128**3 words of a part's passages.
DIGITS = 3
_UNKNOWN = "\x01"

OUT = "doc_id long, n_words long, n_removed long, kept string"


def minimizers(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, minimizer) of every window that lies in one text."""
    at = np.flatnonzero(W.starts_within(offsets, WINDOW))
    g = W.grams(hashes, GRAM)
    span, n = 1, WINDOW - GRAM + 1
    if len(g) < n:
        return at[:0], g[:0]
    low = g
    while span * 2 <= n:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    low = np.minimum(low[: len(g) - n + 1], low[n - span : len(g) + 1 - span])
    return at, low[at]


def _held(docs: pa.Table, cache: W.WordHashes, only: np.ndarray | None = None):
    """(doc_ids, words, hashes, offsets) of the documents, or of those with certain ids, batch by batch; those without an id as without words."""
    if only is not None:
        docs = docs.filter(pc.is_in(docs["doc_id"], pa.array(np.unique(only))))
    ids, texts = docs["doc_id"].to_pylist(), W.text_bytes(docs["text"])
    for first, held in W.batches([t if i is not None else None for i, t in zip(ids, texts, strict=True)]):
        hashes, offsets = W.flat(held, cache)
        yield np.array([i or 0 for i in ids[first : first + len(held)]], np.int64), held, hashes, offsets


def _owner(ids: np.ndarray, offsets: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ids[np.searchsorted(offsets, at, "right") - 1]


def _least(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct keys, least id of each, whether other ids have it too)."""
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    new = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
    starts = np.flatnonzero(new)
    last = np.append(starts[1:], len(keys)) - 1 if len(keys) else starts
    return keys[starts], ids[starts], ids[starts] != ids[last]


def _send_minimizers(n: int):
    def step(part: int, docs: pa.Table) -> pa.Table:
        keys, ids = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        cache = W.WordHashes()
        for own, _, hashes, offsets in _held(docs, cache):
            at, low = minimizers(hashes, offsets)
            owner = _owner(own, offsets, at)
            new = np.ones(len(at), bool)
            new[1:] = (low[1:] != low[:-1]) | (owner[1:] != owner[:-1])
            keys.append(low[new])
            ids.append(owner[new])
        keys, _, several = _least(np.concatenate(keys), np.concatenate(ids))
        return P.send(part, n, keys, several)

    return step


def _recurring(to: int, rows: pa.Table) -> pa.Table:
    """To each part, which of its keys occur in two documents."""
    of, keys, several = P.received(rows, np.bool_)
    distinct, n = np.unique(keys, return_counts=True)
    hit = P.member(keys, np.union1d(distinct[n > 1], keys[several]))
    return P.table((int(p), to, P.squeeze(keys[hit & (of == p)]), b"") for p in np.unique(of[hit]))


def _candidates(docs: pa.Table, recurring: np.ndarray, cache: W.WordHashes):
    """(words, offsets, starts, window hashes, doc_ids) of the windows with a recurring minimizer, by batch."""
    for own, held, hashes, offsets in _held(docs, cache):
        at, low = minimizers(hashes, offsets)
        at = at[P.member(low, recurring)]
        yield held, offsets, at, W.grams(hashes, WINDOW)[at], _owner(own, offsets, at)


def _send_windows(n: int):
    def step(part: int, docs: pa.Table, rows: pa.Table) -> pa.Table:
        _, recurring = P.received(rows)
        keys, ids = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for _, _, _, windows, owner in _candidates(docs, np.sort(recurring), W.WordHashes()):
            keys.append(windows)
            ids.append(owner)
        keys, ids, several = _least(np.concatenate(keys), np.concatenate(ids))
        return P.send(part, n, keys, ids, several)

    return step


def _firsts(to: int, rows: pa.Table) -> pa.Table:
    """To the part of each window's first document, the parts that hold the window besides that document."""
    of, keys, ids, several = P.received(rows, np.int64, np.bool_)
    order = np.lexsort((ids, keys))
    of, keys, ids, several = of[order], keys[order], ids[order], several[order]
    first = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
    group = np.cumsum(first) - 1
    home, owner = of[first][group], ids[first][group]
    wanted = ~first | several
    of, keys, home, owner = of[wanted], keys[wanted], home[wanted], owner[wanted]
    return P.table((int(p), to, P.squeeze(keys[here]), P.pack(owner[here], of[here])) for p in np.unique(home) for here in [home == p])


_PASSAGES = "to long, doc_id long, passage binary"


def _send_passages(part: int, docs: pa.Table, rows: pa.Table) -> pa.Table:
    _, keys, owners, wanted = P.received(rows, np.int64, np.int64)
    order = np.lexsort((wanted, keys))
    keys, owners, wanted = keys[order], owners[order], wanted[order]
    out: tuple[list, list, list] = ([], [], [])
    for own, held, hashes, offsets in _held(docs, W.WordHashes(), owners) if len(keys) else ():
        at = np.flatnonzero(W.starts_within(offsets, WINDOW))
        windows = W.grams(hashes, WINDOW)[at]
        low, high = np.searchsorted(keys, windows, "left"), np.searchsorted(keys, windows, "right")
        hit = (high > low) & (owners[np.minimum(low, len(keys) - 1)] == _owner(own, offsets, at))
        at, low, count = at[hit], low[hit], (high - low)[hit]
        if not len(at):
            continue
        entry = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        to, start = wanted[entry], np.repeat(at, count)
        order = np.lexsort((start, to))
        to, start = to[order], start[order]
        text = np.searchsorted(offsets, start, "right") - 1
        cut = np.concatenate([[True], (to[1:] != to[:-1]) | (start[1:] != start[:-1] + 1) | (text[1:] != text[:-1])])
        begins = np.flatnonzero(cut)
        for b, e in zip(begins, np.append(begins[1:], len(to)), strict=True):
            t = int(text[b])
            a = int(start[b] - offsets[t])
            out[0].append(int(to[b]))
            out[1].append(int(own[t]))
            out[2].append(b" ".join(held[t][a : a + int(e - b) + WINDOW - 1]))
    return pa.table({"to": pa.array(out[0], pa.int64()), "doc_id": pa.array(out[1], pa.int64()), "passage": pa.array(out[2], pa.binary())})


class Phrases:
    """Aho-Corasick automata over the anchors of passages.

    Of the runs of ANCHOR words in each window of a passage, the one in fewest passages is an anchor. Passages
    that share most of their words with many others are thus found by what sets them apart.
    """

    def __init__(self, passages: list[tuple[int, bytes]]) -> None:
        self.owners = [owner for owner, _ in passages]
        split = [text.split() for _, text in passages]
        numbers = {w: i for i, w in enumerate(dict.fromkeys(w for words in split for w in words))}
        #: Words as DIGITS characters each, of ranges of their own, so that automata stay narrow and matches aligned.
        self.code = {w: _digits(i) for w, i in numbers.items()}
        self.numbers = [[numbers[w] for w in words] for words in split]
        self.texts = ["".join([self.code[w] for w in words]) for words in split]
        self.shards = []
        anchors: dict[str, dict[str, tuple[int, int, int]]] = {}
        for p, k in self._rarest():
            # All windows that hold the anchor lie in the words around it: of places with the same ones, the least owner's will do.
            text, place = self.texts[p], (self.owners[p], p, k)
            around = text[DIGITS * max(0, k + ANCHOR - WINDOW) : DIGITS * (k + WINDOW)]
            places = anchors.setdefault(text[DIGITS * k : DIGITS * (k + ANCHOR)], {})
            places[around] = min(places.get(around, place), place)
            if len(anchors) >= SHARD:
                self._compile(anchors)
                anchors = {}
        self._compile(anchors)

    def _rarest(self) -> Iterator[tuple[int, int]]:
        """(passage, start) of the anchors, each once."""
        if not self.numbers:
            return
        sizes = np.array([len(t) for t in self.numbers])
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        runs = W.grams(W.mix(np.fromiter((n for t in self.numbers for n in t), np.uint64, int(offsets[-1]))), ANCHOR)
        _, group, count = np.unique(runs, return_inverse=True, return_counts=True)
        # Fewest first, then the same choice wherever the run occurs.
        rank = np.argsort(np.lexsort((np.arange(len(count)), count)), kind="stable")[group]
        at = np.flatnonzero(W.starts_within(offsets, WINDOW))
        around = np.lib.stride_tricks.sliding_window_view(rank, WINDOW - ANCHOR + 1)
        for start in np.unique(at + around[at].argmin(axis=1)).tolist():
            p = int(np.searchsorted(offsets, start, "right")) - 1
            yield p, int(start - offsets[p])

    def _compile(self, anchors: dict[str, dict[str, tuple[int, int, int]]]) -> None:
        if anchors:
            shard = ahocorasick.Automaton()
            for anchor, places in anchors.items():
                shard.add_word(anchor, sorted(places.values()))
            shard.make_automaton()
            self.shards.append(shard)

    def earlier(self, doc_id: int, words: list[bytes]) -> np.ndarray:
        """Which words lie in a window that a passage of a smaller doc_id holds."""
        covered = np.zeros(len(words) + 1, np.int64)
        at = 0
        # A window has no word that is in no passage.
        for known in "".join([self.code.get(w, _UNKNOWN) for w in words]).split(_UNKNOWN):
            if len(known) >= DIGITS * WINDOW:
                self._mark(doc_id, known, covered[at:])
            at += len(known) // DIGITS + 1
        return np.cumsum(covered)[:-1] > 0

    def _mark(self, doc_id: int, text: str, covered: np.ndarray) -> None:
        done: dict[tuple[int, int], int] = {}
        most = len(text) // DIGITS - WINDOW
        for shard in self.shards:
            # Windows that start from low to before high are known to be held.
            low = high = 0
            for last, places in shard.iter(text):
                end = (last + 1) // DIGITS
                start = end - ANCHOR
                for owner, p, k in places:
                    if owner >= doc_id or (low <= max(0, end - WINDOW) and high > min(start, most)):
                        break
                    if done.get((p, start - k), -1) >= end:
                        continue
                    a = start - _before(text, DIGITS * start, self.texts[p], DIGITS * k)
                    b = end + _after(text, DIGITS * end, self.texts[p], DIGITS * (k + ANCHOR))
                    done[p, start - k] = b
                    if b - a >= WINDOW:
                        covered[a] += 1
                        covered[b] -= 1
                        upto = b - WINDOW + 1
                        low, high = (min(low, a), max(high, upto)) if a <= high and low <= upto else (a, upto)


def _digits(number: int) -> str:
    return "".join(chr((d + 1) * 256 + number // 128**d % 128) for d in range(DIGITS))


def _after(one: str, i: int, other: str, j: int) -> int:
    """Words that two coded texts have in common from i and j on, in steps that double."""
    n, most, step = 0, min(len(one) - i, len(other) - j) // DIGITS, 8
    while n < most:
        step = min(step, most - n)
        at, size = DIGITS * n, DIGITS * step
        if one[i + at : i + at + size] == other[j + at : j + at + size]:
            n, step = n + step, 2 * step
        else:
            most, step = n + step - 1, max(1, step // 2)
    return n


def _before(one: str, i: int, other: str, j: int) -> int:
    """Words that they have in common up to i and j."""
    n, most, step = 0, min(i, j) // DIGITS, 8
    while n < most:
        step = min(step, most - n)
        at, size = DIGITS * n, DIGITS * step
        if one[i - at - size : i - at] == other[j - at - size : j - at]:
            n, step = n + step, 2 * step
        else:
            most, step = n + step - 1, max(1, step // 2)
    return n


def _remove(part: int, docs: pa.Table, rows: pa.Table) -> pa.Table:
    phrases = Phrases(list(zip(rows["doc_id"].to_pylist(), rows["passage"].to_pylist(), strict=True)))
    n_words, n_removed, kept = [], [], []
    for doc_id, text in zip(docs["doc_id"].to_pylist(), W.text_bytes(docs["text"]), strict=True):
        words = text.split() if text else []
        gone = phrases.earlier(doc_id, words) if doc_id is not None and len(words) >= WINDOW and phrases.shards else None
        n_words.append(len(words))
        n_removed.append(0 if gone is None else int(gone.sum()))
        kept.append(b" ".join(words if not n_removed[-1] else [w for w, g in zip(words, gone.tolist(), strict=True) if not g]))
    return pa.table({"doc_id": docs["doc_id"], "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept": pa.array(kept, pa.binary()).cast(pa.string())})


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, and the words that stay, joined by a space."""
    n = P.n_parts(docs)
    parts = P.in_parts(docs, n)
    recurring = P.each_bucket(P.each_part(parts, _send_minimizers(n), P.MAIL), _recurring)
    firsts = P.each_bucket(P.with_mail(parts, recurring, _send_windows(n), P.MAIL), _firsts)
    passages = P.with_mail(parts, firsts, _send_passages, _PASSAGES)
    return P.with_mail(parts, passages, _remove, OUT)

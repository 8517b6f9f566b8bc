"""Katz back-off language model (operator 6).

Counts of n-grams of the training documents, of one word up to ``order`` words, are Good-Turing
discounted: a count r up to KATZ becomes (r + 1) n[r + 1] / n[r], where that lies between 0 and r, and r
less an absolute discount otherwise; a larger one loses what KATZ does. What a history loses goes to the
words not seen after it, in proportion to their probability after the history one word shorter; its
back-off weight is that mass over one minus the summed probability of the words seen, so that every
distribution sums to exactly one. What single words lose goes to one class of unknown words. An n-gram
without a count is evaluated recursively: back-off weight times the probability of the n-gram without its
first word. A text's first words have the shorter histories that begin with its begin.

The tables are partitioned by hash of the n-gram: a bucket holds the counts of its keys over all parts
of the documents, and answers each part on the keys that it sent. For each n-gram one part (the least
that has it) adds what it lost and its word's probability after the shorter history, which has a count
too, to the sums of its history; a second exchange gathers these for all lengths at once. Nothing that
grows with the corpus reaches the driver or any single task.

Words are told apart by 64-bit hashes, longer n-grams by 56 bits of theirs.

Defined results. Null or empty text: one token, the end. Null doc_id: scored, not learnt from, held_out
null. Repeated rows: each counts and gets a result. No training documents: N = V = 0, every score 0.
Texts shorter than the order: evaluated on what precedes. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerlake.errors import InvalidArgument
from ledgerlake.llm import parts as P
from ledgerlake.llm import words as W

#: Counts up to which Good-Turing estimates hold.
KATZ = 5

_END, _BEGIN = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_ODD = np.uint64(0x9E3779B97F4A7C15)

OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_PARTIAL = "part long, doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, histories array<binary>"


def discounted(n: np.ndarray, longest: int = KATZ) -> np.ndarray:
    """For counts 0 to longest: the discounted count. n[r]: how many n-grams occur r times, for r up to longest + 1."""
    absolute = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
    absolute = min(absolute, 0.95) or 0.5
    out = np.zeros(longest + 1)
    for r in range(1, longest + 1):
        good = (r + 1) * n[r + 1] / n[r] if n[r] else 0.0
        out[r] = good if 0 < good < r else r - absolute
    return out


def lost(counts: np.ndarray, table: np.ndarray) -> np.ndarray:
    """What the discount takes from each count."""
    few = np.minimum(counts, len(table) - 1)
    return np.where(counts > 0, few - table[few], 0.0)


@dataclass
class Stream:
    """Tokens of a part's documents: of which document, and by length the distinct n-grams and the place among them of
    the one that ends at each token; -1 where a text has too few words before the token."""

    held_out: list
    train: np.ndarray
    doc: np.ndarray
    begins: np.ndarray
    grams: list[np.ndarray]
    place: list[np.ndarray]

    def history(self, level: int) -> np.ndarray:
        """Place of each token's history among the n-grams of that many words; the end token stands for a text's begin."""
        out = np.empty_like(self.place[level - 1])
        out[1:] = self.place[level - 1][:-1]
        out[self.begins] = np.searchsorted(self.grams[0], _END) if level == 1 else -1
        return out

    def keys(self, level: int) -> np.ndarray:
        return self.grams[level] << np.uint64(8) if level else self.grams[0]


def _stream(docs: pa.Table, held_out: tuple[int, int], order: int) -> Stream:
    ids, texts = docs["doc_id"].to_pylist(), [t and t.lower() for t in W.text_bytes(docs["text"])]
    held = [None if i is None else crc32(str(i).encode()) % held_out[0] == held_out[1] for i in ids]
    cache, tokens, sizes = W.WordHashes(), [], []
    for _, batch in W.batches(texts):
        hashes, offsets = W.flat(batch, cache)
        tokens.append(np.insert(hashes, offsets[1:], _END))
        sizes.append(np.diff(offsets) + 1)
    token, size = np.concatenate(tokens), np.concatenate(sizes)
    begins = np.cumsum(size) - size
    depth = np.arange(len(token)) - np.repeat(begins, size)
    words, word = np.unique(token, return_inverse=True)
    grams, places, hashes = [words], [word], token
    for level in range(1, order):
        before = np.empty_like(token)
        before[1:] = hashes[:-1]
        if level == 1:
            before[begins] = _BEGIN
        hashes = W.mix(before * _ODD + W.mix(token))
        here, place = depth >= level - 1, np.full(len(token), -1)
        distinct, place[here] = np.unique(hashes[here] >> np.uint64(8), return_inverse=True)
        grams.append(distinct)
        places.append(place)
    return Stream(held, np.array([h is False for h in held]), np.repeat(np.arange(len(ids)), size), begins, grams, places)


def _send_counts(n: int, order: int, held_out: tuple[int, int], part: int, docs: pa.Table) -> pa.Table:
    s = _stream(docs, held_out, order)
    learnt = s.train[s.doc]
    counts = [np.bincount(place[learnt & (place >= 0)], minlength=len(grams)).astype(np.uint64) for grams, place in zip(s.grams, s.place, strict=True)]
    return pa.concat_tables([P.send(part, n, s.keys(level), counts[level], first=level * n) for level in range(order)])


def _answer_counts(n: int, to: int, rows: pa.Table) -> pa.Table:
    """To every part: this bucket's numbers of n-grams by count, of tokens and of n-grams; and the counts of the
    keys that the part sent, doubled, plus one for the part that speaks for the key."""
    of, keys, counts = P.received(rows, np.uint64)
    order = np.argsort(keys, kind="stable")
    first = np.concatenate([[True], keys[order][1:] != keys[order][:-1]])
    group = np.empty(len(keys), np.int64)
    group[order] = np.cumsum(first) - 1
    total = np.bincount(group, weights=counts).astype(np.int64)
    speaker = np.full(len(total), np.iinfo(np.int64).max)
    np.minimum.at(speaker, group, of)
    answer = (2 * total[group] + (speaker[group] == of)).astype(np.uint64)
    summary = np.concatenate([np.bincount(np.minimum(total, KATZ + 2), minlength=KATZ + 3)[: KATZ + 2], [total.sum(), (total > 0).sum()]]).astype(np.int64)
    by = {int(p): answer[of == p] for p in np.unique(of)}
    return P.table((p, to, summary.tobytes(), len(by[p]).to_bytes(4, "little") + P.short(by[p]) if p in by else bytes(4)) for p in range(n))


@dataclass
class Counts:
    """What a part knows after the first exchange: by length the counts of its n-grams, 0 for a place of -1, whether it
    speaks for them and their discounts; and numbers of the whole corpus."""

    counts: list[np.ndarray]
    speaks: list[np.ndarray]
    tables: list[np.ndarray]
    tokens: int
    distinct: int
    unknown: float

    def kept(self, level: int, place: np.ndarray) -> np.ndarray:
        counts = self.counts[level][place]
        return counts - lost(counts, self.tables[level])

    def alone(self, word: np.ndarray) -> np.ndarray:
        """Probability of words by themselves."""
        if not self.tokens:
            return np.ones(len(word))
        return np.where(self.counts[0][word] > 0, self.kept(0, word) / self.tokens, self.unknown)


def _counts(n: int, order: int, rows: pa.Table) -> Counts:
    by_bucket = np.argsort(rows["of"].to_numpy(), kind="stable")
    of, summaries, answers = rows["of"].to_numpy()[by_bucket], rows["keys"].to_pylist(), rows["more"].to_pylist()
    sums = np.zeros((order, KATZ + 4), np.int64)
    got: list[list] = [[] for _ in range(order)]
    for bucket, k in zip(of, by_bucket, strict=True):
        level = int(bucket) // n
        sums[level] += np.frombuffer(summaries[k], np.int64)
        got[level].append(P.unshort(answers[k], int.from_bytes(answers[k][:4], "little"), 4)[0])
    marked = [np.concatenate([*x, np.zeros(1, np.uint64)]).astype(np.int64) for x in got]
    tables = [discounted(x[: KATZ + 2]) for x in sums]
    tokens, distinct = int(sums[0][-2]), int(sums[0][-1])
    # All words' losses: those of counts up to KATZ by number, and of each larger one as that of KATZ.
    r = np.arange(1, KATZ + 1)
    gone = float((sums[0][1 : KATZ + 1] * (r - tables[0][1:])).sum() + (distinct - sums[0][1 : KATZ + 1].sum()) * (KATZ - tables[0][KATZ]))
    return Counts([x >> 1 for x in marked], [(x[:-1] & 1) > 0 for x in marked], tables, tokens, distinct, gone / tokens if tokens else 1.0)


def _evaluate(s: Stream, c: Counts, level: int, tokens: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """log10 probabilities of tokens after histories of ``level`` words, without the numerators of back-off weights;
    and for each length of history, from one word on, the tokens that need its weight."""
    if level == 0:
        return np.log10(c.alone(s.place[0][tokens])), []
    place = s.place[level][tokens]
    seen = c.counts[level][place] > 0
    total = np.where(place >= 0, c.counts[level - 1][s.history(level)[tokens]], 0)
    out = np.empty(len(tokens))
    out[seen] = np.log10(c.kept(level, place[seen]) / total[seen])
    out[~seen], needs = _evaluate(s, c, level - 1, tokens[~seen])
    backs = ~seen & (total > 0)
    out[backs] -= np.log10(total[backs])
    return out, [*needs, tokens[backs]]


def _send_losses(n: int, order: int, held_out: tuple[int, int], part: int, docs: pa.Table, rows: pa.Table) -> pa.Table:
    """Of the n-grams that this part speaks for: by history, what they lost and their words' probabilities after the
    shorter history; and the histories it asks about."""
    s, c = _stream(docs, held_out, order), _counts(n, order, rows)
    needs = _evaluate(s, c, order - 1, np.arange(len(s.doc)))[1]
    return pa.concat_tables([P.table(()), *[_losses_of(n, part, s, c, level, needs[level - 1]) for level in range(1, order)]])


def _losses_of(n: int, part: int, s: Stream, c: Counts, level: int, needs: np.ndarray) -> pa.Table:
    history, histories = s.history(level), len(s.grams[level - 1])
    ends = np.flatnonzero(s.place[level] >= 0)[::-1]
    first = np.zeros(len(s.grams[level]), np.int64)
    first[s.place[level][ends]] = ends
    at = first[c.speaks[level] & (c.counts[level][:-1] > 0)]
    if level == 1:
        shorter = c.alone(s.place[0][at])
    else:
        shorter = c.kept(level - 1, s.place[level - 1][at]) / c.counts[level - 2][s.history(level - 1)[at]]
    loss = np.bincount(history[at], weights=lost(c.counts[level][s.place[level][at]], c.tables[level]), minlength=histories)
    seen = np.bincount(history[at], weights=shorter, minlength=histories)
    asked = np.zeros(histories, bool)
    asked[history[needs]] = True
    on = asked | (seen > 0)
    return P.send(part, n, s.keys(level - 1)[on], loss[on], seen[on], asked[on], first=(level - 1) * n)


def _answer_losses(to: int, rows: pa.Table) -> pa.Table:
    of, keys, loss, seen, asked = P.received(rows, np.float64, np.float64, np.bool_)
    distinct, group = np.unique(keys, return_inverse=True)
    loss, seen = np.bincount(group, weights=loss, minlength=len(distinct))[group], np.bincount(group, weights=seen, minlength=len(distinct))[group]
    return P.table((int(p), to, P.squeeze(keys[here]), P.pack(loss[here], seen[here])) for p in np.unique(of[asked]) for here in [asked & (of == p)])


def _score_seen(n: int, order: int, held_out: tuple[int, int], part: int, docs: pa.Table, rows: pa.Table) -> pa.Table:
    """Scores without the back-off weights' numerators, and by length the histories these are needed for."""
    s, c = _stream(docs, held_out, order), _counts(n, order, rows)
    docs_n = len(s.held_out)
    log_p, needs = _evaluate(s, c, order - 1, np.arange(len(s.doc)))
    add = lambda x: np.bincount(s.doc, weights=x, minlength=docs_n)
    known = c.counts[0][s.place[0]]
    base = np.log10((known + 0.1) / (c.tokens + 0.1 * (c.distinct + 1)))
    histories: list[list[bytes]] = [[] for _ in range(docs_n)]
    for level, tokens in enumerate(needs, 1):
        asked = s.keys(level - 1)[s.history(level)[tokens]]
        cuts = np.searchsorted(s.doc[tokens], np.arange(docs_n + 1))
        for own, a, b in zip(histories, cuts[:-1], cuts[1:], strict=True):
            own.append(asked[a:b].tobytes())
    return pa.table({
        "part": pa.array(np.full(docs_n, part), pa.int64()), "doc_id": docs["doc_id"], "held_out": pa.array(s.held_out, pa.bool_()),
        "n_tokens": pa.array(add(np.ones(len(s.doc))).astype(np.int64)), "n_known": pa.array(add(known > 0).astype(np.int64)), "train_tokens": pa.array(np.full(docs_n, c.tokens), pa.int64()),
        "base_score": add(base), "score": add(log_p), "histories": pa.array(histories, pa.list_(pa.binary())),
    })


def _finish(n: int, part: int, scores: pa.Table, rows: pa.Table) -> pa.Table:
    of, keys, loss, seen = P.received(rows, np.float64, np.float64)
    score, histories = scores["score"].to_numpy().copy(), scores["histories"].to_pylist()
    for level in range(max(map(len, histories), default=0)):
        own = of // n == level
        order = np.argsort(keys[own])
        held, weight = keys[own][order], np.log10(loss[own][order] / (1 - seen[own][order]))
        for i, asked in enumerate(histories):
            if asked[level]:
                score[i] += weight[np.searchsorted(held, np.frombuffer(asked[level], np.uint64))].sum()
    return scores.drop_columns(["part", "histories"]).set_column(6, "score", pa.array(score))


def score(docs: DataFrame, held_out: tuple[int, int], order: int = 2) -> DataFrame:
    """Per row: log10 probabilities under the add-0.1 base and the Katz model of n-grams of up to ``order`` words;
    documents whose crc32(doc_id) modulo held_out[0] is held_out[1] are not learnt from."""
    if order < 1:
        raise InvalidArgument(f"order of a language model must be 1 or more, not {order}")
    n = P.n_parts(docs)
    own = P.in_parts(docs, n)
    counts = P.each_bucket(P.each_part(own, partial(_send_counts, n, order, held_out), P.MAIL), partial(_answer_counts, n))
    losses = P.each_bucket(P.with_mail(own, counts, partial(_send_losses, n, order, held_out), P.MAIL), _answer_losses)
    seen = P.with_mail(own, counts, partial(_score_seen, n, order, held_out), _PARTIAL)
    return P.with_mail(seen, losses, partial(_finish, n), OUT)

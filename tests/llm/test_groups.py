"""Operators that compare documents with each other, against brute force over all of them."""

import functools
import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from ledgerlake.errors import InvalidArgument
from ledgerlake.llm import katz, neardup, substring
from ledgerlake.llm import parts as P
from ledgerlake.llm import queries as Q
from ledgerlake.llm import words as W
from ledgerlake.llm.components import components

SF = "/root/testdata/sf0.001"


def read(spark, sf=SF):
    return spark.read.parquet(f"{sf}/documents.parquet")


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


# Words


def test_words_and_grams():
    held = [b"a b c d".split(), [], b"b c d".split(), b"x".split()]
    hashes, offsets = W.flat(held, W.WordHashes())
    assert list(offsets) == [0, 4, 4, 7, 8]
    three = W.grams(hashes, 3)
    assert three[1] == three[4] and len(set(three.tolist())) == 5 and list(W.starts_within(offsets, 3)) == [True, True, False, False, True, False]
    assert [i for i, _ in W.batches([b"a b", None, b"c", b""], 2)] == [0, 1]
    assert len(W.grams(hashes, 9)) == 0


def test_squeezed_keys_and_counts():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 1000):
        for shift in (0, 8):
            keys = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) << np.uint64(shift)
            keys.sort()
            assert (P.unsqueeze(P.squeeze(keys)) == keys).all()
    assert (P.unsqueeze(P.squeeze(np.array([0, 2**64 - 1], np.uint64))) == np.array([0, 2**64 - 1], np.uint64)).all()
    counts = np.array([0, 1, 254, 255, 70_000_000_000, 3], np.uint64)
    got, width = P.unshort(b"xx" + P.short(counts), 6, 2)
    assert (got == counts).all() and width == 6 + 16
    keys = np.sort(rng.integers(0, 2**63, 50, dtype=np.uint64))
    mail = P.send(7, 5, keys, np.arange(50, dtype=np.uint64), np.ones(50, bool))
    of, back, a, b = P.received(mail, np.uint64, np.bool_)
    assert (back == keys).all() and (a == np.arange(50)).all() and b.all() and set(of) == {7}


# 1: near duplicates


def similarity(a, b):
    count = lambda t: Counter(tuple(t[k : k + 5]) for k in range(len(t) - 4)) if len(t) >= 5 else Counter([tuple(t)])
    x, y = count(a), count(b)
    both = sum((x & y).values())
    return both / (sum(x.values()) + sum(y.values()) - both)


def classes_of(rows):
    """class_id by brute force over all pairs of distinct texts."""
    texts, whole = {}, {}
    for i, t in rows:
        if i is not None and t and t.split():
            texts[t] = min(i, texts.get(t, i))
    words = {t: t.split() for t in texts}
    root = {t: t for t in texts}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    names = list(texts)
    shingles = {t: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for t, w in words.items()}
    for k, a in enumerate(names):
        for b in names[:k]:
            if shingles[a] & shingles[b] and find(a) != find(b) and similarity(words[a], words[b]) >= 0.8:
                root[find(a)] = find(b)
    for t, i in texts.items():
        whole[find(t)] = min(i, whole.get(find(t), i))
    return {t: whole[find(t)] for t in texts}


def check_classes(rows, got):
    want = classes_of(rows)
    sizes = Counter(want[t] for i, t in rows if i is not None and t in want)
    expect = Counter((i, want[t], sizes[want[t]]) if i is not None and t in want else (i, i, 1) for i, t in rows)
    assert Counter((r.doc_id, r.class_id, r.class_size) for r in got) == expect


def family(rng, base, n, most):
    """Copies of base with up to ``most`` words replaced."""
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(most + 1)):
            w[rng.randrange(len(w))] = f"w{rng.randrange(9999)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_equal_brute_force(spark, lasting, seed):
    """Small and large families, of short and very long texts, exact copies, repeated multisets, chains; large buckets of several classes."""
    rng = random.Random(seed)
    word = lambda: rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) + str(rng.randrange(40))
    texts = []
    for n, most, length in ((40, 6, 60), (12, 3, 30), (5, 1, 300), (3, 9, 600), (25, 12, 80), (14, 150, 4000)):
        texts += family(rng, [word() for _ in range(length)], n, most)
    texts += [" ".join(word() for _ in range(rng.randrange(1, 50))) for _ in range(60)]
    texts += ["a b c d e " * 30, "a b c d e " * 31, "a b c d e " * 60, "one two", "one two", "", None]
    texts += rng.sample([t for t in texts if t], 30)
    rows = [(rng.choice([i, None]) if i % 29 == 0 else i, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    check_classes(rows, neardup.classes(frame(spark, rows).repartition(3), lasting).collect())


def test_op1(spark):
    rows, got = [(r.doc_id, r.text) for r in read(spark).collect()], Q.op1_near_duplicates(spark, SF).collect()
    check_classes(rows, got)
    text = dict(rows)
    members = {}
    for r in got:
        members.setdefault(r.class_id, set()).add(text[r.doc_id])
    assert all((r.n_links > 0) == (len(members[r.class_id]) > 1) and r.n_links < len(members[r.class_id]) for r in got)


def test_bagminhash_estimates_weighted_jaccard():
    rng = np.random.default_rng(4)
    keys = rng.integers(0, 2**63, 60, dtype=np.uint64)
    x, y = rng.integers(0, 9, 60), rng.integers(0, 9, 60)
    y[:30] = x[:30]
    marks = 4096
    sets = [(np.full((w > 0).sum(), k), keys[w > 0], w[w > 0]) for k, w in enumerate((x, y))]
    got = neardup.bagminhash(*(np.concatenate(c) for c in zip(*sets, strict=True)), 3, marks)
    true = np.minimum(x, y).sum() / np.maximum(x, y).sum()
    assert abs((got[0] == got[1]).mean() - true) < 4 * np.sqrt(true * (1 - true) / marks) and np.isinf(got[2]).all()
    assert abs(marks / got[0].sum() - x.sum() / marks) < 0.1 * x.sum() / marks


def test_components(spark, lasting):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(n, n + 1) for n in range(1000, 1060)] + [(5000, n) for n in range(5001, 5300)] + [(7, 7)]
    got = {r.node: r.part for r in components(spark.createDataFrame(links, "a long, b long"), lasting).collect()}
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert got == {n: find(n) for n in root} and components(spark.createDataFrame([], "a long, b long"), lasting).count() == 0


def test_neardup_of_edge_cases(spark, edge, empty, lasting):
    check_classes([(r.doc_id, r.text) for r in edge.collect()], neardup.classes(edge, lasting).collect())
    kept = neardup.one_of_each(edge, lasting)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == edge.columns and ids.count(None) == 1
    assert sorted(i for i in ids if i is not None) == [*(i for i in range(14) if i != 10), 90]
    assert neardup.classes(empty, lasting).count() == 0 and neardup.one_of_each(empty, lasting).count() == 0


# 5: repeated passages


def removed(rows):
    first = {}
    for i, t in rows:
        w = (t or "").encode().split()
        for k in range(len(w) - 12 if i is not None else 0):
            key = tuple(w[k : k + 13])
            first[key] = min(first.get(key, i), i)
    out = Counter()
    for i, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - 12 if i is not None else 0):
            if first[tuple(w[k : k + 13])] < i:
                gone[k : k + 13] = [True] * 13
        out[i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()] += 1
    return out


def test_passages_equal_brute_force(spark):
    rng = random.Random(1)
    base = [[rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(60)] for _ in range(6)]
    rows = []
    for i in range(300):
        w = []
        for _ in range(rng.randint(0, 4)):
            b, a = rng.choice(base), rng.randrange(40)
            w += b[a : a + rng.randint(5, 30)]
        rows.append((rng.choice([i, i, i, i // 2, None]), " ".join(w) if rng.random() < 0.95 else None))
    got = substring.remove_repeats(frame(spark, rows).repartition(5)).collect()
    assert Counter(map(tuple, got)) == removed(rows) and sum(r.n_removed for r in got) > 1000


def test_small_shards_find_the_same(monkeypatch):
    rng = random.Random(2)
    passages = [(rng.randrange(50), " ".join(rng.choice("abcd") for _ in range(rng.randrange(13, 60))).encode()) for _ in range(80)]
    words = [rng.choice([b"a", b"b", b"c", b"d", b"zz"]) for _ in range(4000)] + passages[3][1].split()
    whole = substring.Phrases(passages).earlier(40, words)
    monkeypatch.setattr(substring, "SHARD", 7)
    assert (substring.Phrases(passages).earlier(40, words) == whole).all() and whole.any()


def test_op5(spark):
    want = Counter((i, n, k, hashlib.sha256(t.encode()).hexdigest()) for (i, n, k, t), m in removed([(r.doc_id, r.text) for r in read(spark).collect()]).items() for _ in range(m))
    assert Counter(map(tuple, Q.op5_repeated_passages(spark, SF).collect())) == want


def test_passages_of_edge_cases(edge, empty):
    got = Counter(map(tuple, substring.remove_repeats(edge).collect()))
    assert got == removed([(r.doc_id, r.text) for r in edge.collect()]) and substring.remove_repeats(empty).count() == 0


# 6: language model


def scores(rows, held=(10, 0), order=2):
    """n-grams as tuples of words, 0 the begin of a text and 1 its end; all counts in dictionaries."""
    out = lambda i: None if i is None else zlib.crc32(str(i).encode()) % held[0] == held[1]
    tokens = [(i, [*(t or "").encode().lower().split(), 1]) for i, t in rows]
    past = lambda w, k: tuple([0, *w][max(0, k + 2 - order) : k + 1]) if order > 1 else ()
    grams = [Counter() for _ in range(order)]
    for i, w in tokens:
        for k, x in enumerate(w if out(i) is False else ()):
            for m in range(len(past(w, k)) + 1):
                grams[m][(*past(w, k)[len(past(w, k)) - m :], x)] += 1

    def table(c):
        n = Counter(c.values())
        return katz.discounted(np.array([n[r] for r in range(katz.KATZ + 2)]))

    tables = [table(c) for c in grams]
    left = lambda m, c: tables[m][c] if c <= katz.KATZ else c - (katz.KATZ - tables[m][katz.KATZ])
    words, n, v = Counter({x: c for (x,), c in grams[0].items()}), grams[0].total(), len(grams[0])
    unknown = sum(c - left(0, c) for c in words.values()) / n if n else 1.0
    total, loss, after = Counter(), Counter(), {}
    for m in range(1, order):
        for (*h, x), c in grams[m].items():
            total[tuple(h)] += c
            loss[tuple(h)] += c - left(m, c)
            after.setdefault(tuple(h), []).append(x)

    @functools.cache
    def weight(h):
        return loss[h] / total[h] / (1 - math.fsum(p(h[1:], x) for x in after[h]))

    @functools.cache
    def p(h, x):
        if not h:
            return left(0, words[x]) / n if words[x] else unknown
        if grams[len(h)][*h, x]:
            return left(len(h), grams[len(h)][*h, x]) / total[h]
        return weight(h) * p(h[1:], x) if total[h] else p(h[1:], x)

    for h in [*list(total)[:20], *list(total)[-20:]]:
        assert math.isclose(math.fsum(p(h, x) for x in words) + p(h, None), 1, rel_tol=1e-9)
    result = []
    for i, w in tokens:
        base = sum(math.log10((words[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        result.append((i, out(i), len(w), sum(words[x] > 0 for x in w), n, base, math.fsum(math.log10(p(past(w, k), x)) for k, x in enumerate(w))))
    return result


def check_scores(rows, got, order=2):
    key = lambda r: (r[0] is None, r[0] or 0, round(r[5], 6), round(r[6], 6))
    want, got = sorted(scores(rows, order=order), key=key), sorted(map(tuple, got), key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for a, b in zip(got, want, strict=True):
        assert math.isclose(a[5], b[5], rel_tol=1e-9, abs_tol=1e-9) and math.isclose(a[6], b[6], rel_tol=1e-9, abs_tol=1e-9)


def test_op6(spark):
    rows, got = [(r.doc_id, r.text) for r in read(spark).collect()], Q.op6_language_model(spark, SF).collect()
    check_scores(rows, got)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_scores_of_edge_cases(spark, edge, empty):
    check_scores([(r.doc_id, r.text) for r in edge.collect()], katz.score(edge, (10, 0)).collect())
    assert katz.score(empty, (10, 0)).count() == 0
    untrained = katz.score(edge, (1, 0)).collect()
    assert {(r.train_tokens, r.n_known, r.base_score, r.score) for r in untrained} == {(0, 0, 0.0, 0.0)}
    few = [(i, t) for i, t in enumerate(["a a a a a a a", "a", "b b", None, "a b a b a b", "c"])]
    check_scores(few, katz.score(frame(spark, few), (10, 0)).collect())


@pytest.mark.parametrize("order", [1, 3, 4])
def test_scores_of_any_order(spark, edge, empty, order):
    docs = read(spark)
    check_scores([(r.doc_id, r.text) for r in docs.collect()], katz.score(docs, (10, 0), order).collect(), order)
    check_scores([(r.doc_id, r.text) for r in edge.collect()], katz.score(edge, (10, 0), order).collect(), order)
    assert katz.score(empty, (10, 0), order).count() == 0
    assert {r.score for r in katz.score(edge, (1, 0), order).collect()} == {0.0}
    with pytest.raises(InvalidArgument):
        katz.score(docs, (10, 0), 0)


def test_discounts():
    assert (katz.discounted(np.array([0, 0, 0, 0, 0, 0, 0]))[1:] == np.arange(1, 6) - 0.5).all()
    got = katz.discounted(np.array([0, 100, 40, 20, 12, 8, 5]))
    assert got[1] == 0.8 and all(0 < got[r] < r for r in range(1, 6))


def test_counts_pass_32_bits():
    """A key counted 1,500,000,000 times in each of two parts."""
    key = np.array([5, 1 << 40], np.uint64)
    rows = P.table((0, part, P.squeeze(key), P.pack(np.array([1_500_000_000, 3], np.uint64))) for part in (0, 1))
    for r in katz._answer_counts(2, 0, rows).to_pylist():
        counts, _ = P.unshort(r["more"], int.from_bytes(r["more"][:4], "little"), 4)
        assert [int(c) >> 1 for c in counts] == [3_000_000_000, 6]


def test_passages_of_one_word_said_over_and_over():
    """Against brute force on short ones; a long one takes no longer a word."""
    rng = np.random.default_rng(3)
    for _ in range(300):
        passages = [(int(o), [b"a b c".split()[k] for k in rng.choice(3, rng.integers(13, 60), p=[0.9, 0.07, 0.03])]) for o in rng.integers(0, 5, 3)]
        text = [b"a b c d".split()[k] for k in rng.choice(4, 80, p=[0.88, 0.06, 0.03, 0.03])]
        want = np.zeros(len(text), bool)
        held = {tuple(words[k : k + 13]) for owner, words in passages if owner < 3 for k in range(len(words) - 12)}
        for k in range(len(text) - 12):
            if tuple(text[k : k + 13]) in held:
                want[k : k + 13] = True
        got = substring.Phrases([(o, b" ".join(w)) for o, w in passages]).earlier(3, text)
        assert (got == want).all()
    words = [b"a"] * 200_000
    assert substring.Phrases([(1, b" ".join(words))]).earlier(2, words).all() and not substring.Phrases([(1, b" ".join(words))]).earlier(1, words).any()

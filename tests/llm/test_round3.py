"""Ranked search, quality rules and whitening against brute force."""

import math
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenderloom.llm import queries, ranked, rules, whitening

from .fixtures import documents, no_documents, prose, rows

D = "/root/testdata/sf0.001"
ITEMS = [(1, prose(1, 12)), (2, "ONE one w3 w3 unseen Größe"), (3, None), (4, " .,; "), (None, "id here 3 14"), (2, "same")]


def brute_ranked(docs, items, k):
    found = [(i, ranked.terms_of(t)) for i, t in docs]
    n, total = sum(bool(t) for _, t in found), sum(len(t) for _, t in found)
    df = Counter(t for _, ts in found for t in set(ts))
    out = []
    for item, text in items:
        scores = []
        for i, ts in found:
            tf, m = Counter(ts), 25 + 75 * len(ts) * n // max(total, 1)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m)) for t in ranked.terms_of(text) if tf[t])
            if s:
                scores.append((-s, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return Counter(out)


def test_terms_follow_the_pattern():
    text = "A-b_c é'É 日本 x9;Z\x00q\x7fr\x80s"
    assert ranked.terms_of(text) == ["a", "b", "c", "é", "É", "日本", "x9", "z", "q", "r\x80s"]
    data = np.frombuffer(text.encode(), np.uint8)
    starts, ends, _ = ranked.words(np.array([0, len(data)]), data, ranked.APART)
    assert [bytes(ranked._LOWER[data[a:b]]).decode() for a, b in zip(starts, ends, strict=True)] == ranked.terms_of(text)


def test_ranked_equals_brute_force(spark, monkeypatch):
    items = spark.createDataFrame([(i, t, "x", 1) for i, t in ITEMS], "item_id long, text string, rank string, score int")
    for k, entries, block in ((10, 1 << 18, 1 << 16), (2, 40, 1 << 16), (3, 5, 4)):  # one shard; small shards; several blocks of queries
        monkeypatch.setattr(ranked, "SHARD_ENTRIES", entries)
        monkeypatch.setattr(ranked, "BLOCK_TERMS", block)
        got = ranked.search(documents(spark).coalesce(2), items, k)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert Counter(map(tuple, got.collect())) == brute_ranked(rows(), ITEMS, k)
    assert ranked.search(no_documents(spark), items).count() == 0
    assert ranked.search(documents(spark), items.limit(0)).count() == 0


def test_best_of_random_lists():
    """Against whole scores, with ties and floors."""
    r = np.random.default_rng(5)
    for _ in range(300):
        n, k = int(r.integers(1, 60)), int(r.integers(1, 6))
        lists = [np.sort(r.choice(n, int(r.integers(1, n + 1)), replace=False)) for _ in range(int(r.integers(0, 7)))]
        impacts = [r.integers(0, 9, len(x)) for x in lists]
        order = sorted(range(len(lists)), key=lambda i: -impacts[i].max())
        whole = np.zeros(n, np.int64)
        for x, y in zip(lists, impacts, strict=True):
            whole[x] += y
        floor = int(r.integers(1, 12))
        some, total = ranked.best([lists[i] for i in order], [impacts[i] for i in order], np.array([impacts[i].max() for i in order], np.int64), floor, k, n)
        assert (whole[some] == total).all() and len(set(some.tolist())) == len(some)
        least = max(floor, np.sort(whole)[-k] if n >= k else 1)
        assert set(np.flatnonzero(whole >= least).tolist()) <= set(some.tolist())


def test_equal_rows_are_documents_of_their_own(spark):
    docs = spark.createDataFrame([(7, "alpha beta")] * 400 + [(None, "alpha beta")] * 3 + [(1, "gamma")] * 300, "doc_id long, text string").repartition(8)
    got = ranked.search(docs, spark.createDataFrame([(1, "Alpha")], "item_id long, text string")).collect()
    assert [(r.rank, r.doc_id) for r in sorted(got)] == [(i, 7) for i in range(1, 11)]


def brute_counts(text):
    t = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(zip(ws, ws[1:], ws[2:], strict=False))
    covered = {p for i in range(len(ws) - 2) if windows[tuple(ws[i : i + 3])] > 1 for p in range(i, i + 3)}
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), len(lines), len(set(ws))


def test_counts_equal_brute_force(spark):
    r = random.Random(3)
    texts = [t for _, t in rows()] + ["".join(r.choice(["a", "b", " ", "\n", "\x0b", "#", "é", "|", " ", "😀"]) for _ in range(r.randint(0, 200))) for _ in range(300)] + ["a b", "a b c", "a a a a", "\n\n", "x\r\nx\r\n"]
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")
    got = {r.doc_id: tuple(r)[1:8] for r in rules.counts(docs).collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute_counts(t), repr(t)


def test_judge(spark):
    good = [" ".join(f"Word{r.randint(0, 400)}" + ("." if i % 9 == 8 else "") for i in range(120)) for r in map(random.Random, range(200))]
    junk = ["### " + " ".join(w + "&&&" for w in t.split()) for t in good[:30]] + [t.upper().replace(" ", "!! ") for t in good[30:50]]
    texts = [*good, *junk, None, "", "a b c " * 50, "short text."]
    docs = spark.createDataFrame([(None if i == 3 else i // 2, t, True, 0.5) for i, t in enumerate(texts)], "doc_id long, text string, kept boolean, posterior double")
    got = rules.judge(docs)
    kept = Counter(r.kept for r in got.collect())
    assert kept == {True: len(good), False: len(texts) - len(good)}
    assert got.where("base_failed and kept").count() == 0 and got.where("base_failed").count() == 4
    assert rules.judge(docs.limit(0)).count() == 0
    assert rules.judge(docs.where("doc_id > 124")).where("kept").count() == 0  # nothing passes the base: no pattern to learn from


def brute_estimate(patterns, rounds):
    """Expectation-maximisation as it is written down, over rows of votes and their number."""
    share = lambda a, b: (a + 0.9) / (a + b + 1)
    of = lambda i, signs: sum(n for v, n in patterns if v[i] in signs)
    rare = [2 * of(i, [-1]) <= of(i, [-1, 1]) for i in range(len(patterns[0][0]))]
    q = [0.1 if any(x == -1 and y for x, y in zip(v, rare, strict=True)) else 0.9 for v, _ in patterns]
    for turn in range(rounds + 1):
        prior = min(max((sum(n * x for (_, n), x in zip(patterns, q, strict=True)) + 0.9) / (sum(n for _, n in patterns) + 1), 0.05), 0.95)
        found = []
        for i in range(len(patterns[0][0])):
            s = {(y, sign): sum(n * (x if y else 1 - x) for (v, n), x in zip(patterns, q, strict=True) if v[i] == sign) for y in (0, 1) for sign in (1, -1)}
            good = min(max(share(s[1, 1], s[1, -1]), 0.5), 0.999)
            found.append((good, min(max(share(s[0, -1], s[0, 1]), 1 - good), 0.999)))
        if turn < rounds:
            odds = [math.log(prior / (1 - prior)) + sum(math.log(a / (1 - b)) if x == 1 else math.log((1 - a) / b) if x == -1 else 0 for x, (a, b) in zip(v, found, strict=True)) for v, _ in patterns]
            q = [1 / (1 + math.exp(-o)) for o in odds]
    return prior, found


def test_estimate_equals_brute_force(spark):
    r = random.Random(11)
    data = [tuple(r.choice([1, 1, 1, 0, -1] if i < 3 else [1, 0, -1, -1, -1]) for i in range(4)) for _ in range(500)] + [(1, 1, 1, -1)] * 900 + [(-1, 1, 0, 1)] * 60
    df = spark.createDataFrame(data, "a int, b int, c int, d int")
    found = rules.estimate(df, ["a", "b", "c", "d"], 7).first().found
    prior, want = brute_estimate(sorted(Counter(data).items()), 7)
    assert found.prior == pytest.approx(prior, rel=1e-9)
    assert [(x.good, x.bad) for x in found.rules] == [pytest.approx(w, rel=1e-9) for w in want]


def test_rules_have_no_python(spark):
    plan = queries.QUERIES["op12_rules"](spark, D)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_remaindering_is_exact():
    r, source = random.Random(2), whitening.primes(20)
    used = [next(source) for _ in range(9)]
    for _ in range(50):
        want = np.array([[r.randint(-(10**52), 10**52) for _ in range(3)] for _ in range(3)], object)
        assert (whitening.remaindered({p: (want % p).astype(np.int64) for p in used}) == want).all()


def brute_fit(vectors):
    """n, S and the covariance as fractions of the distinct vectors."""
    x = sorted({tuple(math.floor(256 * c) for c in v) for v in vectors})
    n, s = len(x), [sum(c) for c in zip(*x, strict=True)]
    y = [[n * c - t for c, t in zip(v, s, strict=True)] for v in x]
    return n, s, [[Fraction(sum(v[i] * v[j] for v in y), n**3) for j in range(len(s))] for i in range(len(s))]


@pytest.mark.parametrize("scale", [1.0, 1e4, 1e9])
def test_whitening_equals_brute_force(spark, monkeypatch, scale):
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 7)
    r = random.Random(4)
    vectors = [[scale * (100 + r.gauss(0, 3)), scale * r.gauss(0, 2), scale * r.gauss(5, 1), scale * r.gauss(0, 0.5), r.gauss(0, 1)] for _ in range(60)]
    vectors += [vectors[0]] * 40
    bad = [None, [1.0, None, 2.0, 3.0, 4.0], [float("nan"), 1.0, 1.0, 1.0, 1.0], [1.0, float("inf"), 1.0, 1.0, 1.0], []]
    data = [(i if i else None, v, 1.5, 2) for i, v in enumerate([*vectors, *bad])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, whitened double, c0 int").repartition(5)
    model = whitening.train(df)
    n, s, v = brute_fit(vectors)
    fit = model.fits[5]
    assert fit.n == n and list(fit.sums) == s and set(model.fits) == {5}
    exact = np.array([[float(x) for x in row] for row in v])
    e, q = np.linalg.eigh(exact)
    assert np.allclose(fit.values, e[::-1], rtol=1e-9) and fit.trace == pytest.approx(float(sum(v[i][i] for i in range(5))), rel=1e-12)
    assert model.identity_error < 1e-6
    got = whitening.whiten(df, model).collect()
    assert len(got) == 4 * len(vectors) and all(r.c0 == 2 for r in got)
    for row in got:
        x = [math.floor(256 * c) for c in vectors[row.vec_id or 0]]
        y = [n * c - t for c, t in zip(x, s, strict=True)]
        assert int(row.deviation) == sum(c * c for c in y)
        k = row.component
        want = sum(float(Fraction(c, n)) * q[i, 5 - k] for i, c in enumerate(y)) / math.sqrt(e[5 - k])
        assert abs(abs(row.whitened) - abs(want)) < 1e-6 and row.explained == pytest.approx(e[5 - k] / e.sum(), rel=1e-6)


def test_whitening_of_few_and_mixed_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [1.0, 2.0, 3.0]), (4, [2.0, 2.0, 5.0]), (5, [0.0]), (6, [1e300])], "vec_id long, embedding array<double>")
    model = whitening.train(df)
    assert {d: f.n for d, f in model.fits.items()} == {2: 1, 3: 2, 1: 2}
    got = {(r.vec_id, r.component): r for r in whitening.whiten(df, model).collect()}
    assert len(got) == 2 + 2 + 3 + 3 + 1 + 1
    assert got[1, 1].whitened is None and got[1, 1].deviation == 0 and got[1, 1].explained == 0
    assert abs(got[3, 1].whitened) == pytest.approx(1) and got[3, 1].explained == pytest.approx(1) and got[3, 2].whitened is None
    assert model.identity_error < 1e-9
    none = whitening.train(df.limit(0))
    assert none.fits == {} and none.identity_error is None and whitening.whiten(df.limit(0), none).count() == 0
    zeros = df.select("vec_id", F.array(F.lit(0.0), F.lit(0.0)).alias("embedding"))
    assert whitening.train(zeros).identity_error is None

"""Fits over counted values against plain loops over the rows."""

from __future__ import annotations

import random

import numpy as np

from tenderloom.operators import fits


def _brute(values, k=3, rounds=50):
    x = np.array([0.0 if v is None else v for v in values])
    start = np.unique([x.min(), *np.quantile(x, [i / (k + 1) for i in range(1, k + 1)]), x.max()])
    c = start[:k] if len(start) >= k else np.linspace(x.min(), x.max(), k)
    for _ in range(rounds):
        near = np.abs(x[:, None] - c[None, :]).argmin(axis=1)
        new = np.array([x[near == i].mean() if (near == i).any() else c[i] for i in range(k)])
        moved, c = np.linalg.norm(new - c), new
        if moved <= 1e-4:
            break
    rank = {i: r for r, i in enumerate(sorted(range(k), key=lambda i: (not (near == i).any(), -c[i])))}
    return [1 - rank[i] / (k - 1) for i in near]


def _scores(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, impact double")
    return [r.score for r in fits.priorities(df).orderBy("i").collect()]


def test_priorities(spark):
    r = random.Random(0)
    for values in ([1.0, 2.0, 50.0, 51.0, 100.0, 101.0], [r.choice([None, 0.0, 5.0, 900.0, round(r.lognormvariate(5, 2), 2)]) for _ in range(400)], [0.0, 0.0, 0.0, 9.0], [7.0] * 50 + [8.0] * 2 + [9.0] * 1000):
        assert _scores(spark, values) == _brute(values)
    assert _scores(spark, [5.0, 5.0, 5.00001]) == [1.0] * 3 and _scores(spark, [None, 4.0]) == [0.0, 1.0] and _scores(spark, []) == []


def test_learned_weights_by_task_and_by_rounds(spark):
    r = random.Random(1)
    rows = [(round(r.random(), 1), r.choice([0.5, 1.0, None]), r.choice(["yes", "no", "?"])) for _ in range(300)]
    df = spark.createDataFrame(rows, "a double, b double, y string")
    x = np.array([(1, a, b) for a, b, y in rows if b is not None and y != "?"])
    y = np.array([float(y == "yes") for a, b, y in rows if b is not None and y != "?"])
    w = np.zeros(3)
    for _ in range(8):
        w -= 0.05 * x.T @ (1 / (1 + np.exp(-x @ w)) - y) / len(y)
    want = dict(zip("ab", abs(w[1:]) / abs(w[1:]).sum(), strict=True))
    for most in (10**6, 0):
        got = fits.learned_weights(df, ["a", "b"], "y", rounds=8, rows_of_task=most)
        assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert fits.learned_weights(df.limit(3), ["a", "b"], "y") == {"a": 0.5, "b": 0.5}
    assert fits.learned_weights(df.where("y = 'yes'"), ["a", "b"], "y") == {"a": 0.5, "b": 0.5}

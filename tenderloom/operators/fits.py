"""Iterated fits over statistics: the rows are read once, to distinct values with
their counts; the rounds are on those, not on the rows. Centres and weights, a
handful of numbers, go to the driver."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderloom.sources.shared import deleted, written

#: Distinct rows of a few numbers that one task takes for all rounds; beyond it, a round is an aggregate.
ROWS_OF_TASK = 200_000
_MONEY = "decimal(38,6)"


def _nearest(x: Column, centres: Sequence[float]) -> Column:
    """The place from 1 of the nearest centre, the first of equals."""
    away = F.array(*[F.abs(x - c) for c in centres])
    return F.array_position(away, F.array_min(away))


def priorities(impacts: DataFrame, k: int = 3, rounds: int = 50, tolerance: float = 1e-4) -> DataFrame:
    """impacts (impact) with a score of 0..1, 1 for the highest of k clusters.

    One-dimensional k-means from the least value, the inner quantiles (of k + 1
    equal parts) and the greatest, the first k of them that differ; with fewer, k
    evenly spaced ones. A null impact counts as 0. Impacts that are all about
    equal score 1; fewer than k rows score by rank. Empty clusters stay
    where they are and rank last.
    """
    value = F.coalesce(F.col("impact").cast("double"), F.lit(0.0))
    counts, path = written(impacts.groupBy(value.alias("x")).agg(F.count("*").alias("n")), "impacts")
    try:
        shares = [i / (k + 1) for i in range(1, k + 1)]
        seen = counts.agg(F.sum("n").alias("rows"), F.min("x").alias("low"), F.max("x").alias("high"), F.percentile("x", F.array(*map(F.lit, shares)), F.col("n")).alias("q")).first()
        if not seen.rows or seen.high - seen.low <= 1e-8 + 1e-5 * abs(seen.low):
            return impacts.withColumn("score", F.lit(1.0))
        if seen.rows < k:  # fewer than k rows
            order = [r.x for r in counts.orderBy(F.desc("x")).collect()]
            told = F.create_map(*[F.lit(v) for i, x in enumerate(order) for v in (x, 1 - i / max(1, seen.rows - 1))])
            return impacts.withColumn("score", told[value].cast("double"))
        start = sorted({seen.low, *seen.q, seen.high})
        centres = start[:k] if len(start) >= k else list(np.linspace(seen.low, seen.high, k))
        for _ in range(rounds):
            # Decimals, so that a mean doesn't hang on the order of rows.
            mean = (F.sum(F.col("x").cast(_MONEY) * F.col("n")).cast("double") / F.sum("n")).alias("m")
            moved = list(centres)
            got = counts.groupBy(_nearest(F.col("x"), centres).alias("c")).agg(mean).collect()  # k rows
            full = {r.c for r in got}
            for r in got:
                moved[r.c - 1] = r.m
            last, shift = centres, sum((a - b) ** 2 for a, b in zip(moved, centres, strict=True)) ** 0.5
            centres = moved
            if shift <= tolerance:
                break
    finally:
        deleted(impacts.sparkSession, path)
    rank = {i: r for r, i in enumerate(sorted(range(k), key=lambda i: (i + 1 not in full, -centres[i])))}
    score = F.element_at(F.array(*[F.lit(1 - rank[i] / (k - 1)) for i in range(k)]), _nearest(value, last).cast("int"))
    return impacts.withColumn("score", score)


def labelled(df: DataFrame, label: str) -> Column:
    """The label as a number: yes, true, preferred, y and 1 are 1; no, false, n and 0 are 0; other numbers stay."""
    text = F.lower(F.btrim(F.col(label).cast("string")))
    return F.when(text.isin("true", "yes", "preferred", "y"), 1.0).when(text.isin("false", "no", "n"), 0.0).otherwise(text.try_cast("double"))


def _step(w: np.ndarray, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The gradient's sum over rows that each stand for n."""
    return x.T @ (n * (1 / (1 + np.exp(-(x @ w))) - y))


def learned_weights(df: DataFrame, features: Sequence[str], label: str, rounds: int = 400, rate: float = 0.05, tolerance: float = 0.0, rows_of_task: int = ROWS_OF_TASK) -> dict[str, float]:
    """Shares of the absolute weights of a logistic regression by full-batch
    gradient descent from 0. Rows with a null or non-number are left out; fewer than
    6 of them, one class, or weights of 0: equal shares.

    Equal rows are one with a count. Up to `rows_of_task` of those, all rounds
    are one task's; of more, a round is an aggregate over them.
    """
    spark = df.sparkSession
    columns = [F.col(c).try_cast("double").alias(f"f{i}") for i, c in enumerate(features)]
    rows = df.select(*columns, labelled(df, label).alias("y")).na.drop()
    counts, path = written(rows.groupBy(*rows.columns).agg(F.count("*").alias("n")), "features")
    names = [f"f{i}" for i in range(len(features))]
    try:
        seen = counts.agg(F.count("*").alias("rows"), F.sum("n").alias("n"), F.countDistinct("y").alias("k")).first()
        if (seen.n or 0) < 6 or seen.k < 2:
            return {f: 1 / len(features) for f in features}
        if seen.rows <= rows_of_task:

            def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                every = pa.Table.from_batches(batches)
                if not every.num_rows:
                    return
                at = [every[c].to_numpy() for c in (*names, "y", "n")]
                x, y, n = np.column_stack([np.ones(every.num_rows), *at[:-2]]), at[-2], at[-1].astype(float)
                w = np.zeros(x.shape[1])
                for _ in range(rounds):
                    g = _step(w, x, y, n) / n.sum()
                    w -= rate * g
                    if np.linalg.norm(g) < tolerance:
                        break
                yield pa.RecordBatch.from_arrays([pa.array([w.tolist()])], ["w"])

            w = counts.coalesce(1).mapInArrow(fit, "w array<double>").first().w
        else:
            w = [0.0] * (len(names) + 1)
            for _ in range(rounds):
                z = sum((F.col(c) * v for c, v in zip(names, w[1:], strict=True)), F.lit(w[0]))
                error = F.col("n") * (1 / (1 + F.exp(-z)) - F.col("y"))
                g = [v / seen.n for v in counts.agg(F.sum(error), *[F.sum(error * F.col(c)) for c in names]).first()]
                w = [v - rate * d for v, d in zip(w, g, strict=True)]
                if sum(d * d for d in g) ** 0.5 < tolerance:
                    break
    finally:
        deleted(spark, path)
    every = sum(map(abs, w[1:]))
    return {f: abs(v) / every if every else 1 / len(features) for f, v in zip(features, w[1:], strict=True)}

"""What becomes of findings: keys, thresholds, duplicates, top ones, weights."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderloom.functions.columns import finding_key, total
from tenderloom.operators.fits import priorities  # noqa: F401  its place for callers
from tenderloom.operators.retrieval import first_n


def together(findings: list[DataFrame]) -> DataFrame:
    """One table with a reference id for each finding."""
    every = reduce(DataFrame.unionByName, findings)
    blank = lambda c: F.coalesce(c, F.lit(""))
    return every.withColumn("ref_id", finding_key(F.lit("P"), F.col("detector"), F.col("sources"), blank(F.col("supplier_id")), blank(F.col("item_id"))))


def above(findings: DataFrame, least: float) -> DataFrame:
    """Findings of at least that impact; a detector with none keeps its best,
    marked as relaxed. The best of each detector is aggregated, not windowed, so
    a detector with very many findings is no single task."""
    best = findings.groupBy("detector").agg(F.max("impact").alias("top"), F.min(F.struct((-F.col("impact")).alias("i"), "ref_id")).alias("b"))
    best = best.where(F.col("top") < least).select("detector", F.col("b.ref_id").alias("ref_id"))
    kept = findings.where(F.col("impact") >= least).withColumn("relaxed", F.lit(False))
    return kept.unionByName(findings.join(F.broadcast(best), ["detector", "ref_id"], "left_semi").withColumn("relaxed", F.lit(True)))


def top_of_each(findings: DataFrame, n: int = 2) -> DataFrame:
    """For each detector the n best findings of different suppliers; a finding
    is unique by (ref_id, supplier)."""
    one = findings.groupBy("detector", "supplier_id").agg(F.min(F.struct((-F.col("impact")).alias("i"), "ref_id", "item_id", "category")).alias("b"))
    rows = first_n(one, ["detector"], [F.col("b.i"), F.col("supplier_id")], n, "supplier_id").withColumnRenamed("rank", "position")
    return rows.select("detector", "position", "supplier_id", F.col("b.item_id").alias("item_id"), F.col("b.category").alias("category"), (-F.col("b.i")).alias("impact"), F.col("b.ref_id").alias("ref_id"))


def weighted(findings: DataFrame, risk: DataFrame, coverage: float = 0.0) -> DataFrame:
    """weight: the share of impact * (1 + risk) * (1 + coverage); shares sum to 1."""
    rows = findings.join(risk.select("supplier_id", "risk_score"), "supplier_id", "left")
    factor = F.greatest(F.col("impact"), F.lit(0.0)) * (1 + F.coalesce("risk_score", F.lit(0.0))) * (1 + coverage)
    rows = rows.withColumn("factor", factor)
    every = rows.agg(total(F.col("factor")).alias("all"))
    return rows.join(F.broadcast(every)).withColumn("weight", F.when(F.col("all") > 0, F.col("factor") / F.col("all")).otherwise(0.0)).drop("factor", "all", "risk_score")


def summary(findings: DataFrame) -> DataFrame:
    return findings.groupBy("detector").agg(F.count("*").alias("n_findings"), F.round(total(F.col("impact")), 2).alias("impact"), F.countDistinct("supplier_id").alias("n_suppliers"))


def leading_category(findings: DataFrame) -> DataFrame:
    """The category with the largest impact; nothing positive counts as 1."""
    worth = F.when(F.col("impact") > 0, F.col("impact")).otherwise(1.0)
    return findings.where("category is not null").groupBy("category").agg(F.round(total(worth), 2).alias("worth")).orderBy(F.desc("worth"), F.desc("category")).limit(1)


def with_feedback(findings: DataFrame, feedback: DataFrame) -> DataFrame:
    """findings with the latest feedback (ref_id, status, at) and `rejected`."""
    latest = feedback.groupBy("ref_id").agg(F.max_by("status", F.struct("at", "status")).alias("feedback"))
    return findings.join(latest, "ref_id", "left").withColumn("rejected", F.coalesce(F.lower("feedback") == "rejected", F.lit(False)))

"""Dispatches, responses and risk signals by key, in batch and as a stream.

Every function works on event time with an explicit as_of. The stream versions
use watermarks; what they yield over all input equals the batch version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tenderloom.operators.retrieval import first_n

LATE = "240 minutes"


def first_responses(events: DataFrame, key: str = "user_id") -> DataFrame:
    """The first response of each key: one aggregate, merged before the shuffle."""
    return events.groupBy(key).agg(F.min(F.struct("ts", "event_id")).alias("f"), F.count("*").alias("n_responses")).select(key, F.col("f.ts").alias("first_ts"), F.col("f.event_id").alias("event_id"), "n_responses")


def watermarked(events: DataFrame, late: str = LATE) -> DataFrame:
    """A stream whose rows may be that late."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def unique_stream(events: DataFrame, key: str = "event_id") -> DataFrame:
    """A watermarked stream without repeats of a key within the watermark."""
    return events.dropDuplicatesWithinWatermark([key])


def counts_by_window(events: DataFrame, width: str = "1 day") -> DataFrame:
    """event_type counts and sums in tumbling windows, of a batch or a
    watermarked stream."""
    g = events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum(F.col("value").cast("decimal(28,6)")).cast("double"), 2).alias("value"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "value")


def match_score(a: str = "d", b: str = "r") -> Column:
    """How well a response fits a dispatch: the same id, or subject, sender's
    domain, workflow and nearness in time; at most 1."""
    c = lambda x, y: F.coalesce(F.col(f"{a}.{x}") == F.col(f"{b}.{y}"), F.lit(False))
    near = F.abs(F.unix_micros(F.col(f"{b}.ts")) - F.unix_micros(F.col(f"{a}.ts"))) <= 72 * 3600 * 1_000_000
    soft = 0.4 * c("subject", "subject").cast("int") + 0.25 * c("domain", "domain").cast("int") + 0.3 * c("workflow_id", "workflow_id").cast("int") + 0.15 * F.coalesce(near, F.lit(False)).cast("int")
    return F.when(c("unique_id", "unique_id"), 1.0).otherwise(F.least(soft, F.lit(1.0)))


def match_responses(dispatches: DataFrame, responses: DataFrame, least: float = 0.45) -> DataFrame:
    """Each response with its best dispatch of the same workflow, if the score
    reaches `least`; ties by the dispatch's unique_id. Both: unique_id, workflow_id,
    subject, domain, ts (ts_ntz or timestamp); responses have response_id."""
    pairs = dispatches.alias("d").join(responses.alias("r"), F.col("d.workflow_id") == F.col("r.workflow_id"))
    scored = pairs.select(F.col("r.response_id").alias("response_id"), F.col("d.unique_id").alias("unique_id"), F.round(match_score(), 4).alias("score"))
    best = scored.where(F.col("score") >= least).groupBy("response_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "unique_id")).alias("b"))
    return best.select("response_id", F.col("b.unique_id").alias("unique_id"), (-F.col("b.s")).alias("score"))


def round_status(expected: DataFrame, arrived: DataFrame) -> DataFrame:
    """Per (workflow_id, round): expected, arrived and pending ids, completeness."""
    got = arrived.select("workflow_id", "round", "unique_id").distinct().withColumn("there", F.lit(1))
    rows = expected.select("workflow_id", "round", "unique_id").distinct().join(got, ["workflow_id", "round", "unique_id"], "left")
    g = rows.groupBy("workflow_id", "round").agg(F.count("*").alias("n_expected"), F.count("there").alias("n_arrived"))
    return g.withColumns({"n_pending": F.col("n_expected") - F.col("n_arrived"), "is_complete": F.col("n_expected") == F.col("n_arrived")})


def next_dispatch(events: DataFrame, dispatch: str, response: str, hours: int = 72, key: str = "user_id") -> DataFrame:
    """Every response with the last dispatch of its key at or before it, within
    the hours: an as-of join as a window over the union of both, one sort."""
    both = events.where(F.col("event_type").isin(dispatch, response))
    w = Window.partitionBy(key).orderBy("ts", F.when(F.col("event_type") == dispatch, 0).otherwise(1), "event_id").rowsBetween(Window.unboundedPreceding, -1)
    sent = F.when(F.col("event_type") == dispatch, F.struct("ts", "event_id"))
    rows = both.withColumn("d", F.last(sent, ignorenulls=True).over(w)).where(F.col("event_type") == response)
    gap = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("d.ts").cast("timestamp"))) / 3.6e9
    return rows.select(key, F.col("event_id").alias("response_id"), F.when(gap <= hours, F.col("d.event_id")).alias("dispatch_id"), F.when(gap <= hours, F.round(gap, 4)).alias("hours"))


def decayed_risk(signals: DataFrame, as_of: Column, half_life: float = 168.0, key: str = "user_id") -> DataFrame:
    """Severity (0..1) averaged with weights that halve every half_life hours;
    probability is the logistic of 8 * (x - 0.5)."""
    age = F.greatest((F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 3.6e9, F.lit(0.0))
    rows = signals.withColumn("w", F.pow(F.lit(0.5), age / half_life))
    exact = lambda c: F.sum(c.cast("decimal(28,14)")).cast("double")
    g = rows.groupBy(key).agg(F.count("*").alias("n_signals"), exact(F.col("severity") * F.col("w")).alias("a"), exact(F.col("w")).alias("b"))
    g = g.withColumn("risk", F.when(F.col("b") > 0, F.col("a") / F.col("b")).otherwise(0.0))
    return g.select(key, "n_signals", F.round("risk", 5).alias("risk"), F.round(1 / (1 + F.exp(-8 * (F.col("risk") - 0.5))), 5).alias("probability"))


def latest_signals(signals: DataFrame, n: int = 50, key: str = "user_id") -> DataFrame:
    """The n latest signals of each key with their position."""
    return first_n(signals, [key], [F.desc("ts"), F.desc("event_id")], n, "event_id").withColumnRenamed("rank", "position")


def ready_nodes(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Pending nodes (node, status) all of whose predecessors (source -> target)
    are completed or skipped."""
    open_ = nodes.where("status not in ('completed', 'skipped')").select(F.col("node").alias("source"))
    blocked = links.join(open_, "source", "left_semi").select(F.col("target").alias("node"))
    return nodes.where("status = 'pending'").join(blocked, "node", "left_anti").select("node")

"""State of a workflow's rounds: which answers are expected, here, pending or late.

A row registers an expected answer (kind `expected`) or is one (`arrived`). The first
answer counts, a registration anew brings a failed one back to waiting and leaves
an answered one as it is, and what waits at the deadline fails. The deadline is
`hours` after the round's latest registration. Answers that nobody expects, or before
they are, are left out.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

HOURS = 72
_STATE = "workflow_id string, round int, status string, n_expected long, n_completed long, pending array<string>, failed array<string>, suppliers array<string>, last_response timestamp"
_KEYS = ["workflow_id", "round"]


def rows_of(expected: DataFrame, arrived: DataFrame) -> DataFrame:
    """expected, arrived (workflow_id, round, unique_id, supplier_id, ts) as rows of one
    stream; those without workflow, round, id or time are left out."""
    def side(df: DataFrame, kind: str) -> DataFrame:
        text = lambda c: F.nullif(F.btrim(F.col(c).cast("string")), F.lit(""))
        return df.select(text("workflow_id").alias("workflow_id"), F.col("round").cast("int").alias("round"), F.lit(kind).alias("kind"), text("unique_id").alias("unique_id"), text("supplier_id").alias("supplier_id"), F.col("ts").cast("timestamp").alias("ts"))

    return side(expected, "expected").unionByName(side(arrived, "arrived")).where("workflow_id is not null and round is not null and unique_id is not null and ts is not null")


def states(rows: DataFrame, as_of, hours: int = HOURS) -> DataFrame:
    """The state of each (workflow_id, round) at a time, from a batch of `rows_of`.

    Per expected id, then per round, each one aggregate that combines before its
    shuffle; a round's own ids are in one row, as its state is.
    """
    seen = rows.where(F.col("ts") <= as_of)
    expects, comes = F.col("kind") == "expected", F.col("kind") == "arrived"
    first = seen.where(expects).groupBy(*_KEYS, "unique_id").agg(F.min("ts").alias("since"), F.max("ts").alias("again"))
    named = seen.where(F.col("supplier_id").isNotNull()).join(first.select(*_KEYS, "unique_id", "since"), [*_KEYS, "unique_id"]).where(F.col("ts") >= F.col("since"))
    named = named.groupBy(*_KEYS, "unique_id").agg(F.max_by("supplier_id", F.struct("ts", comes.alias("c"), "supplier_id")).alias("supplier_id"))
    came = seen.where(comes).join(first.select(*_KEYS, "unique_id", "since"), [*_KEYS, "unique_id"]).where(F.col("ts") >= F.col("since")).groupBy(*_KEYS, "unique_id").agg(F.min("ts").alias("answered"))
    ids = first.join(came, [*_KEYS, "unique_id"], "left").join(named, [*_KEYS, "unique_id"], "left")
    some = lambda c: F.array_sort(F.collect_set(c))
    waits = F.when(F.col("answered").isNull(), F.col("unique_id"))
    g = ids.groupBy(*_KEYS).agg(F.count("*").alias("n_expected"), F.count("answered").alias("n_completed"), some(waits).alias("open"), some("supplier_id").alias("suppliers"), F.max("answered").alias("last_response"), F.max("again").alias("latest"))
    over = (F.col("latest") + F.make_dt_interval(hours=F.lit(hours))) <= as_of
    none = F.array().cast("array<string>")
    g = g.withColumns({"pending": F.when(over, none).otherwise(F.col("open")), "failed": F.when(over, F.col("open")).otherwise(none)})
    status = F.when(F.size("open") == 0, "completed").when(over, "failed").otherwise("waiting")
    return g.select(*_KEYS, status.alias("status"), "n_expected", "n_completed", "pending", "failed", "suppliers", "last_response")


class Round:
    """The state of one round, as JSON between batches: of each id its supplier and time of answer."""

    def __init__(self, told: str | None = None):
        self.ids, self.latest, self.failed = json.loads(told) if told else ({}, None, False)

    def told(self) -> str:
        return json.dumps([self.ids, self.latest, self.failed])

    def take(self, kind: str, unique_id: str, supplier: str | None, at: int) -> bool:
        """Whether the row changes anything."""
        here = self.ids.get(unique_id)
        if kind == "arrived" and here is None:
            return False
        one = here or {"s": None, "a": None}
        self.ids[unique_id] = {"s": supplier or one["s"], "a": at if kind == "arrived" and one["a"] is None else one["a"]}
        if kind == "expected":
            self.latest, self.failed = max(at, self.latest or at), False
        return True

    def row(self, key: tuple) -> tuple:
        left = sorted(i for i, x in self.ids.items() if x["a"] is None)
        answered = [x["a"] for x in self.ids.values() if x["a"] is not None]
        status = "completed" if not left else "failed" if self.failed else "waiting"
        return (*key, status, len(self.ids), len(answered), [] if self.failed else left, left if self.failed else [], sorted({x["s"] for x in self.ids.values() if x["s"]}), pd.Timestamp(max(answered), unit="us") if answered else None)


def stream(rows: DataFrame, hours: int = HOURS, late: str = "1 hour") -> DataFrame:
    """The same over a stream of `rows_of`: the state of a round after each batch that
    changes it, and when the watermark passes its deadline. Equals `states` at the
    last time if rows come in order of time, registrations before answers."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        one = Round(state.get[0] if state.exists else None)
        if state.hasTimedOut:
            one.failed, changed = any(x["a"] is None for x in one.ids.values()), True
        else:
            every = pd.concat(list(frames)).sort_values(["ts", "kind"], ascending=[True, False], kind="stable")
            at = every["ts"].astype("datetime64[us]").astype("int64")
            blank = lambda x: None if pd.isna(x) else x
            changed = False
            for kind, i, supplier, t in zip(every["kind"], every["unique_id"], every["supplier_id"], at, strict=True):
                changed |= one.take(kind, i, blank(supplier), int(t))
        if one.ids:
            state.update((one.told(),))
            if not one.failed and any(x["a"] is None for x in one.ids.values()):
                state.setTimeoutTimestamp(max(one.latest // 1000 + hours * 3_600_000, state.getCurrentWatermarkMs() + 1))
        if changed and one.ids:
            yield pd.DataFrame([one.row(key)], columns=[c.split(" ")[0] for c in _STATE.split(", ")])

    timed = rows.withWatermark("ts", late)
    return timed.groupBy(*_KEYS).applyInPandasWithState(run, _STATE, "told string", "update", GroupStateTimeout.EventTimeTimeout)

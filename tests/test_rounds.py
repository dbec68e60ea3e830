"""Round states: rules, and the stream against the batch."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tenderloom.streaming import rounds

T0 = datetime(2024, 1, 1)
ROWS = "workflow_id string, round int, unique_id string, supplier_id string, ts timestamp"


def at(hours):
    return T0 + timedelta(hours=hours)


def _told(rows):
    return {(r.workflow_id, r.round): (r.status, r.n_expected, r.n_completed, r.pending, r.failed, r.suppliers, r.last_response) for r in rows}


def test_rules(spark):
    expected = [("w", 1, "a", "s1", at(0)), ("w", 1, "a", None, at(9)), ("w", 1, " b ", None, at(0)), ("v", 1, "c", "s", at(0)), ("v", 2, "c", "s", at(100)), ("u", 1, "d", None, at(0)), ("u", 1, "d", None, at(90)), (None, 1, "x", None, at(0)), ("q", 1, " ", None, at(0))]
    arrived = [("w", 1, "a", "s2", at(5)), ("w", 1, "a", "s3", at(7)), ("w", 1, "b", None, at(6)), ("v", 1, "zz", None, at(1)), ("v", 2, "c", None, at(1)), ("t", 1, "a", None, at(1))]
    rows = rounds.rows_of(spark.createDataFrame(expected, ROWS), spark.createDataFrame(arrived, ROWS))
    got = _told(rounds.states(rows, F.lit(at(120)).cast("timestamp")).collect())
    assert got == {
        ("w", 1): ("completed", 2, 2, [], [], ["s3"], at(6)),  # the first answer's time, the last name
        ("v", 1): ("failed", 1, 0, [], ["c"], ["s"], None),
        ("v", 2): ("waiting", 1, 0, ["c"], [], ["s"], None),  # an answer before it was asked for
        ("u", 1): ("waiting", 1, 0, ["d"], [], [], None),  # registered anew
    }
    assert rounds.states(rows.limit(0), F.lit(at(1)).cast("timestamp")).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    r = random.Random(3)
    expected = [(f"w{r.randrange(5)}", r.randrange(1, 3), f"u{r.randrange(8)}", r.choice(["s1", "s2", None]), at(r.randrange(200))) for _ in range(60)]
    arrived = [(f"w{r.randrange(5)}", r.randrange(1, 3), f"u{r.randrange(9)}", r.choice(["s3", None]), at(r.randrange(240) + 0.5)) for _ in range(60)]
    rows = rounds.rows_of(spark.createDataFrame(expected, ROWS), spark.createDataFrame(arrived, ROWS))
    rows = rows.unionByName(rounds.rows_of(spark.createDataFrame([("end", 1, "x", None, at(400)), ("full", 1, "x", "s", at(10))], ROWS), spark.createDataFrame([("full", 1, "x", None, at(200))], ROWS)))
    want = _told(rounds.states(rows, F.lit(at(400)).cast("timestamp")).collect())
    latest = {}
    for i, (low, high) in enumerate([(0, 60), (60, 150), (150, 260), (260, 500)]):
        rows.where((F.col("ts") >= F.lit(at(low))) & (F.col("ts") < F.lit(at(high)))).coalesce(1).write.parquet(f"{tmp_path}/s{i}")
        stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/s*")

        def keep(df, _):
            latest.update(_told(df.collect()))

        rounds.stream(stream).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
    assert latest == want and {x[0] for x in want.values()} == {"completed", "failed", "waiting"}

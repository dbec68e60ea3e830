"""Left joins of rows of which many have no key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def left_known(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """rows left-joined with known by `key`, a column of both, in either case as
    text. Nulls meet nothing; as keys of a shuffle they would all go to one task,
    so each has a made-up key of its own there."""
    own = F.concat(F.lit("\0"), F.monotonically_increasing_id().cast("string"))
    left = rows.withColumn("_left", F.coalesce(F.col(key).cast("string"), own)).withColumn("_has", F.col(key).isNotNull())
    right = known.where(F.col(key).isNotNull()).withColumn("_right", F.col(key).cast("string")).drop(key)
    return left.join(right, (F.col("_left") == F.col("_right")) & F.col("_has"), "left").drop("_left", "_right", "_has")

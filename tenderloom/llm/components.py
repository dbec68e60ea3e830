"""Connected components by alternating large and small stars.

Every round is joins and aggregations over the edges and ends in a written
table; nothing but two numbers for each round goes to the driver. The minimum
of a node's neighbours is aggregated before the shuffle and written before it is
joined back: a broadcast join while the nodes are few, else a join that Spark
splits at a node with very many neighbours (in the aggregate's stage it
couldn't). Tables of a round are deleted once the next one is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderloom.llm.common import cut, forget, small


#: Edges of a task at least, where there are fewer than the shuffle has partitions for.
EDGES = 50_000


def _few(df: DataFrame, n: int) -> DataFrame:
    """df of about n rows in no more tasks than they are worth."""
    parts = max(8, n // EDGES)
    return df.coalesce(parts) if parts < int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def _minima(pairs: DataFrame, n: int, name: str) -> DataFrame:
    """u, m: the smallest v of each u."""
    return cut(_few(pairs.groupBy("u").agg(F.min("v").alias("m")), n), name)


def _large_star(edges: DataFrame, n: int, name: str) -> tuple[DataFrame, DataFrame]:
    """The new edges, some of them repeated, and the table they are made with."""
    both = edges.union(edges.select("v", "u"))
    least = _minima(both, n, name)
    moved = both.join(small(least), "u").where("v > u")
    return moved.select(F.col("v").alias("u"), F.least("m", "u").alias("v")).where("u <> v"), least


def _small_star(edges: DataFrame, n: int, name: str) -> tuple[DataFrame, DataFrame]:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _minima(down, n, name)
    moved = down.join(small(least), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), least


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """edges (u long, v long) -> (node long, component long): each node of any
    edge, and the smallest node that it reaches. Loops, repeated edges and edges
    with a null are allowed; no edges give an empty table."""
    edges = edges.where("u is not null and v is not null")
    nodes = edges.where("u = v").select("u")
    edges = cut(edges.where("u <> v").select("u", "v"), name)
    before, n = None, edges.count()
    while True:
        large, first = _large_star(edges, n, name)
        after, second = _small_star(large, n, name)
        old, edges = edges, cut(_few(after, n), name)
        for done in (old, first, second):
            forget(done)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or now[0] == 0:
            break
        before, n = now, now[0]
    roots = edges.select("v").union(nodes).distinct().join(edges.select(F.col("u").alias("v")), "v", "left_anti")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("v", "v"))

"""Supplier ranking: roll-ups, scores on 0..10, weights, the first n."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tenderloom.functions.columns import total
from tenderloom.operators.fits import learned_weights  # noqa: F401  its place for callers


def order_summary(lines: DataFrame, orders: DataFrame) -> DataFrame:
    rows = lines.join(orders.select("po_id", "order_date"), "po_id", "left")
    return rows.groupBy("supplier_id").agg(F.round(total(F.col("line_total")), 2).alias("po_total"), F.countDistinct("po_id").alias("n_orders"), F.max("order_date").alias("last_order"), F.round(F.avg(F.datediff("ship_date", "order_date")), 4).alias("lead_days"))


def invoice_summary(invoices: DataFrame) -> DataFrame:
    term, paid = F.datediff("due_date", "invoice_date"), F.datediff("paid_date", "invoice_date")
    in_time = (F.col("paid_date") <= F.col("due_date")).cast("double")
    return invoices.groupBy("supplier_id").agg(F.round(total(F.col("invoice_amount")), 2).alias("invoice_total"), F.countDistinct("invoice_id").alias("n_invoices"), F.max("invoice_date").alias("last_invoice"), F.round(F.avg(term), 4).alias("term_days"), F.round(F.avg(paid), 4).alias("paid_days"), F.round(F.avg(in_time), 6).alias("on_time"))


def scores(df: DataFrame, directions: dict[str, str]) -> DataFrame:
    """<metric>_score on 0..10: min-max over all rows, `lower` or `higher` is
    better; equal values score 10, a null scores 0. The bounds are one aggregate,
    broadcast as a single row."""
    bounds = df.agg(*[f(c).alias(f"_{n}_{c}") for c in directions for n, f in (("lo", F.min), ("hi", F.max))])
    out = df.crossJoin(F.broadcast(bounds))
    for c, way in directions.items():
        lo, hi, x = F.col(f"_lo_{c}"), F.col(f"_hi_{c}"), F.col(c)
        share = (hi - x) / (hi - lo) if way == "lower" else (x - lo) / (hi - lo)
        out = out.withColumn(f"{c}_score", F.round(F.when(x.isNull(), 0.0).when(hi == lo, 10.0).otherwise(share * 10), 4))
    return out.drop(*bounds.columns)


def ranked(df: DataFrame, weights: dict[str, float], n: int, key: str = "supplier_id") -> DataFrame:
    """The n rows with the highest weighted mean of their scores, ties by key."""
    every = sum(weights.values())
    if not every:
        raise ValueError("weights sum to 0")
    final = sum((F.col(f"{c}_score") * (w / every) for c, w in weights.items()), F.lit(0.0))
    top = df.withColumn("final_score", F.round(final, 3)).orderBy(F.desc("final_score"), key).limit(n)
    return top.withColumn("rank_position", F.row_number().over(Window.orderBy(F.desc("final_score"), key)))  # over n rows


def category_profile(lines: DataFrame, products: DataFrame, n: int = 5) -> DataFrame:
    """Each supplier's primary category and its n products with most lines."""
    rows = lines.join(products.select("item_id", "category", "product"), "item_id")
    cat = rows.groupBy("supplier_id", "category").count().groupBy("supplier_id").agg(F.min(F.struct((-F.col("count")).alias("c"), "category")).alias("b"), F.count("*").alias("n_categories"))
    prod = rows.groupBy("supplier_id", "product").count()
    rank = F.row_number().over(Window.partitionBy("supplier_id").orderBy(F.desc("count"), "product"))
    top = prod.withColumn("k", rank).where(F.col("k") <= n).groupBy("supplier_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "product"))), lambda x: x["product"]), ",").alias("top_products"))
    return cat.join(top, "supplier_id").select("supplier_id", F.col("b.category").alias("primary_category"), "n_categories", "top_products")

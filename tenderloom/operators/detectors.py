"""Savings-opportunity detectors. Each takes tables and thresholds and gives
findings of one schema: detector, supplier_id, item_id, category, impact and
sources (ids the finding rests on). An impact is rounded to pence.

Group minima and counts are aggregates joined back, or windows over rows that
were aggregated first, so no raw line is in a window. Cheapest and leading
suppliers of equal figures are those of the smallest id. Dates are relative to
an explicit as_of.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderloom.functions.columns import MONEY, id_key, rounded, total

SCHEMA = ["detector", "supplier_id", "item_id", "category", "impact", "sources"]


def _finding(rows: DataFrame, detector: str, impact: Column, item: str | None = None, category: str | None = None, sources: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    return rows.select(
        F.lit(detector).alias("detector"), "supplier_id", (F.col(item) if item else none).alias("item_id"), (F.col(category) if category else none).alias("category"), rounded(impact).alias("impact"),
        (F.array(F.col("supplier_id")) if sources is None else sources).alias("sources"),
    )


def volume_discount(lines: DataFrame, min_quantity: float, min_spend: float, rate: float = 0.05) -> DataFrame:
    """Items bought in volume from one supplier: quantity or spend reaches the
    minimum. If none does, the largest spend alone is found."""
    g = _spend(lines).select("supplier_id", "item_id", "spend", "quantity")
    ok = (F.col("quantity") >= min_quantity) | (F.col("spend") >= min_spend)
    hits = g.where(ok)
    none = g.groupBy().agg(F.count_if(ok).alias("n"), F.min(F.struct((-F.col("spend")).alias("s"), "supplier_id", "item_id")).alias("b"))
    single = none.where("n = 0").where("b is not null").select("b.supplier_id", "b.item_id", (-F.col("b.s")).alias("spend"))
    return _finding(hits.select("supplier_id", "item_id", "spend").union(single), "volume_discount", F.col("spend") * rate, "item_id")


def supplier_consolidation(lines: DataFrame, products: DataFrame, min_spend: float, rate: float = 0.05) -> DataFrame:
    """In a category with several suppliers, all but the one that leads."""
    g = lines.join(products.select("item_id", "category"), "item_id").where("category is not null").groupBy("category", "supplier_id").agg(total(F.col("line_total")).alias("spend"))
    per = g.groupBy("category").agg(F.count("*").alias("n"), F.sum("spend").alias("all"), F.min(F.struct((-F.col("spend")).alias("s"), "supplier_id")).alias("b"))
    several = per.where((F.col("n") > 1) & (F.col("all") >= min_spend)).select("category", F.col("b.supplier_id").alias("_leads"))
    rows = g.join(several, "category").where(~F.col("supplier_id").eqNullSafe(F.col("_leads")))
    return _finding(rows, "supplier_consolidation", F.col("spend") * rate, category="category")


def _filled(lines: DataFrame) -> DataFrame:
    """Missing figures derived in turn: quantity, price, quantity 1, price from
    the value, value."""
    v, p, q = F.col("line_total"), F.col("unit_price"), F.col("quantity")
    out = lines.withColumn("quantity", F.coalesce(q, F.try_divide(v, p))).withColumn("unit_price", F.coalesce(p, F.try_divide(v, F.col("quantity"))))
    return out.withColumn("quantity", F.coalesce("quantity", F.lit(1.0))).withColumn("unit_price", F.coalesce("unit_price", v)).withColumn("line_total", F.coalesce(v, F.col("unit_price") * F.col("quantity")))


def complete_lines(lines: DataFrame) -> DataFrame:
    """Lines with their missing figures; rows without a positive price and quantity go."""
    return _filled(lines).where("unit_price > 0 and quantity > 0")


def pairs(lines: DataFrame) -> DataFrame:
    """The sums of each supplier and item that all detectors on lines need; they, and
    whatever sums lines, take this table for the lines. Money stays exact; the
    complete_ columns are of the complete lines alone."""
    own = lines.withColumn("_total", F.col("line_total").cast(MONEY)).withColumn("_quantity", F.col("quantity"))
    done = lambda c: F.when((F.col("unit_price") > 0) & (F.col("quantity") > 0), c)
    more = [F.max("ship_date").alias("ship_date")] if "ship_date" in lines.columns else []
    return _filled(own).groupBy("supplier_id", "item_id").agg(
        F.sum("_total").alias("line_total"), F.sum("_quantity").alias("quantity"), F.round(F.avg(done(F.col("unit_price"))), 6).alias("complete_price"), F.sum(done(F.col("quantity"))).alias("complete_quantity"),
        F.sum(done(F.col("line_total").cast(MONEY))).alias("complete_total"), *more,
    )


def _pairs(lines: DataFrame) -> DataFrame:
    return lines if "complete_price" in lines.columns else pairs(lines)


def _spend(lines: DataFrame) -> DataFrame:
    """supplier_id, item_id, spend, quantity."""
    return _pairs(lines).select("supplier_id", "item_id", F.coalesce(F.col("line_total").cast("double"), F.lit(0.0)).alias("spend"), "quantity")


def price_variance(lines: DataFrame, threshold: float) -> DataFrame:
    """Suppliers whose mean unit price of an item is more than `threshold` above
    the lowest mean of at least two suppliers."""
    g = complete_lines(lines).groupBy("item_id", "supplier_id").agg(F.round(F.avg("unit_price"), 6).alias("price"), F.sum("quantity").alias("quantity"))
    best = g.groupBy("item_id").agg(F.min("price").alias("best"), F.count("*").alias("n"))
    rows = g.join(best.where("n > 1"), "item_id").where((F.col("price") - F.col("best")) / F.col("best") > threshold)
    return _finding(rows, "price_variance", (F.col("price") - F.col("best")) * F.col("quantity"), "item_id")


def volume_consolidation(lines: DataFrame, min_spend: float) -> DataFrame:
    """What the other suppliers of an item cost more than its cheapest."""
    g = _pairs(lines).where("complete_price is not null").select("item_id", "supplier_id", F.col("complete_price").alias("price"), F.col("complete_quantity").alias("quantity"), F.coalesce(F.col("complete_total").cast("double"), F.lit(0.0)).alias("spend"))
    best = g.groupBy("item_id").agg(F.min(F.struct("price", "supplier_id")).alias("b"), F.count("*").alias("n"), F.sum("spend").alias("all"))
    rows = g.join(best.where((F.col("n") > 1) & (F.col("all") >= min_spend)), "item_id").where(F.col("supplier_id") != F.col("b.supplier_id"))
    rows = rows.withColumn("saved", (F.col("price") - F.col("b.price")) * F.col("quantity")).where("saved > 0")
    return _finding(rows, "volume_consolidation", F.col("saved"), "item_id")


def contract_expiry(contracts: DataFrame, as_of: Column, days: int = 90) -> DataFrame:
    left = F.datediff(F.col("contract_end_date"), as_of)
    return _finding(contracts.where((left >= 0) & (left <= days)), "contract_expiry", F.col("total_contract_value"), sources=F.array("contract_id"))


def contract_portfolio(contracts: DataFrame, as_of: Column, n: int = 3) -> DataFrame:
    """The suppliers with the largest contract portfolios, and their next end."""
    future = F.when(F.col("contract_end_date") >= as_of, F.col("contract_end_date"))
    g = contracts.groupBy("supplier_id").agg(total(F.col("total_contract_value")).alias("value"), F.countDistinct("contract_id").alias("n_contracts"), F.min(future).alias("next_end"))
    return g.select("supplier_id", F.round("value", 2).alias("value"), "n_contracts", "next_end").orderBy(F.desc("value"), "supplier_id").limit(n)


def supplier_risk(suppliers: DataFrame, threshold: float, weight: float = 1000.0) -> DataFrame:
    return _finding(suppliers.where(F.col("risk_score") >= threshold), "supplier_risk", F.col("risk_score") * weight)


def maverick_spend(orders: DataFrame, lines: DataFrame, contracts: DataFrame, suppliers: DataFrame, min_value: float) -> DataFrame:
    """Orders without a contract of a known supplier; the supplier is that of
    the order's largest share of lines."""
    known = contracts.join(suppliers.select("supplier_id"), "supplier_id", "left_semi").select(id_key(F.col("contract_id")).alias("_c")).distinct()
    loose = orders.where(F.col("total_amount") >= min_value).withColumn("_c", id_key(F.col("contract_id"))).join(known, "_c", "left_anti")
    share = lines.groupBy("po_id", "supplier_id").agg(total(F.col("line_total")).alias("v"))
    main = share.groupBy("po_id").agg(F.min(F.struct((-F.col("v")).alias("v"), "supplier_id")).alias("b")).select("po_id", F.col("b.supplier_id").alias("supplier_id"))
    return _finding(loose.join(main, "po_id", "left"), "maverick_spend", F.col("total_amount"), sources=F.array("po_id"))


def duplicate_supplier(lines: DataFrame, min_spend: float) -> DataFrame:
    """Items bought from several suppliers: the top spender, the item's spend."""
    g = _spend(lines).select("item_id", "supplier_id", "spend")
    per = g.groupBy("item_id").agg(F.count("*").alias("n"), F.sum("spend").alias("all"), F.min(F.struct((-F.col("spend")).alias("s"), "supplier_id")).alias("b"))
    rows = per.where((F.col("n") > 1) & (F.col("all") >= min_spend)).select("item_id", "all", F.col("b.supplier_id").alias("supplier_id"))
    return _finding(rows, "duplicate_supplier", F.col("all"), "item_id")


def category_overspend(invoice_lines: DataFrame, products: DataFrame, budgets: DataFrame) -> DataFrame:
    """Categories whose invoiced spend exceeds a positive budget (category, budget)."""
    g = invoice_lines.join(products.select("item_id", "category"), "item_id").groupBy("category", "supplier_id").agg(total(F.col("total_amount_incl_tax")).alias("spend"))
    per = g.groupBy("category").agg(F.sum("spend").alias("all"), F.min(F.struct((-F.col("spend")).alias("s"), "supplier_id")).alias("b"))
    rows = per.join(budgets.where("budget > 0"), "category").where(F.col("all") > F.col("budget")).select("category", F.col("b.supplier_id").alias("supplier_id"), (F.col("all") - F.col("budget")).alias("over"))
    return _finding(rows, "category_overspend", F.col("over"), category="category")


def inflation_passthrough(lines: DataFrame, invoice_lines: DataFrame, inflation: float, tolerance: float) -> DataFrame:
    """Invoice prices that rose above the order's by more than inflation allows."""
    po = lines.groupBy("supplier_id", "item_id").agg(F.round(F.avg("unit_price"), 6).alias("po_price"))
    inv = invoice_lines.groupBy("supplier_id", "item_id").agg(F.round(F.avg("unit_price"), 6).alias("price"), F.sum("quantity").alias("quantity"))
    rows = inv.join(po.where("po_price > 0"), ["supplier_id", "item_id"]).where((F.col("price") - F.col("po_price")) / F.col("po_price") > inflation + tolerance)
    quantity = F.when(F.col("quantity") > 0, F.col("quantity")).otherwise(1.0)
    return _finding(rows, "inflation_passthrough", (F.col("price") - F.col("po_price")) * quantity, "item_id")


def unused_contract_value(contracts: DataFrame, invoices: DataFrame, min_value: float) -> DataFrame:
    """Contract value that the supplier's invoices don't reach."""
    spent = invoices.groupBy("supplier_id").agg(total(F.col("invoice_amount")).alias("spent"))
    left = F.col("total_contract_value") - F.coalesce("spent", F.lit(0.0))
    return _finding(contracts.join(spent, "supplier_id", "left").withColumn("left_over", left).where(F.col("left_over") >= min_value), "unused_contract_value", F.col("left_over"), sources=F.array("contract_id"))


def supplier_performance(invoices: DataFrame, threshold: float, penalty: float = 1000.0) -> DataFrame:
    """Suppliers whose share of invoices in time is below the threshold; sources
    are the five worst invoices."""
    done = F.coalesce("paid_date", "invoice_date")
    late = F.datediff(done, F.col("due_date"))
    rows = invoices.where("due_date is not null").select("supplier_id", "invoice_id", F.greatest(late, F.lit(0)).alias("late"))
    worst = F.slice(F.sort_array(F.collect_list(F.when(F.col("late") > 0, F.struct((-F.col("late")).alias("l"), "invoice_id")))), 1, 5)
    # five of each (supplier, bucket) first, so that no list grows with a supplier
    part = rows.withColumn("b", F.pmod(F.xxhash64("invoice_id"), F.lit(256))).groupBy("supplier_id", "b").agg(F.count("*").alias("n"), F.count_if(F.col("late") > 0).alias("late"), worst.alias("w"))
    g = part.groupBy("supplier_id").agg(F.sum("n").alias("n"), F.sum("late").alias("late"), F.slice(F.sort_array(F.flatten(F.collect_list("w"))), 1, 5).alias("w"))
    g = g.withColumn("score", F.round(1 - F.col("late") / F.col("n"), 6)).where(F.col("score") < threshold)
    return _finding(g, "supplier_performance", (threshold - F.col("score")) * penalty, sources=F.transform("w", lambda x: x["invoice_id"]))


def esg_opportunity(scores: DataFrame, threshold: float) -> DataFrame:
    """(supplier_id, score, incumbent_score): at least the threshold, and better."""
    return _finding(scores.where((F.col("score") >= threshold) & (F.col("score") > F.coalesce("incumbent_score", F.lit(0.0)))), "esg_opportunity", (F.col("score") - F.coalesce("incumbent_score", F.lit(0.0))) * 1000)

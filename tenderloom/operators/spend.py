"""Spend roll-ups, supplier resolution and currency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderloom.functions.columns import alias_key, id_key, price_of, quantity_of, rounded, total
from tenderloom.operators.joins import left_known

#: Pounds for a unit of currency where no rate table is given.
DEFAULT_RATES = {"GBP": 1.0, "USD": 0.79}


def supplier_spend(suppliers: DataFrame, po_lines: DataFrame, invoice_lines: DataFrame) -> DataFrame:
    """Every supplier with its ordered and invoiced spend. Both sides are
    aggregated by supplier before they meet the master."""
    po = po_lines.groupBy("supplier_id").agg(total(price_of(po_lines) * quantity_of(po_lines)).alias("po_spend"))
    inv = invoice_lines.groupBy("supplier_id").agg(total(price_of(invoice_lines) * quantity_of(invoice_lines)).alias("invoice_spend"), F.countDistinct("invoice_id").alias("invoice_count"))
    out = suppliers.join(po, "supplier_id", "left").join(inv, "supplier_id", "left")
    a, b = F.coalesce("po_spend", F.lit(0.0)), F.coalesce("invoice_spend", F.lit(0.0))
    return out.select("supplier_id", "supplier_name", F.round(a, 2).alias("po_spend"), F.round(b, 2).alias("invoice_spend"), F.round(a + b, 2).alias("total_spend"), F.coalesce("invoice_count", F.lit(0)).alias("invoice_count"))


def top_spend(rows: DataFrame, key: str, amount: str, n: int = 10) -> DataFrame:
    """The n largest sums, ties by key."""
    return rows.groupBy(key).agg(F.round(total(F.col(amount)), 2).alias("spend"), F.count("*").alias("n_rows")).orderBy(F.desc("spend"), key).limit(n)


def top_risk(suppliers: DataFrame, n: int = 10) -> DataFrame:
    return suppliers.select("supplier_id", "supplier_name", "risk_score").orderBy(F.desc_nulls_last("risk_score"), "supplier_id").limit(n)


def resolve_headers(headers: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Headers with the supplier's name, by id; the header's own name is the
    fallback where it has one."""
    master = suppliers.select(id_key(F.col("supplier_id")).alias("_k"), F.col("supplier_name").alias("_name"))
    own = F.col("supplier_name") if "supplier_name" in headers.columns else F.lit(None).cast("string")
    return headers.withColumn("_k", id_key(F.col("supplier_id"))).join(master, "_k", "left").withColumn("supplier_name", F.coalesce("_name", own)).drop("_k", "_name")


def resolve_names(names: DataFrame, suppliers: DataFrame, name: str = "name") -> DataFrame:
    """names with supplier_id: by the exact id, else by the alias key of the
    name; the smallest id of equal keys."""
    by_id = suppliers.select(id_key(F.col("supplier_id")).alias("_i"), F.col("supplier_id").alias("_by_id"))
    by_alias = suppliers.groupBy(alias_key(F.col("supplier_name")).alias("_a")).agg(F.min("supplier_id").alias("_by_alias"))
    out = names.withColumn("_i", id_key(F.col(name))).withColumn("_a", alias_key(F.col(name)))
    out = out.join(by_id, "_i", "left").join(by_alias, "_a", "left")
    return out.withColumn("supplier_id", F.coalesce("_by_id", "_by_alias")).drop("_i", "_a", "_by_id", "_by_alias")


def procurement_flow(suppliers: DataFrame, contracts: DataFrame, orders: DataFrame, lines: DataFrame, invoices: DataFrame) -> DataFrame:
    """Per supplier: orders, lines, contracts and invoices that hang together.
    An order's supplier is that of its lines, else of its contract."""
    by_contract = contracts.select("contract_id", F.col("supplier_id").alias("_c"))
    heads = left_known(orders.select("po_id", "contract_id"), by_contract, "contract_id").select("po_id", "_c")
    flow = heads.join(lines.select("po_id", "supplier_id", "line_total"), "po_id", "left").withColumn("supplier_id", F.coalesce("supplier_id", "_c"))
    per = flow.groupBy("supplier_id").agg(F.countDistinct("po_id").alias("n_orders"), F.count("line_total").alias("n_lines"), F.round(total(F.col("line_total")), 2).alias("spend"))
    inv = invoices.groupBy("supplier_id").agg(F.count("*").alias("n_invoices"))
    con = contracts.groupBy("supplier_id").agg(F.countDistinct("contract_id").alias("n_contracts"))
    out = suppliers.select("supplier_id").join(per, "supplier_id", "left").join(inv, "supplier_id", "left").join(con, "supplier_id", "left")
    return out.select("supplier_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_orders", "n_lines", "n_invoices", "n_contracts")], F.coalesce("spend", F.lit(0.0)).alias("spend"))


def rate_of(currency: Column, rates: dict[str, float]) -> Column:
    """Pounds for a unit; an unknown currency counts as pounds."""
    table = F.create_map(*[x for k, v in sorted(rates.items()) for x in (F.lit(k), F.lit(float(v)))])
    return F.coalesce(F.try_element_at(table, F.upper(F.btrim(currency))), F.lit(1.0))


def in_pounds(df: DataFrame, amounts: list[str], rates: dict[str, float] | None = None, currency: str = "currency") -> DataFrame:
    """df with <amount>_gbp and <amount>_usd; a null amount counts as 0."""
    rates = DEFAULT_RATES | (rates or {})
    for a in amounts:
        gbp = F.coalesce(F.col(a), F.lit(0.0)) * rate_of(F.col(currency), rates)
        df = df.withColumns({f"{a}_gbp": rounded(gbp), f"{a}_usd": rounded(gbp / rates["USD"])})
    return df


def cheaper_suppliers(po_lines: DataFrame, invoice_lines: DataFrame) -> DataFrame:
    """For each item bought at a supplier's lowest price, the cheapest supplier
    and what is cheaper; rows already at the lowest price are left out."""
    both = po_lines.select("item_id", "supplier_id", "unit_price").union(invoice_lines.select("item_id", "supplier_id", "unit_price"))
    own = both.where("unit_price > 0").groupBy("item_id", "supplier_id").agg(F.min("unit_price").alias("price"))
    best = own.groupBy("item_id").agg(F.min(F.struct("price", "supplier_id")).alias("b"))
    out = own.join(best, "item_id").where(F.col("price") > F.col("b.price"))
    return out.select("item_id", "supplier_id", rounded(F.col("price"), 4).alias("price"), F.col("b.supplier_id").alias("best_supplier_id"), rounded(F.col("b.price"), 4).alias("best_price"))


def approvals(orders: DataFrame, amount: str, thresholds: DataFrame | None = None, default: float = 10000.0) -> DataFrame:
    """decision: approve up to the supplier's threshold (else the default)."""
    if thresholds is not None:
        orders = orders.join(thresholds.select("supplier_id", "threshold"), "supplier_id", "left")
    limit = F.coalesce("threshold", F.lit(default)) if thresholds is not None else F.lit(default)
    return orders.withColumn("decision", F.when(F.col(amount) <= limit, "approve").otherwise("escalate"))

"""The procurement tables: an adapter from star-schema Parquet, readers with an
empty fallback, and keyed sinks.

The adapter only renames and derives; every table is lazy, so Catalyst prunes
columns and pushes filters into the scans. Lines carry their own supplier.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tenderloom.functions.columns import total


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The Parquet table, or an empty one of the schema where none is there."""
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:  # only a missing path
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def contracts_of(po_lines: DataFrame) -> DataFrame:
    """A contract of each supplier, from its lines or sums of them."""
    spend = po_lines.groupBy("supplier_id").agg(total(F.col("line_total")).alias("spend"), F.max("ship_date").alias("last"))
    return spend.select(F.concat(F.lit("C-"), "supplier_id").alias("contract_id"), "supplier_id", F.round(F.col("spend") * 1.2, 2).alias("total_contract_value"), F.date_add("last", (F.col("supplier_id").cast("long") * 7 % 400).cast("int")).alias("contract_end_date"))


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def suppliers(self) -> DataFrame:
        nation = self.raw("nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("country"))
        return self.raw("supplier").join(nation, "s_nationkey", "left").select(F.col("s_suppkey").cast("string").alias("supplier_id"), F.col("s_name").alias("supplier_name"), "country", F.round((F.col("s_acctbal") + 1000) / 11000, 4).alias("risk_score"))

    @cached_property
    def po_lines(self) -> DataFrame:
        return self.raw("lineitem").select(
            F.col("l_orderkey").cast("string").alias("po_id"), F.col("l_suppkey").cast("string").alias("supplier_id"), F.col("l_partkey").cast("string").alias("item_id"), F.col("l_quantity").alias("quantity"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"), F.col("l_extendedprice").alias("line_total"), F.to_date("l_shipdate").alias("ship_date"),
        )

    @cached_property
    def purchase_orders(self) -> DataFrame:
        key = F.col("o_orderkey")
        contract = F.when(key % 7 != 0, F.concat(F.lit("C-"), (key % 1200).cast("string")))
        currency = F.element_at(F.array(*map(F.lit, ("GBP", "USD", "EUR"))), (key % 3 + 1).cast("int"))
        return self.raw("orders").select(key.cast("string").alias("po_id"), F.to_date("o_orderdate").alias("order_date"), F.col("o_totalprice").alias("total_amount"), F.col("o_orderstatus").alias("po_status"), contract.alias("contract_id"), currency.alias("currency"))

    @cached_property
    def invoice_lines(self) -> DataFrame:
        net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
        return self.raw("lineitem").where("l_linestatus = 'F'").select(
            F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_suppkey").cast("string")).alias("invoice_id"), F.col("l_orderkey").cast("string").alias("po_id"), F.col("l_suppkey").cast("string").alias("supplier_id"), F.col("l_partkey").cast("string").alias("item_id"),
            F.col("l_quantity").alias("quantity"), (net / F.col("l_quantity")).alias("unit_price"), net.alias("line_amount"), (net * (1 + F.col("l_tax"))).alias("total_amount_incl_tax"), F.to_date("l_shipdate").alias("ship_date"),
        )

    @cached_property
    def invoices(self) -> DataFrame:
        rows = self.invoice_lines.groupBy("invoice_id", "po_id", "supplier_id").agg(total(F.col("total_amount_incl_tax")).alias("invoice_amount"), F.max("ship_date").alias("invoice_date"))
        late = (F.col("po_id").cast("long") % 45).cast("int")
        return rows.select("*", F.date_add("invoice_date", 30).alias("due_date"), F.date_add("invoice_date", late).alias("paid_date"))

    @cached_property
    def contracts(self) -> DataFrame:
        return contracts_of(self.po_lines)

    @cached_property
    def products(self) -> DataFrame:
        return self.raw("part").select(F.col("p_partkey").cast("string").alias("item_id"), F.col("p_name").alias("product"), F.col("p_type").alias("category"), F.col("p_brand").alias("brand"))

    @property
    def quote_id(self) -> Column:
        """A quote's id, by columns po_id and supplier_id."""
        return F.concat_ws("-", F.lit("Q"), "po_id", "supplier_id")

    @cached_property
    def quotes(self) -> DataFrame:
        key = F.col("po_id").cast("long")
        terms = F.element_at(F.array(*map(F.lit, ("Net 30", "Net 60", "immediate", "45 days"))), (key % 4 + 1).cast("int"))
        rows = self.po_lines.groupBy("po_id", "supplier_id").agg(total(F.col("line_total")).alias("total_cost"), F.count("*").alias("n_lines"))
        status = self.purchase_orders.select("po_id", (F.col("po_status") == "F").alias("awarded"), "currency", "order_date")
        return rows.join(status, "po_id").select(self.quote_id.alias("quote_id"), "po_id", "supplier_id", "total_cost", "n_lines", "awarded", "currency", F.col("order_date").alias("quote_date"), (key % 30 + 5).cast("int").alias("lead_days"), terms.alias("payment_terms"))


def latest_by_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row for each key: the first in the order, which must be total."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def upsert_by_key(old: DataFrame, new: DataFrame, keys: list[str], order: list, update: bool = True) -> DataFrame:
    """Rows of new replace those of old with the same key (update=False: old ones
    stay). Among rows of one side the first in the order counts."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    first = F.desc("_new") if update else F.asc("_new")
    return latest_by_key(both, keys, [first, *order]).drop("_new")


def write_findings(findings: DataFrame, path: str) -> None:
    """A folder of JSON lines for each detector."""
    findings.write.partitionBy("detector").mode("overwrite").json(path)


def split_valid(df: DataFrame, checks: dict) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and invalid ones with the names of the checks that fail."""
    failed = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]), lambda x: x.isNotNull())
    marked = df.withColumn("errors", failed)
    return marked.where(F.size("errors") == 0).drop("errors"), marked.where(F.size("errors") > 0)

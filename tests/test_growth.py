"""Steps whose work in one task must not grow with the table."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tenderloom.operators import chunking, detectors, enrich, flows, joins, policies, reports, resolution
from tenderloom.plans import more as contexts
from tenderloom.plans import queries
from tenderloom.sources.tables import Tables


@pytest.fixture
def shuffled(spark):
    """Joins shuffle, and partitions stay as they are dealt."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    for k, v in kept.items():
        spark.conf.set(k, v)


def largest_share(df):
    """Of the rows, those in the fullest partition."""
    n = Counter(r.p for r in df.withColumn("p", F.spark_partition_id()).collect())
    return max(n.values()) / sum(n.values())


def test_documents_without_an_order_are_dealt_out(shuffled):
    docs = shuffled.range(4000).select("id", F.when(F.col("id") % 4 == 0, "Invoice").otherwise("Quote").alias("doc_type"), F.create_map(F.lit("po_id"), F.col("id").cast("string")).alias("header"), F.array(F.struct(F.lit("x").alias("item_description"))).alias("lines"), F.lit("t").alias("text"))
    out = reports.quality_report(docs, shuffled.range(0, 4000, 8).select(F.col("id").alias("po_id")))
    assert out.where(F.array_contains("warnings", "order")).count() == 500 and out.count() == 4000
    assert largest_share(out) < 0.3


def test_messages_that_answer_none_are_dealt_out(shuffled):
    k = F.col("id")
    messages = shuffled.range(4000).select(k.cast("string").alias("message_id"), F.when(k % 4 == 1, "PROC-WF-ABCDE1").alias("subject"), F.lit("").alias("body"), F.when(k % 4 == 0, k.cast("string")).when(k % 4 == 1, "0").alias("in_reply_to"))
    out = enrich.message_ids(messages, shuffled.range(0, 4000, 8).select(k.cast("string").alias("message_id"), F.lit("proc-wf-t9").alias("unique_id")))
    assert Counter(r.unique_id for r in out.collect()) == {"PROC-WF-ABCDE1": 1000, "PROC-WF-T9": 500, None: 2500}
    assert largest_share(out) < 0.3


def relations(df, column):
    """How often the plan reads the table with that column."""
    return sum("Relation" in x and f"{column}#" in x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines())


def test_findings_read_the_lines_once_for_orders_and_once_for_invoices(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    found = queries.all_findings(t)
    assert relations(found, "l_orderkey") <= 1  # the invoices; the sums are written
    assert relations(queries.written_findings(t), "l_orderkey") == 0


def test_detectors_find_the_same_in_lines_and_in_their_sums(spark):
    rows = [("s1", "i1", 10.0, None, 30.0, "a"), ("s1", "i1", None, 2.0, 4.0, "b"), ("s2", "i1", 5.0, 1.0, 5.0, "c"), ("s2", "i2", -1.0, 9.0, None, "d"), ("s3", "i2", 0.0, 0.0, None, "e"), ("s3", None, 4.0, 4.0, 16.0, "f"), (None, "i2", 1.0, 1.5, 1.5, "g")]
    lines = spark.createDataFrame(rows, "supplier_id string, item_id string, quantity double, unit_price double, line_total double, po_id string")
    products = spark.createDataFrame([("i1", "c"), ("i2", "c")], "item_id string, category string")
    for detect in (lambda x: detectors.volume_discount(x, 10, 20), lambda x: detectors.volume_discount(x, 1e9, 1e9), lambda x: detectors.supplier_consolidation(x, products, 1), lambda x: detectors.volume_consolidation(x, 1), lambda x: detectors.duplicate_supplier(x, 1)):
        plain, summed = (sorted(map(str, detect(x).collect())) for x in (lines, detectors.pairs(lines)))
        assert plain == summed and plain


def test_chunks_leave_a_worker_in_small_batches():
    """A batch of long texts is not held as one batch of chunks."""
    batch = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array(["A sentence of words. " * 5000] * 40)], ["doc_id", "text"])
    out = list(chunking._cut(iter([batch]), ["doc_id", "chunk", "content"], 1800, 200))
    sizes = [sum(map(len, b.column("content").to_pylist())) for b in out]
    assert sum(sizes) > 4_000_000 and max(sizes) < chunking.AT_ONCE + 200_000
    assert [x for b in out for x in b.column("doc_id").to_pylist()] == sorted(x for b in out for x in b.column("doc_id").to_pylist())


def test_passages_of_contexts_are_cut_once(spark):
    found = contexts.QUERIES["contexts_of_passages"](spark, "/root/testdata/sf0.001")
    assert "MapInArrow" not in found._jdf.queryExecution().optimizedPlan().toString()  # they are written
    assert "ArrowEvalPython" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_orders_without_a_contract_are_dealt_out(shuffled):
    k = F.col("id").cast("string")
    orders = shuffled.range(4000).select(k.alias("po_id"), F.when(F.col("id") % 4 == 0, F.concat(F.lit("C"), k)).alias("contract_id"))
    contracts = shuffled.range(0, 4000, 8).select(F.concat(F.lit("C"), k).alias("contract_id"), F.concat(F.lit("S"), k).alias("supplier_id"))
    out = joins.left_known(orders, contracts, "contract_id")
    assert out.where("supplier_id is not null").count() == 500 and out.count() == 4000
    assert largest_share(out) < 0.3


def test_flow_rows_deal_rows_by_orders_and_items_only(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    plan = resolution.flow_rows(t.suppliers, t.contracts, t.purchase_orders, t.po_lines, t.invoices, t.invoice_lines, t.products)._jdf.queryExecution().optimizedPlan().toString()
    # The invoices' lines stand below the join with the orders' lines.
    depth = lambda text: min(len(x) - len(x.lstrip(" :+-")) for x in plan.splitlines() if "Join LeftOuter" in x and text in x)
    assert depth("invoice_id") > depth("po_id")


def test_details_of_a_policy_are_parsed_once(spark):
    rows = spark.createDataFrame([(1, None, None, '{"policy_name": "A b", "rules": {"name": "R1"}}', None, None)], "policy_id int, policy_name string, policy_desc string, policy_details string, policy_linked_agents string, policy_status int")
    out = policies.policy_rows(rows)
    assert [(r.slug, r.identifier, r.aliases) for r in out.collect()] == [("a_b", "1", ["1", "a_b", "r_1"])]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("to_json") + plan.count("structstojson") <= 1


@pytest.fixture
def odd_tables(spark, tmp_path):
    """Orders that repeat, lines without an order, a supplier or any, and repeated lines."""
    made = {
        "lineitem": ([(1, 1, 1, "F"), (1, 1, 1, "F"), (1, 2, 1, "O"), (2, None, 2, "F"), (None, 2, 2, "F"), (None, None, 3, "F"), (9, 1, 3, "F"), (3, 7, None, "O")], "l_orderkey long, l_suppkey long, l_partkey long, l_linestatus string"),
        "orders": ([(1,), (1,), (2,), (3,), (None,)], "o_orderkey long"),
        "supplier": ([(1, 0), (2, 0), (2, 0), (None, 0)], "s_suppkey long, s_nationkey int"),
        "part": ([(1,), (1,), (None,)], "p_partkey long"),
        "nation": ([(0, "n")], "n_nationkey int, n_name string"),
    }
    more = {"lineitem": "*, 1.0D l_quantity, 2.0D l_extendedprice, 0.0D l_discount, 0.0D l_tax, timestamp'2020-01-01' l_shipdate", "orders": "*, timestamp'2020-01-01' o_orderdate, 1.0D o_totalprice, 'F' o_orderstatus", "supplier": "*, 's' s_name, 1.0D s_acctbal", "part": "*, 'p' p_name, 't' p_type, 'b' p_brand", "nation": "*"}
    for name, (rows, schema) in made.items():
        spark.createDataFrame(rows, schema).selectExpr(*more[name].split(", ")).write.parquet(f"{tmp_path}/{name}.parquet")
    return Tables(spark, str(tmp_path))


def test_vertices_and_edges_are_those_of_the_whole_tables(odd_tables):
    t = odd_tables
    of = {"Supplier": (t.suppliers, "supplier_id"), "Contract": (t.contracts, "contract_id"), "PurchaseOrder": (t.purchase_orders, "po_id"), "Invoice": (t.invoices, "invoice_id"), "Quote": (t.quotes, "quote_id"), "Item": (t.products, "item_id")}
    want = Counter((label, r[0]) for label, (df, key) in of.items() for r in df.select(key).where(f"{key} is not null").distinct().collect())
    assert Counter(map(tuple, flows.vertices(t).collect())) == want
    known = t.suppliers.select("supplier_id")
    want = {
        "BILLS": t.invoices.join(t.purchase_orders, "po_id", "left_semi").select("invoice_id", "po_id"),
        "QUOTED": t.quotes.join(known, "supplier_id", "left_semi").select("supplier_id", "quote_id"),
        "RECEIVED": t.po_lines.select("supplier_id", "po_id").distinct().join(known, "supplier_id", "left_semi"),
        "CONTAINS": t.po_lines.select("po_id", "item_id").distinct(),
    }
    got = Counter(map(tuple, flows.edges(t).where(F.col("kind").isin(*want)).collect()))
    assert got == Counter((kind, *r) for kind, df in want.items() for r in df.collect())


def test_keys_of_the_graph_are_dealt_out_by_their_number(shuffled, monkeypatch):
    """However few partitions shuffles have, and no task of a scan gathers keys of lines."""
    monkeypatch.setattr(flows, "ROWS_OF_TASK", 500, raising=False)
    kept = shuffled.conf.get("spark.sql.shuffle.partitions")
    shuffled.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        found = flows.vertices(Tables(shuffled, "/root/testdata/sf0.001"))
        rows = Counter(r.p for r in found.withColumn("p", F.spark_partition_id()).collect())
    finally:
        shuffled.conf.set("spark.sql.shuffle.partitions", kept)
    assert max(rows.values()) < 1000 < sum(rows.values())

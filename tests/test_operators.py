"""Outcomes of operators on small fixtures, with nulls, ties and empty tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tenderloom.functions import columns as C
from tenderloom.operators import detectors, findings, quotes, ranking, records, retrieval, spend
from tenderloom.sources.tables import read_or_empty, split_valid, upsert_by_key
from tenderloom.streaming import events


def values(spark, expression, texts):
    return [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string").orderBy("i").select(expression).collect()]


def test_numbers_in_text(spark):
    assert values(spark, C.clean_number(F.col("x")), ["1,234.50", "Tax (20%) 150", "(30)", "-5", "none", None]) == [1234.5, 20.0, -30.0, 5.0, None, None]


def test_terms(spark):
    days = C.terms_days(F.col("x"))
    assert values(spark, days, ["Net 30", "immediate payment", "within 45 days", "unknown", None]) == [30, 0, 45, None, None]
    assert values(spark, C.terms_score(days), ["Net 45", "immediate", "120", "?"]) == [50.0, 100.0, 0.0, 50.0]


def test_dates(spark):
    assert values(spark, C.any_date(F.col("x")), ["2024-02-03", "03/02/2024", "3 Feb 2024", "nothing", None]) == [dt.date(2024, 2, 3)] * 3 + [None, None]


def test_overflow_is_null(spark):
    assert values(spark, C.numeric(F.col("x"), 5, 2), ["999.994", "1000", "x"]) == [999.99, None, None]


LINES = "supplier_id string, item_id string, quantity double, unit_price double, line_total double"


def test_price_variance_is_strict(spark):
    lines = spark.createDataFrame([("a", "i", 10.0, 10.0, 100.0), ("b", "i", 10.0, 11.0, 110.0), ("c", "i", 10.0, 12.0, 120.0), ("d", "j", 1.0, 9.0, 9.0), ("e", "i", None, None, None), ("f", "i", -1.0, 5.0, -5.0)], LINES)
    got = {r.supplier_id: r.impact for r in detectors.price_variance(lines, 0.1).collect()}
    assert got == {"c": 20.0}
    assert detectors.price_variance(lines.limit(0), 0.1).count() == 0


def test_missing_line_figures(spark):
    lines = spark.createDataFrame([("a", "i", None, 5.0, 50.0), ("b", "i", 4.0, None, 20.0), ("c", "i", None, None, 7.0)], LINES)
    got = {r.supplier_id: (r.quantity, r.unit_price, r.line_total) for r in detectors.complete_lines(lines).collect()}
    assert got == {"a": (10.0, 5.0, 50.0), "b": (4.0, 5.0, 20.0), "c": (1.0, 7.0, 7.0)}


def test_maverick_orders(spark):
    orders = spark.createDataFrame([("1", "c1 ", 500.0), ("2", None, 500.0), ("3", "C9", 500.0), ("4", None, 5.0)], "po_id string, contract_id string, total_amount double")
    lines = spark.createDataFrame([("1", "s", 1.0), ("2", "s", 1.0), ("2", "t", 9.0)], "po_id string, supplier_id string, line_total double")
    contracts, suppliers = spark.createDataFrame([("C1", "s"), ("C9", "gone")], "contract_id string, supplier_id string"), spark.createDataFrame([("s",), ("t",)], "supplier_id string")
    got = {r.sources[0]: r.supplier_id for r in detectors.maverick_spend(orders, lines, contracts, suppliers, 100).collect()}
    assert got == {"2": "t", "3": None}


def test_findings(spark):
    rows = [("d", "s1", None, None, 10.0, ["x"]), ("d", "s1", None, None, 30.0, ["y"]), ("d", "s2", None, None, 20.0, ["z"]), ("e", "s3", None, "k", 5.0, ["w"])]
    f = findings.together([spark.createDataFrame(rows, "detector string, supplier_id string, item_id string, category string, impact double, sources array<string>")])
    assert [(r.supplier_id, r.impact) for r in findings.top_of_each(f).where("detector = 'd'").orderBy("position").collect()] == [("s1", 30.0), ("s2", 20.0)]
    above = {(r.detector, r.impact, r.relaxed) for r in findings.above(f, 20).collect()}
    assert above == {("d", 30.0, False), ("d", 20.0, False), ("e", 5.0, True)}
    risk = spark.createDataFrame([("s1", 0.5)], "supplier_id string, risk_score double")
    assert abs(sum(r.weight for r in findings.weighted(f, risk).collect()) - 1) < 1e-9
    marked = findings.with_feedback(f, spark.createDataFrame([(f.first().ref_id, "accepted", 1), (f.first().ref_id, "Rejected", 2)], "ref_id string, status string, at int"))
    assert marked.where("rejected").count() == 1


def test_scores(spark):
    df = spark.createDataFrame([("a", 1.0, 5.0), ("b", 3.0, 5.0), ("c", None, 5.0)], "supplier_id string, x double, y double")
    got = {r.supplier_id: (r.x_score, r.y_score) for r in ranking.scores(df, {"x": "lower", "y": "higher"}).collect()}
    assert got == {"a": (10.0, 10.0), "b": (0.0, 10.0), "c": (0.0, 10.0)}


def test_counter_offers(spark):
    rows = [(90.0, 100.0, 110.0, 1), (120.0, 100.0, 110.0, 1), (105.0, 100.0, 110.0, 1), (120.0, 100.0, 110.0, 2), (120.0, 100.0, 110.0, 3), (120.0, 100.0, 110.0, 4), (0.0, 100.0, 110.0, 1)]
    got = quotes.counter_offers(spark.createDataFrame(rows, "offer double, target double, walkaway double, round int")).collect()
    assert [(r.action, r.counter) for r in got] == [("accept", 90.0), ("counter", 105.6), ("counter", 102.5), ("counter", 108.0), ("counter", 105.0), ("hold", 110.0), ("clarify", None)]
    final = quotes.final_offers(spark.createDataFrame([("this is our final offer", 100.0, 110.0), ("best and final", 120.0, 110.0), (None, 1.0, 2.0)], "text string, offer double, walkaway double"))
    assert [r.answer for r in final.collect()] == ["accept", "decline", None]


def test_upsert_and_checks(spark, tmp_path):
    old, new = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, at int"), spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "k int, v string, at int")
    order = [F.desc("at")]
    assert {r.k: r.v for r in upsert_by_key(old, new, ["k"], order).collect()} == {1: "a", 2: "d", 3: "e"}
    assert {r.k: r.v for r in upsert_by_key(old, new, ["k"], order, update=False).collect()} == {1: "a", 2: "b", 3: "e"}
    good, bad = split_valid(spark.createDataFrame([(1, 5.0), (None, -1.0)], "id int, x double"), {"id": F.col("id").isNotNull(), "x": F.col("x") > 0})
    assert good.count() == 1 and bad.first().errors == ["id", "x"]
    assert read_or_empty(spark, str(tmp_path / "none"), old.schema).count() == 0


def test_names(spark):
    suppliers = spark.createDataFrame([("S1", "Acme, Ltd."), ("S2", "Other")], "supplier_id string, supplier_name string")
    names = spark.createDataFrame([("acme ltd",), (" s2",), ("nobody",), (None,)], "name string")
    assert {r.name: r.supplier_id for r in spend.resolve_names(names, suppliers).collect()} == {"acme ltd": "S1", " s2": "S2", "nobody": None, None: None}


def test_chunks_cover_the_text(spark):
    text = " ".join(f"w{i}" for i in range(1500))
    rows = retrieval.chunks(spark.createDataFrame([(1, text), (2, "one"), (3, ""), (4, None)], "doc_id int, text string")).collect()
    assert {w for r in rows if r.doc_id == 1 for w in r.text.split()} == set(text.split()) and max(r.n_words for r in rows) == 600
    assert {r.doc_id for r in rows} == {1, 2}


def test_labelled_values(spark):
    docs = spark.createDataFrame([(1, "Invoice No: 17\nTotal = 5\ninvoice no: 18\nnothing"), (2, None)], "doc_id int, text string")
    assert {(r.label, r.value) for r in records.labelled_values(docs).collect()} == {("invoice no", "17"), ("total", "5")}


def test_matched_responses(spark):
    t0 = dt.datetime(2024, 1, 1)
    schema = "unique_id string, workflow_id string, subject string, domain string, ts timestamp"
    sent = spark.createDataFrame([("u1", "w", "rfq a", "x.com", t0), ("u2", "w", "rfq b", "y.com", t0)], schema)
    got = spark.createDataFrame([("u2", "w", "?", "?", t0, 1), (None, "w", "rfq a", "x.com", t0, 2), (None, "v", "rfq a", "x.com", t0, 3)], schema + ", response_id int")
    assert {r.response_id: r.unique_id for r in events.match_responses(sent, got).collect()} == {1: "u2", 2: "u1"}


def test_ready_nodes(spark):
    nodes = spark.createDataFrame([("a", "completed"), ("b", "pending"), ("c", "pending"), ("d", "running")], "node string, status string")
    links = spark.createDataFrame([("a", "b"), ("d", "c")], "source string, target string")
    assert [r.node for r in events.ready_nodes(nodes, links).collect()] == ["b"]


def test_stream_equals_batch(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    e.union(e.limit(50)).repartition(1).sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    stream = events.counts_by_window(events.unique_stream(events.watermarked(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")))))
    q = stream.writeStream.format("memory").queryName("windows").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.start, r.event_type): (r.n, r.value) for r in spark.table("windows").collect()}
    want = {(r.start, r.event_type): (r.n, r.value) for r in events.counts_by_window(e.withColumn("ts", F.col("ts").cast("timestamp"))).collect()}
    assert got and all(want[k] == v for k, v in got.items())

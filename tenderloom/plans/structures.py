"""Registered queries of tables with a cell a line, records by schema, fits and round
states. The SQL of those on texts works the expected values out from the tables
and reads no text."""

from __future__ import annotations

from pyspark.sql import functions as F

from tenderloom.functions import columns as C
from tenderloom.functions import questions as Q
from tenderloom.operators import extraction, fits, insight, ranking, resolution, retrieval, structured
from tenderloom.plans.more import query
from tenderloom.plans.queries import written_findings
from tenderloom.plans.sql import money
from tenderloom.plans.texts import filled
from tenderloom.sources.shared import written
from tenderloom.streaming import rounds

_CELLS = [
    "Our ref |k|\nDescription\nUnit price\nQty\nAmount\nBolt |k|\n£2.50\n4\n10.00\nsteel plate\nof York\n3\n1.20\n3.60\n020 7946 0958\nTotal\n13.60\n",
    "Item\nQuantity\nTotal\nBolt |k|\n7\n28\nsteel\nplate\n2\n9.00\nSub-total:\n37.00\n",
    "Item\nTotal\nBolt |k|\n7\n28\n",
    "Details\nQty\nAmount\nPlate |k|\n1\n5.00\n\nBank account\nWide plate |k| 1 5.00 5.00\n",
    None,
    "Product\nRate\nUnits\nExtended\n\n\n\n\n\n\n\nPin |k|\n1\n1\n1\n",
]


@query(
    """SELECT o_orderkey AS order_key, position, replace(item, '|k|', o_orderkey::VARCHAR) AS item, quantity, unit_price, amount FROM orders JOIN (VALUES
(0, 0, 'Bolt |k|', '4', '£2.50', '10.00'), (0, 1, 'steel plate of York', '3', '1.20', '3.60'), (1, 0, 'Bolt |k|', '7', '', '28'), (1, 1, 'steel plate', '2', '', '9.00'),
(3, 0, 'Wide plate |k|', '1', '5.00', '5.00')) v(form, position, item, quantity, unit_price, amount) ON o_orderkey % 6 = form"""
)
def cell_tables(t):
    """Tables whose cells stand a line each; one text has a row in both forms."""
    k = F.col("o_orderkey")
    docs = t.raw("orders").select(k.alias("order_key"), filled(_CELLS, {"k": k}).alias("r"))
    return extraction.line_items(docs, "order_key", "r")


HEAD = structured.Schema({"invoice_id": "string", "invoice_date": "date", "supplier_name": "string", "total_amount": "number", "payment_terms": "string"}, {"invoice_id": ["invoice number", "invoice no"], "total_amount": ["grand total", "amount due"]})
LINES = structured.Schema({"item_description": "string", "quantity": "number", "unit_price": "number", "line_amount": "number"}, {"item_description": ["description", "item"], "quantity": ["qty"], "line_amount": ["line total", "amount"]})


@query(
    """{views},
l AS (SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS quantity, max(l_partkey) AS greatest FROM lineitem GROUP BY 1)
SELECT o_orderkey AS order_key, CASE WHEN o_orderkey % 2 = 0 THEN 'INV-' ELSE 'N' END || o_orderkey AS invoice_id, CASE WHEN o_orderkey % 3 > 0 THEN o_orderdate::DATE END AS invoice_date, 'Acme ' || o_custkey AS supplier_name, o_totalprice AS total_amount,
CASE WHEN o_orderkey % 2 = 0 THEN 'Favourite colour=red' ELSE '' END AS other, coalesce(n, 0) AS n_lines, coalesce(quantity, 0)::DOUBLE AS quantity, 'Part ' || greatest AS item, CASE WHEN o_orderkey % 3 > 0 THEN 'payment_terms' ELSE 'invoice_date,payment_terms' END AS missing
FROM orders LEFT JOIN l ON l_orderkey = o_orderkey"""
)
def records_structured(t):
    """Invoices written out of orders and their lines, with slips of the pen in labels, are read back as records."""
    k = F.col("o_orderkey")
    number = lambda c: F.format_string("%.2f", c)
    line = F.concat_ws("  ", F.concat(F.lit("Part "), F.col("l_partkey").cast("string")), number(F.col("l_quantity").cast("double")), number(F.col("l_extendedprice").cast("double")), number(F.col("l_extendedprice").cast("double")))
    lines = t.raw("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("body"))
    date = F.date_format("o_orderdate", "yyyy-MM-dd")
    parts = [
        F.when(k % 2 == 0, "INVOICE\nInvoice Nunber: INV-").otherwise("\tTAX INVOICE\r\nINVOICE NO   N"), k.cast("string"),
        F.when(k % 3 > 0, F.concat(F.lit("\nInvoce Date: "), date)).otherwise("\nPage of pages\n"), F.lit("\nSuplier name: Acme "), F.col("o_custkey").cast("string"), F.when(k % 2 == 0, "\nFavourite colour: red").otherwise(""),
        F.lit("\nGrand Totals: £"), number(F.col("o_totalprice").cast("double")), F.lit("\n\nDescription  Qty  Unit Price  Line Totl\n"), F.coalesce("body", F.lit("")), F.lit("\nVAT  0  0  0\nNot an item  1  2  3\n"),
    ]
    docs = t.raw("orders").join(lines, "o_orderkey", "left").select(k.alias("order_key"), F.concat(*parts).alias("text"))
    out = structured.records(docs, "order_key", "text", HEAD, LINES, list(HEAD.columns))
    other = F.array_join(F.transform(F.map_entries(F.map_filter("other", lambda n, _: n == "Favourite colour")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    top = F.array_max(F.transform("lines", lambda x: F.struct(F.regexp_extract(x["item_description"], "[0-9]+", 0).cast("long").alias("n"), x["item_description"].alias("i"))))
    return out.select("order_key", "invoice_id", "invoice_date", "supplier_name", "total_amount", other.alias("other"), F.size("lines").cast("long").alias("n_lines"), F.aggregate("lines", F.lit(0.0), lambda s, x: s + x["quantity"]).alias("quantity"), top["i"].alias("item"), F.array_join("missing", ",").alias("missing"))


@query(
    """{recursive},
v AS (SELECT impact AS x, count(*) AS n FROM findings GROUP BY 1),
q AS (SELECT list_sort(list_distinct([min(impact), quantile_cont(impact, 0.25), quantile_cont(impact, 0.5), quantile_cont(impact, 0.75), max(impact)])) AS c FROM findings),
r AS (SELECT 0 AS i, c[1] AS a, c[2] AS b, c[3] AS d FROM q
  UNION ALL
  SELECT i + 1, coalesce(sum((x::DECIMAL(38,6) * n)) FILTER (near = 1)::DOUBLE / sum(n) FILTER (near = 1), any_value(a)), coalesce(sum((x::DECIMAL(38,6) * n)) FILTER (near = 2)::DOUBLE / sum(n) FILTER (near = 2), any_value(b)), coalesce(sum((x::DECIMAL(38,6) * n)) FILTER (near = 3)::DOUBLE / sum(n) FILTER (near = 3), any_value(d))
  FROM (SELECT r.*, x, n, CASE WHEN abs(x - a) <= abs(x - b) AND abs(x - a) <= abs(x - d) THEN 1 WHEN abs(x - b) <= abs(x - d) THEN 2 ELSE 3 END AS near FROM r, v WHERE i < 50) GROUP BY i),
s AS (SELECT *, lead(a) OVER w AS a1, lead(b) OVER w AS b1, lead(d) OVER w AS d1 FROM r WINDOW w AS (ORDER BY i)),
c AS (SELECT a, b, d FROM s WHERE i = 49 OR sqrt((a - a1) ** 2 + (b - b1) ** 2 + (d - d1) ** 2) <= 1e-4 ORDER BY i LIMIT 1)
SELECT ref_id, supplier_id, impact, CASE WHEN abs(impact - a) <= abs(impact - b) AND abs(impact - a) <= abs(impact - d) THEN 0.0 WHEN abs(impact - b) <= abs(impact - d) THEN 0.5 ELSE 1.0 END::DOUBLE AS score FROM findings, c"""
)
def findings_prioritised(t):
    """Every finding with the score of its cluster of impacts."""
    return fits.priorities(written_findings(t)).select("ref_id", "supplier_id", "impact", "score")


_LEARNED = f"""{{recursive}},
f AS (SELECT round({money('total_cost')} / count(*), 4) AS cost, round(avg(lead_days), 6) AS lead, CASE WHEN supplier_id::INT % 11 > 0 THEN (risk_score < 0.5)::INT END AS y FROM quotes JOIN suppliers USING (supplier_id) GROUP BY supplier_id, risk_score),
x AS (SELECT round((max(cost) OVER () - cost) / (max(cost) OVER () - min(cost) OVER ()) * 10, 4) AS c, round((max(lead) OVER () - lead) / (max(lead) OVER () - min(lead) OVER ()) * 10, 4) AS l, y FROM f),
r AS (SELECT 0 AS i, 0.0::DOUBLE AS w0, 0.0::DOUBLE AS w1, 0.0::DOUBLE AS w2
  UNION ALL
  SELECT i + 1, w0 - 0.05::DOUBLE * avg(e), w1 - 0.05::DOUBLE * avg(e * c), w2 - 0.05::DOUBLE * avg(e * l) FROM (SELECT r.*, c, l, 1 / (1 + exp(-(w0 + w1 * c + w2 * l))) - y AS e FROM r, x WHERE i < 400 AND y IS NOT NULL) GROUP BY i, w0, w1, w2),
w AS (SELECT abs(w1) / (abs(w1) + abs(w2)) AS cost, abs(w2) / (abs(w1) + abs(w2)) AS lead FROM r WHERE i = 400)
"""


def _learned(t):
    """Weights learned from which suppliers are of low risk."""
    rows = t.quotes.groupBy("supplier_id").agg(F.round(C.total(F.col("total_cost")) / F.count("*"), 4).alias("cost"), F.round(F.avg("lead_days"), 6).alias("lead"))
    rows = rows.join(t.suppliers.select("supplier_id", "risk_score"), "supplier_id")
    label = F.when(F.col("supplier_id").cast("int") % 11 > 0, F.when(F.col("risk_score") < 0.5, "Yes").otherwise("no"))
    scored = ranking.scores(rows.withColumn("label", label), {"cost": "lower", "lead": "lower"})
    got = fits.learned_weights(scored, ["cost_score", "lead_score"], "label")
    return t.spark.createDataFrame([(c.removesuffix("_score"), w) for c, w in got.items()], "metric string, weight double")


@query(_LEARNED + "SELECT unnest(['cost', 'lead']) AS metric, round(unnest([cost, lead]), 6) AS weight FROM w")
def weights_learned(t):
    return _learned(t).select("metric", F.round("weight", 6).alias("weight"))


@query(_LEARNED + ", p AS (SELECT 0.5::DOUBLE * cost + 0.3::DOUBLE AS cost, 0.5::DOUBLE * lead AS lead, 0.2::DOUBLE AS risk FROM w) SELECT unnest(['cost', 'lead', 'risk']) AS metric, round(unnest([cost, lead, risk]) / (cost + lead + risk), 6) AS weight FROM p")
def weights_blended(t):
    """The policy's weights, one of them negative, with the learned ones."""
    policy = t.spark.createDataFrame([("cost", 0.6), ("risk", 0.4), ("esg", -0.5)], "metric string, weight double")
    return insight.blended_weights(policy, _learned(t))


@query(
    """{views},
e AS (SELECT event_id AS k, (user_id // 4)::VARCHAR AS w, day(ts)::INT % 2 AS r, (user_id % 4)::VARCHAR AS u, 's' || event_id % 3 AS s, ts FROM events),
x AS (SELECT w, r, u, min(ts) AS since, max(ts) AS again FROM e WHERE k % 3 = 0 GROUP BY ALL),
a AS (SELECT w, r, u, any_value(again) AS again, min(e.ts) FILTER (e.k % 3 > 0) AS answered, max(struct_pack(t := e.ts, c := e.k % 3 > 0, s := e.s)).s AS s FROM x JOIN e USING (w, r, u) WHERE e.ts >= since AND (e.k % 3 = 0 OR e.k % 2 = 0) GROUP BY ALL),
g AS (SELECT w, r, count(*) AS n, count(answered) AS m, coalesce(string_agg(u, ',' ORDER BY u) FILTER (answered IS NULL), '') AS left_over, string_agg(DISTINCT s, ',' ORDER BY s) AS suppliers, max(answered) AS last, max(again) + INTERVAL 72 HOUR <= (SELECT max(ts) FROM events) AS late FROM a GROUP BY ALL)
SELECT w AS workflow_id, r AS round, CASE WHEN n = m THEN 'completed' WHEN late THEN 'failed' ELSE 'waiting' END AS status, n AS n_expected, m AS n_completed, CASE WHEN late THEN '' ELSE left_over END AS pending, CASE WHEN late THEN left_over ELSE '' END AS failed, suppliers, epoch_us(last) AS last_response FROM g"""
)
def round_states(t):
    """Rounds of odd and even days: every third event registers a user of a group of four, every second of the others is an answer."""
    k = F.col("event_id")
    e = t.raw("events").select(k, F.floor(F.col("user_id") / 4).cast("string").alias("workflow_id"), (F.dayofmonth("ts") % 2).alias("round"), (F.col("user_id") % 4).alias("unique_id"), F.concat(F.lit("s"), (k % 3).cast("string")).alias("supplier_id"), F.col("ts").cast("timestamp").alias("ts"))
    rows = rounds.rows_of(e.where(k % 3 == 0), e.where((k % 3 > 0) & (k % 2 == 0)))
    out = rounds.states(rows, F.lit(e.agg(F.max("ts").alias("as_of")).first().as_of))  # one time
    text = lambda c: F.array_join(c, ",").alias(c)
    return out.select("workflow_id", "round", "status", "n_expected", "n_completed", text("pending"), text("failed"), text("suppliers"), F.unix_micros("last_response").alias("last_response"))


@query("SELECT k, arg_min(name, (-length(name), name)) AS name FROM (SELECT p_partkey AS k, ' we bought ' || p_name || ' of york ' AS t FROM part) JOIN (SELECT DISTINCT array_to_string(string_split(p_name, ' ')[1:n], ' ') AS name FROM part, (VALUES (1), (2), (9)) v(n)) ON contains(t, ' ' || name || ' ') GROUP BY 1")
def long_names_in_texts(t):
    """Names of one to all words of a part's, looked up in sentences about parts with other punctuation."""
    part = t.raw("part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("p"))
    cut = lambda n: F.array_join(F.slice(F.split("p", " "), 1, n), " ")
    names = part.select(F.explode(F.array(cut(1), cut(2), F.col("p"))).alias("supplier_name")).distinct()
    texts = part.select("k", F.concat(F.lit("We bought: "), F.upper(F.replace("p", F.lit(" "), F.lit(", "))), F.lit(" of York.")).alias("text"))
    return resolution.named_in_texts(texts, names, "k", "text").select("k", F.col("supplier_name").alias("name"))


_QUESTIONS = ["Where is  PO-1|k|00 and its invoice?", "what is our policy on PAYMENT terms\nand escalation for lead time", "Quotation or agreement |k|", "post of po", " ", None, "po 12 or po12|k|"]


@query(
    """SELECT o_orderkey AS order_key, replace(q, '|k|', o_orderkey::VARCHAR) AS question, sources, focus FROM orders JOIN (VALUES
(0, 'Where is purchase order 1|k|00 and its invoice?', 'Invoice,PO', 'invoice,po,purchase order'), (1, 'what is our policy on PAYMENT terms and escalation for lead time delivery time discount period escalation clause net terms turnaround', 'Policy', 'policy'),
(2, 'Quotation or agreement |k|', 'Contract,Quote', 'agreement,contract,quotation,quote'), (3, 'post of po', 'PO', 'po,purchase order'), (4, '', '', ''), (5, '', '', ''), (6, 'po 12 or purchase order 12|k|', 'PO', 'po,purchase order')) v(form, q, sources, focus) ON o_orderkey % 7 = form"""
)
def questions_rewritten(t):
    k = F.col("o_orderkey")
    rows = t.raw("orders").select(k.alias("order_key"), filled(_QUESTIONS, {"k": k}).alias("q"))
    q = F.col("q")
    return rows.select("order_key", Q.rewritten(q).alias("question"), F.array_join(Q.sources_of(q), ",").alias("sources"), F.array_join(Q.focus_of(q), ",").alias("focus"))


_BONUS = {"collection": {"c": 0.12, "uploaded_documents": 0.08, "static_policy": 0.14}, "document_type": {"policy": 0.1}}


@query(
    """SELECT o_orderkey AS order_key, bonus FROM orders JOIN (VALUES
(0, 0.12::DOUBLE), (1, 0.13::DOUBLE), (2, 0.24::DOUBLE), (3, 0.34::DOUBLE), (4, 0.02::DOUBLE), (5, 0.0::DOUBLE), (6, 0.24::DOUBLE), (7, 0.36::DOUBLE)) v(form, bonus) ON o_orderkey % 8 = form"""
)
def hits_with_bonus(t):
    """Collection, type and question by the key: plain; policies unasked, asked; in focus; policies out of focus; unknown; policies by source; policies in focus and asked."""
    k = F.col("o_orderkey") % 8
    one = lambda *v: F.element_at(F.array(*[F.lit(x) for x in v]), (k + 1).cast("int"))
    bonus = Q.bonus(
        one("c", "static_policy", "static_policy", "c", "static_policy", None, "uploaded_documents", "static_policy"), one(None, "Policy", "policy", "invoice", "policy", None, None, "policy"), one("x", None, None, None, None, None, "Policy", None), _BONUS,
        one(False, False, True, False, False, None, True, True), one(False, False, False, True, True, None, False, True), one(False, False, False, True, False, None, False, True),
    )
    return t.raw("orders").select(F.col("o_orderkey").alias("order_key"), F.round(bonus, 6).alias("bonus"))


@query(None)
def signed_neighbours(t):
    """Of every hundredth document the ten nearest by signed vectors of their words."""
    docs = t.raw("documents").select(F.col("doc_id").alias("vec_id"), Q.signed_vector(C.words_of(F.col("text"))).alias("embedding")).where("embedding is not null")
    docs, _ = written(docs, "signed")  # searched in several passes
    asked = docs.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return retrieval.dense(docs, asked, 10).select("query_id", "vec_id", "score", F.col("rank").cast("int").alias("rank"))

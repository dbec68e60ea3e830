"""Registered queries that compare row by row: enrichment, lookups, policies and
the operators that other queries only roll up."""

from __future__ import annotations

from pyspark.sql import functions as F

from tenderloom.functions import columns as C
from tenderloom.operators import enrich, findings, flows, policies, quotes, records
from tenderloom.plans.more import dec, query
from tenderloom.plans.sql import money
from tenderloom.plans.texts import filled, filled_sql
from tenderloom.sources.tables import split_valid
from tenderloom.streaming import events as streams


def number(c: str):
    return F.col(c).cast("long")


def most_sql(keys: str, rows: str, name: str) -> str:
    return f"(SELECT {keys}, d AS {name} FROM {rows} GROUP BY {keys}, d QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY count(*) DESC, d) = 1)"


@query(
    f"""{{views}},
found AS (SELECT DISTINCT supplier_id, CASE WHEN po_id::BIGINT % 3 = 0 THEN item_id END AS item_id, CASE WHEN po_id::BIGINT % 3 < 2 THEN po_id END AS po_id FROM po_lines),
l AS (SELECT supplier_id, item_id, po_id, product AS d FROM po_lines JOIN products USING (item_id) WHERE (po_id::BIGINT // 3) % 2 = 0)
SELECT f.supplier_id, f.item_id, f.po_id, coalesce(d0, d1, d2) AS description FROM found f LEFT JOIN {most_sql('supplier_id, item_id', 'l', 'd0')} a ON a.supplier_id = f.supplier_id AND a.item_id = f.item_id LEFT JOIN {most_sql('supplier_id, po_id', 'l', 'd1')} b ON b.supplier_id = f.supplier_id AND b.po_id = f.po_id LEFT JOIN {most_sql('supplier_id', 'l', 'd2')} c ON c.supplier_id = f.supplier_id"""
)
def findings_described(t):
    po = number("po_id")
    found = t.po_lines.select("supplier_id", F.when(po % 3 == 0, F.col("item_id")).alias("item_id"), F.when(po % 3 < 2, F.col("po_id")).alias("po_id")).distinct()
    lines = t.po_lines.where(F.floor(po / 3) % 2 == 0).join(t.products.select("item_id", "product"), "item_id")
    return enrich.described(found, lines, "product").select("supplier_id", "item_id", "po_id", "description")


@query("SELECT po_id, s.supplier_id FROM (SELECT po_id, CASE WHEN po_id::BIGINT % 2 = 0 THEN coalesce(c.supplier_id, l.supplier_id) ELSE l.supplier_id END AS found FROM purchase_orders LEFT JOIN contracts c USING (contract_id) LEFT JOIN (SELECT po_id, min(supplier_id) AS supplier_id FROM po_lines GROUP BY 1) l USING (po_id)) LEFT JOIN (SELECT supplier_id FROM suppliers WHERE supplier_id::INT % 5 > 0) s ON s.supplier_id = found")
def findings_sourced(t):
    refs = F.when(number("po_id") % 2 == 0, F.array(F.lit("x"), "contract_id", "po_id")).otherwise(F.array(F.lit(None).cast("string"), F.col("po_id")))
    rows = t.purchase_orders.select("po_id", refs.alias("refs"))
    return enrich.with_sources(rows, "po_id", "refs", [(t.contracts, "contract_id"), (t.po_lines, "po_id")], t.suppliers.where(number("supplier_id") % 5 > 0)).select("po_id", "supplier_id")


@query("SELECT po_id, item_id, 'own' AS currency_line, currency, order_date FROM po_lines LEFT JOIN (SELECT * FROM purchase_orders WHERE po_id::BIGINT % 4 > 0) USING (po_id)")
def lines_with_headers(t):
    lines = t.po_lines.select("po_id", "item_id", F.lit("own").alias("currency"))
    return enrich.with_headers(lines, t.purchase_orders.where(number("po_id") % 4 > 0).select("po_id", "currency", "order_date"), "po_id")


@query("SELECT po_id, coalesce(string_agg(item_id || ':' || quantity::INT, ',' ORDER BY item_id, quantity), '') AS lines FROM (SELECT po_id, order_date FROM purchase_orders ORDER BY order_date DESC NULLS LAST, po_id LIMIT 50) LEFT JOIN (SELECT * FROM po_lines WHERE item_id::INT % 3 > 0) USING (po_id) GROUP BY 1")
def orders_nested(t):
    out = enrich.nested(t.purchase_orders.select("po_id", "order_date"), t.po_lines.where(number("item_id") % 3 > 0), "po_id", ["item_id", "quantity"], ["order_date"], 50)
    return out.select("po_id", F.array_join(F.transform("lines", lambda x: F.concat_ws(":", x["item_id"], x["quantity"].cast("int").cast("string"))), ",").alias("lines"))


@query("SELECT supplier_id, contracts, categories, items FROM (SELECT supplier_id, string_agg(DISTINCT contract_id, ',' ORDER BY contract_id) AS contracts FROM contracts GROUP BY 1) FULL JOIN (SELECT supplier_id, string_agg(DISTINCT category, ',' ORDER BY category) AS categories FROM po_lines JOIN products USING (item_id) GROUP BY 1) USING (supplier_id) FULL JOIN (SELECT supplier_id, string_agg(item_id, ',' ORDER BY k) AS items FROM (SELECT *, row_number() OVER (PARTITION BY supplier_id ORDER BY n DESC, item_id) AS k FROM (SELECT supplier_id, item_id, count(*) AS n FROM po_lines GROUP BY ALL)) WHERE k <= 5 GROUP BY 1) USING (supplier_id)")
def supplier_profiles(t):
    p = enrich.profiles(t.po_lines, t.contracts, t.products)
    return p.select("supplier_id", *[F.array_join(c, ",").alias(c) for c in ("contracts", "categories", "items")])


@query("SELECT asked_id AS supplier_id, CASE WHEN k % 2 = 0 AND k % 3 < 2 THEN sid END AS flow_id, CASE WHEN k % 2 = 0 AND k % 3 = 0 THEN 'id' WHEN k % 2 = 0 AND k % 3 = 1 THEN 'name' END AS how FROM (SELECT supplier_id AS sid, supplier_id::INT AS k, CASE WHEN supplier_id::INT % 3 = 0 THEN supplier_id ELSE 'none' || supplier_id END AS asked_id FROM suppliers)")
def flows_looked_up(t):
    k = number("supplier_id")
    asked = t.suppliers.select(F.when(k % 3 == 0, F.col("supplier_id")).otherwise(F.concat(F.lit("none"), "supplier_id")).alias("supplier_id"), F.when(k % 3 == 1, F.upper("supplier_name")).otherwise("zzz").alias("supplier_name"))
    return enrich.flow_of(asked, t.suppliers.where(k % 2 == 0), t.suppliers).select("supplier_id", "flow_id", "how")


@query("SELECT po_id, coalesce(c.supplier_id, l.supplier_id) AS supplier_id FROM purchase_orders LEFT JOIN contracts c USING (contract_id) LEFT JOIN (SELECT po_id, min(supplier_id) AS supplier_id FROM po_lines WHERE po_id::BIGINT % 2 = 0 GROUP BY 1) l USING (po_id)")
def event_suppliers(t):
    rows = t.purchase_orders.select("po_id", "contract_id")
    return enrich.first_known(rows, "po_id", [(F.col("contract_id"), t.contracts, "contract_id"), (F.col("po_id"), t.po_lines.where(number("po_id") % 2 == 0), "po_id")]).select("po_id", "supplier_id")


@query("SELECT message_id, CASE k % 4 WHEN 0 THEN 'PROC-WF-SUB' || (k + 1000) WHEN 1 THEN 'PROC-WF-BODY' || (k + 1000) WHEN 2 THEN 'PROC-WF-THREAD' || (k - 1) END AS unique_id FROM (SELECT o_orderkey AS k, 'M' || o_orderkey AS message_id FROM orders) WHERE k % 4 < 4")
def message_tokens(t):
    k = F.col("o_orderkey")
    text = lambda *x: F.concat(*[v if not isinstance(v, str) else F.lit(v) for v in x])
    num = (k + 1000).cast("string")
    m = t.raw("orders").select(
        text("M", k.cast("string")).alias("message_id"), F.when(k % 4 == 0, text("Re: proc-wf-sub", num, " offer")).otherwise("PROC-WF-1").alias("subject"),
        F.when(k % 4 < 2, text("Ref (PROC-WF-BODY", num, ")")).alias("body"), F.when(k % 4 == 2, text("T", (k - 1).cast("string"))).alias("in_reply_to"),
    )
    threads = t.raw("orders").select(text("T", (k - 1).cast("string")).alias("message_id"), text("proc-wf-thread", (k - 1).cast("string")).alias("unique_id")).where(k % 4 == 2)
    return enrich.message_ids(m, threads).select("message_id", "unique_id")


@query(
    """{views},
d AS (SELECT o_orderkey AS dispatch, 't' || o_orderkey AS u, 'm' || o_orderkey || '@x' AS m, 'c' || o_custkey AS s FROM orders WHERE o_orderkey % 3 = 0),
i AS (SELECT k, arg_min(dispatch, (level, dispatch)) AS dispatch, min(level) AS level FROM (SELECT u AS k, 0 AS level, dispatch FROM d UNION ALL SELECT m, 1, dispatch FROM d UNION ALL SELECT s, 2, min(dispatch) FROM d GROUP BY s HAVING count(*) = 1) GROUP BY 1)
SELECT message, dispatch, level FROM (SELECT o_orderkey AS message, CASE o_orderkey % 4 WHEN 0 THEN 't' || (o_orderkey - 1) WHEN 1 THEN 'm' || (o_orderkey - 1) || '@x' WHEN 2 THEN 'c' || o_custkey END AS k FROM orders WHERE o_orderkey % 3 = 1) LEFT JOIN i USING (k)"""
)
def messages_identified(t):
    k, o = F.col("o_orderkey"), t.raw("orders")
    key, before = k.cast("string"), (k - 1).cast("string")
    d = o.where(k % 3 == 0).select(k.alias("dispatch"), F.concat(F.lit("T"), key).alias("unique_id"), F.concat(F.lit("<M"), key, F.lit("@x>")).alias("message_id"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("supplier_id"))
    one = F.when(k % 4 == 0, F.concat(F.lit("t"), before)).when(k % 4 == 1, F.concat(F.lit(" M"), before, F.lit("@X"))).when(k % 4 == 2, F.concat(F.lit("c"), F.col("o_custkey").cast("string")))
    return enrich.by_identifiers(o.where(k % 3 == 1).select(k.alias("message"), F.array(F.lit("nothing"), one).alias("identifiers")), d)


@query(
    """{views},
s AS (SELECT (po_id::BIGINT % 40)::VARCHAR AS rfq_id, supplier_id, max((lead_days, payment_terms)) AS x FROM quotes WHERE supplier_id::INT % 2 = 0 GROUP BY ALL)
SELECT concat_ws('|', rfq_id, supplier_id, round) AS key, rfq_id, supplier_id, round, status FROM (SELECT rfq_id, l.supplier_id, coalesce(r, struct_extract(x, 1), 0)::INT AS round, struct_extract(x, 2) AS status FROM (SELECT (po_id::BIGINT % 40)::VARCHAR AS rfq_id, supplier_id, CASE WHEN po_id::BIGINT % 3 > 0 THEN po_id::BIGINT % 5 END AS r FROM po_lines) l LEFT JOIN s USING (rfq_id, supplier_id))"""
)
def negotiation_rows(t):
    po = number("po_id")
    rfq = (po % 40).cast("string").alias("rfq_id")
    sessions = t.po_lines.select(rfq, "supplier_id", F.when(po % 3 > 0, po % 5).cast("int").alias("round"))
    states = t.quotes.where(number("supplier_id") % 2 == 0).select(rfq, "supplier_id", F.col("lead_days").alias("current_round"), F.col("payment_terms").alias("status"))
    return enrich.negotiations(sessions, states)


@query("SELECT supplier_id, max(quote_date) AS quote_date, arg_max(quote_id, (quote_date, quote_id)) AS quote_id, arg_max(lead_days, (quote_date, quote_id)) AS lead_days, count(*) AS n_sessions FROM quotes GROUP BY 1")
def negotiation_context(t):
    return enrich.latest_context(t.quotes, ["supplier_id"], "quote_date", ["quote_id", "lead_days"])


@query("SELECT workflow_id, count(*) AS n FROM (SELECT o_custkey % 100 AS workflow_id, o_orderkey % 97 > 0 AS sent, o_orderkey % 3 > 0 AS waits FROM orders) GROUP BY 1 HAVING bool_and(sent) AND bool_or(waits)")
def active_workflows(t):
    k = F.col("o_orderkey")
    rows = t.raw("orders").select((F.col("o_custkey") % 100).alias("workflow_id"), F.when(k % 97 > 0, k).alias("message_id"), F.when(k % 3 == 0, F.col("o_orderdate")).alias("responded_at"))
    return enrich.active_workflows(rows)


_SET = "list_sort(list_distinct(list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda x: x <> '')))"


@query(
    f"""{{views}},
a AS (SELECT item_id, {_SET.format("array_to_string(string_split(product, ' ')[1:3], ' ') || ' spare'")} AS x FROM products), b AS (SELECT item_id AS product_id, {_SET.format('product')} AS y FROM products WHERE item_id::INT % 10 = 0),
u AS (SELECT DISTINCT x FROM a), v AS (SELECT y, min(product_id) AS product_id FROM b GROUP BY 1),
c AS (SELECT x, product_id, round(len(list_intersect(x, y)) / sqrt(len(x) * len(y)), 6) AS s FROM u JOIN v ON list_has_any(x, y)),
d AS (SELECT x, arg_min(product_id, (-s, product_id)) AS product_id, max(s) AS similarity FROM c WHERE s >= 0.45 GROUP BY 1)
SELECT item_id, product_id, similarity FROM a JOIN d USING (x)"""
)
def item_categories(t):
    words = F.array_join(F.slice(F.split("product", " "), 1, 3), " ")
    return enrich.nearest_category(t.products.select("item_id", F.concat(words, F.lit(" spare")).alias("description")), t.products.where(number("item_id") % 10 == 0).select(F.col("item_id").alias("product_id"), "product"))


@query("SELECT l_orderkey AS k, array_to_string(list_filter(a, lambda x, i: list_position(a, x) = i), ',') AS items, v AS value FROM (SELECT l_orderkey, flatten(list([l_returnflag, l_linestatus] ORDER BY l_linenumber, l_returnflag, l_linestatus)) AS a, arg_min(l_shipmode, l_linenumber) FILTER (l_linenumber % 2 = 0) AS v FROM (SELECT *, 'n' || l_linenumber AS l_shipmode FROM lineitem) GROUP BY 1)")
def findings_merged(t):
    n = F.col("l_linenumber")
    rows = t.raw("lineitem").select(F.col("l_orderkey").alias("k"), n.alias("n"), F.array("l_returnflag", "l_linestatus").alias("items"), F.when(n % 2 == 0, F.concat(F.lit("n"), n.cast("string"))).otherwise(" ").alias("value"))
    return enrich.merged_lists(rows, ["k"], "n", ["items"], ["value"]).select("k", F.array_join("items", ",").alias("items"), "value")


_NEAR_HITS = "list(b.item) FILTER (b.place < a.place AND (a.doc = b.doc) = {} AND round(list_inner_product(a.v, b.v), 9) >= 0.35)"


@query(
    f"""{{views}},
h0 AS (SELECT label, vec_id % 3 AS doc, vec_id AS item, vec_id * 7919 % 1000 AS score, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
h AS (SELECT label, doc, item, score, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS v, row_number() OVER (PARTITION BY label ORDER BY score DESC, item) AS place FROM h0 QUALIFY place <= 12),
n AS (SELECT a.label, a.item, a.place, coalesce({_NEAR_HITS.format('true')}, []) AS same, coalesce({_NEAR_HITS.format('false')}, []) AS other FROM h a JOIN h b USING (label) GROUP BY ALL),
f AS (WITH RECURSIVE r AS (SELECT label, 0::BIGINT AS place, []::BIGINT[] AS kept FROM h GROUP BY label UNION ALL SELECT r.label, n.place, CASE WHEN list_has_any(kept, same) THEN kept ELSE list_append(kept, n.item) END FROM r JOIN n ON n.label = r.label AND n.place = r.place + 1) SELECT label, arg_max(kept, place) AS kept FROM r GROUP BY 1),
m AS (SELECT label, item, other, row_number() OVER (PARTITION BY label ORDER BY place) AS place FROM n JOIN f USING (label) WHERE list_contains(kept, item)),
g AS (WITH RECURSIVE r AS (SELECT label, 0::BIGINT AS place, []::BIGINT[] AS kept FROM m GROUP BY label UNION ALL SELECT r.label, m.place, CASE WHEN m.place <= 6 AND list_has_any(kept, other) THEN kept ELSE list_append(kept, m.item) END FROM r JOIN m ON m.label = r.label AND m.place = r.place + 1) SELECT label, arg_max(kept, place) AS kept FROM r GROUP BY 1)
SELECT label, doc, item, score, (list_position(kept, item) - 1)::INT AS position FROM h JOIN g USING (label) WHERE list_contains(kept, item)"""
)
def hits_distinct(t):
    k = F.col("vec_id")
    hits = t.raw("embeddings").select("label", (k % 3).alias("doc"), k.alias("item"), (k * 7919 % 1000).alias("score"), C.unit(F.transform("embedding", lambda x: x.cast("double"))).alias("vector"))
    return enrich.distinct_meanings(hits, "label", 12, 0.35, 6)


@query(f"SELECT supplier_id, count(*) AS n, count(*) FILTER (late > 0) AS n_late, round(avg(CASE WHEN late > 0 THEN late END), 4) AS days_late, round({money('CASE WHEN late > 0 THEN invoice_amount END')}, 2) AS value_late, round(count(*) FILTER (late > 0) / count(*), 6) AS late_share FROM (SELECT *, paid_date - due_date AS late FROM invoices) GROUP BY 1")
def late_invoices(t):
    return enrich.late_invoices(t.invoices)


_DETAILS = ['{"policy_name": "Price Rule |k|", "rules": {"name": "Rule9"}}', "plain words", None, '{"identifier": "ID-|k|", "policy_identifier": "P|k|"}', " "]
_POLICIES = f"SELECT p_partkey AS policy_id, CASE WHEN p_partkey % 3 > 0 THEN 'Maker ' || p_partkey END AS policy_name, CASE WHEN p_partkey % 4 > 0 THEN p_brand END AS policy_desc, {filled_sql(_DETAILS, {'k': 'p_partkey'})} AS policy_details, CASE p_partkey % 6 WHEN 0 THEN 0 WHEN 1 THEN 1 END AS policy_status FROM part"


def _slug(x: str) -> str:
    return f"nullif(trim(lower(regexp_replace(regexp_replace(trim({x}), '([A-Z0-9])', '_\\1', 'g'), '[^A-Za-z0-9]+', '_', 'g')), '_'), '')"


_PART = "CASE WHEN starts_with(policy_details, '{{') THEN json_extract_string(policy_details, '$.{}') END".format
_LADDER = ", ".join([_slug("policy_name"), _slug(_PART("policy_name")), _slug(_PART("identifier")), _slug("policy_desc"), _slug("policy_id::VARCHAR")])
_ALIASES = f"list_sort(list_distinct(list_filter([{_LADDER}, {_slug(_PART('policy_identifier'))}, {_slug(_PART('rules.name'))}, {_slug(_PART('rules.policy_name'))}] || CASE WHEN policy_id % 7 = 0 THEN ['rank_agent', 'quote_agent'] ELSE []::VARCHAR[] END, lambda x: x IS NOT NULL)))"
_ACTIVE = f"SELECT policy_id, coalesce({_PART('policy_identifier')}, {_PART('identifier')}, policy_id::VARCHAR) AS identifier, coalesce({_LADDER}) AS slug, {_ALIASES} AS aliases FROM ({_POLICIES}) WHERE coalesce(policy_status, 1) = 1"


def active_policies(t):
    k = F.col("p_partkey")
    rows = t.raw("part").select(
        k.alias("policy_id"), F.when(k % 3 > 0, F.concat(F.lit("Maker "), k.cast("string"))).alias("policy_name"), F.when(k % 4 > 0, F.col("p_brand")).alias("policy_desc"),
        filled(_DETAILS, {"k": k}).alias("policy_details"), F.when(k % 7 == 0, "RankAgent, ,quote agent").alias("policy_linked_agents"), F.when(k % 6 == 0, 0).when(k % 6 == 1, 1).alias("policy_status"),
    )
    return policies.policy_rows(rows)


@query(f"SELECT policy_id, identifier, slug, array_to_string(aliases, ',') AS aliases FROM ({_ACTIVE})")
def policy_table(t):
    return active_policies(t).withColumn("aliases", F.array_join("aliases", ","))


@query(f"SELECT detector, policy_id FROM (VALUES ('rank_agent'), ('rule_9'), ('maker_5'), ('none')) v(detector) LEFT JOIN (SELECT a AS detector, max(policy_id) AS policy_id FROM (SELECT policy_id, unnest(aliases) AS a FROM ({_ACTIVE})) GROUP BY 1) USING (detector)")
def policy_registry(t):
    return policies.registry(t.spark.createDataFrame([("rank_agent",), ("rule_9",), ("maker_5",), ("none",)], "detector string"), active_policies(t))


@query("SELECT supplier_id, 'min_spend' AS name, value, level FROM (SELECT supplier_id, level, value, row_number() OVER (PARTITION BY supplier_id ORDER BY r, value) AS k FROM (SELECT supplier_id, CASE po_id::BIGINT % 4 WHEN 0 THEN 'rules' WHEN 1 THEN 'explicit' WHEN 2 THEN 'defaults' ELSE 'other' END AS level, CASE po_id::BIGINT % 4 WHEN 0 THEN 3 WHEN 1 THEN 1 WHEN 2 THEN 2 END AS r, CASE WHEN po_id::BIGINT % 5 > 0 THEN item_id ELSE ' ' END AS value FROM po_lines) WHERE r IS NOT NULL AND trim(value) <> '') WHERE k = 1")
def policy_conditions(t):
    po = number("po_id")
    level = F.when(po % 4 == 0, "rules").when(po % 4 == 1, "explicit").when(po % 4 == 2, "defaults").otherwise("other")
    rows = t.po_lines.select("supplier_id", level.alias("level"), F.when(po % 3 == 0, "MinSpend").otherwise("min spend").alias("name"), F.when(po % 5 > 0, F.col("item_id")).otherwise(" ").alias("value"))
    return policies.conditions(rows, ["supplier_id"], ["explicit", "defaults", "rules"])


_FINALS = ["Our final offer: |k|", "We could talk", None, "This is the LOWEST we can go", "best and final"]


@query(f"SELECT k, coalesce(regexp_matches(lower(coalesce(r, '')), '{quotes.FINAL}'), false) AS is_final, CASE WHEN regexp_matches(lower(coalesce(r, '')), '{quotes.FINAL}') THEN CASE WHEN k % 100 <= 50 THEN 'accept' ELSE 'decline' END END AS answer FROM (SELECT o_orderkey AS k, {filled_sql(_FINALS, {'k': 'o_orderkey'})} AS r FROM orders)")
def final_offers(t):
    k = F.col("o_orderkey")
    return quotes.final_offers(t.raw("orders").select(k.alias("k"), filled(_FINALS, {"k": k}).alias("text"), (k % 100).alias("offer"), F.lit(50).alias("walkaway"))).select("k", "is_final", "answer")


@query("SELECT ref_id, feedback, coalesce(lower(feedback) = 'rejected', false) AS rejected FROM (SELECT ref_id, CASE supplier_id::INT % 4 WHEN 0 THEN 'Rejected' WHEN 1 THEN 'accepted' END AS feedback FROM findings)")
def findings_with_feedback(t):
    from tenderloom.plans.queries import written_findings

    every, k = written_findings(t), number("supplier_id")
    given = every.where(k % 4 < 2).select("ref_id", k.alias("k")).distinct()
    old = given.select("ref_id", F.lit("older").alias("status"), F.lit(1).alias("at"))
    new = given.select("ref_id", F.when(F.col("k") % 4 == 0, "Rejected").otherwise("accepted").alias("status"), F.lit(2).alias("at"))
    return findings.with_feedback(every, old.union(new)).select("ref_id", "feedback", "rejected")


@query("SELECT po_id, array_to_string(list_filter([CASE WHEN contract_id IS NULL THEN 'contract' END, CASE WHEN total_amount <= 100000 THEN 'amount' END], lambda x: x IS NOT NULL), ',') AS errors FROM purchase_orders")
def records_checked(t):
    good, bad = split_valid(t.purchase_orders, {"contract": F.col("contract_id").isNotNull(), "amount": F.col("total_amount") > 100000})
    return good.select("po_id", F.lit("").alias("errors")).union(bad.select("po_id", F.array_join("errors", ",")))


_DATES = ["2024-03-0|d|", "0|d|/03/2024", "0|d|-03-2024", "0|d|.03.2024", "|d| Mar 2024", "|d| March 2024", "Mar |d|, 2024", "March |d|, 2024", "2024/03/0|d|", "soon", None]


@query("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 11 < 9 THEN DATE '2024-03-01' + (o_orderkey % 8)::INT END AS day FROM orders")
def dates_read(t):
    k = F.col("o_orderkey")
    return t.raw("orders").select(k.alias("k"), filled(_DATES, {"k": k, "d": k % 8 + 1}).alias("r")).select("k", C.any_date(F.col("r")).alias("day"))


_NUMBERS = ["£1,2|a|.50 in all", "(|a|.25)", "20% of |a|", "none", None, "3 x |a|", "-|a|"]


@query("SELECT o_orderkey AS k, CASE o_orderkey % 7 WHEN 0 THEN 1200 + a + 0.5 WHEN 1 THEN -(a + 0.25) WHEN 2 THEN 20 WHEN 5 THEN a WHEN 6 THEN a END::DOUBLE AS value FROM (SELECT *, o_orderkey % 90 + 10 AS a FROM orders)")
def numbers_read(t):
    k = F.col("o_orderkey")
    return t.raw("orders").select(k.alias("k"), filled(_NUMBERS, {"k": k, "a": k % 90 + 10}).alias("r")).select("k", C.clean_number(F.col("r")).alias("value"))


@query("SELECT k AS node FROM (SELECT o_orderkey AS k FROM orders) WHERE k % 3 = 2 AND k NOT IN (SELECT o_orderkey + 1 FROM orders WHERE o_orderkey % 3 = 1 AND o_orderkey % 5 = 0)")
def nodes_ready(t):
    k, o = F.col("o_orderkey"), t.raw("orders")
    status = F.when(k % 3 == 2, "pending").when((k % 3 == 1) & (k % 5 == 0), "running").when(k % 3 == 1, "completed").otherwise("skipped")
    return streams.ready_nodes(o.select(k.alias("node"), status.alias("status")), o.where(k % 3 == 1).select(k.alias("source"), (k + 1).alias("target")))


@query(
    """{views},
d AS (SELECT event_id AS unique_id, user_id AS w, event_type AS subject, user_id % 3 AS domain, ts FROM events WHERE event_id % 4 = 0), r AS (SELECT event_id AS response_id, CASE WHEN event_id % 3 = 0 THEN event_id - 1 END AS unique_id, user_id AS w, event_type AS subject, event_id % 3 AS domain, ts FROM events WHERE event_id % 4 = 1),
p AS (SELECT response_id, d.unique_id, round(CASE WHEN r.unique_id = d.unique_id THEN 1.0 ELSE least(0.4::DOUBLE * (d.subject = r.subject)::INT + 0.25::DOUBLE * (d.domain = r.domain)::INT + 0.3::DOUBLE + 0.15::DOUBLE * (abs(epoch_us(r.ts) - epoch_us(d.ts)) <= 259200000000)::INT, 1.0) END, 4) AS score FROM d JOIN r USING (w))
SELECT response_id, arg_min(unique_id, (-score, unique_id)) AS unique_id, max(score)::DOUBLE AS score FROM p WHERE score >= 0.45 GROUP BY 1"""
)
def responses_scored(t):
    e, k = t.raw("events"), F.col("event_id")
    common = [F.col("user_id").alias("workflow_id"), F.col("event_type").alias("subject"), F.col("ts").cast("timestamp").alias("ts")]
    sent = e.where(k % 4 == 0).select(k.alias("unique_id"), (F.col("user_id") % 3).alias("domain"), *common)
    got = e.where(k % 4 == 1).select(k.alias("response_id"), F.when(k % 3 == 0, k - 1).alias("unique_id"), (k % 3).alias("domain"), *common)
    return streams.match_responses(sent, got)


@query("SELECT po_id AS workflow_id, round, supplier_id, round(min(price)::DECIMAL(28,6), 4)::DOUBLE AS price FROM (SELECT po_id, supplier_id, quantity::INT % 3 AS round, unit_price AS price, max(quantity::INT % 3) OVER (PARTITION BY po_id) AS last FROM po_lines) WHERE round = last GROUP BY ALL")
def last_round_offers(t):
    rows = t.po_lines.select(F.col("po_id").alias("workflow_id"), "supplier_id", (F.col("quantity").cast("int") % 3).alias("round"), F.col("unit_price").alias("price"))
    return quotes.latest_round(rows).withColumn("price", C.rounded(F.col("price"), 4))


@query("SELECT 'HAS_CONTRACT' AS kind, supplier_id AS source, contract_id AS target FROM contracts JOIN suppliers USING (supplier_id) UNION ALL SELECT 'UNDER', po_id, contract_id FROM purchase_orders JOIN contracts USING (contract_id) UNION ALL SELECT DISTINCT 'RECEIVED', supplier_id, po_id FROM po_lines JOIN suppliers USING (supplier_id) UNION ALL SELECT 'BILLS', invoice_id, po_id FROM invoices JOIN purchase_orders USING (po_id) UNION ALL SELECT 'QUOTED', supplier_id, quote_id FROM quotes JOIN suppliers USING (supplier_id) UNION ALL SELECT DISTINCT 'CONTAINS', po_id, item_id FROM po_lines")
def graph_edge_rows(t):
    return flows.edges(t)


@query(f"SELECT po_id, {dec('coalesce(total_amount, s)')} AS total_amount, coalesce(abs(s - total_amount) <= 0.02, false) AS matches FROM (SELECT po_id, s, CASE po_id::BIGINT % 3 WHEN 0 THEN s + 0.01 WHEN 1 THEN s + 5 END AS total_amount FROM (SELECT po_id, {money('line_total')} AS s FROM po_lines GROUP BY 1))")
def orders_reconciled(t):
    po = number("po_id")
    sums = t.po_lines.groupBy("po_id").agg(C.total(F.col("line_total")).alias("s"))
    headers = sums.select("po_id", F.when(po % 3 == 0, F.col("s") + 0.01).when(po % 3 == 1, F.col("s") + 5).alias("total_amount"))
    return records.reconcile(headers, t.po_lines, "po_id", "total_amount", "line_total").select("po_id", C.rounded(F.col("total_amount")).alias("total_amount"), "matches")

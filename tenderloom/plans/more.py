"""Registered queries of field cleaning, resolution and roll-ups, each with the
same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tenderloom.functions import columns as C
from tenderloom.functions import fields as X
from tenderloom.operators import insight, quotes, records, resolution, retrieval
from tenderloom.plans.sql import SQL as SQL_OF
from tenderloom.plans.sql import VIEWS, money
from tenderloom.sources.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    """Registers a query and its SQL; None where SQL has no such function."""

    def keep(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


def dec(x: str) -> str:
    return f"round(({x})::DECIMAL(28,6), 2)::DOUBLE"


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_ENDINGS = (" Ltd", " & Sons", " Holdings PLC", " of the North GmbH")
_MADE_NAMES = "SELECT supplier_id, supplier_name || [' Ltd', ' & Sons', ' Holdings PLC', ' of the North GmbH'][supplier_id::INT % 4 + 1] AS name FROM suppliers"


def made_names(t: Tables) -> DataFrame:
    ending = F.element_at(F.array(*map(F.lit, _ENDINGS)), (F.col("supplier_id").cast("int") % 4 + 1).cast("int"))
    return t.suppliers.select("supplier_id", F.concat("supplier_name", ending).alias("name"))


def _company_key(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(regexp_replace(lower(trim({x})), {quoted(X.LEGAL_FORMS)}, '', 'g'), '[,.&''\"-]+', ' ', 'g'), '[ \\t\\r\\n\\f]+', ' ', 'g'))"


def _core_words(x: str) -> str:
    return f"list_sort(list_filter(list_distinct(string_split({_company_key(x)}, ' ')), lambda w: w <> '' AND w NOT IN ({', '.join(map(quoted, X.NOISE_WORDS))})))"


@query(f"SELECT supplier_id, {_company_key('name')} AS company, array_to_string({_core_words('name')}, ' ') AS words, trim(regexp_replace(lower(trim(regexp_replace(regexp_replace(trim(name), '([A-Z0-9])', '_\\1', 'g'), '[^A-Za-z0-9]+', '_', 'g'), '_')), '^_|_$', '', 'g')) AS slug FROM ({_MADE_NAMES})")
def company_names(t):
    name = F.col("name")
    return made_names(t).select("supplier_id", X.company_key(name).alias("company"), F.array_join(X.core_words(name), " ").alias("words"), X.slug(name).alias("slug"))


_SUBJECT = "CASE turn % 4 WHEN 0 THEN 'Re: ' WHEN 1 THEN ' Fwd:  Re: ' WHEN 2 THEN 'RE: ' ELSE '' END || text"
_S0 = f"trim(replace(replace(regexp_replace(trim({_SUBJECT}, ' \t\r\n'), '[ \\t\\r\\n\\f]+', ' ', 'g'), 'Re:', ''), 'Fwd:', ''))"


@query(f"SELECT conv_id, turn, sha1(coalesce(lower(CASE WHEN starts_with(lower(s), 're: ') THEN trim(s[5:]) ELSE s END), '')) AS subject FROM (SELECT conv_id, turn, {_S0} AS s FROM conversations)")
def subject_keys(t):
    mark = F.element_at(F.array(*map(F.lit, ("Re: ", " Fwd:  Re: ", "RE: ", ""))), (F.col("turn") % 4 + 1).cast("int"))
    return t.raw("conversations").select("conv_id", "turn", F.sha1(F.coalesce(X.subject_key(F.concat(mark, "text")), F.lit("")).cast("binary")).alias("subject"))


_PLAIN = r"trim(regexp_replace(regexp_replace(coalesce(text, ''), '[^\p{L}\p{N}_ \t\r\n\f.,:/@-]', '', 'g'), '[ \t\r\n\f]+', ' ', 'g'))"
_BARE = "coalesce(text, '')"
for _pattern in X.IDENTIFIERS:
    _BARE = f"regexp_replace({_BARE}, {quoted(_pattern)}, '', 'g')"


@query(f"SELECT doc_id, sha1({_PLAIN}) AS plain, sha1(trim(regexp_replace(regexp_replace({_BARE}, '[ \\t\\r\\n\\f]+', ' ', 'g'), ' +([,.;:])', '\\1', 'g'), ' ,;-')) AS bare FROM documents")
def plain_texts(t):
    text = F.col("text")
    return t.raw("documents").select("doc_id", F.sha1(X.plain_text(text).cast("binary")).alias("plain"), F.sha1(X.without_identifiers(text).cast("binary")).alias("bare"))


@query(r"SELECT doc_id, try_cast(nullif(regexp_extract(text, '([0-9]+(?:[.][0-9]+)?)', 1), '') AS DOUBLE) AS number, try_cast(nullif(replace(regexp_extract(text, '([0-9]+[.,]?[0-9]*)', 1), ',', ''), '') AS DOUBLE) AS price, try_cast(nullif(regexp_extract(text, '(?i)([0-9]+)[ \t\r\n\f]*days', 1), '') AS BIGINT) AS days, coalesce(nullif(regexp_extract(text, '(?i)top[- \t\r\n\f]*([0-9]{1,9})', 1), '')::INT, 3) AS wanted FROM documents")
def numbers_in_texts(t):
    text = F.col("text")
    return t.raw("documents").select("doc_id", X.first_number(text).alias("number"), X.offered_price(text).alias("price"), X.offered_days(text).alias("days"), X.wanted_count(text).alias("wanted"))


@query("SELECT page_id, nullif(regexp_extract(address, '@(.+)', 1), '') AS domain, address FROM (SELECT page_id, lower(CASE WHEN page_id % 2 = 0 THEN 'P' || page_id || '@' || regexp_extract(url, '//([^/]+)', 1) ELSE 'x' END) AS address FROM pages)")
def sender_addresses(t):
    sender = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("Some One <P"), F.col("page_id").cast("string"), F.lit("@"), F.regexp_extract("url", "//([^/]+)", 1), F.lit(">"))).otherwise(" x ")
    return t.raw("pages").select("page_id", X.domain_of(sender).alias("domain"), X.address_of(sender).alias("address"))


@query("SELECT doc_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || translate(h[17], '0123456789abcdef', '89ab89ab89ab89ab') || h[18:20] || '-' || h[21:32] AS point FROM (SELECT doc_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(doc_id::VARCHAR)) AS h FROM documents)")
def point_keys(t):
    return t.raw("documents").select("doc_id", X.chunk_key(F.lit("6ba7b811-9dad-11d1-80b4-00c04fd430c8"), F.col("doc_id")).alias("point"))


@query("SELECT event_id, CASE WHEN trim(p) NOT IN ('', 'None', 'null', 'nan', 'NaN', '<NA>') THEN trim(p) END AS kind, coalesce(try_cast(CASE WHEN event_id % 3 = 0 THEN 'n/a' ELSE value::VARCHAR END AS DOUBLE), -1.0) AS value, CASE WHEN NOT (value / 300 < 0.65 AND coalesce(CASE WHEN event_id % 2 = 0 THEN value / 200 END, value / 300) < 0.6) THEN event_type END AS sure, CASE event_type WHEN 'view' THEN 1.0 WHEN 'purchase' THEN 9.0 ELSE 5.0 END::DOUBLE AS score FROM (SELECT *, CASE event_id % 5 WHEN 0 THEN ' nan ' WHEN 1 THEN '' ELSE ' ' || event_type END AS p FROM events)")
def cleaned_events(t):
    e, odd = t.raw("events"), F.col("event_id") % 5
    raw = F.when(odd == 0, " nan ").when(odd == 1, "").otherwise(F.concat(F.lit(" "), "event_type"))
    field = F.when(F.col("event_id") % 2 == 0, F.col("value") / 200)
    return e.select(
        "event_id", X.unlisted(raw).alias("kind"), X.number_or(F.when(F.col("event_id") % 3 == 0, "n/a").otherwise(F.col("value").cast("string")), -1.0).alias("value"),
        X.unless_doubtful(F.col("event_type"), F.col("value") / 300, field).alias("sure"), X.mapped(F.col("event_type"), {"view": 1.0, "purchase": 9.0}, 5.0).alias("score"),
    )


@query(r"SELECT o_orderkey AS order_key, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice::DECIMAL(18,2)::VARCHAR ELSE 'about ' || o_orderkey END AS amount, list_filter(string_split(coalesce(o_orderpriority, '') || ',,x', ','), lambda v: v <> '')[1] AS first, len(list_filter(string_split(coalesce(o_orderpriority, '') || ',,x', ','), lambda v: v <> ''))::INT AS n FROM orders")
def order_texts(t):
    number = F.concat(F.lit("£ "), F.format_number(F.col("o_totalprice").cast("decimal(18,2)"), 2))
    amount = F.when(F.col("o_orderkey") % 2 == 0, number).otherwise(F.concat(F.lit("about "), F.col("o_orderkey").cast("string")))
    parts = X.listed(F.concat(F.coalesce("o_orderpriority", F.lit("")), F.lit(",,x")))
    return t.raw("orders").select(F.col("o_orderkey").alias("order_key"), X.money_text(amount).alias("amount"), F.try_element_at(parts, F.lit(1)).alias("first"), F.size(parts).alias("n"))


@query(f"SELECT invoice_id, round((100 * (gross - net) / net)::DECIMAL(28,6), 1)::DOUBLE AS tax FROM (SELECT invoice_id, {money('line_amount')} AS net, {money('total_amount_incl_tax')} AS gross FROM invoice_lines GROUP BY 1) WHERE net > 0")
def invoice_tax(t):
    sums = t.invoice_lines.groupBy("invoice_id").agg(C.total(F.col("line_amount")).alias("net"), C.total(F.col("total_amount_incl_tax")).alias("gross"))
    return sums.where("net > 0").select("invoice_id", X.tax_percent(F.col("net"), F.col("gross") - F.col("net")).alias("tax"))


@query(f"SELECT level, round({money('line_total')}, 2) AS spend, count(DISTINCT item_id) AS n_items FROM (SELECT item_id, concat_ws('>', nullif(lower(trim(category)), ''), nullif(lower(trim(brand)), '')) AS level FROM products) JOIN po_lines USING (item_id) GROUP BY level")
def category_level_spend(t):
    return insight.spend_by_level(t.po_lines, t.products, X.levels_key(F.col("category"), F.col("brand")))


@query("SELECT supplier_id, array_to_string(list_filter(a, lambda x, i: list_position(list_transform(a, lambda y: lower(y)), lower(x)) = i), '|') AS names FROM (SELECT supplier_id, [supplier_name, upper(supplier_name), coalesce(country, ''), lower(coalesce(country, '')), 'x', 'X'] AS a FROM suppliers)")
def supplier_tokens(t):
    land = F.coalesce("country", F.lit(""))
    every = F.array("supplier_name", F.upper("supplier_name"), land, F.lower(land), F.lit("x"), F.lit("X"))
    return t.suppliers.select("supplier_id", F.array_join(X.distinct_ignoring_case(every), "|").alias("names"))


_ASKED = "SELECT DISTINCT CASE k % 5 WHEN 0 THEN upper(supplier_name) WHEN 1 THEN supplier_name || ' Trading Ltd' WHEN 2 THEN 'The ' || supplier_name || ' of York' WHEN 3 THEN 'York ' || supplier_name || ' Bakers and Millers' ELSE 'Nobody ' || k END AS name FROM (SELECT *, supplier_id::INT AS k FROM suppliers)"


@query(
    f"""{{views}},
asked0 AS ({_ASKED}), asked AS (SELECT name, lower(trim(name)) AS low, {_company_key('name')} AS key, {_core_words('name')} AS ws FROM asked0),
known AS (SELECT supplier_id, lower(trim(supplier_name)) AS s_low, {_company_key('supplier_name')} AS s_key, {_core_words('supplier_name')} AS s_ws FROM suppliers),
ex AS (SELECT name, min(supplier_id) AS exact FROM asked JOIN known ON low = s_low GROUP BY 1),
p AS (SELECT *, len(list_intersect(ws, s_ws)) AS common_n, len(list_distinct(ws || s_ws)) AS either FROM asked JOIN known ON list_has_any(ws, s_ws)),
q AS (SELECT name, supplier_id, CASE WHEN length(s_key) >= 3 AND (contains(' ' || key || ' ', ' ' || s_key || ' ') OR contains(' ' || s_key || ' ', ' ' || key || ' ')) THEN length(s_key) END AS inside, CASE WHEN common_n > 1 OR common_n = len(ws) OR common_n = len(s_ws) THEN greatest(common_n / either, CASE WHEN common_n = len(ws) AND common_n > 1 THEN 0.7 ELSE 0.0 END) END AS share FROM p),
c AS (SELECT name, arg_min(supplier_id, (-inside, supplier_id)) FILTER (inside IS NOT NULL) AS contained, arg_min(supplier_id, (-share, supplier_id)) FILTER (share >= 0.5) AS shared FROM q GROUP BY 1)
SELECT name, coalesce(exact, contained, shared) AS supplier_id, CASE WHEN exact IS NOT NULL THEN 'exact' WHEN contained IS NOT NULL THEN 'contained' WHEN shared IS NOT NULL THEN 'words' END AS how FROM asked LEFT JOIN ex USING (name) LEFT JOIN c USING (name)"""
)
def names_matched(t):
    k, name = F.col("supplier_id").cast("int"), F.col("supplier_name")
    asked = F.when(k % 5 == 0, F.upper(name)).when(k % 5 == 1, F.concat(name, F.lit(" Trading Ltd"))).when(k % 5 == 2, F.concat(F.lit("The "), name, F.lit(" of York")))
    asked = asked.when(k % 5 == 3, F.concat(F.lit("York "), name, F.lit(" Bakers and Millers"))).otherwise(F.concat(F.lit("Nobody "), k.cast("string")))
    return resolution.match_names(t.suppliers.select(asked.alias("name")), t.suppliers)


@query("SELECT conv_id, turn, arg_min(n_name, (-length(n_name), n_name)) AS name FROM (SELECT DISTINCT conv_id, turn, unnest(regexp_split_to_array(lower(text), '[ \\t\\r\\n\\f,;:.!?()]+')) AS w FROM conversations) JOIN (SELECT lower(trim(n_name)) AS w, n_name FROM (SELECT p_name, unnest(string_split(p_name, ' ')) AS n_name FROM part UNION ALL SELECT 'x', 'of' UNION ALL SELECT 'x', 'and' UNION ALL SELECT 'x', 'tion') WHERE length(n_name) >= 3) USING (w) GROUP BY 1, 2")
def names_in_turns(t):
    names = t.raw("part").select(F.explode(F.split("p_name", " ")).alias("supplier_name")).union(t.spark.createDataFrame([("of",), ("and",), ("tion",)], "supplier_name string")).distinct()
    rows = t.raw("conversations").select(F.struct("conv_id", "turn").alias("k"), "text")
    return resolution.named_in_texts(rows, names, "k", "text").select("k.conv_id", "k.turn", F.col("supplier_name").alias("name"))


@query(
    f"""SELECT o.po_id, coalesce(l.supplier_id, c.supplier_id) AS supplier_id, supplier_name, l.item_id, product, category, i.invoice_id, il.item_id AS invoice_item, {dec("line_total")} AS line_total, {dec("line_amount")} AS line_amount
FROM purchase_orders o LEFT JOIN po_lines l USING (po_id) LEFT JOIN contracts c USING (contract_id) LEFT JOIN suppliers s ON s.supplier_id = coalesce(l.supplier_id, c.supplier_id) LEFT JOIN products p ON p.item_id = l.item_id
LEFT JOIN invoices i ON i.po_id = o.po_id AND i.supplier_id = coalesce(l.supplier_id, c.supplier_id) LEFT JOIN invoice_lines il ON il.invoice_id = i.invoice_id"""
)
def procurement_flow_rows(t):
    rows = resolution.flow_rows(t.suppliers, t.contracts, t.purchase_orders, t.po_lines, t.invoices, t.invoice_lines, t.products)
    return rows.select("po_id", "supplier_id", "supplier_name", "item_id", "product", "category", "invoice_id", "invoice_item", C.rounded(F.col("line_total")).alias("line_total"), C.rounded(F.col("line_amount")).alias("line_amount"))


@query(f"SELECT invoice_id, item_id, coalesce(a.s, b.s) AS supplier_id, {dec('line_amount')} AS amount FROM invoice_lines l LEFT JOIN (SELECT invoice_id, min(supplier_id) AS s FROM invoices WHERE po_id::BIGINT % 2 = 0 GROUP BY 1) a USING (invoice_id) LEFT JOIN (SELECT po_id, min(supplier_id) AS s FROM po_lines GROUP BY 1) b USING (po_id)")
def invoice_line_suppliers(t):
    known = t.invoices.where(F.col("po_id").cast("long") % 2 == 0)
    return resolution.supplier_of_lines(t.invoice_lines, known, t.po_lines).select("invoice_id", "item_id", "supplier_id", C.rounded(F.col("line_amount")).alias("amount"))


@query(f"SELECT s.supplier_id, supplier_name, spend FROM suppliers s LEFT JOIN (SELECT supplier_id, round({money('line_total')}, 2) AS spend FROM po_lines WHERE supplier_id::INT % 3 = 0 GROUP BY 1) USING (supplier_id) WHERE s.supplier_id::INT % 2 = 0")
def candidate_rows(t):
    spend = t.po_lines.where(F.col("supplier_id").cast("int") % 3 == 0).groupBy("supplier_id").agg(F.round(C.total(F.col("line_total")), 2).alias("spend"))
    rows = spend.join(t.suppliers.select("supplier_id", "supplier_name"), "supplier_id")
    wanted = t.suppliers.where(F.col("supplier_id").cast("int") % 2 == 0).select(F.concat(F.lit(" "), "supplier_id").alias("supplier_id"))
    return resolution.with_candidates(rows, wanted, t.suppliers).select("supplier_id", "supplier_name", "spend")


@query("SELECT supplier_id, supplier_name FROM suppliers WHERE supplier_id IN ('1', '3') OR lower(supplier_name) IN ('supplier#000000005', 'supplier#7')")
def suppliers_asked_for(t):
    return resolution.of_suppliers(t.suppliers, ["1", "3"], [" SUPPLIER#000000005", "supplier#7"]).select("supplier_id", "supplier_name")


@query("SELECT supplier_id, supplier_name FROM suppliers WHERE supplier_id::INT % 4 IN (0, 1)")
def suppliers_by_spelling(t):
    k = F.col("supplier_id").cast("int")
    wanted = t.suppliers.where(k % 4 <= 1).select(F.when(k % 4 == 0, F.upper("supplier_name")).otherwise(F.concat("supplier_name", F.lit(" Ltd."))).alias("supplier_name"))
    return resolution.by_spellings(t.suppliers, wanted, "supplier_name").select("supplier_id", "supplier_name")


@query("SELECT quote_id, supplier_id, round(total_cost, 2) AS total_cost FROM quotes ORDER BY quote_date DESC NULLS LAST, quote_id LIMIT 100")
def quotes_with_fallback(t):
    order = [F.desc_nulls_last("quote_date"), F.col("quote_id")]
    return resolution.with_fallback(t.quotes, F.col("supplier_id") == "none", order).select("quote_id", "supplier_id", F.round("total_cost", 2).alias("total_cost"))


@query("SELECT quote_id, side, round(total_cost, 2) AS total_cost FROM (SELECT quote_id, 'own' AS side, total_cost FROM quotes WHERE lead_days % 2 = 0 UNION ALL SELECT quote_id, 'found', total_cost FROM quotes WHERE lead_days % 3 = 0) QUALIFY row_number() OVER (PARTITION BY quote_id ORDER BY side DESC) = 1")
def quote_sources_merged(t):
    q = t.quotes.select("quote_id", F.round("total_cost", 2).alias("total_cost"), "lead_days")
    own, found = q.where("lead_days % 2 = 0").drop("lead_days").withColumn("side", F.lit("own")), q.where("lead_days % 3 = 0").drop("lead_days").withColumn("side", F.lit("found"))
    return resolution.merged(own, found, F.col("quote_id")).select("quote_id", "side", "total_cost")


@query("SELECT supplier_id, count(paid_date) AS n_responses, round(avg(((paid_date - invoice_date) * 24)::DECIMAL(20,6))::DECIMAL(28,6), 2)::DOUBLE AS hours, CASE WHEN hours IS NULL THEN 'Unknown' WHEN hours < 24 THEN 'Very Responsive' WHEN hours < 72 THEN 'Moderate' ELSE 'Slow' END AS speed FROM (SELECT supplier_id, invoice_date, CASE WHEN supplier_id::INT % 5 > 0 THEN paid_date END AS paid_date FROM invoices) GROUP BY 1")
def supplier_responses(t):
    rows = t.invoices.select("supplier_id", "invoice_date", F.when(F.col("supplier_id").cast("int") % 5 > 0, F.col("paid_date")).alias("paid_date"))
    return insight.response_stats(rows, "supplier_id", "invoice_date", "paid_date")


@query("SELECT workflow_id, n_invited, coalesce(n_answered, 0) AS n_answered, coalesce(n_answered, 0) >= least(40, n_invited) AS ready FROM (SELECT user_id % 50 AS workflow_id, count(DISTINCT user_id) AS n_invited FROM events WHERE event_type = 'view' GROUP BY 1) LEFT JOIN (SELECT user_id % 50 AS workflow_id, count(DISTINCT user_id) AS n_answered FROM events WHERE event_type = 'purchase' AND value > 50 GROUP BY 1) USING (workflow_id)")
def negotiation_triggers(t):
    e = t.raw("events").withColumn("workflow_id", F.col("user_id") % 50)
    return insight.negotiation_ready(e.where("event_type = 'view'"), e.where("event_type = 'purchase' and value > 50"), "workflow_id", "user_id", 40)


@query(f"SELECT sentiment, count(*) AS n, round(avg(up), 4) AS up, round(avg(down), 4) AS down FROM ({SQL_OF['conversation_feedback']}) GROUP BY 1")
def feedback_statistics(t):
    return insight.by_sentiment(records.feedback(t.raw("conversations")))


@query("SELECT 'events' AS name, count(*) AS n_rows, 6 AS n_columns, count(*) > 0 AS filled FROM events UNION ALL SELECT 'labels', count(*), 3, count(*) > 0 FROM labels UNION ALL SELECT 'none', 0, 5, false")
def data_profile(t):
    return insight.data_profile({"events": t.raw("events"), "labels": t.raw("labels"), "none": t.raw("documents").where("false")})


@query("SELECT supplier_id, first(item_id ORDER BY k) AS mode, string_agg(item_id, ',' ORDER BY k) AS top FROM (SELECT *, row_number() OVER (PARTITION BY supplier_id ORDER BY n DESC, item_id) AS k FROM (SELECT supplier_id, item_id, count(*) AS n FROM po_lines GROUP BY ALL)) WHERE k <= 5 GROUP BY 1")
def top_items(t):
    return insight.top_values(t.po_lines, "supplier_id", "item_id").select("supplier_id", "mode", F.array_join("top", ",").alias("top"))


@query(f"SELECT supplier_id, (CASE WHEN coalesce(po, 0) > 0 THEN 1 ELSE 0 END + CASE WHEN coalesce(inv, 0) + coalesce(n, 0) > 0 THEN 1 ELSE 0 END + CASE WHEN coalesce(po, 0) > 1e7 THEN 1 ELSE 0 END) / 3 AS coverage FROM suppliers LEFT JOIN (SELECT supplier_id, {money('line_total')} AS po FROM po_lines WHERE supplier_id::INT % 2 = 0 GROUP BY 1) USING (supplier_id) LEFT JOIN (SELECT supplier_id, {money('line_amount')} AS inv, count(*) AS n FROM invoice_lines WHERE supplier_id::INT % 3 = 0 GROUP BY 1) USING (supplier_id)")
def metric_coverage(t):
    k = F.col("supplier_id").cast("int")
    po = t.po_lines.where(k % 2 == 0).groupBy("supplier_id").agg(C.total(F.col("line_total")).alias("po"))
    inv = t.invoice_lines.where(k % 3 == 0).groupBy("supplier_id").agg(C.total(F.col("line_amount")).alias("inv"), F.count("*").alias("n"))
    rows = t.suppliers.select("supplier_id").join(po, "supplier_id", "left").join(inv, "supplier_id", "left").withColumn("large", F.col("po") - 1e7)
    return rows.select("supplier_id", insight.coverage(rows, [["po", "absent"], ["inv", "n"], ["absent"], ["large"]]).alias("coverage"))


@query("SELECT round(min(total_cost), 2) AS least_price, round(max(total_cost), 2) AS greatest_price, min(lead_days) AS least_lead, max(lead_days) AS greatest_lead, max(days)::INT AS greatest_terms FROM quotes JOIN terms USING (payment_terms)")
def quote_context(t):
    q = t.quotes.withColumn("total_cost", F.round("total_cost", 2))
    return insight.analytics_context(q, "total_cost", "lead_days", C.terms_days(F.col("payment_terms")))


_CANDIDATES = "SELECT l_orderkey AS doc, 'total' AS field, CASE WHEN l_linenumber % 2 = 0 THEN ' ab  c' ELSE 'AB C' END || (l_linenumber // 3)::VARCHAR AS value, l_returnflag AS method, round(l_discount * 5 + 0.3, 4) AS confidence FROM lineitem"
_CONSENSUS = f"""SELECT * FROM (SELECT *, round(least(1.0, CASE WHEN n_methods >= 2 THEN least(1.0, c + 0.1) ELSE c END + least(0.05 * (n_methods - 1), 0.15)), 3) AS score FROM (SELECT doc, field, upper(regexp_replace(trim(value), '[ \\t\\r\\n]+', ' ', 'g')) AS same, max(confidence) AS c, count(DISTINCT method) AS n_methods, arg_min(value, (-confidence, value)) AS value FROM ({_CANDIDATES}) GROUP BY ALL)) QUALIFY row_number() OVER (PARTITION BY doc, field ORDER BY score DESC, same) = 1"""


def extracted(t: Tables) -> DataFrame:
    line = F.col("l_linenumber")
    value = F.concat(F.when(line % 2 == 0, " ab  c").otherwise("AB C"), F.floor(line / 3).cast("string"))
    return t.raw("lineitem").select(F.col("l_orderkey").alias("doc"), F.lit("total").alias("field"), value.alias("value"), F.col("l_returnflag").alias("method"), F.round(F.col("l_discount") * 5 + 0.3, 4).alias("confidence"))


@query(f"SELECT doc, field, value, score, n_methods FROM ({_CONSENSUS}) WHERE score >= 0.5")
def fields_agreed(t):
    return insight.consensus(extracted(t), ["doc"])


@query("SELECT l_orderkey AS doc, round(count(DISTINCT l_returnflag) / 3, 3) AS coverage, round(sum(DISTINCT CASE l_returnflag WHEN 'A' THEN 3 WHEN 'N' THEN 2 ELSE 1 END) / 6, 3) AS weighted FROM lineitem GROUP BY 1")
def field_coverage(t):
    rows = t.raw("lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_returnflag").alias("field"))
    return insight.field_coverage(rows, ["doc"], {"A": 3, "N": 2, "R": 1})


@query("SELECT po_id, array_to_string(list_filter([CASE WHEN r IS NULL THEN 'record' END, CASE WHEN r IS NOT NULL AND contract_id IS NULL THEN 'contract' END, CASE WHEN r IS NOT NULL AND amount <= 50000 THEN 'amount' END], lambda x: x IS NOT NULL), ',') AS failed FROM (SELECT DISTINCT po_id FROM po_lines) LEFT JOIN (SELECT po_id, true AS r, contract_id, total_amount AS amount FROM purchase_orders WHERE po_id::BIGINT % 11 > 0) USING (po_id) WHERE failed <> ''")
def order_discrepancies(t):
    orders = t.purchase_orders.where(F.col("po_id").cast("long") % 11 > 0).select("po_id", "contract_id", "total_amount")
    out = insight.discrepancies(t.po_lines, orders, "po_id", {"contract": F.col("contract_id").isNull(), "amount": F.col("total_amount") <= 50000})
    return out.select("po_id", F.array_join("failed", ",").alias("failed"))


@query("SELECT count(*) AS n_queries, round(avg((n > 1)::INT), 4) AS share FROM (SELECT po_id, count(DISTINCT supplier_id) AS n FROM po_lines GROUP BY 1)")
def multi_source_orders(t):
    return insight.multi_source_share(t.po_lines, "po_id", "supplier_id")


@query("SELECT user_id % 10 AS workflow_id, count(DISTINCT user_id) AS n_expected, arg_max(event_id, (ts, event_id)) AS last FROM events WHERE event_type = 'view' GROUP BY 1")
def expected_members(t):
    return insight.expected_members(t.raw("events").where("event_type = 'view'").withColumn("workflow_id", F.col("user_id") % 10), "workflow_id", "user_id", "ts", "event_id")


@query("SELECT doc, arg_max(value, (confidence, length(value), value)) AS value, max(confidence) AS confidence FROM (" + _CANDIDATES + ") GROUP BY 1")
def best_candidates(t):
    return insight.best_candidates(extracted(t), ["doc"], "value", "confidence")


@query("SELECT user_id, event_id, row_number() OVER w AS step, round((value - lag(value) OVER w)::DECIMAL(28,6), 2)::DOUBLE AS change FROM events WHERE event_type = 'purchase' WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def negotiation_steps(t):
    return insight.steps_of(t.raw("events").where("event_type = 'purchase'"), "user_id", ["ts", "event_id"], "value").select("user_id", "event_id", F.col("step").cast("long").alias("step"), "change")


@query("SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS roles, count(*) AS n_turns, max(CASE WHEN role = 'assistant' THEN turn END) AS last_answer FROM conversations GROUP BY 1")
def threads(t):
    return insight.thread(t.raw("conversations"), "conv_id", "turn", "role", "assistant")


@query("SELECT source, doc_id, k AS rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS k FROM documents WHERE n_chars >= 1000) WHERE k <= 12")
def rerank_span(t):
    return insight.rerank_span(t.raw("documents").select("source", "doc_id", "n_chars"), "source", "doc_id", "n_chars", 12, 1000).select("source", "doc_id", F.col("rank").cast("long").alias("rank"))


@query("SELECT event_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-20 00:00:00'")
def events_since(t):
    since = F.to_timestamp_ntz(F.lit("2024-01-20 00:00:00")) if dict(t.raw("events").dtypes)["ts"] == "timestamp_ntz" else F.lit("2024-01-20 00:00:00").cast("timestamp")
    return insight.changed_since(t.raw("events"), "ts", since).select("event_id", "event_type")


_STATE = "CASE o_orderkey % 6 WHEN 0 THEN ' Done ' WHEN 1 THEN 'ERROR' WHEN 2 THEN '2.5' WHEN 3 THEN '' WHEN 4 THEN 'nan' ELSE o_orderstatus END"
_DONE, _NOT_DONE = (", ".join(map(quoted, x)) for x in (X.DONE, X.NOT_DONE))


@query(f"SELECT order_key, CASE WHEN done THEN 1 ELSE -1 END AS sign, CASE WHEN done THEN 'completed' ELSE 'failed' END AS label, known AS recognised FROM (SELECT *, coalesce(s IN ({_DONE}) OR (v IS NOT NULL AND NOT isnan(v) AND v > 0), false) AS done, coalesce(s IN ({_DONE}, {_NOT_DONE}) OR (v IS NOT NULL AND NOT isnan(v)), false) AS known FROM (SELECT o_orderkey AS order_key, lower(trim({_STATE})) AS s, try_cast(lower(trim({_STATE})) AS DOUBLE) AS v FROM orders))")
def completion_states(t):
    odd = F.col("o_orderkey") % 6
    state = F.when(odd == 0, " Done ").when(odd == 1, "ERROR").when(odd == 2, "2.5").when(odd == 3, "").when(odd == 4, "nan").otherwise(F.col("o_orderstatus"))
    return t.raw("orders").select(F.col("o_orderkey").alias("order_key"), X.completion(state).alias("c")).select("order_key", "c.*")


@query("SELECT event_id, round(CASE WHEN v IS NULL OR v < 0 THEN 0.0 WHEN v > 1 THEN least(v / 100, 1.0) ELSE v END, 6) AS share FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 7 = 1 THEN value / 1000 ELSE value - 20 END AS v FROM events)")
def risk_shares(t):
    odd, value = F.col("event_id") % 7, F.col("value")
    return t.raw("events").select("event_id", F.round(C.risk_share(F.when(odd == 0, None).when(odd == 1, value / 1000).otherwise(value - 20)), 6).alias("share"))


@query("SELECT rank_position, supplier_id, q.quote_id AS quote_id, round(q.total_cost, 2) AS total_cost FROM (SELECT rank_position, supplier_id, arg_min(quotes, (total_cost, quote_id)) AS q FROM (SELECT supplier_id, row_number() OVER (ORDER BY risk_score DESC, supplier_id)::INT AS rank_position FROM suppliers ORDER BY rank_position LIMIT 10) JOIN quotes USING (supplier_id) GROUP BY 1, 2) ORDER BY rank_position LIMIT 3")
def quotes_by_rank(t):
    order = [F.col("risk_score").desc_nulls_last(), F.col("supplier_id")]
    ten = t.suppliers.select("supplier_id", "risk_score").orderBy(*order).limit(10)
    ranked = ten.select("supplier_id", F.row_number().over(Window.orderBy(*order)).alias("rank_position"))
    return quotes.cheapest_of_ranked(t.quotes, ranked)


_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower(coalesce({}, '')), '[^a-z0-9]+'), lambda x: x <> ''))"


@query(f"SELECT conv_id, turn, round(CASE WHEN len(list_distinct(a || b)) > 0 THEN len(list_intersect(a, b)) / len(list_distinct(a || b)) ELSE 0.0 END, 6) AS overlap FROM (SELECT x.conv_id, x.turn, {_WORDS.format('x.text')} AS a, {_WORDS.format('y.text')} AS b FROM conversations x JOIN conversations y ON x.conv_id = y.conv_id AND x.turn = y.turn + 1)")
def turn_overlap(t):
    turns = t.raw("conversations").select("conv_id", "turn", C.words_of(F.col("text")).alias("a"))
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("a").alias("b"))
    return turns.join(before, ["conv_id", "turn"]).select("conv_id", "turn", F.round(C.jaccard(F.col("a"), F.col("b")), 6).alias("overlap"))


_REPLY = "CASE o_orderkey % 4 WHEN 0 THEN 'Our price is £' || amount || '. Lead time 3 weeks. Net ' || o_orderkey % 60 || ' days, green steel.' WHEN 1 THEN 'USD 1,250.50 first, then EUR ' || amount || ' with a discount. A delay of 10 business days is a risk! More soon.' WHEN 2 THEN 'We are unable to quote. Call 12.' ELSE 'Final offer: ' || amount || ', delivery 2.5 days' END"
_BARE_REPLY = f"regexp_replace(regexp_replace(r, '{X.DURATION}', ' ', 'g'), '{X.NET_DAYS}', ' ', 'g')"
_SENTENCES = "array_to_string(list_transform(list_filter(string_split(regexp_replace(r, '([.!?])[ \\t\\r\\n\\f]+', '\\1' || chr(1), 'g'), chr(1)), lambda s: regexp_matches(s, '{}')), lambda s: trim(s)), '|')"
_OFFERS = f"""SELECT order_key, try_cast(replace(regexp_extract_all({_BARE_REPLY}, '{X.PRICED}', 1)[-1], ',', '') AS DOUBLE) AS price,
 CASE upper(regexp_extract_all({_BARE_REPLY}, '{X.MONEY_OF}', 1)[-1]) {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in X.SIGNS.items())} ELSE upper(regexp_extract_all({_BARE_REPLY}, '{X.MONEY_OF}', 1)[-1]) END AS currency,
 try_cast(nullif(regexp_extract(r, '{X.NET_DAYS}', 1), '') AS BIGINT) AS net_days,
 round_even(try_cast(regexp_extract_all(r, '{X.DURATION}', 1)[-1] AS DOUBLE) * CASE WHEN contains(lower(regexp_extract_all(r, '{X.DURATION}', 2)[-1]), 'week') THEN 7 ELSE 1 END, 0)::BIGINT AS lead_days,
 {_SENTENCES.format(X.RISK_WORDS)} AS risks, {_SENTENCES.format(X.GREEN_WORDS)} AS green FROM (SELECT o_orderkey AS order_key, {_REPLY} AS r FROM (SELECT *, o_totalprice::DECIMAL(18,2)::VARCHAR AS amount FROM orders))"""


def offers_in_replies(t):
    k, amount = F.col("o_orderkey"), F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    first = F.concat(F.lit("Our price is £"), amount, F.lit(". Lead time 3 weeks. Net "), (k % 60).cast("string"), F.lit(" days, green steel."))
    second = F.concat(F.lit("USD 1,250.50 first, then EUR "), amount, F.lit(" with a discount. A delay of 10 business days is a risk! More soon."))
    reply = F.when(k % 4 == 0, first).when(k % 4 == 1, second).when(k % 4 == 2, "We are unable to quote. Call 12.").otherwise(F.concat(F.lit("Final offer: "), amount, F.lit(", delivery 2.5 days")))
    r = F.col("r")
    return t.raw("orders").select(k.alias("order_key"), reply.alias("r")).select(
        "order_key", X.last_price(r).alias("price"), X.last_currency(r).alias("currency"), X.net_days(r).alias("net_days"), X.lead_days(r).alias("lead_days"),
        F.array_join(X.sentences_with(r, X.RISK_WORDS), "|").alias("risks"), F.array_join(X.sentences_with(r, X.GREEN_WORDS), "|").alias("green"),
    )


@query(_OFFERS)
def reply_offers(t):
    return offers_in_replies(t)


@query(f"SELECT min(price) AS price_min, max(price) AS price_max, min(lead_days) AS lead_min, max(lead_days) AS lead_max, max(net_days) AS net_max FROM ({_OFFERS})")
def offer_bounds(t):
    return insight.offer_bounds(offers_in_replies(t))


@query("SELECT lang, source, doc_id, row_number() OVER (PARTITION BY lang ORDER BY score DESC, doc_id)::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY (place = 1) DESC, score DESC, doc_id) AS k FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY score DESC, doc_id) AS place FROM (SELECT lang, source, doc_id, n_chars + CASE source WHEN 'src3' THEN 0.12 WHEN 'src8' THEN 0.14 ELSE 0.08 END AS score FROM documents WHERE lang IS NOT NULL))) WHERE k <= 8")
def hits_covering(t):
    bonus = X.mapped(F.col("source"), {"src3": 0.12, "src8": 0.14}, 0.08)
    hits = t.raw("documents").where("lang IS NOT NULL").select("lang", "source", "doc_id", (F.col("n_chars") + bonus).alias("score"))
    return retrieval.covering(hits, ["lang"], "source", "score", "doc_id", 8).select("lang", "source", "doc_id", "rank")


def with_views(sql: str) -> str:
    """{views} stands for the common tables that a text goes on from, {recursive} for the same where it has recursive ones."""
    return sql.replace("{views}", VIEWS).replace("{recursive}", VIEWS.replace("WITH", "WITH RECURSIVE", 1)) if sql.startswith(("{views}", "{recursive}")) else VIEWS + sql

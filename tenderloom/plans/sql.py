"""The same queries as DuckDB SQL, over the same Parquet tables."""

from __future__ import annotations

from tenderloom.plans.queries import AS_OF, EVENTS_AS_OF


def money(x: str) -> str:
    return f"coalesce(sum(({x})::DECIMAL(28,6))::DOUBLE, 0.0)"


VIEWS = f"""WITH
suppliers AS (SELECT s_suppkey::VARCHAR AS supplier_id, s_name AS supplier_name, n_name AS country, round((s_acctbal + 1000) / 11000, 4) AS risk_score FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey),
po_lines AS (SELECT l_orderkey::VARCHAR AS po_id, l_suppkey::VARCHAR AS supplier_id, l_partkey::VARCHAR AS item_id, l_quantity AS quantity, l_extendedprice / l_quantity AS unit_price, l_extendedprice AS line_total, l_shipdate::DATE AS ship_date FROM lineitem),
purchase_orders AS (SELECT o_orderkey::VARCHAR AS po_id, o_orderdate::DATE AS order_date, o_totalprice AS total_amount, o_orderstatus AS po_status, CASE WHEN o_orderkey % 7 <> 0 THEN 'C-' || (o_orderkey % 1200)::VARCHAR END AS contract_id, ['GBP', 'USD', 'EUR'][o_orderkey % 3 + 1] AS currency FROM orders),
invoice_lines AS (SELECT l_orderkey::VARCHAR || '-' || l_suppkey::VARCHAR AS invoice_id, l_orderkey::VARCHAR AS po_id, l_suppkey::VARCHAR AS supplier_id, l_partkey::VARCHAR AS item_id, l_quantity AS quantity, l_extendedprice * (1 - l_discount) / l_quantity AS unit_price, l_extendedprice * (1 - l_discount) AS line_amount, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS total_amount_incl_tax, l_shipdate::DATE AS ship_date FROM lineitem WHERE l_linestatus = 'F'),
invoices0 AS (SELECT invoice_id, po_id, supplier_id, {money("total_amount_incl_tax")} AS invoice_amount, max(ship_date) AS invoice_date FROM invoice_lines GROUP BY ALL),
invoices AS (SELECT *, invoice_date + 30 AS due_date, invoice_date + (po_id::BIGINT % 45)::INT AS paid_date FROM invoices0),
contracts AS (SELECT 'C-' || supplier_id AS contract_id, supplier_id, round({money("line_total")} * 1.2, 2) AS total_contract_value, max(ship_date) + (supplier_id::BIGINT * 7 % 400)::INT AS contract_end_date FROM po_lines GROUP BY supplier_id),
products AS (SELECT p_partkey::VARCHAR AS item_id, p_name AS product, p_type AS category, p_brand AS brand FROM part),
quotes0 AS (SELECT po_id, supplier_id, {money("line_total")} AS total_cost, count(*) AS n_lines FROM po_lines GROUP BY ALL),
quotes AS (SELECT 'Q-' || po_id || '-' || supplier_id AS quote_id, po_id, supplier_id, total_cost, n_lines, po_status = 'F' AS awarded, currency, order_date AS quote_date, (po_id::BIGINT % 30 + 5)::INT AS lead_days, ['Net 30', 'Net 60', 'immediate', '45 days'][po_id::BIGINT % 4 + 1] AS payment_terms FROM quotes0 JOIN purchase_orders USING (po_id)),
terms AS (SELECT * FROM (VALUES ('Net 30', 30, 66.67), ('Net 60', 60, 33.33), ('immediate', 0, 100.0), ('45 days', 45, 50.0)) v(payment_terms, days, score)),
f_volume AS (SELECT 'volume_discount' AS detector, supplier_id, item_id, NULL::VARCHAR AS category, round(({money("line_total")} * 0.05)::DECIMAL(28,6), 2)::DOUBLE AS impact, supplier_id AS sources FROM po_lines GROUP BY supplier_id, item_id HAVING sum(quantity) >= 100 OR {money("line_total")} >= 300000),
f_cat0 AS (SELECT category, supplier_id, {money("line_total")} AS spend FROM po_lines JOIN products USING (item_id) WHERE category IS NOT NULL GROUP BY ALL),
f_cat1 AS (SELECT *, count(*) OVER (PARTITION BY category) AS n, sum(spend) OVER (PARTITION BY category) AS total_spend, row_number() OVER (PARTITION BY category ORDER BY spend DESC, supplier_id) AS k FROM f_cat0),
f_consolidation AS (SELECT 'supplier_consolidation' AS detector, supplier_id, NULL::VARCHAR AS item_id, category, round((spend * 0.05)::DECIMAL(28,6), 2)::DOUBLE AS impact, supplier_id AS sources FROM f_cat1 WHERE n > 1 AND total_spend >= 1000 AND k > 1),
f_price AS (SELECT item_id, supplier_id, round(avg(unit_price), 6) AS price, sum(quantity) AS quantity, {money("line_total")} AS spend FROM po_lines WHERE unit_price > 0 AND quantity > 0 GROUP BY ALL),
f_best AS (SELECT *, count(*) OVER w AS n, sum(spend) OVER w AS total_spend, min(price) OVER w AS best, first_value(supplier_id) OVER (PARTITION BY item_id ORDER BY price, supplier_id) AS best_supplier, row_number() OVER (PARTITION BY item_id ORDER BY spend DESC, supplier_id) AS k FROM f_price WINDOW w AS (PARTITION BY item_id)),
f_volcon AS (SELECT 'volume_consolidation' AS detector, supplier_id, item_id, NULL::VARCHAR AS category, round(((price - best) * quantity)::DECIMAL(28,6), 2)::DOUBLE AS impact, supplier_id AS sources FROM f_best WHERE n > 1 AND total_spend >= 1500000 AND supplier_id <> best_supplier AND (price - best) * quantity > 0),
f_dup AS (SELECT 'duplicate_supplier' AS detector, supplier_id, item_id, NULL::VARCHAR AS category, round((total_spend)::DECIMAL(28,6), 2)::DOUBLE AS impact, supplier_id AS sources FROM f_best WHERE n > 1 AND total_spend >= 1500000 AND k = 1),
f_expiry AS (SELECT 'contract_expiry' AS detector, supplier_id, NULL::VARCHAR AS item_id, NULL::VARCHAR AS category, total_contract_value AS impact, contract_id AS sources FROM contracts WHERE contract_end_date - DATE '{AS_OF}' BETWEEN 0 AND 90),
f_risk AS (SELECT 'supplier_risk' AS detector, supplier_id, NULL::VARCHAR AS item_id, NULL::VARCHAR AS category, round((risk_score * 1000)::DECIMAL(28,6), 2)::DOUBLE AS impact, supplier_id AS sources FROM suppliers WHERE risk_score >= 0.8),
f_unused0 AS (SELECT contract_id, supplier_id, total_contract_value - coalesce(spent, 0) AS left_over FROM contracts LEFT JOIN (SELECT supplier_id, {money("invoice_amount")} AS spent FROM invoices GROUP BY 1) USING (supplier_id)),
f_unused AS (SELECT 'unused_contract_value' AS detector, supplier_id, NULL::VARCHAR AS item_id, NULL::VARCHAR AS category, round((left_over)::DECIMAL(28,6), 2)::DOUBLE AS impact, contract_id AS sources FROM f_unused0 WHERE left_over >= 1000),
findings0 AS (SELECT * FROM f_volume UNION ALL SELECT * FROM f_consolidation UNION ALL SELECT * FROM f_volcon UNION ALL SELECT * FROM f_dup UNION ALL SELECT * FROM f_expiry UNION ALL SELECT * FROM f_risk UNION ALL SELECT * FROM f_unused),
findings AS (SELECT *, concat_ws('_', 'P', detector, sha1(sources)[1:8], coalesce(supplier_id, ''), coalesce(item_id, '')) AS ref_id FROM findings0),
words AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM documents),
wanted AS (SELECT DISTINCT query_id, unnest(w) AS term FROM (SELECT item_id AS query_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM benchmark WHERE item_id % 100 = 0)),
tf AS (SELECT doc_id, size, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS size, unnest(w) AS term FROM words) WHERE term IN (SELECT term FROM wanted) GROUP BY ALL),
idf AS (SELECT term, ln((n - df + 0.5) / (df + 0.5) + 1) AS idf, avg_size FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), (SELECT count(*) AS n, avg(len(w)) AS avg_size FROM words)),
bm25 AS (SELECT query_id, doc_id, round(sum((idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * size / avg_size)))::DECIMAL(28,12))::DOUBLE, 6) AS score FROM tf JOIN idf USING (term) JOIN wanted USING (term) GROUP BY ALL),
bm25_rank AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm25),
bm0 AS (SELECT query_id, doc_id, round(sum((idf * tf * 2.5 / (tf + 1.5))::DECIMAL(28,12))::DOUBLE, 6) AS score FROM tf JOIN idf USING (term) JOIN wanted USING (term) GROUP BY ALL),
bm0_rank AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm0)
"""

_FINDING = "detector, supplier_id, item_id, category, impact, sources"
_FLOW_COUNTS = "coalesce(n_contracts, 0) AS n_contracts, coalesce(n_orders, 0) AS n_orders, coalesce(n_invoices, 0) AS n_invoices, coalesce(n_quotes, 0) AS n_quotes, coalesce(n_items, 0) AS n_items"
_FLOWS = f"""SELECT supplier_id, {_FLOW_COUNTS}, coalesce(po_value, 0.0) AS po_value, coalesce(invoice_value, 0.0) AS invoice_value, latest_end, ((coalesce(n_contracts, 0) > 0)::INT + (coalesce(n_orders, 0) > 0)::INT + (coalesce(n_invoices, 0) > 0)::INT + (coalesce(n_quotes, 0) > 0)::INT) / 4 AS coverage
FROM suppliers LEFT JOIN (SELECT supplier_id, count(*) AS n_contracts, max(contract_end_date) AS latest_end FROM contracts GROUP BY 1) USING (supplier_id)
LEFT JOIN (SELECT supplier_id, count(DISTINCT po_id) AS n_orders, count(DISTINCT item_id) AS n_items, round({money("line_total")}, 2) AS po_value FROM po_lines GROUP BY 1) USING (supplier_id)
LEFT JOIN (SELECT supplier_id, count(*) AS n_invoices, round({money("invoice_amount")}, 2) AS invoice_value FROM invoices GROUP BY 1) USING (supplier_id)
LEFT JOIN (SELECT supplier_id, count(*) AS n_quotes FROM quotes GROUP BY 1) USING (supplier_id)"""


def _overlap() -> str:
    from tenderloom.operators.flows import RELATIONS

    parts = []
    for source, a, target, b, kind, _ in RELATIONS:
        k = f"SELECT DISTINCT upper(trim({{}})) AS k FROM {{}} WHERE {{}} IS NOT NULL"
        left, right = k.format(a, source, a), k.format(b, target, b)
        parts.append(f"SELECT '{source}.{a}' AS source, '{target}.{b}' AS target, '{kind}' AS kind, s AS source_keys, t AS target_keys, c AS shared_keys, round(c / s, 6) AS source_coverage, round(c / t, 6) AS target_coverage FROM (SELECT (SELECT count(*) FROM ({left})) AS s, (SELECT count(*) FROM ({right})) AS t, (SELECT count(*) FROM (({left}) INTERSECT ({right}))) AS c)")
    return " UNION ALL ".join(parts)


_HITS = lambda words: " + ".join(f"contains(t, '{w}')::INT * {2 if ' ' in w else 1}" for w in words)


def _types() -> str:
    from tenderloom.operators.records import TYPES

    cols = ", ".join(f"{_HITS(w)} AS {k}" for k, w in TYPES.items())
    case = " ".join(f"WHEN {k} = score THEN '{k}'" for k in TYPES)
    return f"SELECT doc_id, CASE WHEN score < 2 THEN 'unknown' {case} END AS document_type, score::INT AS score FROM (SELECT *, greatest({', '.join(TYPES)}) AS score FROM (SELECT doc_id, {cols} FROM (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents)))"


def _feedback() -> str:
    from tenderloom.operators.records import NEGATIVE, POSITIVE

    return f"SELECT conv_id, turn, CASE WHEN up > down THEN 'positive' WHEN down > up THEN 'negative' ELSE 'neutral' END AS sentiment, up, down FROM (SELECT conv_id, turn, ({_HITS(POSITIVE)})::INT AS up, ({_HITS(NEGATIVE)})::INT AS down FROM (SELECT *, lower(coalesce(text, '')) AS t FROM conversations WHERE role = 'user'))"


_DAY = f"DATE '{AS_OF}'"
_SPLIT_WS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\r\n]+'), lambda x: x <> '')"

SQL: dict[str, str] = {
    "supplier_spend": f"""SELECT supplier_id, supplier_name, round(coalesce(a, 0), 2) AS po_spend, round(coalesce(b, 0), 2) AS invoice_spend, round(coalesce(a, 0) + coalesce(b, 0), 2) AS total_spend, coalesce(n, 0) AS invoice_count FROM suppliers
LEFT JOIN (SELECT supplier_id, {money("unit_price * quantity")} AS a FROM po_lines GROUP BY 1) USING (supplier_id) LEFT JOIN (SELECT supplier_id, {money("unit_price * quantity")} AS b, count(DISTINCT invoice_id) AS n FROM invoice_lines GROUP BY 1) USING (supplier_id)""",
    "top_supplier_spend": f"SELECT supplier_id, round({money('line_total')}, 2) AS spend, count(*) AS n_rows FROM po_lines GROUP BY 1 ORDER BY spend DESC, supplier_id LIMIT 10",
    "supplier_risk_top": "SELECT supplier_id, supplier_name, risk_score FROM suppliers ORDER BY risk_score DESC NULLS LAST, supplier_id LIMIT 10",
    "invoice_headers_resolved": "SELECT invoice_id, supplier_id, supplier_name, round(invoice_amount::DECIMAL(28,6), 2)::DOUBLE AS invoice_amount, invoice_date, due_date FROM invoices LEFT JOIN suppliers USING (supplier_id)",
    "procurement_flow": f"""SELECT supplier_id, coalesce(n_orders, 0) AS n_orders, coalesce(n_lines, 0) AS n_lines, coalesce(n_invoices, 0) AS n_invoices, coalesce(n_contracts, 0) AS n_contracts, coalesce(spend, 0.0) AS spend FROM suppliers
LEFT JOIN (SELECT coalesce(l.supplier_id, c.supplier_id) AS supplier_id, count(DISTINCT p.po_id) AS n_orders, count(line_total) AS n_lines, round({money('line_total')}, 2) AS spend FROM purchase_orders p LEFT JOIN contracts c ON p.contract_id = c.contract_id LEFT JOIN po_lines l ON p.po_id = l.po_id GROUP BY 1) USING (supplier_id)
LEFT JOIN (SELECT supplier_id, count(*) AS n_invoices FROM invoices GROUP BY 1) USING (supplier_id) LEFT JOIN (SELECT supplier_id, count(*) AS n_contracts FROM contracts GROUP BY 1) USING (supplier_id)""",
    "gbp_normalised_orders": "SELECT po_id, currency, round((total_amount * r)::DECIMAL(28,6), 2)::DOUBLE AS total_amount_gbp, round((total_amount * r / 0.79::DOUBLE)::DECIMAL(28,6), 2)::DOUBLE AS total_amount_usd FROM purchase_orders JOIN (VALUES ('GBP', 1::DOUBLE), ('USD', 0.79::DOUBLE), ('EUR', 0.85::DOUBLE)) v(currency, r) USING (currency)",
    "cheaper_suppliers": "SELECT item_id, supplier_id, round(price::DECIMAL(28,6), 4)::DOUBLE AS price, best_supplier_id, round(best_price::DECIMAL(28,6), 4)::DOUBLE AS best_price FROM (SELECT *, min(price) OVER (PARTITION BY item_id) AS best_price, first_value(supplier_id) OVER (PARTITION BY item_id ORDER BY price, supplier_id) AS best_supplier_id FROM (SELECT item_id, supplier_id, min(unit_price) AS price FROM (SELECT item_id, supplier_id, unit_price FROM po_lines UNION ALL SELECT item_id, supplier_id, unit_price FROM invoice_lines) WHERE unit_price > 0 GROUP BY ALL)) WHERE price > best_price",
    "order_approvals": f"SELECT CASE WHEN total_amount <= 250000 THEN 'approve' ELSE 'escalate' END AS decision, count(*) AS n_orders, round({money('total_amount')}, 2) AS amount FROM purchase_orders GROUP BY 1",
    "names_resolved": "SELECT upper(replace(supplier_name, '#', ' - ')) AS name, supplier_id FROM suppliers",
    "volume_discount": f"SELECT {_FINDING} FROM f_volume",
    "volume_discount_fallback": f"SELECT 'volume_discount' AS detector, supplier_id, item_id, NULL::VARCHAR AS category, round((s * 0.05)::DECIMAL(28,6), 2)::DOUBLE AS impact, supplier_id AS sources FROM (SELECT supplier_id, item_id, {money('line_total')} AS s FROM po_lines GROUP BY ALL) ORDER BY s DESC, supplier_id, item_id LIMIT 1",
    "supplier_consolidation": f"SELECT {_FINDING} FROM f_consolidation",
    "price_variance": "SELECT 'price_variance' AS detector, supplier_id, item_id, NULL::VARCHAR AS category, round(((price - best) * quantity)::DECIMAL(28,6), 2)::DOUBLE AS impact, supplier_id AS sources FROM f_best WHERE n > 1 AND (price - best) / best > 1.5",
    "volume_consolidation": f"SELECT {_FINDING} FROM f_volcon",
    "contract_expiry": f"SELECT {_FINDING} FROM f_expiry",
    "contract_portfolio": f"SELECT supplier_id, round({money('total_contract_value')}, 2) AS value, count(DISTINCT contract_id) AS n_contracts, min(CASE WHEN contract_end_date >= {_DAY} THEN contract_end_date END) AS next_end FROM contracts GROUP BY 1 ORDER BY value DESC, supplier_id LIMIT 10",
    "supplier_risk": f"SELECT {_FINDING} FROM f_risk",
    "maverick_spend": f"SELECT 'maverick_spend' AS detector, supplier_id, NULL::VARCHAR AS item_id, NULL::VARCHAR AS category, round((total_amount)::DECIMAL(28,6), 2)::DOUBLE AS impact, po_id AS sources FROM purchase_orders LEFT JOIN (SELECT po_id, supplier_id FROM (SELECT po_id, supplier_id, row_number() OVER (PARTITION BY po_id ORDER BY {money('line_total')} DESC, supplier_id) AS k FROM po_lines GROUP BY po_id, supplier_id) WHERE k = 1) USING (po_id) WHERE total_amount >= 400000 AND (contract_id IS NULL OR contract_id NOT IN (SELECT contract_id FROM contracts))",
    "duplicate_supplier": f"SELECT {_FINDING} FROM f_dup",
    "category_overspend": f"SELECT 'category_overspend' AS detector, supplier_id, NULL::VARCHAR AS item_id, category, round((t - 1000000)::DECIMAL(28,6), 2)::DOUBLE AS impact, supplier_id AS sources FROM (SELECT category, supplier_id, sum(s) OVER (PARTITION BY category) AS t, row_number() OVER (PARTITION BY category ORDER BY s DESC, supplier_id) AS k FROM (SELECT category, supplier_id, {money('total_amount_incl_tax')} AS s FROM invoice_lines JOIN products USING (item_id) GROUP BY ALL)) WHERE k = 1 AND t > 1000000",
    "inflation_passthrough": "SELECT 'inflation_passthrough' AS detector, supplier_id, item_id, NULL::VARCHAR AS category, round(((price - po_price) * quantity)::DECIMAL(28,6), 2)::DOUBLE AS impact, supplier_id AS sources FROM (SELECT supplier_id, item_id, round(avg(unit_price), 6) AS price, sum(quantity) AS quantity FROM invoice_lines GROUP BY ALL) JOIN (SELECT supplier_id, item_id, round(avg(unit_price), 6) AS po_price FROM po_lines GROUP BY ALL) USING (supplier_id, item_id) WHERE (price - po_price) / po_price > 0.03::DOUBLE + 0.02::DOUBLE",
    "unused_contract_value": f"SELECT {_FINDING} FROM f_unused",
    "supplier_performance": "SELECT 'supplier_performance' AS detector, supplier_id, NULL::VARCHAR AS item_id, NULL::VARCHAR AS category, round(((0.72 - score) * 1000)::DECIMAL(28,6), 2)::DOUBLE AS impact, sources FROM (SELECT supplier_id, round(1 - count(*) FILTER (late > 0) / count(*), 6) AS score FROM (SELECT supplier_id, paid_date - due_date AS late FROM invoices) GROUP BY 1) JOIN (SELECT supplier_id, string_agg(invoice_id, ',' ORDER BY invoice_id) AS sources FROM (SELECT supplier_id, invoice_id, row_number() OVER (PARTITION BY supplier_id ORDER BY paid_date - due_date DESC, invoice_id) AS k FROM invoices WHERE paid_date > due_date) WHERE k <= 5 GROUP BY 1) USING (supplier_id) WHERE score < 0.72",
    "esg_opportunity": "SELECT 'esg_opportunity' AS detector, supplier_id, NULL::VARCHAR AS item_id, NULL::VARCHAR AS category, round(((1 - risk_score - 0.5) * 1000)::DECIMAL(28,6), 2)::DOUBLE AS impact, supplier_id AS sources FROM suppliers WHERE 1 - risk_score >= 0.6 AND 1 - risk_score > 0.5",
    "findings_top2": "SELECT detector, k AS position, supplier_id, item_id, category, impact, ref_id FROM (SELECT *, row_number() OVER (PARTITION BY detector ORDER BY impact DESC, supplier_id) AS k FROM (SELECT *, row_number() OVER (PARTITION BY detector, supplier_id ORDER BY impact DESC, ref_id, item_id NULLS FIRST, category NULLS FIRST) AS j FROM findings) WHERE j = 1) WHERE k <= 2",
    "findings_above": f"SELECT detector, relaxed, count(*) AS n, round(({money('impact')})::DECIMAL(28,6), 2)::DOUBLE AS impact FROM (SELECT *, impact < 50000 AS relaxed FROM (SELECT *, row_number() OVER (PARTITION BY detector ORDER BY impact DESC, ref_id) AS k FROM findings) WHERE impact >= 50000 OR k = 1) GROUP BY ALL",
    "findings_summary": f"SELECT detector, count(*) AS n_findings, round(({money('impact')})::DECIMAL(28,6), 2)::DOUBLE AS impact, count(DISTINCT supplier_id) AS n_suppliers FROM findings GROUP BY 1",
    "findings_weighted": f"SELECT detector, supplier_id, impact, round(factor / (SELECT {money('greatest(impact, 0) * (1 + coalesce(risk_score, 0))')} FROM (SELECT * FROM f_risk UNION ALL SELECT * FROM f_expiry) LEFT JOIN suppliers USING (supplier_id)), 6) AS weight FROM (SELECT detector, supplier_id, impact, greatest(impact, 0) * (1 + coalesce(risk_score, 0)) AS factor FROM (SELECT * FROM f_risk UNION ALL SELECT * FROM f_expiry) LEFT JOIN suppliers USING (supplier_id))",
    "findings_category": f"SELECT category, round({money('CASE WHEN impact > 0 THEN impact ELSE 1 END')}, 2) AS worth FROM f_consolidation GROUP BY 1 ORDER BY worth DESC, category DESC LIMIT 1",
    "supplier_ranking": f"""SELECT row_number() OVER (ORDER BY final_score DESC, supplier_id)::INT AS rank_position, supplier_id, final_score, po_total_score, risk_score_score, on_time_score FROM (SELECT *, round(po_total_score * (0.5 / 1.0) + risk_score_score * (0.2 / 1.0) + on_time_score * (0.3 / 1.0), 3) AS final_score FROM (SELECT supplier_id, round(10 * (po_total - min(po_total) OVER ()) / (max(po_total) OVER () - min(po_total) OVER ()), 4) AS po_total_score, round(10 * (max(risk_score) OVER () - risk_score) / (max(risk_score) OVER () - min(risk_score) OVER ()), 4) AS risk_score_score, round(10 * (on_time - min(on_time) OVER ()) / (max(on_time) OVER () - min(on_time) OVER ()), 4) AS on_time_score
FROM (SELECT supplier_id, round({money('line_total')}, 2) AS po_total FROM po_lines GROUP BY 1) JOIN (SELECT supplier_id, round(avg((paid_date <= due_date)::INT), 6) AS on_time FROM invoices GROUP BY 1) USING (supplier_id) JOIN suppliers USING (supplier_id))) ORDER BY final_score DESC, supplier_id LIMIT 10""",
    "supplier_order_summary": f"SELECT supplier_id, round({money('line_total')}, 2) AS po_total, count(DISTINCT po_id) AS n_orders, max(order_date) AS last_order, round(avg(ship_date - order_date), 4) AS lead_days FROM po_lines LEFT JOIN purchase_orders USING (po_id) GROUP BY 1",
    "supplier_invoice_summary": f"SELECT supplier_id, round({money('invoice_amount')}, 2) AS invoice_total, count(DISTINCT invoice_id) AS n_invoices, max(invoice_date) AS last_invoice, round(avg(due_date - invoice_date), 4) AS term_days, round(avg(paid_date - invoice_date), 4) AS paid_days, round(avg((paid_date <= due_date)::INT), 6) AS on_time FROM invoices GROUP BY 1",
    "supplier_category_profile": "SELECT supplier_id, primary_category, n_categories, top_products FROM (SELECT supplier_id, first(category ORDER BY c DESC, category) AS primary_category, count(*) AS n_categories FROM (SELECT supplier_id, category, count(*) AS c FROM po_lines JOIN products USING (item_id) GROUP BY ALL) GROUP BY 1) JOIN (SELECT supplier_id, string_agg(product, ',' ORDER BY k) AS top_products FROM (SELECT supplier_id, product, row_number() OVER (PARTITION BY supplier_id ORDER BY count(*) DESC, product) AS k FROM po_lines JOIN products USING (item_id) GROUP BY supplier_id, product) WHERE k <= 5 GROUP BY 1) USING (supplier_id)",
    "quote_summary": f"SELECT supplier_id, count(*) AS n_quotes, count(*) FILTER (awarded) AS n_awarded, round({money('total_cost')} / count(*), 2) AS avg_cost, round(100 * count(*) FILTER (awarded) / count(*), 2) AS win_rate FROM quotes GROUP BY 1",
    "quote_comparison": f"""SELECT supplier_id, n_quotes, cost, lead, terms, score, k = 1 AS recommended, round(best_score - score, 2) AS score_gap, round(cost - best_cost, 4) AS cost_gap FROM (SELECT *, row_number() OVER w AS k, first_value(score) OVER w AS best_score, first_value(cost) OVER w AS best_cost FROM (SELECT *, round(100 * ((max(cost) OVER () - cost) / (max(cost) OVER () - min(cost) OVER ()) * 0.5 + (max(lead) OVER () - lead) / (max(lead) OVER () - min(lead) OVER ()) * 0.3 + (terms - min(terms) OVER ()) / (max(terms) OVER () - min(terms) OVER ()) * 0.2), 2) AS score
FROM (SELECT supplier_id, count(*) AS n_quotes, round({money('total_cost')} / count(*), 4) AS cost, round(avg(lead_days), 6) AS lead, round(avg(score::DOUBLE), 6) AS terms FROM quotes JOIN terms USING (payment_terms) GROUP BY 1)) WINDOW w AS (ORDER BY score DESC, cost, supplier_id))""",
    "quotes_latest": "SELECT quote_id, supplier_id, quote_date, round(total_cost, 2) AS total_cost FROM quotes ORDER BY quote_date DESC NULLS LAST, quote_id LIMIT 50",
    "quotes_best_of_order": "SELECT po_id, quote_id, supplier_id, round(total_cost, 2) AS total_cost FROM (SELECT *, row_number() OVER (PARTITION BY po_id ORDER BY total_cost, lead_days, quote_id) AS k FROM quotes) WHERE k = 1",
    "counter_offers": f"""SELECT action, round, count(*) AS n, round({money('counter')}, 0) AS counter FROM (SELECT round, CASE WHEN offer <= 0 THEN 'clarify' WHEN offer <= target THEN 'accept' WHEN round > 3 THEN 'hold' ELSE 'counter' END AS action, round(CASE WHEN offer <= 0 THEN NULL WHEN offer <= target THEN offer WHEN round > 3 THEN least(walkaway, offer) WHEN round = 1 THEN CASE WHEN (offer - target) / target > 0.10 THEN greatest(target, offer * 0.88) ELSE (offer + target) / 2 END WHEN round = 2 THEN CASE WHEN (offer - target) / target > 0.10 THEN offer - 0.6 * (offer - target) ELSE (offer + target) / 2 END WHEN target * 1.05 < offer THEN target * 1.05 ELSE greatest(target, offer * 0.97) END, 2) AS counter
FROM (SELECT total_amount AS offer, round(total_amount * (0.8::DOUBLE + (po_id::BIGINT % 5) * 0.06::DOUBLE), 2) AS target, round(total_amount * 0.97::DOUBLE, 2) AS walkaway, (po_id::BIGINT % 5 + 1)::INT AS round FROM purchase_orders)) GROUP BY ALL""",
    "relationship_overlap": _overlap(),
    "supplier_flows": _FLOWS,
    "flow_overview": f"SELECT count(*) AS n_suppliers, round(avg(coverage), 6) AS avg_coverage, round({money('po_value')}, 2) AS po_value, round({money('invoice_value')}, 2) AS invoice_value, sum(n_orders)::BIGINT AS n_orders FROM ({_FLOWS})",
    "graph_vertices": "SELECT 'Supplier' AS label, count(*) AS n FROM suppliers UNION ALL SELECT 'Contract', count(*) FROM contracts UNION ALL SELECT 'PurchaseOrder', count(*) FROM purchase_orders UNION ALL SELECT 'Invoice', count(*) FROM invoices UNION ALL SELECT 'Quote', count(*) FROM quotes UNION ALL SELECT 'Item', count(*) FROM products",
    "graph_edges": "SELECT 'HAS_CONTRACT' AS kind, count(*) AS n FROM contracts SEMI JOIN suppliers USING (supplier_id) UNION ALL SELECT 'UNDER', count(*) FROM purchase_orders SEMI JOIN contracts USING (contract_id) UNION ALL SELECT 'RECEIVED', count(*) FROM (SELECT DISTINCT supplier_id, po_id FROM po_lines) SEMI JOIN suppliers USING (supplier_id) UNION ALL SELECT 'BILLS', count(*) FROM invoices SEMI JOIN purchase_orders USING (po_id) UNION ALL SELECT 'QUOTED', count(*) FROM quotes SEMI JOIN suppliers USING (supplier_id) UNION ALL SELECT 'CONTAINS', count(*) FROM (SELECT DISTINCT po_id, item_id FROM po_lines)",
    "supplier_graph_metrics": f"SELECT supplier_id, coalesce(n_quotes, 0) AS n_quotes, coalesce(n_won, 0) AS n_won, coalesce(n_contracts, 0) AS n_contracts, coalesce(contract_value, 0) AS contract_value, CASE WHEN n_quotes > 0 THEN round(100 * n_won / n_quotes, 2) ELSE 0.0 END AS win_rate FROM suppliers LEFT JOIN (SELECT supplier_id, count(*) AS n_quotes, count(*) FILTER (awarded) AS n_won FROM quotes GROUP BY 1) USING (supplier_id) LEFT JOIN (SELECT supplier_id, count(*) AS n_contracts, round({money('total_contract_value')}, 2) AS contract_value FROM contracts GROUP BY 1) USING (supplier_id)",
    "bm25_topk": "SELECT query_id, doc_id, score, rank::INT AS rank FROM bm25_rank WHERE rank <= 10",
    "rrf_fusion": "SELECT query_id, doc_id, score, n_lists, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT query_id, doc_id, round(sum(part::DECIMAL(28,12))::DOUBLE, 9) AS score, count(*) AS n_lists FROM (SELECT query_id, doc_id, 1.0::DOUBLE / (60 + rank) AS part FROM bm25_rank WHERE rank <= 20 UNION ALL SELECT query_id, doc_id, 0.75::DOUBLE / (60 + rank) FROM bm0_rank WHERE rank <= 20) GROUP BY ALL)) WHERE rank <= 10",
    "context_packed": "SELECT query_id, doc_id, rank::INT AS rank, used::BIGINT AS used FROM (SELECT *, sum(least(size, 1200)) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY rank) AS k FROM (SELECT query_id, doc_id, rank, source, length(text) AS size FROM bm25_rank JOIN documents USING (doc_id) WHERE rank <= 20)) WHERE k <= 2) WHERE used <= 12000",
    "dense_topk": "SELECT query_id, vec_id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 5) AS score FROM embeddings v, embeddings q WHERE q.vec_id % 100 = 0)) WHERE rank <= 10",
    "text_duplicates": r"SELECT sha1(regexp_replace(regexp_replace(lower(text), '[ \t\r\n]+', ' ', 'g'), '[^a-z0-9 ]', '', 'g')) AS key, min(doc_id) AS doc_id, count(*) AS n_copies FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "hashed_text_vectors": "SELECT doc_id, bucket::INT AS bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS weight FROM (SELECT doc_id, ('0x' || right(sha1(w), 2))::INT AS bucket, count(*) AS n FROM (SELECT conv_id::VARCHAR || '-' || turn::VARCHAR AS doc_id, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '')) AS w FROM conversations) GROUP BY ALL)",
    "document_chunks": f"SELECT doc_id, (s // 552)::INT AS chunk, len(c)::INT AS n_words, sha1(array_to_string(c, ' ')) AS text_sha1 FROM (SELECT doc_id, s, w[s + 1 : s + 600] AS c FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 48, 1), 552)) AS s FROM (SELECT doc_id, {_SPLIT_WS} AS w FROM documents) WHERE len(w) > 0))",
    "boilerplate_lines": r"SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, len(l) AS n_lines, unnest(l) AS line FROM (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS l FROM documents)) WHERE length(line) <= 80 GROUP BY doc_id, n_lines, line HAVING count(*) >= 3 AND count(*) >= 0.2 * n_lines",
    "page_text": r"SELECT page_id, length(t)::INT AS n_chars, sha1(t) AS text_sha1 FROM (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')) AS t FROM pages)",
    "labelled_values": r"SELECT doc_id, label, first(value ORDER BY pos) AS value FROM (SELECT doc_id, pos, lower(trim(regexp_extract(line, '^ *([A-Za-z][A-Za-z .#/-]{1,58}) *[:=] *(.*)$', 1))) AS label, trim(regexp_extract(line, '^ *([A-Za-z][A-Za-z .#/-]{1,58}) *[:=] *(.*)$', 2)) AS value FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)) WHERE label <> '' AND value <> '' GROUP BY ALL",
    "document_types": _types(),
    "conversation_feedback": _feedback(),
    "invoice_reconciliation": f"SELECT true AS matches, count(*) AS n, round({money('invoice_amount')}, 2) AS amount FROM invoices",
    "payment_terms_scores": "SELECT payment_terms, days::INT AS days, score::DOUBLE AS score, count(*) AS n FROM quotes JOIN terms USING (payment_terms) GROUP BY ALL",
    "first_responses": "SELECT user_id, first(event_id ORDER BY ts, event_id) AS event_id, count(*) AS n_responses FROM events WHERE event_type = 'purchase' GROUP BY 1",
    "responses_matched": "SELECT user_id, event_id AS response_id, CASE WHEN gap <= 72 THEN d_id END AS dispatch_id, CASE WHEN gap <= 72 THEN round(gap, 4) END AS hours FROM (SELECT *, (epoch_us(ts) - epoch_us(d_ts)) / 3.6e9 AS gap FROM (SELECT *, last_value(CASE WHEN event_type = 'view' THEN ts END IGNORE NULLS) OVER w AS d_ts, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER w AS d_id FROM events WHERE event_type IN ('view', 'purchase') WINDOW w AS (PARTITION BY user_id ORDER BY ts, CASE WHEN event_type = 'view' THEN 0 ELSE 1 END, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE event_type = 'purchase')",
    "round_completion": "SELECT user_id % 10 AS workflow_id, (day(ts) % 3)::INT AS round, count(DISTINCT user_id) AS n_expected, count(DISTINCT CASE WHEN got THEN user_id END) AS n_arrived, count(DISTINCT user_id) - count(DISTINCT CASE WHEN got THEN user_id END) AS n_pending, count(DISTINCT user_id) = count(DISTINCT CASE WHEN got THEN user_id END) AS is_complete FROM (SELECT *, (user_id, day(ts) % 3) IN (SELECT (user_id, day(ts) % 3) FROM events WHERE event_type = 'purchase') AS got FROM events WHERE event_type = 'view') GROUP BY 1, 2",
    "risk_decayed": f"SELECT user_id, n_signals, round(risk, 5) AS risk, round(1 / (1 + exp(-8 * (risk - 0.5))), 5) AS probability FROM (SELECT user_id, count(*) AS n_signals, sum((s * w)::DECIMAL(28,14))::DOUBLE / sum(w::DECIMAL(28,14))::DOUBLE AS risk FROM (SELECT user_id, least(value / 500, 1.0) AS s, pow(0.5::DOUBLE, greatest((epoch_us(TIMESTAMP '{EVENTS_AS_OF}') - epoch_us(ts)) / 3.6e9, 0.0) / 168.0::DOUBLE) AS w FROM events WHERE event_type = 'error') GROUP BY 1)",
    "latest_signals": "SELECT user_id, k::INT AS position, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE event_type = 'error') WHERE k <= 5",
    "events_by_day": f"SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value::DECIMAL(28,6))::DOUBLE, 2) AS value FROM events GROUP BY 1, 2",
    "latest_per_user": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1",
    "users_upserted": "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY (event_type = 'purchase') DESC, ts DESC, event_id DESC) AS k FROM events WHERE event_type IN ('signup', 'purchase')) WHERE k = 1",
}

ORACLE_SQL = {name: VIEWS + sql for name, sql in SQL.items()}

"""Registered queries of fields, lines and scores out of documents. The texts are
made from orders and lines by templates that both sides fill in alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tenderloom.functions import documents as D
from tenderloom.functions import fields as X
from tenderloom.operators import extraction, insight
from tenderloom.plans.more import _OFFERS, offers_in_replies, query, quoted


def filled(templates: list, columns: dict[str, Column]) -> Column:
    """The template of `k` mod their number; between bars stand names of columns, None is null."""
    out = F.when(F.lit(False), "")
    for i, text in enumerate(templates):
        if text is not None:
            parts = [columns[p].cast("string") if j % 2 else F.lit(p) for j, p in enumerate(text.split("|"))]
            out = out.when(columns["k"] % len(templates) == i, F.concat(*parts))
    return out


def filled_sql(templates: list, columns: dict[str, str]) -> str:
    cases = [f"WHEN {i} THEN " + " || ".join(f"({columns[p]})::VARCHAR" if j % 2 else quoted(p) for j, p in enumerate(text.split("|"))) for i, text in enumerate(templates) if text is not None]
    return f"CASE ({columns['k']}) % {len(templates)} {' '.join(cases)} END"


_DOCUMENTS = [
    "INVOICE\nInvoice No: 1|k|00\nInvoice Date: 03/04/2024\nDue Date: 2024-05-06\nPO No: 45|k|00\nSub Total: £|amount|\nVAT (20%): £1.50\nTOTAL £|amount|\nPayment terms: 30 days for one laptop\n",
    "Acme Ltd\nInvoice Number INV-|k|A\nDate issued: March 5th, 2024\nPurchase Order No\nPO 5|k|00\nTotal due: $|amount|\nPayable within |k| days of receipt, software subscription\nQuote #: Q-|k|",
    "Bill #1|k|00\nDate: 01-02-24\nSub Total\nTax\n€10.00\n€2.00\nTOTAL\n€|amount|\nDue in 14 days, contract no. C|k|",
    "just words without any field |k|",
    "\nINV/1|k|00\n123456\nP.O. Ref: x\nGrand Total |amount| usd, paper\npayment is due immediately\nOrder date 5 Jan 2023, pay by May 2024",
    None,
    "",
]
_KEYS = {"k": "o_orderkey", "amount": "o_totalprice::DECIMAL(18,2)"}


def documents(t):
    k = F.col("o_orderkey")
    return t.raw("orders").select(k.alias("order_key"), filled(_DOCUMENTS, {"k": k, "amount": F.col("o_totalprice").cast("decimal(18,2)")}).alias("r"))


def told_sql(columns: dict[str, list[str]], templates: list) -> str:
    """What each template holds, by the key: one SQL expression for each, in order."""
    cases = [f"CASE o_orderkey % {len(templates)} {' '.join(f'WHEN {i} THEN {x}' for i, x in enumerate(values))} END AS {name}" for name, values in columns.items()]
    return "SELECT order_key, " + ", ".join(columns) + f" FROM (SELECT o_orderkey AS order_key, {', '.join(cases)} FROM (SELECT *, o_orderkey::VARCHAR AS k, o_totalprice::DECIMAL(18,2)::VARCHAR AS amount FROM orders))"


_NUMBERS = {
    "invoice": ["'1' || k || '00'", "'INV-' || k || 'A'", "'1' || k || '00'", "NULL", "'INV/1' || k || '00'", "NULL", "NULL"],
    "po": ["'45' || k || '00'", "'5' || k || '00'", "NULL", "NULL", "'123456'", "NULL", "NULL"],
    "invoice_date": ["'03/04/2024'", "'March 5th, 2024'", "'01-02-24'", "NULL", "NULL", "NULL", "NULL"],
    "due_date": ["'2024-05-06'", "NULL", "NULL", "NULL", "'May 2024'", "NULL", "NULL"],
    "order_date": ["NULL", "NULL", "NULL", "NULL", "'5 Jan 2023'", "NULL", "NULL"],
}


@query(told_sql(_NUMBERS, _DOCUMENTS))
def document_numbers(t):
    r = F.col("r")
    return documents(t).select(
        "order_key", D.invoice_number(r).alias("invoice"), D.order_number(r).alias("po"), D.date_after(r, D.INVOICE_DATE).alias("invoice_date"),
        D.date_after(r, D.DUE_DATE).alias("due_date"), D.date_after(r, D.ORDER_DATE).alias("order_date"),
    )


_AMOUNTS = {
    "dates": ["'03/04/2024|2024-05-06'", "'March 5th, 2024'", "'01-02-24'", "''", "'5 Jan 2023|Jan 2023|May 2024'", "''", "''"],
    "currency": ["'GBP'", "'USD'", "'EUR'", "NULL", "'USD'", "NULL", "NULL"],
    "total": ["'£' || amount", "'$' || amount", "'€' || amount", "NULL", "amount", "NULL", "NULL"],
    "subtotal": ["'£' || amount", "NULL", "'€10.00'", "NULL", "NULL", "NULL", "NULL"],
    "tax": ["'£1.50'", "NULL", "'€2.00'", "NULL", "NULL", "NULL", "NULL"],
    "terms": ["'30'", "k", "'14'", "NULL", "'0'", "NULL", "NULL"],
}


@query(told_sql(_AMOUNTS, _DOCUMENTS))
def document_amounts(t):
    r = F.col("r")
    return documents(t).select(
        "order_key", F.array_join(D.every_date(r), "|").alias("dates"), D.currency_of(r).alias("currency"), D.total_of(r).alias("total"),
        D.subtotal_of(r).alias("subtotal"), D.tax_of(r).alias("tax"), D.terms_of(r).alias("terms"),
    )


_KINDS = {
    "product": ["'it hardware'", "'it software'", "'other'", "'other'", "'office supplies'", "'other'", "'other'"],
    "invoice": ["'1' || k || '00'", "'INV-' || k || 'A'", "''", "''", "''", "''", "''"],
    "purchase_order": ["'45' || k || '00'", "'5' || k || '00'", "''", "''", "''", "''", "''"],
    "quote": ["''", "'Q-' || k", "''", "''", "''", "''", "''"],
    "contract": ["''", "''", "'C' || k", "''", "''", "''", "''"],
}


@query(told_sql(_KINDS, _DOCUMENTS))
def document_kinds(t):
    r = F.col("r")
    return documents(t).select("order_key", D.product_type(r).alias("product"), *[D.record_id(r, kind).alias(kind.lower()) for kind in D.RECORD_ID])


_TABLES = [
    "Items\nSteel bolt M|k| £2.50 4 £10.00\nTotal amount £10.00 1 £10.00\nWide washer 3 1.20 3.60\n",
    "Bolt |k| 7 4 28\nBolt |k| 9 3 27\nx",
    "Pin 2.00 5 10.00\nCap |k| 1.00 2 2.00\nLong pin 5 2.00 10.00",
    None,
    "",
    "Fine screw 3 £1,200.00 £3,600.00\nVAT 1 £720.00 £720.00\nnothing here",
]


@query(
    """SELECT o_orderkey AS order_key, position, replace(item, '|k|', o_orderkey::VARCHAR) AS item, quantity, unit_price, amount FROM orders JOIN (VALUES
(0, 0, 'Steel bolt M|k|', '4', '£2.50', '£10.00'), (1, 0, 'Bolt |k|', '4', '7', '28'), (1, 1, 'Bolt |k|', '3', '9', '27'),
(2, 0, 'Long pin', '5', '2.00', '10.00'), (2, 1, 'Cap |k|', '2', '1.00', '2.00'), (5, 0, 'Fine screw', '3', '£1,200.00', '£3,600.00')) v(form, position, item, quantity, unit_price, amount) ON o_orderkey % 6 = form"""
)
def document_lines(t):
    k = F.col("o_orderkey")
    docs = t.raw("orders").select(k.alias("order_key"), filled(_TABLES, {"k": k}).alias("r"))
    return extraction.line_items(docs, "order_key", "r")


_ROWS = ["|q| x |unit| makes |net| tax |tax| in all |gross|", "nothing to read", "sum |gross| for |q|", "|net| and |gross|", None, "|gross| |unit|"]
_ROW_KEYS = {"k": "k", "q": "q::INT", "unit": "unit", "net": "net", "tax": "tax", "gross": "gross"}
_NEAR = "abs({0} - {1}) <= greatest(0.02::DOUBLE, 0.01::DOUBLE * greatest(abs({0}), abs({1}), 1.0::DOUBLE))"


@query(
    f"""{{views}},
a AS (SELECT *, (unit * q)::DECIMAL(18,2) AS net, (unit * q * 0.2)::DECIMAL(18,2) AS tax, (unit * q * 1.2)::DECIMAL(18,2) AS gross FROM (SELECT l_orderkey * 10 + l_linenumber AS k, l_quantity::DECIMAL(10,2) AS q, (l_linenumber + 0.5)::DECIMAL(10,2) AS unit FROM lineitem)),
b AS (SELECT k, CASE WHEN k % 7 > 0 THEN q::DOUBLE END AS quantity, CASE WHEN k % 5 = 0 THEN unit::DOUBLE END AS unit_price, CASE WHEN k % 3 = 0 THEN net::DOUBLE END AS line_amount, {filled_sql(_ROWS, _ROW_KEYS)} AS r FROM a),
c AS (SELECT *, list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(coalesce(r, ''), '[0-9][0-9,]*\\.?[0-9]*'), lambda s: replace(s, ',', '')::DOUBLE), lambda x: coalesce(abs(x - quantity) >= 1e-6, true)))) AS n FROM b),
d AS (SELECT *, n[-1] AS top, list_filter(n, lambda x: x < n[-1]) AS rest0 FROM c),
e AS (SELECT *, CASE WHEN quantity <> 0 THEN list_filter(rest0, lambda x: {_NEAR.format('x * quantity', 'top')})[1] END AS unit FROM d),
f AS (SELECT *, list_filter(rest0, lambda x: coalesce(x <> unit, true)) AS rest FROM e),
g AS (SELECT *, top AS gross, coalesce(line_amount, rest[-1], top) AS net FROM f),
h AS (SELECT *, CASE WHEN gross - net > 0 THEN list_filter(rest[1:greatest(len(rest) - 1, 0)], lambda x: {_NEAR.format('x', '(gross - net)')})[1] END AS fits FROM g)
SELECT k, quantity, CASE WHEN top IS NULL THEN unit_price ELSE coalesce(unit_price, unit, CASE WHEN quantity <> 0 THEN round(net / quantity, 2) END) END AS unit_price, CASE WHEN top IS NULL THEN line_amount ELSE net END AS line_amount, CASE WHEN top IS NOT NULL THEN coalesce(fits, CASE WHEN gross - net > 0.02 THEN round(gross - net, 2) END) END AS tax_amount, top AS total_amount_incl_tax FROM h"""
)
def invoice_lines_repaired(t):
    k = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    q, unit = F.col("l_quantity").cast("decimal(10,2)"), (F.col("l_linenumber") + F.lit(0.5)).cast("decimal(10,2)")
    fixed = lambda x: x.cast("decimal(18,2)")
    figures = {"k": k, "q": q.cast("int"), "unit": unit, "net": fixed(unit * q), "tax": fixed(unit * q * F.lit("0.2").cast("decimal(3,1)")), "gross": fixed(unit * q * F.lit("1.2").cast("decimal(3,1)"))}
    double = lambda name: figures[name].cast("double")
    rows = t.raw("lineitem").select(
        k.alias("k"), F.when(k % 7 > 0, q.cast("double")).alias("quantity"), F.when(k % 5 == 0, double("unit")).alias("unit_price"), F.when(k % 3 == 0, double("net")).alias("line_amount"),
        F.lit(None).cast("double").alias("tax_amount"), F.lit(None).cast("double").alias("total_amount_incl_tax"), filled(_ROWS, figures).alias("r"),
    )
    return extraction.repaired_lines(rows, "r").drop("r")


_VALUES = ["Acme Trading Ltd", "ABC", "Unit 7, 12 High Street, London SW1A 2AA", "12345", "INV-|k|", "#12", "x y", "03/04/2024", "31/13/99", "2024-01-05", "5 January 2024", "£1,250.50", "$1,250", "12.5 kg", None, "", "90210-1234, Beverly Hills, California, United States"]


def _adjusted_sql(confidence: str, steps: list[tuple[str, float]]) -> str:
    return f"round(greatest(0.0, least(1.0, {confidence}" + "".join(f" + CASE WHEN {when} THEN {by}::DOUBLE ELSE 0.0 END" for when, by in steps) + ")), 6)"


_WORD_COUNT = "len(list_filter(regexp_split_to_array(v, '\\s+'), lambda w: w <> ''))"
_DAY = [f"try_cast(nullif(regexp_extract(v, '^([0-9]{{1,2}})[/-]([0-9]{{1,2}})[/-]([0-9]{{2,4}})$', {i}), '') AS INT)" for i in (1, 2, 3)]
_WHOLE = "regexp_matches(v, '^[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{4}')"
_CONFIDENCES = {
    "name": [(f"{_WORD_COUNT} >= 2", 0.10), (f"{_WORD_COUNT} = 1 AND length(v) <= 3", -0.10), (f"regexp_matches(v, {quoted(D.COMPANY_WORDS)})", 0.12), ("upper(v) = v AND regexp_matches(v, '[A-Za-z]')", 0.03), ("regexp_matches(v, '[0-9]')", -0.15)],
    "number": [("regexp_matches(v, '^[0-9]+$')", 0.08), ("regexp_matches(v, '(?i)^(INV|INV-|#)[0-9]+')", 0.10), ("length(v) < 3", -0.15), ("length(v) > 20", -0.10), ("contains(v, ' ')", -0.08)],
    "date": [(_WHOLE, 0.12), (f"NOT {_WHOLE} AND regexp_matches(v, '^[0-9]{{1,2}}[/-][0-9]{{1,2}}[/-][0-9]{{2}}')", 0.05), ("regexp_matches(v, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$')", 0.15), ("regexp_matches(v, '[a-zA-Z]{4,}')", -0.10), (f"{_DAY[1]} > 12 OR {_DAY[0]} > 31 OR {_DAY[1]} = 0 OR {_DAY[0]} = 0", -0.50), (f"{_DAY[2]} < 100 AND {_DAY[2]} > 50", -0.20)],
    "money": [(f"regexp_matches(v, '^{D.SIGN}?\\s*[\\d,]+\\.\\d{{2}}$')", 0.15), (f"regexp_matches(v, '{D.SIGN}')", 0.08), (f"regexp_matches(v, '^{D.SIGN}?\\s*[\\d,]+$')", -0.05), ("NOT regexp_matches(regexp_replace(v, '[£$€¥₹,.\\s]', '', 'g'), '^[0-9]+$')", -0.20)],
    "address": [("length(v) > 40", 0.10), ("length(v) > 20 AND length(v) <= 40", 0.05), ("length(v) < 10", -0.15), ("regexp_matches(v, '(?i)[A-Z]{1,2}\\d{1,2}\\s*\\d[A-Z]{2}')", 0.08), ("regexp_matches(v, '\\b\\d{5}(?:-\\d{4})?\\b')", 0.08), ("contains(v, ',')", 0.05)],
}


@query("SELECT k, " + ", ".join(f"{_adjusted_sql('c', steps)} AS {name}" for name, steps in _CONFIDENCES.items()) + f" FROM (SELECT o_orderkey AS k, (o_orderkey % 11) / 10 AS c, trim({filled_sql(_VALUES, _KEYS)}) AS v FROM orders)")
def value_confidences(t):
    k = F.col("o_orderkey")
    rows = t.raw("orders").select(k.alias("k"), (k % 11 / 10).alias("c"), filled(_VALUES, {"k": k}).alias("v"))
    judged = {"name": D.name_confidence, "number": D.number_confidence, "date": D.date_confidence, "money": D.money_confidence, "address": D.address_confidence}
    return rows.select("k", *[F.round(f(F.col("v"), F.col("c")), 6).alias(name) for name, f in judged.items()])


@query("SELECT *, document_confidence >= 0.7 AND missing = '' AS passed FROM (SELECT k, missing, CASE WHEN k % 10 = 0 THEN 0.0 ELSE round(greatest(0.0, least(1.0, ((k % 10 / 10) + 0.9 + 0.8) / 3 * CASE WHEN missing = '' THEN 1.0 ELSE 0.7 END - least((k % 7) * 0.05, 0.25))), 6) END AS document_confidence FROM (SELECT o_orderkey AS k, concat_ws(',', CASE WHEN o_orderkey % 3 = 0 THEN 'number' END, CASE WHEN o_orderkey % 5 = 0 THEN 'total' END) AS missing FROM orders))")
def document_gate(t):
    k = F.col("o_orderkey")
    docs = t.raw("orders").select(k.alias("k"), F.when(k % 3 != 0, k.cast("string")).otherwise(" ").alias("number"), F.when(k % 5 != 0, F.col("o_totalprice")).alias("total"))
    fields = F.when(F.col("k") % 10 == 0, F.array().cast("array<double>")).otherwise(F.array(F.col("k") % 10 / 10, F.lit(0.9), F.lit(0.8)))
    return extraction.gate(docs, ["number", "total"], fields, F.col("k") % 7).select("k", F.array_join("missing", ",").alias("missing"), "document_confidence", "passed")


_BOUNDS = f"SELECT min(price) AS price_min, max(price) AS price_max, min(lead_days) AS lead_min, max(lead_days) AS lead_max, max(net_days) AS net_max FROM ({_OFFERS})"


@query(
    f"""SELECT order_key, round(p, 4) AS price_score, round(tl, 4) AS terms_score, round(rs, 4) AS response_score, round(rk, 4) AS risk_score, round(g, 4) AS green_score, round(p * 0.32 + tl * 0.22 + rs * 0.18 + rk * 0.18 + g * 0.1, 4) AS score FROM (SELECT order_key,
CASE WHEN price IS NULL THEN 65.0 ELSE greatest(0.0, least(100.0, CASE WHEN price_max > price_min THEN 95.0 - (price - price_min) / (price_max - price_min) * 35.0 ELSE 82.0 END + CASE WHEN order_key % 2 = 0 THEN 4.0 ELSE 0.0 END)) END::DOUBLE AS p,
greatest(0.0, least(100.0, 0.6::DOUBLE * CASE WHEN net_days > 0 THEN 60.0::DOUBLE + net_days / greatest(net_max, net_days) * 35.0::DOUBLE ELSE 58.0 END + 0.4::DOUBLE * CASE WHEN lead_days > 0 THEN CASE WHEN lead_max > lead_min THEN 88.0::DOUBLE - (lead_days - lead_min) / (lead_max - lead_min) * 40.0::DOUBLE ELSE 78.0 END ELSE 62.0 END))::DOUBLE AS tl,
CASE order_key % 3 WHEN 0 THEN 58.0 WHEN 1 THEN 58.0 + 0.5 * 37.0 ELSE 100.0 END::DOUBLE AS rs,
CASE WHEN risks = '' THEN 86.0 ELSE 86.0 - 14.0 * len(string_split(risks, '|')) END::DOUBLE AS rk, CASE WHEN green <> '' THEN 82.0 WHEN order_key % 5 = 0 THEN 74.0 ELSE 48.0 END::DOUBLE AS g FROM ({_OFFERS}), ({_BOUNDS}))"""
)
def offer_scorecards(t):
    k, some = F.col("order_key"), lambda c: F.filter(F.split(c, "[|]"), lambda s: s != "")
    o = offers_in_replies(t)
    ideas = F.when(k % 5 == 0, F.array(F.lit("a roadmap"))).otherwise(F.array().cast("array<string>"))
    rows = o.select("order_key", "price", "lead_days", "net_days", some("risks").alias("risks"), some("green").alias("green"), ideas.alias("ideas"), (k % 2 == 0).alias("discount"), (k % 3).alias("answered"), F.lit(2).alias("rounds"))
    return extraction.scorecards(rows, insight.offer_bounds(o)).select("order_key", *[f"{n}_score" for n in D.SCORE_WEIGHTS], "score")


_NOTES = ["We plan automation. Prices drop soon!", "A concession is possible. Our roadmap grows", "no", None, "Savings? Yes. analytics and more."]


@query(f"SELECT k, coalesce(regexp_matches(r, {quoted(D.DISCOUNT)}), false) AS discount, coalesce(array_to_string(list_transform(list_filter(string_split(regexp_replace(r, '([.!?])[ \\t\\r\\n\\f]+', '\\1' || chr(1), 'g'), chr(1)), lambda s: regexp_matches(s, {quoted(D.INNOVATION)})), lambda s: trim(s)), '|'), '') AS ideas FROM (SELECT o_orderkey AS k, {filled_sql(_NOTES, _KEYS)} AS r FROM orders)")
def reply_notes(t):
    k, r = F.col("o_orderkey"), F.col("r")
    rows = t.raw("orders").select(k.alias("k"), filled(_NOTES, {"k": k}).alias("r"))
    return rows.select("k", F.coalesce(r.rlike(D.DISCOUNT), F.lit(False)).alias("discount"), F.coalesce(F.array_join(X.sentences_with(r, D.INNOVATION), "|"), F.lit("")).alias("ideas"))

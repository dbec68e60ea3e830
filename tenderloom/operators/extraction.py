"""Lines and figures out of documents: table rows of a text, repaired invoice
lines, the gate of a document, a scorecard of offers. A document's lines stay
inside its row, so nothing here shuffles by document."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenderloom.functions import documents as D
from tenderloom.functions import fields as X

#: The last three words of a table's line in its two forms.
_PRICE, _QUANTITY = rf"^{D.SIGN}?\d[\d,]*(\.\d{{0,2}})?$", r"^\d+$"
PRICE_FIRST, QUANTITY_FIRST = (_PRICE, _QUANTITY, _PRICE), (_QUANTITY, _PRICE, _PRICE)
# Labels that are no items, and the fields that a kind must have.
SUMMARY = ("total", "sub-total", "subtotal", "tax", "vat", "gst", "discount", "shipping", "freight", "balance", "amount due", "grand total", "net", "total amount", "vat (20%)", "vat (10%)", "vat (5%)")
SUMMARY_STARTS = ("total amount", "vat ", "vat(", "sales tax", "grand total", "tax ", "tax(")
SUMMARY_HOLDS = ("account no", "account number", "account name", "sort code", "bank", "iban", "swift", "bic", "payable to", "remit to", "po no", "invoice no", "date issued", "vat no", "pay by", "payment", "thank you", "invoice reference", "this invoice")
#: Words of a table's head: its first cell, and all of its cells.
FIRST_CELLS = ("description", "item", "particular", "particulars", "product", "service", "details")
HEAD_CELLS = (*FIRST_CELLS, "price", "rate", "unit price", "cost", "qty", "quantity", "units", "count", "amount", "subtotal", "sub-total", "total", "line total", "extended")
REQUIRED = {
    "Invoice": ("invoice_id", "invoice_date", "vendor_name", "buyer_id", "invoice_total_incl_tax"),
    "Purchase_Order": ("po_id", "order_date", "vendor_name", "total_amount"),
    "Quote": ("quote_id", "quote_date", "vendor_name", "total_amount"),
    "Contract": ("contract_id", "contract_start_date", "supplier_id"),
}


#: Telephone numbers: two to four groups of digits, the inner ones of three or four.
PHONE = r"^\+[\d ()-]{7,20}$|^(\+\d{1,3}[ -])?\(?\d{2,5}\)?([ -]\d{3,4}){1,2}([ -]\d{2,4})?$"
_ROWS = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("item", "quantity", "unit_price", "amount")]))


def _is_number(cell: str) -> bool:
    try:
        float(re.sub(r"[£$€¥₹,\s]", "", cell))
    except ValueError:
        return False
    return True


def _is_sum(label: str) -> bool:
    low = label.lower().strip().rstrip(":")
    return low in SUMMARY or low.startswith(SUMMARY_STARTS) or any(w in low for w in SUMMARY_HOLDS)


def _cell_rows(lines: list[str]) -> Iterator[tuple[str, str, str, str]]:
    """Rows of a table of three or four columns whose cells stand a line each.

    The head is the first line that starts one, with the head cells after it. Where no row
    begins, one line is passed over; the table ends after more than two such
    lines than it has columns (twice the columns for names without figures).
    A name may go over two lines.
    """
    cells = [x.strip() for x in lines]
    start = next((i for i, x in enumerate(cells) if x.lower() in FIRST_CELLS), None)
    if start is None:
        return
    at = next((i for i in range(start, len(cells)) if cells[i].lower() not in HEAD_CELLS), len(cells))
    n = at - start
    if n not in (3, 4):
        return
    idle = 0
    while at + n <= len(cells):
        name, *rest = cells[at : at + n]
        named = name != "" and not _is_sum(name) and not _is_number(name) and not name.startswith("+") and not re.search(PHONE, name)
        two_lines = not _is_number(rest[0]) and at + n < len(cells)
        if two_lines:  # quantity before price
            quantity, price, amount, size = rest[1], rest[2] if n == 4 else "", cells[at + n], n + 1
            fits, name = _is_number(quantity) or _is_number(amount), f"{name} {rest[0]}"
        else:  # price before quantity
            quantity, price, amount, size = rest[n - 3], rest[0] if n == 4 else "", rest[-1], n
            fits = any(map(_is_number, rest))
        if named and fits:
            yield name, quantity, price, amount
            idle, at = 0, at + size
            continue
        at += 1
        idle += not (named and two_lines and n == 4)
        if idle > (2 * n if named else n + 2):
            return


@F.pandas_udf(_ROWS)
def cell_rows(lines: pd.Series) -> pd.Series:
    """Lines of a text -> the rows of its table with one cell a line."""
    return lines.map(lambda x: [] if x is None else list(_cell_rows(list(x))))


def _items(lines: Column, form: tuple[str, str, str], quantity: int, price: int) -> Column:
    """The lines whose last three words have the form and other words before them,
    but for those of sums, as structs."""
    split = F.filter(F.transform(lines, lambda x: F.filter(F.split(x, "\\s+"), lambda w: w != "")), lambda w: F.size(w) > 3)
    last = lambda w, i: F.element_at(w, i - 3)
    fits = F.filter(split, lambda w: reduce(Column.__and__, [last(w, i).rlike(p) for i, p in enumerate(form)]))
    read = F.transform(fits, lambda w: F.struct(F.array_join(F.slice(w, 1, F.size(w) - 3), " ").alias("item"), last(w, quantity).alias("quantity"), last(w, price).alias("unit_price"), last(w, 2).alias("amount")))

    def kept(x: Column) -> Column:
        label = F.rtrim(F.lower(x["item"]), F.lit(":"))
        return (x["item"] != "") & ~label.isin(*SUMMARY) & ~reduce(Column.__or__, [label.startswith(s) for s in SUMMARY_STARTS] + [label.contains(s) for s in SUMMARY_HOLDS]) & ~x["item"].rlike(PHONE)

    return F.filter(read, kept)


def line_items(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, position, item, quantity, unit_price, amount: rows of the tables in a
    text. A row is a line with the price or the quantity first, or each of its
    cells is a line. All three forms are tried; the one with most amounts counts,
    then the one with longer items, then in this order. An item takes the longer
    name that another form has for the same amount if it holds the name. Lines
    that are a telephone number don't count. Null and empty texts have none."""
    clean = F.filter(F.split(F.col(text), "\n"), lambda x: ~F.btrim(x).rlike(PHONE))
    headed = F.exists("_l", lambda x: F.lower(F.btrim(x, F.lit(" \t\r"))).isin(*FIRST_CELLS))
    lines = F.filter("_l", lambda x: F.btrim(x) != "")
    # Only texts with a head go to Python.
    read = docs.select(key, clean.alias("_l")).select(key, _items(lines, PRICE_FIRST, 1, 0).alias("a"), _items(lines, QUANTITY_FIRST, 0, 1).alias("b"), cell_rows(F.when(headed, F.col("_l"))).alias("c"))
    length = lambda c: F.aggregate(c, F.lit(0), lambda n, x: n + F.char_length(x["item"]))
    form = lambda c, i: F.struct((-F.size(F.filter(c, lambda x: F.btrim(x["amount"]) != ""))).alias("n"), (-length(c) / F.nullif(F.size(c), F.lit(0))).alias("length"), F.lit(i).alias("i"), F.col(c).cast(_ROWS).alias("rows"))
    forms = F.array_sort(F.filter(F.array(form("a", 0), form("b", 1), form("c", 2)), lambda x: F.size(x["rows"]) > 0))
    rows = read.select(key, forms.alias("f")).where(F.size("f") > 0).select(key, F.get("f", F.lit(0))["rows"].alias("best"), F.flatten(F.slice("f", 2, 2)["rows"]).alias("rest"))
    one = rows.select(key, "rest", F.posexplode("best").alias("position", "x"))
    bare = lambda c: F.regexp_replace(c, r"[£$€¥₹,\s]", "")
    longer = F.filter("rest", lambda o: (bare(F.col("x.amount")) != "") & (bare(o["amount"]) == bare(F.col("x.amount"))) & (F.char_length(o["item"]) > F.char_length("x.item")) & F.contains(F.lower(o["item"]), F.lower("x.item")))
    longest = F.aggregate(longer, F.col("x.item"), lambda n, o: F.when((F.char_length(o["item"]) > F.char_length(n)) & F.contains(F.lower(o["item"]), F.lower(n)), o["item"]).otherwise(n))
    return one.select(key, "position", longest.alias("item"), F.col("x.quantity").alias("quantity"), F.col("x.unit_price").alias("unit_price"), F.col("x.amount").alias("amount"))


def repaired_lines(rows: DataFrame, text: str) -> DataFrame:
    """Rows (quantity, unit_price, line_amount, tax_amount, total_amount_incl_tax
    and their text) with missing figures from the numbers of the text: the
    greatest is the total, one that times the quantity gives the total is the
    price, the greatest of the rest is the line's amount (the total without one),
    the difference is the tax. Figures that are there stay; so do rows whose text
    has no number beside the quantity."""
    near = lambda a, b: F.abs(a - b) <= F.greatest(F.lit(0.02), 0.01 * F.greatest(F.abs(a), F.abs(b), F.lit(1.0)))
    q = F.col("quantity")
    found = F.transform(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"[0-9][0-9,]*\.?[0-9]*"), F.lit(0)), lambda s: F.replace(s, F.lit(","), F.lit("")).try_cast("double"))
    numbers = F.array_sort(F.array_distinct(F.filter(found, lambda x: F.coalesce(F.abs(x - q) >= 1e-6, F.lit(True)))))
    out = rows.withColumn("_n", numbers).withColumn("_top", F.try_element_at("_n", F.lit(-1)))
    out = out.withColumn("_rest", F.filter("_n", lambda x: x < F.col("_top")))
    out = out.withColumn("_unit", F.when(q != 0, F.try_element_at(F.filter("_rest", lambda x: near(x * q, F.col("_top"))), F.lit(1))))
    out = out.withColumn("_rest", F.filter("_rest", lambda x: F.coalesce(x != F.col("_unit"), F.lit(True))))
    total = F.coalesce("total_amount_incl_tax", "_top")
    line = F.coalesce("line_amount", F.try_element_at("_rest", F.lit(-1)), "_top")
    out = out.withColumns({"_total": total, "_line": line})
    gap = F.col("_total") - F.col("_line")
    fits = F.try_element_at(F.filter(F.slice("_rest", 1, F.greatest(F.size("_rest") - 1, F.lit(0))), lambda x: near(x, gap)), F.lit(1))
    tax = F.coalesce("tax_amount", F.when(gap > 0, fits), F.when(gap > 0.02, F.round(gap, 2)))
    price = F.coalesce("unit_price", "_unit", F.when(q != 0, F.round(F.col("_line") / q, 2)))
    some = F.col("_top").isNotNull()
    new = {"total_amount_incl_tax": F.col("_total"), "line_amount": F.col("_line"), "tax_amount": tax, "unit_price": price}
    old = {c: F.col(c) for c in new}
    return out.select(*[c for c in rows.columns if c not in new], *[F.when(some, new[c]).otherwise(old[c]).alias(c) for c in new])


def gate(docs: DataFrame, required: list[str], fields: Column, issues: Column, least: float = 0.70) -> DataFrame:
    """Documents with the required fields they lack (null or blank), their
    confidence, and whether they pass: no field lacks and it reaches the least."""
    lacks = F.filter(F.array(*[F.when(F.coalesce(F.btrim(F.col(c).cast("string")), F.lit("")) == "", c) for c in required]), lambda x: x.isNotNull())
    out = docs.withColumn("missing", lacks)
    out = out.withColumn("document_confidence", F.round(D.document_confidence(fields, F.size("missing") == 0, issues), 6))
    return out.withColumn("passed", (F.size("missing") == 0) & (F.col("document_confidence") >= least))


def scorecards(offers: DataFrame, bounds: DataFrame) -> DataFrame:
    """Offers (price, lead_days, net_days, risks, green, ideas, discount, answered,
    rounds) with five scores of 0..100 and their weighted sum. bounds is one row."""
    o = offers.crossJoin(F.broadcast(bounds))
    c = F.col
    parts = {
        "price": D.price_score(c("price"), c("price_min"), c("price_max"), c("discount")),
        "terms": D.terms_and_lead_score(c("net_days"), c("net_max"), c("lead_days"), c("lead_min"), c("lead_max")),
        "response": D.response_score(c("answered"), c("rounds")), "risk": D.risk_score(c("risks"), X.RISK_WORDS), "green": D.green_score(c("green"), c("ideas")),
    }
    every = reduce(Column.__add__, [parts[k] * w for k, w in D.SCORE_WEIGHTS.items()])
    return o.select(*offers.columns, *[F.round(p, 4).alias(f"{k}_score") for k, p in parts.items()], F.round(every, 4).alias("score"))

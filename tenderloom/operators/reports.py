"""A report on the fields read from a document: what is missing, what the text
contradicts, and a score. All of it is columns of the document's row; only the
orders that invoices name are looked up by a join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderloom.functions.columns import any_date
from tenderloom.operators.extraction import REQUIRED
from tenderloom.operators.joins import left_known

# Points of a hundred that a fault costs, dates in order, signs of currencies.
COSTS = {"missing": 15, "vendor": 10, "buyer": 20, "line": 2, "no_lines": 10, "dates": 10, "order": 5, "sign": 5}
DATES = {"Invoice": ("invoice_date", "due_date"), "Purchase_Order": ("order_date", "expected_delivery_date"), "Contract": ("contract_start_date", "contract_end_date")}
SIGNS = {"GBP": "£", "USD": "$", "EUR": "€"}
#: Characters in which the vendor, the buyer and the currency's sign are looked for.
HEAD, SECTION, FRONT = 500, 200, 1000
_RECIPIENT = ("invoice to", "bill to", "invoiceto", "billto")


def _by_kind(kind: Column, values: dict, otherwise: Column) -> Column:
    out = otherwise
    for name, value in values.items():
        out = F.when(kind == name, value).otherwise(out)
    return out


def _recipient(text: Column) -> Column:
    """The text after the first label of a recipient; null without one."""
    low = F.regexp_replace(F.lower(text), "[ \\t-\\r]+", " ")
    ends = [F.when(F.locate(label, low) > 0, F.struct(F.locate(label, low).alias("at"), F.lit(len(label)).alias("n"))) for label in _RECIPIENT]
    first = F.least(*ends)
    rest = F.substr(low, first["at"] + first["n"])
    return F.when(first.isNotNull(), F.substring(F.ltrim(rest, F.lit(": ")), 1, SECTION))


def quality_report(docs: DataFrame, orders: DataFrame) -> DataFrame:
    """docs (doc_type, header map<string, string>, lines array of structs with
    item_description, text and others) with score (0 to 1), valid, errors, warnings;
    columns of these names are replaced. orders (po_id) are those that exist.

    Errors: a required field missing or empty, an invoice's buyer absent from the
    recipient's section, a second date before the first. Warnings: an invoice's vendor
    absent from the text's head, no lines (but in contracts), lines without a
    description by number, an unknown order of an invoice, a currency whose sign the
    text lacks. Null headers, lines and texts are empty ones, an unknown doc_type
    requires nothing, dates that can't be read are not compared."""
    kept = [c for c in docs.columns if c not in ("score", "valid", "errors", "warnings")]
    kind, h = F.col("_kind"), F.col("_h")
    get = lambda name: F.nullif(F.try_element_at(h, F.lit(name)), F.lit(""))
    nothing = F.array().cast("array<string>")
    rows = docs.select(F.struct(*kept).alias("_row"), F.col("doc_type").alias("_kind"), F.coalesce("header", F.create_map().cast("map<string,string>")).alias("_h"), F.coalesce(F.transform("lines", lambda x: x["item_description"]), nothing).alias("_l"), F.coalesce("text", F.lit("")).alias("_t"))
    known = orders.where("po_id is not null").select(F.col("po_id").cast("string").alias("_po")).distinct().withColumn("_known", F.lit(True))

    text, invoice = F.col("_t"), kind == "Invoice"
    required = _by_kind(kind, {k: F.array(*map(F.lit, v)) for k, v in REQUIRED.items()}, nothing)
    missing = F.transform(F.filter(required, lambda name: F.coalesce(F.try_element_at(h, name), F.lit("")) == ""), lambda name: F.concat(F.lit("missing:"), name))
    absent = lambda value, where: F.coalesce(~F.contains(F.lower(where), F.lower(value)), F.lit(False))
    pair = [_by_kind(kind, {k: any_date(get(v[i])) for k, v in DATES.items()}, F.lit(None).cast("date")) for i in (0, 1)]
    second = _by_kind(kind, {k: F.lit(v[1]) for k, v in DATES.items()}, F.lit(None).cast("string"))
    listed = lambda value, test: F.when(test, F.array(value)).otherwise(nothing)
    errors = F.concat(missing, listed(F.lit("buyer"), invoice & absent(get("buyer_id"), _recipient(text))), listed(F.concat(F.lit("dates:"), second), F.coalesce(pair[1] < pair[0], F.lit(False))))

    bare = F.filter(F.transform("_l", lambda x, i: F.when(F.coalesce(x, F.lit("")) == "", F.concat(F.lit("line:"), i + 1))), lambda x: x.isNotNull())
    sign = _by_kind(get("currency"), {k: F.lit(v) for k, v in SIGNS.items()}, F.lit(None).cast("string"))
    before = F.concat(
        listed(F.lit("vendor"), invoice & absent(get("vendor_name"), F.substring(text, 1, HEAD))),
        bare,
        listed(F.lit("no_lines"), kind.isin("Invoice", "Purchase_Order", "Quote") & (F.size("_l") == 0)),
    )
    after = listed(F.lit("sign"), absent(sign, F.substring(text, 1, FRONT)))
    # All that needs the text is worked out before the rows are dealt to the orders.
    told = rows.select("_row", errors.alias("errors"), before.alias("_before"), after.alias("_after"), F.when(kind == "Invoice", get("po_id")).alias("_po"))
    unknown = listed(F.lit("order"), F.col("_po").isNotNull() & F.col("_known").isNull())
    out = left_known(told, known, "_po").select("_row", "errors", F.concat("_before", unknown, "_after").alias("warnings"))
    cost = F.aggregate(F.concat("errors", "warnings"), F.lit(0), lambda s, x: s + _by_kind(F.split_part(x, F.lit(":"), F.lit(1)), {k: F.lit(v) for k, v in COSTS.items()}, F.lit(0)))
    return out.select("_row.*", (F.greatest(100 - cost, F.lit(0)) / 100).alias("score"), (F.size("errors") == 0).alias("valid"), "errors", "warnings")

"""Text to records: labelled values, document types, feedback, field checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderloom.functions.columns import collapsed

#: Words that tell the type of a document.
TYPES = {
    "invoice": ("invoice", "bill to", "amount due", "remittance"),
    "purchase_order": ("purchase order", "ship to", "order number", "delivery date"),
    "contract": ("agreement", "term", "clause", "party"),
    "quote": ("quote", "quotation", "valid until", "estimate"),
}
POSITIVE = ("thank", "great", "perfect", "correct", "helpful")
NEGATIVE = ("wrong", "incorrect", "bad", "useless", "not helpful")


def labelled_values(docs: DataFrame) -> DataFrame:
    """doc_id, label, value of lines `label: value`; the first of a label."""
    line = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("at", "line"))
    pair = line.select("doc_id", "at", F.lower(F.btrim(F.regexp_extract("line", "^ *([A-Za-z][A-Za-z .#/-]{1,58}) *[:=] *(.*)$", 1))).alias("label"), F.btrim(F.regexp_extract("line", "^ *([A-Za-z][A-Za-z .#/-]{1,58}) *[:=] *(.*)$", 2)).alias("value"))
    return pair.where("label <> '' and value <> ''").groupBy("doc_id", "label").agg(F.min(F.struct("at", "value")).alias("b")).select("doc_id", "label", F.col("b.value").alias("value"))


def _hits(text, words) -> F.Column:
    return sum((F.contains(text, F.lit(w)).cast("int") * (2 if " " in w else 1) for w in words), F.lit(0))


def document_type(docs: DataFrame, least: int = 2) -> DataFrame:
    """The type with the highest keyword score; ties keep the order invoice,
    purchase_order, contract, quote; below the least score it is `unknown`."""
    text = F.lower(F.coalesce("text", F.lit("")))
    scored = docs.select("doc_id", *[_hits(text, words).alias(k) for k, words in TYPES.items()])
    top = F.greatest(*TYPES)
    kind = F.when(top < least, "unknown")
    for k in TYPES:
        kind = kind.when(F.col(k) == top, k)
    return scored.select("doc_id", kind.alias("document_type"), top.alias("score"))


def feedback(turns: DataFrame) -> DataFrame:
    """User turns with a positive or negative signal."""
    text = F.lower(F.coalesce("text", F.lit("")))
    rows = turns.where("role = 'user'").withColumns({"up": _hits(text, POSITIVE), "down": _hits(text, NEGATIVE)})
    kind = F.when(F.col("up") > F.col("down"), "positive").when(F.col("down") > F.col("up"), "negative").otherwise("neutral")
    return rows.select("conv_id", "turn", kind.alias("sentiment"), "up", "down")


def reconcile(headers: DataFrame, lines: DataFrame, key: str, amount: str, line_amount: str, tolerance: float = 0.02) -> DataFrame:
    """Headers with the sum of their lines; a blank amount is filled from it."""
    s = lines.groupBy(key).agg(F.sum(F.col(line_amount).cast("decimal(28,6)")).cast("double").alias("line_sum"))
    out = headers.join(s, key, "left")
    return out.withColumns({"matches": F.coalesce(F.abs(F.col("line_sum") - F.col(amount)) <= tolerance, F.lit(False)), amount: F.coalesce(amount, "line_sum")})


def sentences(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences: ends of sentence followed by white space or the end."""
    text = collapsed(F.coalesce("text", F.lit("")))
    return docs.select("doc_id", F.when(text == "", 0).otherwise(F.size(F.split(F.regexp_replace(text, "[.!?]+ ", "\u0001"), "\u0001"))).alias("n_sentences"))

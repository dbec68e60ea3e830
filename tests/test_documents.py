"""Fields and lines of documents, and joins that complete rows, on small cases."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from tenderloom.functions import documents as D
from tenderloom.operators import enrich, extraction, policies


def test_fields_of_null_and_empty_texts(spark):
    rows = spark.createDataFrame([(1, None), (2, "")], "k int, r string")
    r = F.col("r")
    got = rows.select(D.invoice_number(r).alias("a"), D.total_of(r).alias("b"), D.terms_of(r).alias("c"), D.currency_of(r).alias("d"), F.size(D.every_date(r)).alias("n"), D.product_type(r).alias("p")).collect()
    assert [tuple(x) for x in got] == [(None, None, None, None, 0, "other")] * 2


def test_subtotal_on_a_later_line(spark):
    rows = spark.createDataFrame([("Sub Total\nTax\nx\n £ 12.50\n£2.50\n",)], "r string")
    assert rows.select(D.subtotal_of(F.col("r"))).first()[0] == "£ 12.50"


def test_lines_of_a_long_text_and_of_none(spark):
    long = "\n".join(f"Bolt number {'x' * (i % 50)} 2.00 5 10.00" for i in range(3000))
    rows = spark.createDataFrame([(1, long), (2, None), (3, ""), (4, "Total 1.00 1 1.00")], "k int, r string")
    got = extraction.line_items(rows, "k", "r").groupBy("k").agg(F.count("*").alias("n"), F.max("position").alias("m")).collect()
    assert [tuple(x) for x in got] == [(1, 3000, 2999)]


def test_nearest_category_is_exact(spark):
    words = [["a", "b"], ["a", "b", "c", "d"], ["x"], ["a"], ["a", "x", "y", "z", "w"]]
    items = [(str(i), " ".join(w)) for i, w in enumerate([*words, ["q"], []])] + [("r", "A b"), ("n", None)]
    products = [(str(i), " ".join(w)) for i, w in enumerate(words)]
    got = {r.item_id: (r.product_id, r.similarity) for r in enrich.nearest_category(spark.createDataFrame(items, "item_id string, description string"), spark.createDataFrame(products, "product_id string, product string")).collect()}
    want = {}
    for key, text in items:
        x = set((text or "").lower().split())
        best = min(((-round(len(x & set(p.split())) / (len(x) * len(p.split())) ** 0.5, 6), i) for i, p in products), default=(0, "")) if x else (0, "")
        if best[0] <= -0.45:
            want[key] = (best[1], -best[0])
    assert got == want
    assert enrich.nearest_category(spark.createDataFrame([], "item_id string, description string"), spark.createDataFrame(products, "product_id string, product string")).count() == 0


def test_policy_details(spark):
    rows = spark.createDataFrame([('{"a": 1}',), ("plain",), (None,), (" ",), ("[1]",)], "d string")
    assert [r[0] for r in rows.select(policies.details_of(F.col("d"))).collect()] == ['{"a": 1}', '{"text":"plain"}', "{}", "{}", '{"text":"[1]"}']


def test_gate_without_fields(spark):
    rows = spark.createDataFrame([(1, "x"), (2, None)], "k int, number string")
    got = extraction.gate(rows, ["number"], F.array().cast("array<double>"), F.lit(0)).select("k", "document_confidence", "passed").orderBy("k").collect()
    assert [tuple(x) for x in got] == [(1, 0.0, False), (2, 0.0, False)]


def test_fields_in_texts_written_by_hand(spark):
    texts = {
        "Our invoice-no. 2024/0815 of 3rd March, 2024; purchase order ref: PO-77120\nNet amount: 1,250.00\nVAT (19 %) €237.50\nAmount due € 1,487.50\nterms: 45 days net": ("2024/0815", "77120", "€ 1,487.50", "1,250.00", "€237.50", "45"),
        "BILL NUM B-99\nTotal payable 12\npayable upon receipt": ("B-99", None, "12", None, None, "0"),
        "Invoices are paid net 60, the bill of 12 May is not.": (None, None, None, None, None, "60"),
        "We invented taxes; orders go on. Totally fine.": (None, None, None, None, None, None),
    }
    r = F.col("r")
    rows = spark.createDataFrame([(t,) for t in texts], "r string")
    got = rows.select("r", D.invoice_number(r), D.order_number(r), D.total_of(r), D.subtotal_of(r), D.tax_of(r), D.terms_of(r)).collect()
    assert {x[0]: tuple(x)[1:] for x in got} == texts


def test_lines_by_their_last_words(spark):
    text = "Hex  bolt\tM8 12 £0.50 £6.00\nno 1 2\n5 1.00 5.00\nGrand total 1 £6.00 £6.00\nNut 1 2 three"
    got = extraction.line_items(spark.createDataFrame([(1, text)], "k int, r string"), "k", "r").collect()
    assert [(x.item, x.quantity, x.unit_price, x.amount) for x in got] == [("Hex bolt M8", "12", "£0.50", "£6.00")]


def test_patterns_look_at_one_letter_before_their_words(spark):
    """Labels and months are tried only where one of them can begin, and the same is found as without that look."""
    plain = lambda p: re.sub(r"\(\?=\[[a-z]+\]\)", "", p)
    r = random.Random(3)
    parts = ["Total", "TOTAL due", "grand total", "sub-total", "Sub Total\n", "VAT", "tax", "Tax (20%): ", "net 30", "net amount", "terms", "within", "due in", "due date", "days", "payment is", "upon receipt", "immediately", "Date", "issued on", "P.O. date", "invoice no", "inv.", "£", "$5", "1,200.50", "30", " 12 ", "2024", "05/06/2024", "2024-05-06", "March", "may", "Dec", "5th", "sales tax", "x", "#", ":", ".", "\n", "\n", " "]
    texts = spark.createDataFrame([("".join(r.choice(parts) + r.choice(["", " ", " "]) for _ in range(r.randint(1, 25))),) for _ in range(1500)], "t string").repartition(4).cache()
    groups = [*D.DATES, *D.TOTAL, *D.SUBTOTAL, *D.TAX, *D.TERMS, D.AFTER_SUBTOTAL, D.AT_ONCE, *D.INVOICE_DATE, *D.DUE_DATE, *D.ORDER_DATE]
    looking = [p for p in groups if plain(p) != p]
    assert len(looking) >= 14
    every = lambda p: F.regexp_extract_all("t", F.lit(p), F.lit(0))
    same, found = texts.select(*[(every(p) == every(plain(p))).alias(f"s{i}") for i, p in enumerate(looking)], *[F.size(every(p)).alias(f"n{i}") for i, p in enumerate(looking)]).agg(F.array(*[F.bool_and(f"s{i}") for i in range(len(looking))]), F.array(*[F.sum(f"n{i}") for i in range(len(looking))])).first()
    assert all(same) and sum(n > 0 for n in found) >= 12

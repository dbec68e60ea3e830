"""Tables with a cell a line and records by schema on small cases."""

from __future__ import annotations

import datetime

from tenderloom.operators import extraction, structured

HEAD = structured.Schema({"invoice_id": "string", "invoice_date": "date", "total_amount": "number"}, {"invoice_id": ["invoice number"], "total_amount": ["grand total"]})
LINES = structured.Schema({"description": "string", "quantity": "number", "amount": "number"}, {"quantity": ["qty"]})


def _rows(text):
    return list(extraction._cell_rows(text.split("\n")))


def test_cells():
    assert _rows("Item\nQty\nAmount\nBolt\n1\n2") == [("Bolt", "1", "", "2")]
    assert _rows("Item\nQty\nAmount\nSteel\nbolt\n1\n2\nPin\n3\n£4.00") == [("Steel bolt", "1", "", "2"), ("Pin", "3", "", "£4.00")]
    # Names without figures don't end a table of four columns; two of them can be the name of a row.
    assert _rows("Item\nRate\nUnits\nTotal\nwords\nand\nmore\nthere\nand\nso\non\nPin\n1\n1\n1") == [("and so", "on", "Pin", "1")]
    assert _rows("Item\nQty\nAmount" + "\n" * 7 + "Bolt\n1\n2") == []  # six lines without a row end it
    assert _rows("Item\nQty\nBolt\n1\n2") == _rows("Bolt\n1\n2") == _rows("") == _rows("Item") == []
    assert _rows("Item\nQty\nAmount\nBolt\n1") == []  # no whole row


def test_line_items(spark):
    rows = [(1, "Item\nQty\nAmount\nLong bolt\n1\n2.00\nBolt 2.00 1 2.00"), (2, "+44 20 7946 0958 1 2\nPin 1 2 2\nOur bank 1 2 2"), (3, None), (4, ""), (5, "x\n" * 5000 + "Pin 1 2 2")]
    got = sorted(map(tuple, extraction.line_items(spark.createDataFrame(rows, "k int, t string"), "k", "t").collect()))
    assert got == [(1, 0, "Long bolt", "1", "", "2.00"), (2, 0, "Pin", "2", "1", "2"), (5, 0, "Pin", "2", "1", "2")]
    assert extraction.line_items(spark.createDataFrame([], "k int, t string"), "k", "t").count() == 0


def test_records(spark):
    text = "Invoice Numbr: A-1\nInvoice date\t3 Mar 2024\nInvoice number: B-2\nGrand total - £1,200.50\nColour: red\n\nDescription\tQty\tAmount\nBolt\t2\t10.5\n\t\nPin\t\t4\nTotal\t2\t14.5\nCap\t1\t1"
    rows = [(1, text), (2, None), (3, ""), (4, "Qty   Amount\n5   6"), (5, "Invoice date: never")]
    got = {r.k: r for r in structured.records(spark.createDataFrame(rows, "k int, t string"), "k", "t", HEAD, LINES, ["invoice_id", "total_amount"]).collect()}
    one = got[1]
    # The first label takes the column; the better one comes too late and stays as it is.
    assert (one.invoice_id, one.total_amount, one.invoice_date) == ("A-1", 1200.5, datetime.date(2024, 3, 3))
    assert one.other["Invoice number"] == "B-2" and one.other["Colour"] == "red" and one.missing == []
    assert [tuple(x)[1:] for x in one.lines] == [("Bolt", 2.0, 10.5), ("Pin", 4.0, None)]  # blank cells close up
    assert got[2].lines == got[3].lines == [] and got[2].other == {} and got[2].missing == ["invoice_id", "total_amount"]
    assert [tuple(x)[1:] for x in got[4].lines] == [(None, 5.0, 6.0)]
    assert got[5].invoice_date is None and got[5].invoice_id is None
    assert structured.records(spark.createDataFrame([], "k int, t string"), "k", "t", HEAD, LINES).count() == 0


def test_records_are_read_within_their_rows(spark):
    text = "Invoice number: A-1\nnames\t" + "x" * 80 + "\nInvoice number: B\n\nDescription  Qty  Amount  Note\nBolt 1  2  3\nTOTAL  1  1"
    docs = spark.createDataFrame([(i, text) for i in range(3)] + [(2, "Grand total: 7"), (None, text)], "k int, t string")
    out = structured.records(docs, "k", "t", HEAD, LINES)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Generate" not in plan and "Join" not in plan
    got = {r.k: r for r in out.collect()}
    assert len(got) == 4 and [tuple(x) for x in got[1].lines] == [(5, "Bolt 1", 2.0, 3.0)]
    assert (got[1].invoice_id, got[1].total_amount) == ("A-1", 1.0) and got[1].other["names"] == "x" * 80 and got[1].other["Bolt 1"] == "2  3"
    assert (got[2].invoice_id, got[2].total_amount) == ("A-1", 7.0)  # two texts of one key
    assert got[None].invoice_id is None and got[None].lines == [] and got[None].other == {}

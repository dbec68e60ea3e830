"""Chunks by passages, packed contexts and exact dense search on small cases."""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tenderloom.operators import chunking, reports, retrieval


def test_passage_chunks(spark):
    long = " ".join(f"Sentence number {i} is here." for i in range(12))
    rows = [(1, "One.\n\nTwo.\n\n\nThree."), (2, long), (3, None), (4, " \n\n\t"), (5, "x" * 130), (6, "")]
    out = chunking.passage_chunks(spark.createDataFrame([(*r, 0) for r in rows], "id long, text string, chunk int"), "id", limit=80, overlap=20)
    got = {}
    for r in sorted(out.collect()):
        assert r.chunk == len(got.setdefault(r.id, []))
        got[r.id].append(r.content)
    assert out.columns == ["id", "chunk", "content"]
    assert got[1] == ["One. Two. Three."] and got[5] == ["x" * 130] and set(got) == {1, 2, 5}
    # Two sentences are 52 to 54 characters, so the lead of 26 has no room before the next two.
    assert " ".join(got[2]) == long and all(len(c) <= 80 for c in got[2])


def test_chunks_overlap_and_lose_nothing():
    r = random.Random(4)
    for _ in range(60):
        text = "\n\n".join(" ".join("w" * r.randint(1, 9) + r.choice([".", "", "!", ""]) for _ in range(r.randint(0, 60))) for _ in range(r.randint(0, 6)))
        limit, overlap = r.choice([60, 120, 300]), r.choice([0, 15, 40])
        chunks = chunking.chunked(text, limit, overlap)
        rest = chunking.chunked(text, limit, 0)
        assert " ".join(" ".join(rest).split()) == " ".join(text.split())
        assert all(len(c) <= limit or " " not in c or not any(m in c[:-1] for m in (". ", "! ")) for c in rest)
        words, at = text.split(), 0  # every chunk goes on where one before it was, or repeats its end
        for c in chunks:
            part = c.split()
            start = next(s for s in range(at, -1, -1) if words[s : s + len(part)] == part)
            at = max(at, start + len(part))
        assert at == len(words)


def test_context_has_three_documents(spark):
    hits = [(1, i + 1, "a" if i < 5 else "b" if i == 5 else "c", chr(97 + i) * 40) for i in range(7)] + [(1, 8, "d", "z" * 9), (1, 9, "c", "")]
    hits += [(2, 1, "a", "x" * 500), (2, 2, "b", "y")] + [(3, 1, None, "q"), (3, 2, None, None)]
    df = spark.createDataFrame(hits, "query_id long, rank int, document string, text string")
    out = {}
    for r in chunking.packed_context(df, "document", "text", budget=184, least=3).orderBy("query_id", "place").collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.document, r.n_chars))
        assert r.block.startswith(f"[{r.document or 'unknown'}] ") and r.block.endswith("\n\n")
    # 46 characters a block: four of a fill it; b and c each take the place of a's last.
    assert out[1] == [(1, "a", 40), (2, "a", 40), (6, "b", 40), (7, "c", 40)]
    assert out[2] == [(1, "a", 178)]  # no document has two blocks, so none makes room
    assert out[3] == [(1, None, 1)]
    assert chunking.packed_context(df.limit(0), "document", "text").count() == 0


def _brute(vectors, queries, n):
    out = []
    for q, b in queries:
        scored = []
        for k, a in vectors:
            if len(a) == len(b):
                norm = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
                scored.append((-round(sum(x * y for x, y in zip(a, b)) / norm, 5) if norm else 0.0, k))
        out += [(q, k, -s, i) for i, (s, k) in enumerate(sorted(scored)[:n], 1)]
    return sorted(out)


@pytest.mark.parametrize(("most", "cells"), [(4_000_000, 64), (0, 7)])
def test_dense_equals_brute_force(spark, most, cells):
    r = random.Random(cells)
    centre = [[r.gauss(0, 1) for _ in range(5)] for _ in range(6)]
    vectors = [(i, [x + r.gauss(0, 0.1) for x in r.choice(centre)]) for i in range(300)]
    vectors += [(300 + i, [1.0, 2.0, 3.0, 4.0, 5.0]) for i in range(100)]  # equal rows
    vectors += [(400, [0.0] * 5), (401, [0.0] * 5), (402, [1.0, 1.0]), (403, [-1.0, -2.0, -3.0, -4.0, -5.0])]
    queries = [v for v in vectors if v[0] % 20 == 0] + [(900, [1.0, 0.5]), (901, [r.gauss(0, 1) for _ in range(5)])]
    bad = [(500, None), (501, [1.0, None, 1.0, 1.0, 1.0]), (502, [math.nan] * 5)]
    v = spark.createDataFrame(vectors + bad, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    q = spark.createDataFrame(queries + bad, "query_id long, embedding array<double>")
    got = sorted(map(tuple, retrieval.dense(v, q, 5, cells, most).select("query_id", "vec_id", "score", "rank").collect()))
    want = _brute(vectors, queries, 5)
    assert [(a, b, d) for a, b, _, d in got] == [(a, b, d) for a, b, _, d in want]
    assert all(abs(a[2] - b[2]) < 2e-5 for a, b in zip(got, want, strict=True))


def test_dense_of_nothing(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id long, embedding array<double>")
    q = v.withColumnRenamed("vec_id", "query_id")
    assert retrieval.dense(v.limit(0), q, 3).count() == 0 and retrieval.dense(v, q.limit(0), 3).count() == 0
    plan = retrieval.dense(v, q, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan


def test_dense_meets_in_blocks(spark):
    r = random.Random(3)
    rows = [(i, np.ones(4), 2.0) for i in range(3000)] + [(3000 + i, np.array([r.gauss(0, 1) for _ in range(4)]), None) for i in range(500)] + [(4000, np.zeros(4), 0.0), (4001, np.ones(2), math.sqrt(2))]
    v = pd.DataFrame([(i, x, float(np.linalg.norm(x))) for i, x, _ in rows], columns=["vec_id", "v", "norm"]).sample(frac=1, random_state=1)
    q = v[v.vec_id % 500 == 1].rename(columns={"vec_id": "query_id", "v": "q", "norm": "q_norm"})
    got = retrieval._block_scores(v, q, 3)
    assert got.groupby("query_id").size().max() < 60  # of thousands of equal vectors only the first go on
    best = got.assign(s=-got.score.round(5)).sort_values(["query_id", "s", "vec_id"]).groupby("query_id").head(3)
    want = _brute(list(zip(v.vec_id, v.v)), list(zip(q.query_id, q.q)), 3)
    assert list(zip(best.query_id, best.vec_id)) == [(a, b) for a, b, _, _ in want]
    s = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id long, embedding array<double>")
    plan = retrieval.dense(s, s.withColumnRenamed("vec_id", "query_id"), 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapCoGroups") >= 2 and "zip_with" not in plan.split("FlatMapCoGroups")[0]  # no row for each pair


def test_report_on_edges(spark):
    schema = "id long, doc_type string, header map<string,string>, lines array<struct<item_description:string>>, text string, score string"
    full = {"invoice_id": "1", "invoice_date": "2024-02-01", "vendor_name": "V", "buyer_id": "B", "invoice_total_incl_tax": "5"}
    rows = [
        (1, "Invoice", full, [("a",)], "V\nInvoice To B", "x"),
        (2, "Invoice", None, None, None, None),
        (3, None, full, [], "", None),
        (4, "Contract", {"contract_id": "c", "contract_start_date": "soon", "contract_end_date": "2020-01-01", "supplier_id": "s"}, None, None, None),
        (5, "Invoice", full | {"due_date": "01/01/2024", "po_id": "p"}, [("a",)] * 2 + [("",)], "bill to somebody; v", None),
        (6, "Invoice", full | {"po_id": "q", "currency": "XYZ"}, [("a",)], "v, no label of a recipient", None),
    ]
    out = {r.id: (r.score, r.valid, r.errors, r.warnings) for r in reports.quality_report(spark.createDataFrame(rows, schema), spark.createDataFrame([("q",), ("q",), (None,)], "po_id string")).collect()}
    assert out[1] == (1.0, True, [], []) and out[3] == (1.0, True, [], []) and out[4] == (1.0, True, [], []) and out[6] == (1.0, True, [], [])
    assert out[2] == (0.15, False, ["missing:" + f for f in full], ["no_lines"])
    # "bill to somebody" holds the letter of buyer B, the dates are turned round, order p is unknown.
    assert out[5] == (0.83, False, ["dates:due_date"], ["line:3", "order"]) and len(out) == 6

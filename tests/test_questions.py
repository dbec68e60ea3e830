"""Signed vectors against the library, names against all pairs."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenderloom.functions import questions as Q
from tenderloom.functions.columns import words_of
from tenderloom.functions.fields import company_key, core_words
from tenderloom.operators import resolution
from tenderloom.plans.catalog import QUERIES

D = "/root/testdata/sf0.001"


def _vector(text):
    v = np.zeros(64)
    for w in re.findall("[a-z0-9]+", "".join(c.lower() if c.isascii() else c for c in text or "")):
        d = hashlib.blake2b(w.encode(), digest_size=8, person=b"rag_hash").digest()
        v[int.from_bytes(d[:4], "big") % 64] += -1 if d[4] % 2 else 1
    return v / np.linalg.norm(v) if v.any() else None


def test_signed_vectors(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text")
    own = spark.createDataFrame([(-1, None), (-2, ""), (-3, "?!")], "doc_id long, text string")
    got = {r.doc_id: (r.text, r.v) for r in docs.union(own).select("doc_id", "text", Q.signed_vector(words_of(F.col("text"))).alias("v")).collect()}
    plain = {k: x for k, x in got.items() if (x[0] or "").isascii()}
    assert len(plain) > 20
    for text, v in plain.values():
        want = _vector(text)
        assert (v is None) == (want is None) and (v is None or np.allclose(v, want, atol=1e-12))
    assert got[-1][1] is got[-2][1] is got[-3][1] is None


def test_signed_neighbours(spark):
    v = {r.doc_id: np.array(r.v) for r in spark.read.parquet(f"{D}/documents.parquet").select("doc_id", Q.signed_vector(words_of(F.col("text"))).alias("v")).where("v is not null").collect()}
    want = {}
    for q in (i for i in v if i % 100 == 0):
        score = {i: round(float(x @ v[q]), 5) for i, x in v.items()}
        want[q] = [score[i] for i in sorted(score, key=lambda i: (-score[i], i))[:10]]
    got: dict = {}
    for r in QUERIES["signed_neighbours"](spark, D).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.score)
    assert got.keys() == want.keys() and all(np.allclose(got[q], want[q], atol=2e-5) for q in want)


def test_names_equal_all_pairs(spark):
    r = random.Random(5)
    hot, rare = ["trading", "services", "north"], [f"w{i}" for i in range(40)]
    name = lambda: " ".join(r.sample(hot, r.randint(0, 3)) + r.sample(rare, r.randint(0, 2)))
    names, known = sorted({name() for _ in range(150)}), [(f"s{i}", name()) for i in range(150)]
    own = spark.createDataFrame([(n,) for n in names], "name string")
    suppliers = spark.createDataFrame(known, "supplier_id string, supplier_name string")
    asked = own.select("name", core_words(F.col("name")).alias("words"), company_key(F.col("name")).alias("key"))
    other = suppliers.select("supplier_id", "supplier_name", core_words(F.col("supplier_name")).alias("s_words"))
    pairs = {(p.name, p.supplier_id): (set(p.words), set(p.s_words)) for p in asked.crossJoin(other).collect()}
    least = 0.5

    def can(a, b):
        both = len(a & b)
        return both > 0 and (a <= b or b <= a or both > 1 and both / len(a | b) >= least)

    must = {k for k, (a, b) in pairs.items() if can(a, b)}
    found = resolution._candidates(asked, other.withColumn("s_low", F.lower("supplier_name")).withColumn("_k", F.struct("supplier_id", "s_low")), least)
    got = {(x.name, x._k.supplier_id) for x in found.collect()}
    assert must <= got and len(got) < len(pairs) / 2


def test_texts_are_never_broadcast(spark):
    names = spark.createDataFrame([(f"name {i} of many",) for i in range(2000)], "supplier_name string")
    texts = spark.createDataFrame([(1, "see Name 7, of many")], "k int, t string")
    for most in (resolution.MOST_BROADCAST, 0):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(resolution, "MOST_BROADCAST", most)
            out = resolution.named_in_texts(texts, names, "k", "t")
        assert ("BuildRight" in (plan := out._jdf.queryExecution().executedPlan().toString())) == (most > 0) and "BuildLeft" not in plan
        assert [tuple(r) for r in out.collect()] == [(1, "name 7 of many")]

"""Many equal rows, as any crawl has them: no group, array or partition holds them all."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tenderloom.llm import blocks, near, repeats
from tenderloom.llm.queries import vocabulary

from .fixtures import prose

N = 20_000
SAME = prose(21, 60)
NEAR = SAME.rsplit(" ", 1)[0] + " other"


@pytest.fixture(scope="module", params=[None, 5], ids=["null id", "repeated id"])
def docs(spark, request):
    """N equal rows, a near copy, and another text."""
    same = spark.range(N, numPartitions=8).select(F.lit(request.param).cast("long").alias("doc_id"), F.lit(SAME).alias("text"))
    rest = spark.createDataFrame([(900, NEAR), (901, prose(22, 80))], "doc_id long, text string")
    return same.union(rest)


def held(monkeypatch, module):
    """The tables that the module writes, by name."""
    seen = {}

    def cut(df, name, plain=module.cut):
        seen[name] = plain(df, name)
        return seen[name]

    monkeypatch.setattr(module, "cut", cut)
    return seen


def test_repeats(spark, docs, monkeypatch):
    seen = held(monkeypatch, repeats)
    got = Counter((r.n_words, r.n_removed) for r in repeats.drop_repeats(docs).select("n_words", "n_removed").collect())
    assert got == {(60, 60): N, (60, 59): 1, (80, 0): 1}
    assert seen["repeat-anchors"].groupBy("did", "th").count().agg(F.max("count")).first()[0] == 1
    assert seen["repeat-prefixes"].where("is_hot").count() == 0
    got = Counter((r.start, r.n_words) for r in repeats.maximal_repeats(docs).select("start", "n_words").collect())
    assert got == {(0, 60): N, (0, 59): 1}


def test_near_copies(spark, docs, monkeypatch):
    keyed = corpus_pipeline.row_keys(docs)
    seen = held(monkeypatch, near)
    found = near.near_duplicates(keyed.select(F.col(corpus_pipeline.ROW_KEY).alias("doc_id"), "text"), k=5)
    assert Counter(r["count"] for r in found.groupBy("component_id").count().collect()) == {N + 1: 1, 1: 1}
    assert seen["near-sets"].count() == 2  # one of the equal rows and the near copy
    assert seen["near-nodes"].count() == 3


def test_one_id_with_many_texts_is_spread(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 20)
    texts = [SAME.replace("w1 ", f"v{i} ", 1) for i in range(300)]
    docs = spark.createDataFrame([(5, t) for t in texts] + [(6, SAME)], "doc_id long, text string")
    seen = held(monkeypatch, near)
    found = near.near_duplicates(docs, k=2)
    assert found.where("component_id <> 5").count() == 0
    assert seen["near-sets"].count() > 250


def test_blocks(spark, docs, tmp_path):
    path = blocks.write(docs, vocabulary("word_bpe_49k.json"), end_id=1, path=f"file://{tmp_path}/ids")
    chunks = spark.read.parquet(path)
    most = chunks.select("shard", F.size("doc_ids").alias("n")).groupBy("shard").sum("n").agg(F.max("sum(n)")).first()[0]
    assert most < N / 3
    got = blocks.read(spark, path)
    assert got.count() == N + 2 and got.select("start").distinct().count() == N + 2
    assert got.agg(F.max(F.col("start") + F.col("n_tokens"))).first()[0] == got.agg(F.sum("n_tokens")).first()[0]


def test_pipeline_keeps_one(spark, docs):
    assert Counter(r.text for r in corpus_pipeline.without_near_copies(spark, docs, "").collect()).total() == 2

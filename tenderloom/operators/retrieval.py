"""Retrieval over many documents and a stated set of queries: BM25, dense
search, fusion, diversity, context packing, chunks.

A set of queries is far smaller than the corpus; its terms or vectors are
broadcast behind the caller's bound, and the corpus is read once. The rows of a
query that compete for its first n are cut to n in each part of the corpus
before they meet, so no query is one task's heap.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tenderloom.functions.columns import bucket_of, dot, text_key, unit, words_of


def first_n(rows: DataFrame, keys: list[str], order: list[Column], n: int, salt: str, parts: int = 64) -> DataFrame:
    """The first n rows of each key with their rank: of each salt first, then of
    what is left."""
    salted = rows.withColumn("_s", F.pmod(F.xxhash64(salt), F.lit(parts)))
    part = salted.withColumn("_k", F.row_number().over(Window.partitionBy(*keys, "_s").orderBy(*order))).where(F.col("_k") <= n)
    return part.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n).drop("_s", "_k")


def bm25(docs: DataFrame, queries: DataFrame, n: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """docs (doc_id, text), queries (query_id, text): the n best documents of
    each query. Only terms of queries are counted in the documents."""
    wanted = queries.select("query_id", F.explode(F.array_distinct(words_of(F.col("text")))).alias("term"))
    terms = F.broadcast(wanted.select("term").distinct())
    words = docs.select("doc_id", words_of(F.col("text")).alias("w")).withColumn("size", F.size("w"))
    every = words.agg(F.count("*").alias("n_docs"), F.avg("size").alias("avg_size"))
    tf = words.select("doc_id", "size", F.explode("w").alias("term")).join(terms, "term").groupBy("doc_id", "size", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = df.crossJoin(F.broadcast(every)).select("term", F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"), "avg_size")
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("size") / F.col("avg_size")))
    scored = tf.join(F.broadcast(idf), "term").join(F.broadcast(wanted), "term").groupBy("query_id", "doc_id").agg(F.round(F.sum(part.cast("decimal(28,12)")).cast("double"), 6).alias("score"))
    return first_n(scored, ["query_id"], [F.desc("score"), F.asc("doc_id")], n, "doc_id")


def _angles(centres: np.ndarray):
    """A function of Arrow batches: the angles of each vector to the centres; null
    for a zero vector and one of another length."""

    @F.pandas_udf("array<double>")
    def angles(vectors: pd.Series) -> pd.Series:
        out: list[list[float] | None] = [None] * len(vectors)
        at = [i for i, v in enumerate(vectors) if len(v) == centres.shape[1]]
        if at:
            rows = np.stack([np.asarray(vectors.iloc[i], dtype=np.float64) for i in at])
            norms = np.linalg.norm(rows, axis=1)
            cosines = (rows / np.where(norms > 0, norms, 1)[:, None]) @ centres.T
            for i, n, a in zip(at, norms, np.arccos(np.clip(cosines, -1, 1)), strict=True):
                out[i] = a.tolist() if n > 0 else None
        return pd.Series(out, dtype=object)

    return angles


def _nearest(centres: np.ndarray):
    """A function of Arrow batches: the nearest centre of each vector and the angle to
    it; -1 and null for a zero vector and one of another length."""

    @F.pandas_udf("a double, cell int")
    def nearest(vectors: pd.Series) -> pd.DataFrame:
        a, cell = np.full(len(vectors), np.nan), np.full(len(vectors), -1, dtype=np.int32)
        at = np.array([i for i, v in enumerate(vectors) if len(v) == centres.shape[1]], dtype=np.int64)
        if len(at) and len(centres):
            rows = np.stack([np.asarray(vectors.iloc[i], dtype=np.float64) for i in at])
            norms = np.linalg.norm(rows, axis=1)
            angles = np.arccos(np.clip((rows / np.where(norms > 0, norms, 1)[:, None]) @ centres.T, -1, 1))
            best = angles.argmin(axis=1)
            a[at], cell[at] = np.where(norms > 0, angles[np.arange(len(at)), best], np.nan), np.where(norms > 0, best, -1)
        return pd.DataFrame({"a": a, "cell": cell})

    return nearest


#: Scores that are computed at once.
_AT_ONCE = 4_000_000


def _block_scores(v: pd.DataFrame, q: pd.DataFrame, n: int) -> pd.DataFrame:
    """query_id, vec_id, score: for each query the vectors that can be among its n best by
    a score of 5 places, ties by vec_id. A product of matrices tells them, with a place
    of the rounding to spare; their scores are then summed in order of the dimensions."""
    out = []
    v = v.sort_values("vec_id", ignore_index=True)
    length, asked = v["v"].map(len), q["q"].map(len)
    for size in length.unique():
        vs, qs = v[length == size], q[asked == size]
        if not len(qs):
            continue
        rows, norm = np.stack(vs["v"].to_numpy()).astype(np.float64), vs["norm"].to_numpy()
        ways = (rows / np.where(norm > 0, norm, 1)[:, None]).T
        for start in range(0, len(qs), max(1, _AT_ONCE // len(vs))):
            some = qs.iloc[start : start + max(1, _AT_ONCE // len(vs))]
            wanted, q_norm = np.stack(some["q"].to_numpy()).astype(np.float64), some["q_norm"].to_numpy()
            near = (wanted / np.where(q_norm > 0, q_norm, 1)[:, None]) @ ways
            near[np.isnan(near)] = 2
            least = np.partition(near, len(vs) - n, axis=1)[:, len(vs) - n] if len(vs) > n else np.full(len(some), -2.0)
            i, j = np.nonzero(near >= (least - 1.1e-5)[:, None])
            total = np.zeros(len(i))
            for d in range(int(size)):
                total += rows[j, d] * wanted[i, d]
            both = norm[j] * q_norm[i]
            score = np.divide(total, both, out=np.zeros(len(i)), where=both != 0)
            kept = (pd.DataFrame({"i": i, "s": score}).groupby(["i", "s"], dropna=False).cumcount() < n).to_numpy()  # of equal scores the smallest vec_ids
            out.append(pd.DataFrame({"query_id": some["query_id"].to_numpy()[i[kept]], "vec_id": vs["vec_id"].to_numpy()[j[kept]], "score": score[kept]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


def dense(vectors: DataFrame, queries: DataFrame, n: int, cells: int = 64, most_of_group: int = 4_000_000) -> DataFrame:
    """vectors (vec_id, embedding), queries (query_id, embedding): the n nearest
    by cosine (5 places, ties by vec_id), exactly, without all pairs.

    Up to `cells` vectors are centres, and every vector lies in the cell of its
    nearest one. A query looks into its nearest cells that hold n vectors first; the
    n-th score found there is a bound: by the triangle inequality of angles a
    vector whose angle to its centre differs from the query's by more than the
    bound's angle can't be among the n. Cells are left out by it. Vectors
    without a direction in common gain little by that, but lose nothing.

    The centres and the cells' counts go through the driver, a row for each cell.
    A zero vector scores 0, and a zero query looks at all. Vectors and queries that
    are null or have null or NaN entries are left out; those of another length
    than the query's have no score. A cell is cut into parts of about most_of_group
    numbers; the queries that look into it meet each of them, as matrices.
    """
    whole = lambda name: F.forall(name, lambda x: x.isNotNull() & ~F.isnan(x))
    norm = lambda name: F.sqrt(dot(F.col(name), F.col(name)))
    v = vectors.where(whole("embedding")).select("vec_id", F.col("embedding").alias("v"), norm("embedding").alias("norm"))
    q = queries.where(whole("embedding")).select("query_id", F.col("embedding").alias("q"), norm("embedding").alias("q_norm"))
    chosen = [r.c for r in v.where("norm > 0").orderBy(F.xxhash64("vec_id"), "vec_id").limit(cells).select(unit(F.col("v")).alias("c")).collect()]
    centres = np.array(sorted({tuple(c) for c in chosen if len(c) == len(chosen[0])})) if chosen else np.zeros((0, 1))
    angles = _angles(centres)

    placed = v.withColumn("p", _nearest(centres)("v")).select("vec_id", "v", "norm", F.col("p.a").alias("a"), F.col("p.cell").alias("cell"))
    known = placed.groupBy("cell").agg(F.count("*").alias("n"), F.sum(F.size("v")).alias("numbers"), F.min("a").alias("low"), F.max("a").alias("high")).collect()  # a row for each cell

    told = [F.struct(F.get("as", F.lit(r.cell)).alias("qa"), *[F.lit(r[x]).cast(kind).alias(x) for x, kind in (("cell", "int"), ("n", "long"), ("low", "double"), ("high", "double"))]) for r in sorted(known, key=lambda r: r.cell)]
    empty = F.array().cast("array<struct<qa:double,cell:int,n:bigint,low:double,high:double>>")
    asked = q.withColumn("as", angles("q")).select("query_id", "q", "q_norm", (F.array_sort(F.array(*told)) if told else empty).alias("near"))
    parts = F.create_map(*[F.lit(x) for r in known for x in (r.cell, max(1, min(r.n, -(-r.numbers // max(1, most_of_group)))))])[F.col("cell")] if known else F.lit(1)
    kinds = [f"{name} {df.schema[name].dataType.simpleString()}" for name, df in (("query_id", q), ("vec_id", v))]
    cut = placed.select("vec_id", "v", "norm", "cell", F.pmod(F.xxhash64("vec_id"), parts).cast("int").alias("part"))

    def best(looked: DataFrame) -> DataFrame:
        """The n best of each query in the cells that it looks into."""
        each = looked.select("query_id", "q", "q_norm", "cell", F.explode(F.sequence(F.lit(0), (parts - 1).cast("int"))).alias("part"))
        met = cut.groupBy("cell", "part").cogroup(each.groupBy("cell", "part")).applyInPandas(lambda a, b: _block_scores(a, b, n), ", ".join([*kinds, "score double"]))
        return first_n(met.select("query_id", "vec_id", F.round("score", 5).alias("score")), ["query_id"], [F.desc("score"), F.asc("vec_id")], n, "vec_id")

    counted = F.transform("near", lambda x, i: F.struct(x.alias("x"), F.aggregate(F.slice("near", 1, i), F.lit(0).cast("long"), lambda s, y: s + F.when(y["qa"].isNull(), 0).otherwise(y["n"])).alias("before")))
    close = asked.select("query_id", "q", "q_norm", F.explode(F.filter(counted, lambda y: y["before"] < n)).alias("y")).select("query_id", "q", "q_norm", F.col("y.x.cell").alias("cell"))
    bound = best(close).groupBy("query_id").agg(F.when(F.count("*") == n, F.min("score")).alias("bound"))

    # A place of the rounding and the error of the angles are allowed for.
    most = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("bound") - 1e-5))) + 1e-6
    rows = asked.join(bound, "query_id", "left").select("query_id", "q", "q_norm", most.alias("most"), F.explode("near").alias("x")).select("query_id", "q", "q_norm", "most", F.col("x.cell").alias("cell"), F.col("x.qa").alias("qa"), F.col("x.low").alias("low"), F.col("x.high").alias("high"))
    return best(rows.where(F.coalesce((F.col("qa") - F.col("high") <= F.col("most")) & (F.col("low") - F.col("qa") <= F.col("most")), F.lit(True))))


def fuse(lists: list[tuple[DataFrame, float]], n: int, k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of ranked lists (query_id, doc_id, rank): the sum
    of weight / (k + rank)."""
    rows = None
    for df, weight in lists:
        one = df.select("query_id", "doc_id", (F.lit(weight) / (k + F.col("rank"))).alias("part"))
        rows = one if rows is None else rows.union(one)
    scored = rows.groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("part").cast("decimal(28,12)")).cast("double"), 9).alias("score"), F.count("*").alias("n_lists"))
    return first_n(scored, ["query_id"], [F.desc("score"), F.asc("doc_id")], n, "doc_id")


def cap_by_group(hits: DataFrame, group: str, most: int) -> DataFrame:
    """At most `most` hits of a group for each query, in rank order."""
    w = Window.partitionBy("query_id", group).orderBy("rank")
    return hits.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most).drop("_k")


def pack(hits: DataFrame, length: Column, budget: int) -> DataFrame:
    """Hits in rank order as long as their lengths fit into the budget."""
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return hits.withColumn("used", F.sum(length).over(w)).where(F.col("used") <= budget)


def drop_equal_texts(docs: DataFrame) -> DataFrame:
    """Per normalised text the smallest doc_id, and how many share it."""
    return docs.where("text is not null").select("doc_id", text_key(F.col("text")).alias("key")).groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n_copies"))


def hashed_vectors(docs: DataFrame) -> DataFrame:
    """doc_id, bucket, weight: counts of words in 256 buckets, length 1."""
    words = docs.select("doc_id", F.explode(words_of(F.col("text"))).alias("w")).groupBy("doc_id", "w").count()
    g = words.groupBy("doc_id", bucket_of(F.col("w")).alias("bucket")).agg(F.sum("count").alias("n"))
    norm = g.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("n") * F.col("n")).cast("double")).alias("norm"))
    return g.join(norm, "doc_id").select("doc_id", "bucket", F.round(F.col("n") / F.col("norm"), 6).alias("weight"))


def chunks(docs: DataFrame, size: int = 600, overlap: int = 48) -> DataFrame:
    """Windows of `size` words, each `overlap` words after the last one's end
    back; a text of fewer words is one chunk, without words none."""
    step = size - overlap
    w = docs.select("doc_id", F.filter(F.split(F.coalesce("text", F.lit("")), "[ \\t\\r\\n]+"), lambda x: x != "").alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - overlap - 1, F.lit(0)), F.lit(step))
    out = w.select("doc_id", "w", F.posexplode(starts).alias("chunk", "start"))
    return out.select("doc_id", "chunk", F.array_join(F.slice("w", F.col("start") + 1, size), " ").alias("text")).select("doc_id", "chunk", F.size(F.split("text", " ")).alias("n_words"), "text")


def boilerplate(docs: DataFrame, longest: int = 80, least: int = 3, share: float = 0.2) -> DataFrame:
    """Short lines that repeat in a text: at least 3 times and a fifth of its lines."""
    lines = docs.select("doc_id", F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), F.btrim), lambda x: x != "").alias("l"))
    one = lines.select("doc_id", F.size("l").alias("n_lines"), F.explode("l").alias("line")).where(F.char_length("line") <= longest)
    g = one.groupBy("doc_id", "n_lines", "line").count()
    return g.where((F.col("count") >= least) & (F.col("count") >= share * F.col("n_lines"))).select("doc_id", "line", F.col("count").alias("n"))


def covering(hits: DataFrame, keys: list[str], collection: str, score: str, hit: str, n: int) -> DataFrame:
    """The n hits of each key by score in which every collection has its best
    hit, and the rank in that order; if there are more than n collections, the
    best hits of the n best. Only the first n of each collection meet in a key."""
    order = [F.col(score).desc(), F.col(hit)]
    best = first_n(hits, [*keys, collection], order, n, hit).withColumnRenamed("rank", "_place")
    chosen = best.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy((F.col("_place") == 1).desc(), *order))).where(F.col("_k") <= n)
    return chosen.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).drop("_place", "_k")

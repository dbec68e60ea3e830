"""Ranked lexical search: the best documents of each query, by MaxScore in shards.

Queries go against all documents in blocks, each with a vocabulary of bounded
size. One pass over the documents makes shards: inverted lists of the block's
terms (documents and counts, sorted by term) for some thousands of documents. The
shards' own counts give N, L and the document frequencies. A second pass scores
the shards: a term's upper bound is its largest score in the shard, a query's
terms are taken from the largest bound down, and once the bounds that are left
add up to less than the worst of the ten best so far, they are non-essential:
they can bring in no document by themselves, and are looked up only for documents
that can still get among the ten. The ten best go from shard to shard of a task;
those of the tasks are merged in two steps, so that no task gets all of a query.

Scores are 64-bit integers: a term of weight w = floor(1000 * ln((2N + 2) / (2df + 1)))
adds w * (10**9 * tf div (1000 * tf + 8 * m)), m = 25 + (75 * n * N div L).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenderloom.llm.common import cut, forget, span_hashes, steps, text_buffers, words

#: Bytes of text that are split at a time, and lists' entries and documents of a shard.
STEP, SHARD_ENTRIES, SHARD_DOCS = 1 << 20, 1 << 18, 1 << 13
#: Distinct terms of a block of queries at most (or one query's).
BLOCK_TERMS = 1 << 16
SALTS = 64
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: ASCII bytes other than letters and digits are in no term.
APART = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_FOLD = {i: i + 32 for i in range(65, 91)}


def terms_of(text: str | None) -> list[str]:
    return TERM.findall((text or "").translate(_FOLD))


class Vocabulary:
    """Numbers of the given distinct terms, found by hash and confirmed by their bytes."""

    def __init__(self, terms: list[str]):
        raw = [t.encode() for t in terms]
        ends = np.cumsum([len(r) for r in raw], dtype=np.int64)
        self.data, starts = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], ends[:-1]]).astype(np.int64)
        h = span_hashes(self.data, starts, ends, lower=False)
        self.order = np.argsort(h)
        self.hashes, self.starts, self.lengths = h[self.order], starts, ends - starts

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of the term at each byte range of data, A-Z taken for a-z; -1 without."""
        out = np.full(len(starts), -1, np.int64)
        h = span_hashes(data, starts, ends, lower=True)
        place = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        at = np.flatnonzero(self.hashes[place] == h)
        term, n = self.order[place[at]], ends[at] - starts[at]
        same = self.lengths[term] == n
        at, term, n = at[same], term[same], n[same]
        if len(at):
            lead = np.cumsum(n) - n
            inner = np.arange(int(n.sum())) - np.repeat(lead, n)
            equal = _LOWER[data[np.repeat(starts[at], n) + inner]] == self.data[np.repeat(self.starts[term], n) + inner]
            same = np.logical_and.reduceat(equal, lead)
            out[at[same]] = term[same]
        return out


_LISTS, _SUMS = ["ids", "terms", "df", "docs", "counts", "lengths"], ["n_docs", "n_terms"]
_SHARD = ", ".join([f"{c} array<long>" for c in _LISTS] + [f"{c} long" for c in _SUMS])


class _Shard:
    """Documents with terms of the vocabulary, and counts of all."""

    def __init__(self):
        self.ids, self.lengths, self.docs, self.terms, self.counts = [], [], [], [], []
        self.n_docs = self.n_terms = self.held = self.entries = 0

    def add(self, ids: pa.Array, n: np.ndarray, doc: np.ndarray, term: np.ndarray, size: int) -> None:
        self.n_docs += int((n > 0).sum())
        self.n_terms += int(n.sum())
        key, count = np.unique(term * len(n) + doc, return_counts=True)
        doc, term = key % max(len(n), 1), key // max(len(n), 1)
        some = np.unique(doc)
        self.ids.append(ids.take(pa.array(some)))
        self.lengths.append(n[some])
        self.docs.append(np.searchsorted(some, doc) + self.held)
        self.terms.append(term)
        self.counts.append(count)
        self.held += len(some)
        self.entries += len(key)

    def row(self) -> pa.RecordBatch:
        doc, term, count = (np.concatenate(x).astype(np.int64) for x in (self.docs, self.terms, self.counts))
        order = np.argsort(term, kind="stable")
        distinct, df = np.unique(term, return_counts=True)
        lists = [distinct, df, doc[order], count[order], np.concatenate(self.lengths)]
        one = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))
        columns = [one(pa.concat_arrays(self.ids), pa.int64()), *[one(x, pa.int64()) for x in lists], pa.array([self.n_docs], pa.int64()), pa.array([self.n_terms], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, _LISTS + _SUMS)




def shards(docs: DataFrame, vocabulary: list[str], text: str = "text") -> DataFrame:
    """Inverted lists of the vocabulary's terms, one row for each shard: ids and
    lengths of the documents that have any, the terms with their df, and docs and
    counts term after term; n_docs and n_terms of all documents."""
    told = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, shard = Vocabulary(told.value), _Shard()
        for b in batches:
            offsets, data = text_buffers(b.column(1))
            ids = b.column(0).cast(pa.int64())
            for i, j in steps(offsets, STEP):
                own = data[offsets[i] : offsets[j]]
                starts, ends, first = words(offsets[i : j + 1] - offsets[i], own, APART)
                term, n = known.find(own, starts, ends), np.diff(first)
                found = term >= 0
                shard.add(ids.slice(i, j - i), n, np.repeat(np.arange(j - i), n)[found], term[found], j - i)
                if shard.entries >= SHARD_ENTRIES or shard.held >= SHARD_DOCS:
                    yield shard.row()
                    shard = _Shard()
        if shard.ids:
            yield shard.row()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, _SHARD)


def best(docs: list[np.ndarray], impacts: list[np.ndarray], bounds: np.ndarray, floor: int, k: int, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents (numbers below n_docs) that can be among the k best with floor or
    more, and their whole scores. Lists come with falling bounds."""
    left = np.append(np.cumsum(bounds[::-1])[::-1], 0)  # of list i and those after it
    total, i, look = np.zeros(n_docs, np.int64), 0, 1
    while i < len(docs) and left[i] >= floor:  # essential: a document may qualify by these lists alone
        total[docs[i]] += impacts[i]
        i += 1
        if i == look and n_docs > k:  # partial scores bound the k-th best from below
            floor, look = max(floor, int(np.partition(total, n_docs - k)[n_docs - k])), 2 * look
    some = np.flatnonzero(total + left[i] >= floor)
    some = some[total[some] > 0]
    for j in range(i, len(docs)):  # non-essential: only while a document can qualify
        some = some[total[some] + left[j] >= floor]
        if not len(some):
            break
        place = np.minimum(np.searchsorted(docs[j], some), len(docs[j]) - 1)
        hit = docs[j][place] == some
        total[some[hit]] += impacts[j][place[hit]]
    some = some[total[some] >= floor]
    return some, total[some]


def _top(scores: np.ndarray, ids: np.ndarray, known: np.ndarray, k: int) -> np.ndarray:
    """Places of the k first: by falling score, then by id, unknown ids last."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= least)
        return some[_top(scores[some], ids[some], known[some], k)] if len(some) < len(scores) else np.lexsort((ids, ~known, -scores))[:k]
    return np.lexsort((ids, ~known, -scores))[:k]


def _ranked_shards(index: DataFrame, queries: list[Counter], weights: dict[int, int], n: int, n_terms: int, k: int) -> DataFrame:
    """item, doc_id, score: the k best of each task."""
    told = index.sparkSession.sparkContext.broadcast((queries, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weights = told.value
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
        held = [none] * len(queries)
        for b in batches:
            for row in range(b.num_rows):
                ids, terms, df, docs, counts, lengths = (b.column(c)[row].values for c in range(6))
                known = np.asarray(ids.is_valid())
                ids = ids.fill_null(0).to_numpy()
                if not len(terms):
                    continue
                terms, df, docs, counts, lengths = (x.to_numpy() for x in (terms, df, docs, counts, lengths))
                m = 25 + 75 * lengths * n // n_terms
                first = np.concatenate([[0], np.cumsum(df)])
                weight = np.array([weights[t] for t in terms.tolist()], np.int64)
                impact = np.repeat(weight, df) * (1_000_000_000 * counts // (1000 * counts + 8 * m[docs]))
                most = np.maximum.reduceat(impact, first[:-1])
                place = {t: i for i, t in enumerate(terms.tolist())}
                for q, wanted in enumerate(queries):
                    at = [(place[t], c) for t, c in wanted.items() if t in place]
                    at.sort(key=lambda x: -most[x[0]] * x[1])
                    scores, own, sure = held[q]
                    floor = max(1, int(scores[-1]) if len(scores) == k else 1)
                    lists = [docs[first[p] : first[p + 1]] for p, _ in at]
                    parts = [impact[first[p] : first[p + 1]] * c for p, c in at]
                    some, total = best(lists, parts, np.array([most[p] * c for p, c in at], np.int64), floor, k, len(ids))
                    if len(some):
                        scores, own, sure = np.concatenate([scores, total]), np.concatenate([own, ids[some]]), np.concatenate([sure, known[some]])
                        top = _top(scores, own, sure, k)
                        held[q] = scores[top], own[top], sure[top]
        out = [np.concatenate(x) for x in zip(*held, strict=True)]
        item = np.repeat(np.arange(len(held)), [len(s) for s, _, _ in held])
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(out[1], mask=~out[2]), pa.array(out[0])], ["item", "doc_id", "score"])

    return index.mapInArrow(run, "item int, doc_id long, score long")


def _blocks(items: DataFrame) -> Iterator[list[tuple[object, Counter]]]:
    """Items with terms, in blocks whose distinct terms are bounded; one block is on the driver at a time."""
    block, seen = [], set()
    for r in items.toLocalIterator():
        found = Counter(terms_of(r.text))
        if not found:
            continue
        if block and len(seen | found.keys()) > BLOCK_TERMS:
            yield block
            block, seen = [], set()
        block.append((r.item_id, found))
        seen |= found.keys()
    if block:
        yield block


def search(docs: DataFrame, items: DataFrame, k: int = 10, text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item (item_id,
    text) with a score above 0, equal scores by doc_id.

    A row of docs is a document and a row of items a query, whatever ids they
    share; rows without doc_id come last among equals. A null or empty text has no
    term, and items without terms no result. Empty tables give an empty result;
    other columns aren't looked at.
    """
    spark = docs.sparkSession
    id_type = items.schema["item_id"].dataType
    out = spark.createDataFrame([], T.StructType([T.StructField("item_id", id_type), *T._parse_datatype_string("rank int, doc_id long, score long")]))
    for block in _blocks(items.select("item_id", F.col(text).alias("text"))):
        vocabulary = sorted(set().union(*(c for _, c in block)))
        number = {t: i for i, t in enumerate(vocabulary)}
        index = cut(shards(docs, vocabulary, text), "ranked-shards")
        sums = index.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("l")).first()
        if not sums.n:
            continue
        n, n_terms = int(sums.n), int(sums.l)
        df = index.select(F.explode(F.arrays_zip("terms", "df")).alias("t")).groupBy("t.terms").agg(F.sum("t.df").alias("df")).collect()  # one row for each term of the block
        weights = {r.terms: math.floor(1000 * math.log((2 * n + 2) / (2 * r.df + 1))) for r in df}
        queries = [Counter({number[t]: c for t, c in found.items()}) for _, found in block]
        found = cut(_ranked_shards(index, queries, weights, n, n_terms, k), "ranked")
        forget(index)
        order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
        first = lambda rows, *by: rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
        some = first(found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))), "item", "salt")
        ids = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(block)], T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", id_type)]))
        out = out.union(first(some.drop("rank", "salt"), "item").join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score"))
    return out

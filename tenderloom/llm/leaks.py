"""Benchmark decontamination by template windows.

Text is canonicalised to tokens: runs of letters, digits and other non-ASCII
bytes. A token that begins with a digit is a number, a known unit right after a
number is a unit, a capitalised word inside a sentence is a name; each of these
is its typed placeholder in the template, and its own (lower-case) hash is the
slot's value. Everything else is its lower-case hash. A capitalised word that
opens a sentence may be a name or not: windows over it are made both ways, on
both sides. A text has two forms, which meet only their like: in the first each
word is a token, in the second a run of capitalised words is one name.

Windows of WINDOW template tokens (and of shorter lengths for items that are
shorter) are hashed and joined with those of the benchmark. A window of nothing
but placeholders is no evidence and is left out. For each document and item the
slots of the matching windows must be consistent: one value of the item stands
for one value of the document throughout. Windows whose slots are not take no
part. An item counts as leaked if the windows that match cover at least SHARE
of its windows in one of the forms. An item shorter than a window whose opener
is a slot must keep its values or have LITERALS words besides the slots. Slots that all have the item's own values make it `exact`,
other values `re-parameterised`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderloom.llm.common import _BASE, _UNBASE, ROW_KEY, cut, mix, powers, row_keys, small, span_hashes, steps, text_buffers

WINDOW = 8
SHARE = 0.5
LITERALS = 3
#: Benchmark windows (rows, some 150 bytes each) up to this number are broadcast; more are joined by shuffle.
BROADCAST_WINDOWS = 1 << 18
UNITS = "mm cm m km in ft mi mg g kg t lb oz ml l s ms min h hr hrs hour hours day days week weeks month months year years minute minutes second seconds meter meters metre metres kilometer kilometers gram grams liter liters litre litres percent dollar dollars euro euros cent cents usd eur gbp mph kmh kph".split()

_TOKEN = np.zeros(256, bool)
_TOKEN[[b for b in range(128) if chr(b).isalnum()] + list(range(128, 256))] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?\n\r:;|\"(["]] = True
NUMBER, UNIT, NAME = (np.uint64(x) for x in (0x1111111111111111, 0x2222222222222222, 0x3333333333333333))


def _hash_words(texts: list[str]) -> np.ndarray:
    raw = [t.encode() for t in texts]
    ends = np.cumsum([len(r) for r in raw])
    data = np.frombuffer(b"".join(raw), np.uint8)
    return span_hashes(data, ends - np.array([len(r) for r in raw]), ends, True)


_UNIT_HASHES = np.sort(_hash_words(UNITS))


def tokens(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Template token, slot value (0: no slot) and own value of every token, each
    text's first token (n + 1 entries), whether a token is capitalised and
    whether it begins a sentence."""
    inner = _TOKEN[data]
    # a point or comma between digits belongs to the number
    if len(data) > 2:
        point = ((data[1:-1] == 46) | (data[1:-1] == 44)) & _DIGIT[data[:-2]] & _DIGIT[data[2:]]
        inner[1:-1] |= point
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inner
    before[offsets[:-1]] = False
    starts = np.flatnonzero(inner & ~before[:-1])
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = inner
    after[offsets[1:]] = False
    ends = np.flatnonzero(inner & ~after[1:]) + 1
    first = np.searchsorted(starts, offsets)
    value = span_hashes(data, starts, ends, True)
    template = value.copy()
    slot = np.zeros(len(value), np.uint64)
    if not len(value):
        return template, slot, value, first, np.zeros(0, bool), np.zeros(0, bool)
    number = _DIGIT[data[starts]]
    same_text = np.ones(len(starts), bool)
    same_text[first[:-1][np.diff(first) > 0]] = False
    follows = np.zeros(len(starts), bool)
    follows[1:] = number[:-1] & same_text[1:]
    unit = follows & ~number & np.isin(value, _UNIT_HASHES)
    lead, second = data[starts], data[np.minimum(starts + 1, len(data) - 1)]
    wide_upper = (lead == 0xC3) & (second >= 0x80) & (second <= 0x9E)
    third = data[np.minimum(starts + np.where(wide_upper, 2, 1), len(data) - 1)]
    long_enough = ends - starts > np.where(wide_upper, 2, 1)
    capital = (((lead >= 65) & (lead <= 90)) | wide_upper) & long_enough & (((third >= 97) & (third <= 122)) | (third >= 0xC3))
    stops = np.concatenate([[0], np.cumsum(_STOP[data])])
    previous = np.concatenate([[0], ends[:-1]])
    begins = ~same_text | (stops[starts] > stops[np.minimum(previous, starts)])
    name = capital & ~begins
    for kind, which in ((NUMBER, number), (UNIT, unit), (NAME, name)):
        template[which] = kind
        slot[which] = value[which] | np.uint64(1)
    return template, slot, value, first, capital, begins


def _joined(template: np.ndarray, slot: np.ndarray, value: np.ndarray, first: np.ndarray, capital: np.ndarray, begins: np.ndarray):
    """Template, slots, first tokens and openers where a run of capitalised words
    of a sentence is one name, its opener too."""
    inside = np.zeros(len(value), bool)
    inside[1:] = capital[1:] & capital[:-1] & ~begins[1:]
    kept = np.flatnonzero(~inside)
    count = np.concatenate([[0], np.cumsum(~inside)])
    nth = (np.arange(len(value)) - kept[count[1:] - 1]).astype(np.uint64)
    run = np.add.reduceat(mix(value + nth * np.uint64(_BASE)), kept) if len(kept) else value
    lead = capital[kept]
    return np.where(lead, NAME, template[kept]), np.where(lead, run | np.uint64(1), slot[kept]), count[first], lead & begins[kept]


def _forms(offsets: np.ndarray, data: np.ndarray):
    """Form, template, slots, first tokens and openers that are slots of each way
    to read the texts; and whether only windows with such an opener are wanted."""
    template, slot, value, first, capital, begins = tokens(offsets, data)
    opener = capital & begins
    yield 0, template, slot, first, np.zeros(len(value), bool), False
    yield 0, np.where(opener, NAME, template), np.where(opener, value | np.uint64(1), slot), first, opener, True
    yield 1, *_joined(template, slot, value, first, capital, begins), False


def _windows(template: np.ndarray, slot: np.ndarray, first: np.ndarray, size: int, form: int, opener: np.ndarray, opened_only: bool):
    """Number of the first token and hash of each window within one text that
    has a literal token, and whether an opener in it is a slot."""
    n = len(template) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
    total = np.zeros(len(template) + 1, np.uint64)
    np.cumsum(template * powers(_BASE, len(template)), out=total[1:])
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    literal = np.concatenate([[0], np.cumsum(slot == 0)])
    openers = np.concatenate([[0], np.cumsum(opener)])
    opened = openers[size:] > openers[:n]
    ok = (doc[:n] == doc[size - 1 :]) & (literal[size:] - literal[:n] > 0)
    at = np.flatnonzero(ok & opened if opened_only else ok)
    h = mix((total[at + size] - total[at]) * powers(_UNBASE, n)[at] + np.uint64(size + (form << 32)))
    return at, h, opened[at]


def template_windows(df: DataFrame, key: str, text: str, sizes: list[int], only: np.ndarray | None = None, whole_only: bool = False) -> DataFrame:
    """key, form, pos, hash, size, slots (values of the window's tokens, 0:
    literal), opened (a sentence's opener is one of the slots).

    only: hashes to keep, sorted. whole_only: sizes below the largest are made
    only for texts of exactly that many tokens, as for benchmark items."""
    told = df.sparkSession.sparkContext.broadcast(only) if only is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            offsets, data = text_buffers(b.column(1))
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for i, j in steps(offsets):
                for form, template, slot, first, opener, opened_only in _forms(offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]]):
                    for size in sizes:
                        at, h, opened = _windows(template, slot, first, size, form, opener, opened_only)
                        if told is not None:
                            keep = np.searchsorted(told.value, h)
                            keep = told.value[np.minimum(keep, len(told.value) - 1)] == h if len(told.value) else np.zeros(len(h), bool)
                            at, h, opened = at[keep], h[keep], opened[keep]
                        doc = np.searchsorted(first, at, "right") - 1
                        if whole_only and size < max(sizes):
                            keep = np.diff(first)[doc] == size
                            at, h, opened, doc = at[keep], h[keep], opened[keep], doc[keep]
                        values = slot[at[:, None] + np.arange(size)].view(np.int64)
                        lists = pa.ListArray.from_arrays(pa.array((np.arange(len(at) + 1) * size).astype(np.int32)), pa.array(values.ravel()))
                        whole = lambda x, n=len(at): pa.array(np.full(n, x), pa.int32())
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(ids[i + doc], pa.int64()), whole(form), pa.array(at - first[doc], pa.int32()), pa.array(h.view(np.int64)), whole(size), lists, pa.array(opened)], ["key", "form", "pos", "hash", "size", "slots", "opened"]
                        )

    rows = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "key long, form int, pos int, hash long, size int, slots array<long>, opened boolean")


def _lengths(df: DataFrame, text: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            offsets, data = text_buffers(b.column(0))
            for _, _, _, first, _, opened_only in _forms(offsets, data):
                if not opened_only:
                    yield pa.RecordBatch.from_arrays([pa.array(np.diff(first), pa.int64())], ["n"])

    return df.select(F.col(text).alias("text")).mapInArrow(run, "n long")


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE, text: str = "text") -> DataFrame:
    """doc_id, item_id, n_windows (of the item), n_matched (distinct item windows
    found with consistent slots), coverage, kind ('exact' or 're-parameterised').

    docs (doc_id, text), benchmark (item_id, text). A row with a null id or text
    has no part; an item without a literal token has no windows and never
    leaks; repeated rows with one id count once. The form with the better
    coverage is told. Items shorter than the window
    are one window of their own length. Empty tables give an empty result.
    """
    lengths = [r.n for r in _lengths(benchmark.where(F.col(text).isNotNull()), text).where(F.col("n") < window).distinct().collect()]
    sizes = sorted({int(n) for n in lengths if n > 0} | {window})
    item = template_windows(benchmark, "item_id", text, sizes, whole_only=True)
    item = item.select(F.col("key").alias("item_id"), "form", F.col("pos").alias("item_pos"), "hash", "size", F.col("slots").alias("item_slots"), F.col("opened").alias("item_opened")).distinct()
    item = cut(item, "leak-items")
    few = item.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS  # the rows themselves: many items may share a hash
    only = np.sort(np.array([r.hash for r in item.select("hash").distinct().collect()], np.int64).view(np.uint64)) if few else None
    found = template_windows(docs, "doc_id", text, sizes, only).withColumnRenamed("key", "doc_id").drop("opened")
    pairs = found.join(F.broadcast(item) if few else item, ["hash", "size", "form"])
    both = F.zip_with("item_slots", "slots", lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    pairs = pairs.withColumn("slot", F.array_distinct(F.filter(both, lambda s: s["a"] != 0)))
    same = F.forall("slot", lambda s: s["a"] == s["b"])
    told = F.size(F.filter("item_slots", lambda s: s == 0)) >= LITERALS
    pairs = pairs.where(~F.col("item_opened") | (F.col("size") >= window) | told | same)
    # One occurrence of an item in a document is a diagonal; most keep one, copies have more.
    pairs = pairs.withColumn("diagonal", F.col("pos") - F.col("item_pos")).select("doc_id", "item_id", "form", "diagonal", "item_pos", "slot")
    pairs = cut(pairs, "leak-windows")
    place = ["doc_id", "item_id", "form", "diagonal"]
    values = pairs.select(*place, F.explode("slot").alias("s")).select(*place, "s.a", "s.b").groupBy(*place, "a", "b").count()
    best = values.groupBy(*place, "a").agg(F.max_by("b", F.struct("count", "b")).alias("b"))
    chosen = best.groupBy(*place).agg(F.map_from_entries(F.collect_list(F.struct("a", "b"))).alias("value"))
    agreed = pairs.join(chosen, place, "left").where(F.forall("slot", lambda s: s["b"] == F.col("value")[s["a"]]))
    per_item = cut(item.groupBy("item_id", "form").agg(F.countDistinct("item_pos").alias("n_windows")), "leak-sizes")
    scored = agreed.groupBy("doc_id", "item_id", "form").agg(F.countDistinct("item_pos").alias("n_matched"), F.min(same.cast("int")).alias("same"))
    scored = scored.join(small(per_item), ["item_id", "form"]).withColumn("coverage", F.col("n_matched") / F.col("n_windows"))
    better = F.max(F.struct("coverage", "same", (-F.col("form")).alias("form"), "n_windows", "n_matched")).alias("best")
    best = scored.where(F.col("coverage") >= share).groupBy("doc_id", "item_id").agg(better)
    kind = F.when(F.col("best.same") == 1, "exact").otherwise("re-parameterised")
    return best.select("doc_id", "item_id", "best.n_windows", "best.n_matched", "best.coverage", kind.alias("kind"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without the rows whose text holds an item. Each row is judged by its
    own text, whatever its doc_id: rows without one or with the same one are told
    apart by row_keys. A row with a null or empty text stays."""
    keyed = row_keys(docs)
    hit = cut(leaks(keyed.select(F.col(ROW_KEY).alias("doc_id"), F.col(options.get("text", "text"))), benchmark, **options).select(F.col("doc_id").alias(ROW_KEY)).distinct(), "leaks")
    return keyed.join(small(hit), ROW_KEY, "left_anti").select(docs.columns)

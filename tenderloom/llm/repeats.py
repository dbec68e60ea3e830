"""Removal of repeated passages: prefix-partitioned suffix trees over words.

A window is WINDOW consecutive words of one document; it is repeated if its
word sequence also starts anywhere else. In a suffix tree of all documents the
repeated windows are the paths to nodes of depth WINDOW or more.

The tree is sparse: it holds the suffixes that start at anchors. A window's
anchor is the place in it whose run of ANCHOR words has the smallest hash, so
equal windows have their anchors at the same place, and about one position in
nine is an anchor. (Each suffix by itself would travel with WINDOW words; a
suffix at an anchor travels once for all windows that share it.)

1. The anchors' prefixes (ANCHOR words) are counted over the corpus; a window
   whose prefix stands once cannot be repeated.
2. Suffixes at repeated prefixes are partitioned by prefix: each goes, with its
   words and those before it, to the one group that starts with the same words.
   A group is a subtree: its suffixes are sorted by words, neighbours have their
   common-prefix lengths, and a run of lengths of d or more is a node of depth
   d. With l equal words before the anchor a node of depth WINDOW - l holds
   repeated windows. All of this compares words, not hashes.
3. A prefix with more than GROUP suffixes is lengthened to the whole window. Such
   a group is a single node of which only the size counts; it is told by 128 bits
   and aggregated in the task and before the shuffle. The repeated nodes are
   broadcast to the texts if they are few; else lists of them are joined to the
   suffixes, which Spark splits.
4. The repeated windows of a document are gathered; runs of them are its maximal
   repeats, and the covered words go.

The text is shuffled once, compressed, by document; the plan uses that exchange
again. Documents are told apart by doc_id and 64 bits of the text, so a repeated
doc_id does no harm. Rows that are equal in both are counted first: every window
of theirs is repeated, and one of them stands for all in the trees.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderloom.llm.common import cut, hashed_words, mix, powers, small, steps, text_buffers

WINDOW = 35
ANCHOR = 18
#: Suffixes at one anchor that are compared in one task at most.
GROUP = 2000
#: Repeated windows at hot anchors that are broadcast at most, 16 bytes each.
BROADCAST_ROWS = 1 << 20
#: In place of starts: every window of the text is repeated.
_EVERY = pa.array([-1], pa.int32())
_BASES = (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25)


def _totals(w: np.ndarray, base: int) -> np.ndarray:
    """The running sum of word * base**i."""
    total = np.zeros(len(w) + 1, np.uint64)
    np.cumsum(w * powers(base, len(w)), out=total[1:])
    return total


def _runs(total: np.ndarray, k: int, base: int) -> np.ndarray:
    """Hashes of every run of k words."""
    n = len(total) - 1 - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    return mix((total[k:] - total[:n]) * powers(pow(base, -1, 1 << 64), n))


def _least(h: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """For each i the smallest of h[i : i + span] and its first position."""
    value, place, reach = h, np.arange(len(h)), 1
    while reach < span:
        step = min(reach, span - reach)
        n = len(value) - step
        later = value[step:] < value[:n]
        value, place = np.where(later, value[step:], value[:n]), np.where(later, place[step:], place[:n])
        reach += step
    return value, place


def windows(offsets: np.ndarray, data: np.ndarray, window: int, anchor: int):
    """doc, start and number (in the step) of every window, its anchor's hash and
    place, and the hashes of the step's words."""
    w, first = hashed_words(offsets, data)
    n = len(w) - window + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64), none, w
    value, place = _least(_runs(_totals(w, _BASES[0]), anchor, _BASES[0]), window - anchor + 1)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    ok = np.flatnonzero(doc[:n] == doc[window - 1 :])
    doc = doc[ok]
    return doc, ok - first[doc], ok, value[ok], place[ok], w


def _fingerprints(w: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of the windows that start at `at`, in two halves."""
    one, two = (_runs(_totals(w, base), window, base)[at] if len(at) else np.zeros(0, np.uint64) for base in _BASES)
    return one, two


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x, pa.int64())


def _first_of_runs(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


def _anchors(keyed: DataFrame, window: int, anchor: int) -> DataFrame:
    """m, did, th: each anchor that some window names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            offsets, data = text_buffers(b.column(2))
            did, th = b.column(0).to_numpy(), b.column(1).to_numpy()
            for i, j in steps(offsets):
                doc, _, _, m, place, _ = windows(offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]], window, anchor)
                new = _first_of_runs(place)
                yield pa.RecordBatch.from_arrays([_long(m[new]), _long(did[i + doc[new]]), _long(th[i + doc[new]])], ["m", "did", "th"])

    return keyed.mapInArrow(run, "m long, did long, th long")


def _texts(packed: pa.Array) -> pa.Array:
    """The texts of compressed ones."""
    unpack = zstandard.ZstdDecompressor().decompress
    return pa.array([unpack(x) if x is not None else None for x in packed.to_pylist()], pa.binary())


def _pack(keyed: DataFrame) -> DataFrame:
    """keyed with its texts compressed, for the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            texts = b.column(2).cast(pa.large_string()).cast(pa.large_binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([pack(x) if x is not None else None for x in texts], pa.binary()), b.column(3)], ["did", "th", "packed", "doc_id"])

    return keyed.select("did", "th", "text", F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(run, "did long, th long, packed binary, doc_id long")


def _suffixes(marked: DataFrame, window: int, anchor: int) -> DataFrame:
    """m, did, th, start, lead, n, words for each anchor of a document in its list
    `cold`: the start of its first window, the words of that before the anchor,
    the number of its windows and all their words, joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = _texts(b.column(2))
            offsets, data = text_buffers(texts)
            did, th = b.column(0).to_numpy(), b.column(1).to_numpy()
            for i, j in steps(offsets):
                names = np.unique(b.column(3).slice(i, j - i).flatten().to_numpy()).view(np.uint64)
                doc, start, at, m, place, _ = windows(offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]], window, anchor)
                keep = np.isin(m, names)
                doc, start, at, m, place = doc[keep], start[keep], at[keep], m[keep], place[keep]
                new = _first_of_runs(place)
                n, lead = np.diff(np.append(new, len(doc))), (place - at)[new]
                doc, start = doc[new], start[new]
                segments, last, own = [], -1, []
                for d, a, z in zip(doc.tolist(), start.tolist(), (start + n + window - 1).tolist(), strict=True):
                    if d != last:
                        last, own = d, (texts[i + d].as_py() or b"").split()
                    segments.append(b" ".join(own[a:z]))
                yield pa.RecordBatch.from_arrays([_long(m[new]), _long(did[i + doc]), _long(th[i + doc]), pa.array(start, pa.int32()), pa.array(lead, pa.int32()), pa.array(n, pa.int32()), pa.array(segments, pa.binary())], ["m", "did", "th", "start", "lead", "n", "words"])

    rows = marked.select("did", "th", "packed", "cold").where(F.size("cold") > 0)
    return rows.mapInArrow(run, "m long, did long, th long, start int, lead int, n int, words binary")


def common_prefix(a: list[bytes], b: list[bytes]) -> int:
    """Equal words at the beginning of both."""
    return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def deep_windows(members: list[tuple[int, int, bytes]], window: int) -> list[list[int]]:
    """The subtree of one prefix: for each member (lead, n, words) the numbers of
    its windows that are repeated, as nodes of depth `window` over the suffixes
    at the anchors and the words before them."""
    every = [list(range(n)) for _, n, _ in members]
    places: dict[tuple[int, int, bytes], list[int]] = {}
    for i, member in enumerate(members):
        places.setdefault(member, []).append(i)
    if len(places) == 1:
        return every if len(members) > 1 else [[]]
    kinds = list(places)
    own = [words.split(b" ") for _, _, words in kinds]
    right = [w[lead:] for w, (lead, _, _) in zip(own, kinds, strict=True)]
    order = sorted(range(len(kinds)), key=right.__getitem__)
    depth = [common_prefix(right[a], right[b]) for a, b in zip(order, order[1:], strict=False)]
    found: list[set[int]] = [set() for _ in kinds]
    for before in range(max(lead for lead, _, _ in kinds) + 1):
        node: dict[tuple[bytes, ...], list[int]] = {}
        for k, i in enumerate(order):
            if k and depth[k - 1] < window - before:  # a node of that depth ends
                node = {}
            lead, n, _ = kinds[i]
            if lead - n < before <= lead:
                same = node.setdefault(tuple(own[i][lead - before : lead]), [])
                same.append(i)
                if len(same) > 1:
                    for x in same[-2:] if len(same) == 2 else same[-1:]:
                        found[x].add(kinds[x][0] - before)
    out: list[list[int]] = [[]] * len(members)
    for kind, told in zip(kinds, found, strict=True):
        for i in places[kind]:
            out[i] = every[i] if len(places[kind]) > 1 else sorted(told)
    return out


def _repeated_in_groups(suffixes: DataFrame, window: int) -> DataFrame:
    """did, th, starts of the windows that stand twice in their prefix's subtree."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            yield from zip(*(b.column(c).to_pylist() for c in range(7)), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        did, th, starts = [], [], []

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(did, pa.int64()), pa.array(th, pa.int64()), pa.array(starts, pa.list_(pa.int32()))], ["did", "th", "starts"])

        for _, group in groupby(rows(batches), key=lambda r: r[0]):
            group = list(group)  # GROUP rows at most
            for r, numbers in zip(group, deep_windows([r[4:] for r in group], window), strict=True):
                if numbers:
                    did.append(r[1])
                    th.append(r[2])
                    starts.append([r[3] + k for k in numbers])
            if len(did) > 10_000:
                yield told()
                did, th, starts = [], [], []
        yield told()

    n = int(suffixes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return suffixes.repartition(n, "m").sortWithinPartitions("m").mapInArrow(run, "did long, th long, starts array<int>")


def _hot(marked: DataFrame, window: int, anchor: int, schema: str, tell) -> DataFrame:
    """tell(batch, i, j, doc, start, one, two) of each step of the texts with hot
    anchors, for the windows at those: number of the text, start, fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            offsets, data = text_buffers(_texts(b.column(2)))
            for i, j in steps(offsets):
                names = np.unique(b.column(3).slice(i, j - i).flatten().to_numpy()).view(np.uint64)
                doc, start, at, m, _, w = windows(offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]], window, anchor)
                keep = np.isin(m, names)
                yield tell(b, i, j, doc[keep], start[keep], *_fingerprints(w, at[keep], window))

    return marked.select("did", "th", "packed", "hot").where(F.size("hot") > 0).mapInArrow(run, schema)


def _counted(b: pa.RecordBatch, i: int, j: int, doc: np.ndarray, start: np.ndarray, one: np.ndarray, two: np.ndarray) -> pa.RecordBatch:
    order = np.lexsort((two, one))
    one, two = one[order], two[order]
    new = np.flatnonzero(np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])])) if len(one) else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([_long(one[new]), _long(two[new]), _long(np.diff(np.append(new, len(one))))], ["one", "two", "n"])


def _hot_windows(marked: DataFrame, window: int, anchor: int) -> DataFrame | None:
    """did, th, starts of the repeated windows at hot anchors; None without any."""
    nodes = _hot(marked, window, anchor, "one long, two long, n long", _counted).groupBy("one", "two").agg(F.sum("n").alias("n")).where("n > 1").select("one", "two")
    nodes = cut(nodes, "repeat-nodes")
    n = nodes.limit(BROADCAST_ROWS + 1).count()
    if not n:
        return None
    if n > BROADCAST_ROWS:
        return _joined_windows(marked, nodes, window, anchor)
    found = nodes.toPandas()
    one, two = found["one"].to_numpy().view(np.uint64), found["two"].to_numpy().view(np.uint64)
    order = np.argsort(one, kind="stable")
    told = marked.sparkSession.sparkContext.broadcast((one[order], two[order]))

    def tell(b, i, j, doc, start, one, two) -> pa.RecordBatch:
        first, second = told.value
        left, right = np.searchsorted(first, one, "left"), np.searchsorted(first, one, "right")
        keep = np.zeros(len(one), bool)
        while (open_ := left < right).any():  # nearly always one round
            keep[open_] |= second[left[open_]] == two[open_]
            left = left + 1
        ends = np.searchsorted(doc[keep], np.arange(j - i + 1)).astype(np.int32)
        return pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.ListArray.from_arrays(pa.array(ends), pa.array(start[keep].astype(np.int32)))], ["did", "th", "starts"])

    return _hot(marked, window, anchor, "did long, th long, starts array<int>", tell)


def _joined_windows(marked: DataFrame, nodes: DataFrame, window: int, anchor: int) -> DataFrame:
    """The same by a join with the nodes, one row for each window; a node with
    very many windows is a skewed join, which Spark splits."""

    def tell(b, i, j, doc, start, one, two) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([_long(one), _long(two), b.column(0).take(pa.array(i + doc)), b.column(1).take(pa.array(i + doc)), pa.array(start.astype(np.int32))], ["one", "two", "did", "th", "start"])

    rows = _hot(marked, window, anchor, "one long, two long, did long, th long, start int", tell)
    return rows.join(nodes, ["one", "two"]).select("did", "th", F.array("start").alias("starts"))


def repeated_windows(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """docs keyed (did, th, packed, doc_id) without equal rows; did, th, starts:
    the first words of the repeated windows, at least once each; and the equal
    rows (did, th, text, doc_id), None without any."""
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)).cast("long")).alias("did"), F.xxhash64(text).alias("th"), F.col(text).alias("text"), "doc_id")
    again = cut(keyed.groupBy("did", "th").count().where("count > 1").select("did", "th"), "repeat-rows")
    if again.isEmpty():
        equal, single, one_each = None, keyed, keyed
    else:
        told = small(again)
        equal, single = keyed.join(told, ["did", "th"], "left_semi"), keyed.join(told, ["did", "th"], "left_anti")
        one_each = single.unionByName(equal.dropDuplicates(["did", "th"]))  # combined in each task before the shuffle
    packed = _pack(one_each)
    anchors = _anchors(one_each.select("did", "th", "text"), window, anchor)
    # Written before it is joined back, so that a very common anchor is a skewed join and no group.
    counted = cut(anchors.groupBy("m").count().where("count > 1").select("m", (F.col("count") > GROUP).alias("is_hot")), "repeat-prefixes")
    found = anchors.join(counted, "m").groupBy("did", "th")
    found = cut(found.agg(F.collect_set(F.when(~F.col("is_hot"), F.col("m"))).alias("cold"), F.collect_set(F.when(F.col("is_hot"), F.col("m"))).alias("hot")), "repeat-anchors")
    marked = packed.join(found, ["did", "th"])
    cold = _repeated_in_groups(_suffixes(marked, window, anchor), window)
    hot = _hot_windows(marked, window, anchor)
    return packed if equal is None else _pack(single), cold if hot is None else cold.union(hot), equal


def maximal_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, text: str = "text") -> DataFrame:
    """doc_id, start, n_words: the passages of each document of which every window
    is repeated and that no neighbouring word prolongs. Rows as in drop_repeats;
    a document without any has no row."""
    packed, found, equal = repeated_windows(docs, window, anchor, text)
    gathered = found.groupBy("did", "th").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("starts")))).alias("starts"))
    runs = F.aggregate(
        "starts",
        F.array().cast("array<struct<start:int,last:int>>"),
        lambda a, s: F.when((F.size(a) > 0) & (F.element_at(a, -1)["last"] + 1 == s), F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(F.element_at(a, -1)["start"].alias("start"), s.alias("last"))))).otherwise(F.concat(a, F.array(F.struct(s.alias("start"), s.alias("last"))))),
    )
    rows = packed.select("did", "th", "doc_id").join(gathered.where(F.size("starts") > 0).select("did", "th", runs.alias("runs")), ["did", "th"])
    out = rows.select("doc_id", F.explode("runs").alias("r")).select("doc_id", F.col("r.start").cast("long").alias("start"), (F.col("r.last") - F.col("r.start") + window).cast("long").alias("n_words"))
    if equal is None:
        return out
    whole = equal.select("doc_id", F.size(F.filter(F.split("text", "[ \\t-\\r]+"), lambda w: w != "")).cast("long").alias("n_words"))
    return out.unionByName(whole.where(F.col("n_words") >= window).select("doc_id", F.lit(0).cast("long").alias("start"), "n_words"))


def drop_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept (the remaining words joined by one
    space) and kept_sha256 for every row of docs.

    All copies go, the first too; windows are judged on the input. A null or
    empty text has no words and the kept text ''. A row without doc_id counts
    like any other. Repeated rows are each other's copies. Other columns are not
    looked at; an empty table gives an empty result.
    """
    packed, found, equal = repeated_windows(docs, window, anchor, text)
    gathered = found.groupBy("did", "th").agg(F.flatten(F.collect_list("starts")).alias("starts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total, removed, kept = [], [], []
            for raw, starts in zip(_texts(b.column(1)).to_pylist(), b.column(2), strict=True):
                own = (raw or b"").split()
                total.append(len(own))
                if starts.is_valid and starts.values.equals(_EVERY):
                    own = own if len(own) < window else []
                elif starts.is_valid:
                    edge = np.zeros(len(own) + 1, np.int64)
                    at = np.unique(starts.values.to_numpy())
                    edge[at] += 1
                    edge[at + window] -= 1
                    own = [own[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
                removed.append(total[-1] - len(own))
                kept.append(b" ".join(own))
            sha = [hashlib.sha256(x).hexdigest() for x in kept]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(sha, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept", "kept_sha256"],
            )

    rows = packed.join(gathered, ["did", "th"], "left").select("doc_id", "packed", "starts")
    if equal is not None:
        rows = rows.union(_pack(equal).select("doc_id", "packed", F.array(F.lit(-1))))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string")

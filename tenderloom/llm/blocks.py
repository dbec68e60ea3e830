"""Token ids in patched frame-of-reference blocks.

A block holds BLOCK ids. Its minimum is subtracted; the width that covers the
chosen percentile of the differences is the block's width in bits; every
difference is packed at that width, and the few that need more bits have their
high bits in an exception list (position in block, high part). A chunk is a run of whole
documents: a header, the start of each document in ids, the start of each block
in bytes, then the blocks. One chunk is one row of a Parquet data set, which is
the container that any shared store holds; rows are in ascending doc_id order.

Chunk: magic "PFB1", then uint32 documents, ids, blocks; uint32 document starts
(documents + 1); uint32 block starts (blocks + 1); blocks. Block: uint32
minimum, uint8 width, uint16 exceptions (then their uint16 positions and uint32
high parts), then the packed low parts. All little endian.
"""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tenderloom.llm.common import shared_dir, steps, text_buffers, words
from tenderloom.llm.fragments import Store, ranges

BLOCK = 256
PERCENTILE = 90
#: Ids that a chunk holds at least, unless the partition ends; documents are never split.
CHUNK_IDS = 1 << 16
MAGIC = b"PFB1"


def _bits(x: np.ndarray) -> np.ndarray:
    """Bits that each value needs; 0 needs none."""
    return np.frexp(x.astype(np.float64))[1]


def _pack(low: np.ndarray, width: int) -> np.ndarray:
    """Rows of values below 2**width as rows of bytes, the lowest bit first."""
    bits = np.empty((*low.shape, width), np.uint8)
    for k in range(width):
        bits[:, :, k] = (low >> np.uint32(k)) & np.uint32(1)
    return np.packbits(bits.reshape(len(low), -1), axis=1, bitorder="little")


def _unpack(raw: np.ndarray, width: int, n: int) -> np.ndarray:
    bits = np.unpackbits(raw, axis=1, count=n * width, bitorder="little").reshape(len(raw), n, width)
    out = np.zeros((len(raw), n), np.uint32)
    for k in range(width):
        out |= bits[:, :, k].astype(np.uint32) << np.uint32(k)
    return out


def pack_blocks(ids: np.ndarray, block: int = BLOCK, percentile: int = PERCENTILE) -> list[bytes]:
    """Blocks of uint32 ids; the last may be shorter. Whole blocks of one width
    are packed together."""
    out: list[bytes] = []
    whole = len(ids) // block * block
    for part in (ids[:whole].reshape(-1, block), ids[whole:].reshape(1, -1)):
        if not part.size:
            continue
        base = part.min(axis=1)
        rest = part - base[:, None]
        need = _bits(rest)
        at = max(0, -(-part.shape[1] * percentile // 100) - 1)
        width = np.partition(need, at, axis=1)[:, at]
        found: list[bytes] = [b""] * len(part)
        for w in np.unique(width):
            rows = np.flatnonzero(width == w)
            packed = _pack(rest[rows] & np.uint32((1 << int(w)) - 1), int(w))
            many = (need[rows] > w).any(axis=1)
            for k, r in enumerate(rows):
                over = np.flatnonzero(need[r] > w) if many[k] else np.zeros(0, np.int64)
                found[r] = struct.pack("<IBH", base[r], w, len(over)) + over.astype("<u2").tobytes() + (rest[r, over] >> np.uint32(w)).astype("<u4").tobytes() + packed[k].tobytes()
        out += found
    return out


def unpack_block(raw: bytes, n: int) -> np.ndarray:
    base, width, over = struct.unpack_from("<IBH", raw)
    low = _unpack(np.frombuffer(raw, np.uint8, offset=7 + 6 * over)[None], width, n)[0]
    if over:
        at = np.frombuffer(raw, "<u2", over, 7)
        low[at] |= np.frombuffer(raw, "<u4", over, 7 + 2 * over) << np.uint32(width)
    return low + np.uint32(base)


def pack_chunk(lists: list[np.ndarray]) -> bytes:
    """A chunk of the documents' id arrays."""
    ids = np.concatenate(lists).astype(np.uint32) if lists else np.zeros(0, np.uint32)
    blocks = pack_blocks(ids)
    starts = np.cumsum([0, *map(len, lists)]).astype("<u4").tobytes()
    places = np.cumsum([0, *map(len, blocks)]).astype("<u4").tobytes()
    return MAGIC + struct.pack("<III", len(lists), len(ids), len(blocks)) + starts + places + b"".join(blocks)


class Chunk:
    """Reads a chunk; a document takes only the blocks that hold its ids."""

    def __init__(self, raw: bytes):
        if raw[:4] != MAGIC:
            raise ValueError("not a chunk of token blocks")
        self.docs, self.ids, n = struct.unpack_from("<III", raw, 4)
        self.starts = np.frombuffer(raw, "<u4", self.docs + 1, 16).astype(np.int64)
        self.places = np.frombuffer(raw, "<u4", n + 1, 20 + 4 * self.docs).astype(np.int64)
        self.raw, self.at = raw, 24 + 4 * self.docs + 4 * n

    def block(self, k: int) -> np.ndarray:
        return unpack_block(self.raw[self.at + self.places[k] : self.at + self.places[k + 1]], min(BLOCK, self.ids - k * BLOCK))

    def whole(self) -> np.ndarray:
        """All ids; blocks of one width without exceptions to apply are unpacked together."""
        n = len(self.places) - 1
        out = np.zeros(n * BLOCK, np.uint32).reshape(n, BLOCK)
        heads = [struct.unpack_from("<IBH", self.raw, self.at + p) for p in self.places[:-1].tolist()]
        by: dict[int, list[int]] = {}
        for k, (_, width, _) in enumerate(heads[: n - 1]):
            by.setdefault(width, []).append(k)
        for width, ks in by.items():
            size = BLOCK * width // 8
            body = b"".join(self.raw[(a := self.at + int(self.places[k]) + 7 + 6 * heads[k][2]) : a + size] for k in ks)
            out[ks] = _unpack(np.frombuffer(body, np.uint8).reshape(len(ks), size), width, BLOCK)
        for k, (base, width, over) in enumerate(heads[: n - 1]):
            if over:
                a = self.at + int(self.places[k]) + 7
                out[k, np.frombuffer(self.raw, "<u2", over, a)] |= np.frombuffer(self.raw, "<u4", over, a + 2 * over) << np.uint32(width)
            out[k] += np.uint32(base)
        if n:
            last = self.block(n - 1)
            out[n - 1, : len(last)] = last
        return out.reshape(-1)[: self.ids]

    def document(self, i: int) -> np.ndarray:
        a, b = self.starts[i], self.starts[i + 1]
        if a == b:
            return np.zeros(0, np.uint32)
        first = a // BLOCK
        got = np.concatenate([self.block(k) for k in range(first, (b - 1) // BLOCK + 1)])
        return got[a - first * BLOCK : b - first * BLOCK]


CHUNK_SCHEMA = "shard int, chunk int, before long, doc_ids array<long>, n_ids long, body binary"


def write(docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None, text: str = "text") -> str:
    """Encodes the texts, writes the ids as chunks in ascending doc_id order and
    returns the folder.

    A range shuffle by doc_id makes the shards (a hash of the text splits repeated
    keys, a row number equal rows, and only such numbers are sampled for the
    ranges); each task sorts,
    encodes and packs its own, so the ids are made once and move nowhere. A null
    doc_id comes first; rows of one doc_id are in order of that hash. An empty
    table makes no chunk.
    """
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, names, lists, held, n, before = TaskContext.get().partitionId(), [], [], 0, 0, 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([n], pa.int32()), pa.array([before], pa.int64()), pa.array([names], pa.list_(pa.int64())), pa.array([held], pa.int64()), pa.array([pack_chunk(lists)], pa.binary())], ["shard", "chunk", "before", "doc_ids", "n_ids", "body"])

        for b in batches:
            offsets, data = text_buffers(b.column(1))
            names_of = b.column(0).to_pylist()
            for i, j in steps(offsets):
                got, first = _words(tokenizer).encode(offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]])
                edges = first.tolist()
                for k in range(i, j):
                    names.append(names_of[k])
                    lists.append(np.append(got[edges[k - i] : edges[k - i + 1]].astype(np.uint32), np.uint32(end_id)))
                    held += len(lists[-1])
                    if held >= CHUNK_IDS:
                        yield row()
                        names, lists, held, n, before = [], [], 0, n + 1, before + held
        if names:
            yield row()

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("row"))
    ordered = keyed.repartitionByRange(parts, "doc_id", "h", "row").sortWithinPartitions("doc_id", "h", "text").drop("h", "row")
    ordered.mapInArrow(run, CHUNK_SCHEMA).write.parquet(path)
    return path


def read(spark, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (binary)
    of every document, from the chunks.

    A chunk knows the ids before it in its shard; one total for each shard (as
    many as the range shuffle has partitions) goes to a window and is broadcast.
    """
    chunks = spark.read.schema(T._parse_datatype_string(CHUNK_SCHEMA)).parquet(path)
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = chunks.groupBy("shard").agg(F.sum("n_ids").alias("n")).select("shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("earlier"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for base, names, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                c = Chunk(body.as_py())
                raw = c.whole().astype("<u4").tobytes()
                ends = (c.starts * 4).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.int64()), pa.array(c.starts[:-1] + base, pa.int64()), pa.array(np.diff(c.starts), pa.int64()), pa.BinaryArray.from_buffers(pa.binary(), c.docs, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(raw)])],
                    ["doc_id", "start", "n_tokens", "ids"],
                )

    placed = chunks.join(F.broadcast(shards), "shard").select((F.col("before") + F.col("earlier")).alias("base"), "doc_ids", "body")
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


class Words(Store):
    """Fragments for a vocabulary that drops white space and lower-cases: no
    piece crosses white space, or goes from an ASCII letter to ASCII punctuation
    or back (an apostrophe may begin a piece with letters). Fragments of ASCII
    letters are lower-cased before they are looked up."""

    def __init__(self, path: str):
        super().__init__(path)
        kind = np.zeros(256, np.uint8)
        kind[[b for b in range(33, 127) if not chr(b).isalnum()]] = 1
        kind[[b for b in range(128) if chr(b).isalpha()]] = 2
        piece = np.zeros((256, 256), bool)
        piece[np.ix_(kind == 2, kind == 1)] = True
        piece[np.ix_((kind == 1) & (np.arange(256) != 39), kind == 2)] = True
        self.piece = piece.ravel()
        self.low = np.arange(256, dtype=np.uint8)
        self.low[65:91] += 32
        self.one = re.compile(rb"[a-z]+")
        del self.told

    def encode(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of texts, one after another, and each text's first (n + 1)."""
        starts, ends, first = words(offsets, data)
        raw = data.tobytes()
        if not any(s.encode() in raw for s in self.added):
            pair = data[:-1].astype(np.uint16)
            pair <<= 8
            pair |= data[1:]
            at = np.flatnonzero(self.piece[pair]) + 1
            k = np.searchsorted(starts, at, "right") - 1
            at = at[(k >= 0) & (at > starts[k]) & (at < ends[k])] if len(starts) else at[:0]
            starts, ends = np.sort(np.concatenate([starts, at])), np.sort(np.concatenate([ends, at]))
            first = np.searchsorted(starts, offsets)
        wide = np.concatenate([[0], np.cumsum(data >= 128)])
        plain = wide[starts] == wide[ends]
        low = self.low[data]
        back = ranges(starts[~plain], (ends - starts)[~plain])
        low[back] = data[back]
        ids, n = self.gather(self.lookup(low, starts, ends))
        return ids, np.concatenate([[0], np.cumsum(n)])[first]


def _words(path: str, kept: dict = {}) -> Words:  # noqa: B006
    """One for each worker and file."""
    if path not in kept:
        kept[path] = Words(path)
    return kept[path]

"""Shared pieces of the corpus operators: written cut points, text access in
Arrow batches and vectorised word hashing.

Words are runs of bytes other than space and \\t-\\r in the UTF-8 text; all of
those delimiters are ASCII, so working on bytes is the same as on characters.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step takes; a longer text is a step of its own.
STEP_BYTES = 1 << 18


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set, a session
    in one process takes a temporary one; a cluster has to name it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tenderloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back, which ends
    its lineage: a lost executor costs no recomputation of what came before."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def forget(df: DataFrame) -> None:
    """Deletes the folder of a table that `cut` wrote and nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.cut_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of a few numbers each (some 16 MB) that are broadcast at most.
BROADCAST_ROWS = 1 << 20


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df (a written table of numbers), marked for broadcast if it has at most
    `most` rows; beyond that, joins with it shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


ROW_KEY = "row key"
#: Keys of rows that doc_id doesn't tell apart begin here; doc_ids are below.
MADE_KEYS = 1 << 62


def row_keys(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with ROW_KEY: doc_id where no other row has it, else (a null or
    repeated doc_id) MADE_KEYS and 62 bits of a hash of doc_id and text, the same
    for equal rows."""
    ids = docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").cast("long").alias(f"{ROW_KEY} id"))
    shared = small(cut(ids, "repeated-ids").withColumn(f"{ROW_KEY} again", F.lit(True)))
    both = docs.join(shared, F.col("doc_id").cast("long") == F.col(f"{ROW_KEY} id"), "left")
    made = F.xxhash64("doc_id", text).bitwiseAND(MADE_KEYS - 1).bitwiseOR(MADE_KEYS)
    key = F.when(F.col("doc_id").isNotNull() & F.col(f"{ROW_KEY} again").isNull(), F.col("doc_id").cast("long")).otherwise(made)
    return both.withColumn(ROW_KEY, key).select(*docs.columns, ROW_KEY)


def residue(column: str, modulus: int):
    """crc32 of the decimal text of a column, modulo."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1) and bytes of a string column; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if len(offsets) == 0:
        return np.zeros(1, np.int64), whole[:0]
    return offsets - offsets[0], whole[offsets[0] : offsets[-1]]


def give_back() -> None:
    """Returns what a batch took to the system: Python workers live on, and what
    they keep counts against the executor in every later stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim is not None:
        trim(0)


def steps(offsets: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [i, j) of at most limit bytes each, or one row if it is longer."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j
    give_back()


_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]
_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def powers(base: int, n: int, kept: dict = {}) -> np.ndarray:  # noqa: B006
    """base**0 .. base**(n-1) modulo 2**64; the longest table so far is kept."""
    if base not in kept or len(kept[base]) < n:
        out = np.ones(max(n, 1), np.uint64)
        out[1:] = base
        table = np.multiply.accumulate(out)
        if n > 4 * STEP_BYTES:  # for one giant text only
            return table
        kept[base] = table
    return kept[base][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """A 64-bit hash of each byte range: a polynomial over random byte values."""
    n = len(data)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[data] * powers(_BASE, n), out=total[1:])
    return mix((total[ends] - total[starts]) * powers(_UNBASE, n + 1)[starts] + (ends - starts).astype(np.uint64))


def words(offsets: np.ndarray, data: np.ndarray, apart: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in data, and for each text the first word's
    number (n + 1 entries). offsets begin at 0; apart: which bytes are in no word."""
    inner = ~apart[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inner
    before[offsets[:-1]] = False  # a text begins here
    starts = np.flatnonzero(inner & ~before[:-1])
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = inner
    after[offsets[1:]] = False
    ends = np.flatnonzero(inner & ~after[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashed_words(offsets: np.ndarray, data: np.ndarray, lower: bool = False):
    """Word hashes and, for each text, its first word's number."""
    starts, ends, first = words(offsets, data)
    return span_hashes(data, starts, ends, lower), first


def shingle_hashes(w: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of k words within each text; a text of 1 to k - 1
    words has its whole sequence as the only one. Also each text's first number."""
    n = np.diff(first)
    h = np.zeros(max(len(w) - k + 1, 0), np.uint64)
    for j in range(k):
        h = h * np.uint64(_BASE) + w[j : len(w) - k + 1 + j] if len(h) else h
    h = mix(h)
    doc = np.repeat(np.arange(len(n)), n)
    ok = np.zeros(len(w), bool)
    if len(h):
        ok[: len(h)] = doc[: len(h)] == doc[k - 1 :]
    out, lead = np.zeros(len(w), np.uint64), ok.copy()
    out[: len(h)] = h
    for i in np.flatnonzero((n > 0) & (n < k)):
        one = np.uint64(n[i])
        with np.errstate(over="ignore"):
            for x in w[first[i] : first[i + 1]]:
                one = one * np.uint64(_UNBASE) + x
        out[first[i]] = mix(np.array([one]))[0]
        lead[first[i]] = True
    return out[lead], np.concatenate([[0], np.cumsum(np.bincount(doc[lead], minlength=len(n)))]).astype(np.int64)


def reduceat(op, values: np.ndarray, first: np.ndarray, empty) -> np.ndarray:
    """op over each range of values; `empty` for an empty range."""
    n = np.diff(first)
    out = np.full(len(n), empty, values.dtype)
    if (n > 0).any():
        out[n > 0] = op.reduceat(values, first[:-1][n > 0])
    return out

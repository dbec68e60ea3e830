"""BPE encoding and decoding by forced boundaries.

A byte pair that occurs inside no vocabulary token is never merged, so a cut
between its two bytes is certain. The texts are cut at such pairs, the
fragments are encoded independently of each other, each distinct one once, and
the ids are concatenated.

A cut must also leave the tokenizer's first split of the text as it is. The
pattern of byte-level vocabularies looks ahead only over white space and never
back, so these pairs are cuts, where no vocabulary token holds them:

* a byte other than white space, then ASCII white space: one piece ends there;
* an ASCII letter, then an ASCII letter: both lie inside one run of letters.

After white space beyond ASCII nothing is cut. The strings of added tokens are
cut out first, as the library does. The pairs come from the vocabulary file.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenderloom.llm.common import steps, text_buffers
from tenderloom.llm.fragments import WHITE, Store, after_wide_space, byte_letters, ranges


class Forced(Store):
    """Fragments between forced boundaries of a byte-level vocabulary."""

    def __init__(self, path: str):
        super().__init__(path)
        byte_of = {c: b for b, c in byte_letters().items()}
        vocab = {bytes(byte_of[c] for c in t): i for t, i in self.told["model"]["vocab"].items()}
        inside = np.zeros((256, 256), bool)
        for t in vocab:
            inside[list(t[:-1]), list(t[1:])] = True
        white, letter = np.isin(np.arange(256), WHITE), np.array([b < 128 and chr(b).isalpha() for b in range(256)])
        safe = (~white[:, None] & white[None]) | (letter[:, None] & letter[None])
        self.forced = (safe & ~inside).ravel()
        self.white = white
        self.bytes_of = {i: t for t, i in vocab.items()} | {i: t.encode() for t, i in self.added.items()}
        size = max(self.bytes_of) + 1
        self.raw_n = np.array([len(self.bytes_of.get(i, b"")) for i in range(size)])
        self.raw_start = np.cumsum(self.raw_n) - self.raw_n
        self.raw = np.frombuffer(b"".join(self.bytes_of.get(i, b"") for i in range(size)), np.uint8)
        told = [b"%d," % i for i in range(size)]
        self.told_n = np.array([len(x) for x in told])
        self.told_start = np.cumsum(self.told_n) - self.told_n
        self.told_raw = np.frombuffer(b"".join(told), np.uint8)
        del self.told

    def cuts(self, data: np.ndarray) -> np.ndarray:
        """Positions of the certain cuts, in order."""
        pair = data[:-1].astype(np.uint16)
        pair <<= 8
        pair |= data[1:]
        at = np.flatnonzero(self.forced[pair]) + 1
        return at[~(self.white[data[at]] & after_wide_space(data, at))]

    def encode(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of texts, one after another, and each text's first (n + 1)."""
        bounds = [offsets[:-1], offsets[1:], self.cuts(data)]
        own: list[tuple[int, int, int]] = []
        if self.special is not None:
            raw = data.tobytes()
            if any(s.encode() in raw for s in self.added):
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    own += [(m.start(), m.end(), self.added[m[0].decode()]) for m in self.special.finditer(raw, a, b)]
        if own:
            bounds += [np.array([x[0] for x in own]), np.array([x[1] for x in own])]
            inner = bounds[2]
            k = np.searchsorted(bounds[3], inner, "right") - 1
            bounds[2] = inner[(k < 0) | (inner >= bounds[4][k])]
        edges = np.sort(np.concatenate([*bounds, [0, len(data)]]))
        edges = edges[np.concatenate([[True], np.diff(edges) != 0])]
        starts, ends = edges[:-1], edges[1:]
        lead = np.searchsorted(starts, offsets)
        if not own:
            ids, n = self.gather(self.lookup(data, starts, ends))
        else:
            special = np.full(len(starts), -1)
            special[np.searchsorted(starts, bounds[3])] = [x[2] for x in own]
            plain = special < 0
            got, m = self.gather(self.lookup(data, starts[plain], ends[plain]))
            n = np.ones(len(starts), np.int64)
            n[plain] = m
            mine = np.repeat(plain, n)
            ids = np.empty(len(mine), np.int32)
            ids[mine], ids[~mine] = got, special[~plain]
        return ids, np.concatenate([[0], np.cumsum(n)])[lead]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of ids, one after another, and how many each has."""
        n = self.raw_n[ids]
        return self.raw[ranges(self.raw_start[ids], n)], n

    def commas(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids in decimal, each followed by a comma, and their lengths."""
        n = self.told_n[ids]
        return self.told_raw[ranges(self.told_start[ids], n)], n


def _forced(path: str, kept: dict = {}) -> Forced:  # noqa: B006
    """One for each worker and file."""
    if path not in kept:
        kept[path] = Forced(path)
    return kept[path]


def _texts(raw: np.ndarray, n: np.ndarray, first: np.ndarray) -> list[bytes]:
    """The bytes of each text from those of its ids."""
    edges = np.concatenate([[0], np.cumsum(n)])[first].tolist()
    whole = raw.tobytes()
    return [whole[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with `ids` (array<int>) in place of `text`, encoded with the
    byte-level vocabulary file in `path`, which every worker reads.

    A null or empty text has no ids. Other columns are carried along; one that
    is named like `ids` is replaced. Repeated rows stay repeated.
    """
    keep = [c for c in docs.columns if c not in (text, ids)]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(ids, T.ArrayType(T.IntegerType(), True))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            offsets, data = text_buffers(b.column(len(keep)))
            for i, j in steps(offsets):
                got, first = _forced(path).encode(offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]])
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(got))
                yield pa.RecordBatch.from_arrays([*b.slice(i, j - i).columns[: len(keep)], lists], schema.names)

    return docs.select(*keep, F.col(text)).mapInArrow(run, schema)


def decode(rows: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """rows with the column `decoded`, the text of `ids`; null ids give null.
    Bytes that are no UTF-8 become U+FFFD, as the library's decoder does."""
    keep = [c for c in rows.columns if c != decoded]
    schema = T.StructType([rows.schema[c] for c in keep] + [T.StructField(decoded, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(keep.index(ids))
            first = np.concatenate([[0], np.cumsum([len(x) if x is not None else 0 for x in lists.to_pylist()])])
            out = _texts(*_forced(path).decode(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)), first)
            got = [t.decode("utf-8", "replace") if v else None for t, v in zip(out, lists.is_valid().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.string())], schema.names)

    return rows.select(*keep).mapInArrow(run, schema)


def digest(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """doc_id, n_tokens, and the sha256 of the comma-joined ids and of the text
    decoded from the ids. The encoding is that of `encode`; the digests are
    taken in the task, so that no id list goes to the JVM only to be hashed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = hashlib.sha256
        for b in batches:
            offsets, data = text_buffers(b.column(1))
            for i, j in steps(offsets):
                store = _forced(path)
                ids, first = store.encode(offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]])
                told = _texts(*store.commas(ids), first)
                back = _texts(*store.decode(ids), first)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(i, j - i),
                        pa.array(np.diff(first), pa.int64()),
                        pa.array([sha(x[:-1]).hexdigest() for x in told], pa.string()),
                        pa.array([sha(x.decode("utf-8", "replace").encode()).hexdigest() for x in back], pa.string()),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    schema = T.StructType([docs.schema["doc_id"], *T._parse_datatype_string("n_tokens long, ids_sha256 string, decoded_sha256 string")])
    return docs.select("doc_id", text).mapInArrow(run, schema)

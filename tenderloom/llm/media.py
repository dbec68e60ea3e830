"""Media columns: PNG images in binary columns, and their features.

`encode` stores the UTF-8 bytes of each text as the samples of an 8-bit RGB
image, 64 pixels wide; the bytes are filled up with spaces to a positive
multiple of 192, one image row. `read` takes any 8-bit, non-interlaced PNG of
grey, grey-alpha, RGB or RGBA samples, tests the checksum of every chunk (zlib
tests its own), undoes the row filters with numpy and computes a 64-bit hash of
the lowest cosine frequencies of the brightness.

Defined results: a null or empty text is an image of one row of spaces; equal
texts give equal media; other columns are carried along by `encode` as they
are; a null medium has null features; a damaged medium raises an error that
names the chunk. Repeated rows stay repeated; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROW = 192
SIGNATURE = b"\x89PNG\r\n\x1a\n"
_CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def write_png(samples: np.ndarray, channels: int = 3, level: int = 6) -> bytes:
    """samples: uint8 rows of width * channels. Each row takes the filter of
    none, left and up with the smallest sum of absolute differences."""
    height, stride = samples.shape
    left, up = samples.copy(), samples.copy()
    left[:, channels:] -= samples[:, :-channels]
    up[1:] -= samples[:-1]
    every = np.stack([samples, left, up])
    cost = np.abs(every.view(np.int8).astype(np.int16)).sum(axis=2)
    choice = cost.argmin(axis=0)
    rows = np.empty((height, stride + 1), np.uint8)
    rows[:, 0] = choice
    rows[:, 1:] = every[choice, np.arange(height)]
    kind = {v: k for k, v in _CHANNELS.items()}[channels]
    head = struct.pack(">IIBBBBB", stride // channels, height, 8, kind, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def _slow_rows(kind: int, row: np.ndarray, above: np.ndarray, bpp: int) -> np.ndarray:
    """The average (3) and Paeth (4) filters, which need the pixel to the left."""
    out, zero = row.astype(np.int64).reshape(-1, bpp), np.zeros(bpp, np.int64)
    over = above.astype(np.int64).reshape(-1, bpp)
    a, c = zero, zero
    for x in range(len(out)):
        b = over[x]
        if kind == 3:
            guess = (a + b) // 2
        else:
            p = a + b - c
            da, db, dc = abs(p - a), abs(p - b), abs(p - c)
            guess = np.where((da <= db) & (da <= dc), a, np.where(db <= dc, b, c))
        out[x] = a = (out[x] + guess) & 255
        c = b
    return out.reshape(-1).astype(np.uint8)


def unfilter(kinds: np.ndarray, rows: np.ndarray, bpp: int) -> np.ndarray:
    """The samples of filtered rows. Runs of rows of one filter are undone at once."""
    out = np.empty_like(rows)
    height, stride = rows.shape
    edges = np.flatnonzero(np.diff(kinds)) + 1
    for i, j in zip([0, *edges], [*edges, height], strict=True):
        above = out[i - 1] if i else np.zeros(stride, np.uint8)
        if kinds[i] == 0:
            out[i:j] = rows[i:j]
        elif kinds[i] == 1:
            np.cumsum(rows[i:j].reshape(j - i, -1, bpp), axis=1, dtype=np.uint8, out=out[i:j].reshape(j - i, -1, bpp))
        elif kinds[i] == 2:
            np.cumsum(rows[i:j], axis=0, dtype=np.uint8, out=out[i:j])
            out[i:j] += above
        elif kinds[i] in (3, 4):
            for k in range(i, j):
                out[k] = _slow_rows(int(kinds[k]), rows[k], out[k - 1] if k else above, bpp)
        else:
            raise ValueError(f"PNG: unknown row filter {kinds[i]}")
    return out


def read_png(media: bytes) -> tuple[np.ndarray, int]:
    """Samples as height x (width * channels), and the channels. Every chunk's
    checksum is tested."""
    if media[:8] != SIGNATURE:
        raise ValueError("PNG: no signature")
    at, head, packed, ended = 8, None, [], False
    while at < len(media) and not ended:
        (n,), kind = struct.unpack_from(">I", media, at), media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + n]
        if len(media) < at + 12 + n or zlib.crc32(kind + body) != struct.unpack_from(">I", media, at + 8 + n)[0]:
            raise ValueError(f"PNG: chunk {kind!r} is damaged")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        ended = kind == b"IEND"
        at += 12 + n
    if head is None or not ended:
        raise ValueError("PNG: no IHDR or no IEND")
    width, height, depth, colour, method, filtering, interlace = head
    if depth != 8 or colour not in _CHANNELS or method or filtering or interlace:
        raise ValueError("PNG: only 8-bit samples without palette or interlacing are read")
    bpp = _CHANNELS[colour]
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    if len(raw) != height * (width * bpp + 1):
        raise ValueError("PNG: IDAT has another size than IHDR says")
    raw = raw.reshape(height, width * bpp + 1)
    return unfilter(raw[:, 0], raw[:, 1:], bpp), bpp


def _cosines(n: int) -> np.ndarray:
    k = np.arange(n)
    return np.cos(np.pi * k[:, None] * (2 * k[None] + 1) / (2 * n)).astype(np.float32)


_COSINES = _cosines(32)[:8]


def _to_32(x: np.ndarray) -> np.ndarray:
    """Means over 32 even shares of the first axis; fewer than 32 lines are repeated."""
    n = len(x)
    if n < 32:
        return x[np.arange(32) * n // 32]
    edges = np.arange(33) * n // 32
    return np.add.reduceat(x, edges[:-1], axis=0) / np.diff(edges)[:, None]


def cosine_hash(samples: np.ndarray, channels: int) -> str:
    """64 bits as hex: brightness averaged to 32 x 32, and which of the 8 x 8
    lowest cosine coefficients are above their median."""
    grey = samples.reshape(len(samples), -1, channels)[:, :, : 3 if channels > 2 else 1].mean(axis=2, dtype=np.float32)
    small = _to_32(_to_32(grey).T.copy()).T
    low = np.round(_COSINES @ small @ _COSINES.T, 2)
    bits = low.ravel() > np.median(low.ravel()[1:])
    return np.packbits(bits).tobytes().hex()


def encode(docs: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """docs with the column `media` in place of `text`: its PNG."""
    keep = [c for c in docs.columns if c not in (text, media)]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(media, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x in b.column(len(keep)).to_pylist():
                raw = (x or "").encode()
                raw += b" " * (-len(raw) % ROW or (0 if raw else ROW))
                out.append(write_png(np.frombuffer(raw, np.uint8).reshape(-1, ROW)))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(out, pa.binary())], [*keep, media])

    return docs.select(*keep, F.col(text)).mapInArrow(run, schema)


FEATURES = "n_samples long, sample_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def read(df: DataFrame, media: str = "media") -> DataFrame:
    """df with the features of its medium in place of `media`: the number of
    sample bytes, their sha256, the crc32 of their last 16, the medium's own
    size and sha256, and the cosine hash."""
    extra = T._parse_datatype_string(FEATURES)
    keep = [c for c in df.columns if c != media and c not in extra.names]
    schema = T.StructType([df.schema[c] for c in keep] + list(extra))
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def one(x: bytes | None) -> tuple:
        if x is None:
            return (None,) * 6
        samples, channels = read_png(x)
        raw = samples.tobytes()
        return len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-16:]), len(x), hashlib.sha256(x).hexdigest(), cosine_hash(samples, channels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = list(zip(*map(one, b.column(len(keep)).to_pylist()), strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *map(pa.array, found, types)], schema.names)

    return df.select(*keep, F.col(media)).mapInArrow(run, schema)

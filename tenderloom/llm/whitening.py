"""Embedding whitening over an exact scatter matrix in residue numbers.

Entries become integers, x = floor(SCALE * c). The fit list holds each distinct
x vector once. With n of them and sums S, y = n * x - S is centred and still an
integer, and n**3 times the covariance is the scatter sum(y y^T). It is computed
modulo several primes: each partition multiplies its y modulo a prime as doubles
(blocks so small that every sum of products stays below 2**53), the residues are
summed over the partitions, and Chinese remaindering of the sums gives the
scatter as exact integers, whatever the order of partitions or repeated tasks.
Its eigenvectors are taken in double precision on the driver.

Vectors of different lengths are fitted by themselves. What goes to the driver
is of the size of the scatter (dimensions squared times primes).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenderloom.llm.common import cut, forget

SCALE = 256
COMPONENTS = 4
#: Residues are centred, below 2**PRIME_BITS / 2 in size, and BLOCK_ROWS products are summed before they are reduced: 2 * (PRIME_BITS - 1) bits and those of BLOCK_ROWS are 53 at most.
PRIME_BITS, BLOCK_ROWS = 20, 1 << 12
#: Entries of a block at most, for very long vectors.
BLOCK_ENTRIES = 1 << 21
#: Components whose share of the trace is below this have no scale of their own.
LEAST_SHARE = 1e-13
_TOP = float(1 << 63)


@dataclass(frozen=True)
class Fit:
    """n, the sums of x, eigenvalues (falling), eigenvectors (columns) and trace of x's covariance."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


@dataclass(frozen=True)
class Model:
    """A fit for each length of vector, and the largest entry of whitened's covariance minus the identity."""

    fits: dict[int, Fit]
    identity_error: float | None


def primes(bits: int) -> Iterator[int]:
    """Primes below 2**bits, the largest first."""
    for p in range((1 << bits) - 1, 2, -2):
        if all(p % q for q in range(3, int(p**0.5) + 1, 2)):
            yield p


def integers(c: np.ndarray) -> np.ndarray:
    """floor(SCALE * c) as 64-bit integers; beyond their range the nearest one."""
    v = np.floor(c.astype(np.float64) * SCALE)
    inside = np.clip(v, -_TOP, np.nextafter(_TOP, 0)).astype(np.int64)
    return np.where(v >= _TOP, np.iinfo(np.int64).max, inside)


def centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """n * x - S, exact: 64-bit integers where they suffice, else Python's."""
    largest = max(int(x.max(initial=0)), -int(x.min(initial=0)))
    if n * largest + max(map(abs, sums), default=0) < 1 << 63:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _vectors(df: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """The columns to keep (renamed c0, c1 ...), d and x (the integers, as bytes) of valid rows."""
    own = [T.StructField(f"c{i}", df.schema[c].dataType) for i, c in enumerate(keep)]
    schema = T.StructType(own + list(T._parse_datatype_string("d int, x binary")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(0)
            offsets, values = lists.offsets.to_numpy(), lists.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
            d = np.diff(offsets)
            good = np.zeros(len(values) + 1, np.int64)
            np.cumsum(~np.isfinite(values), out=good[1:])
            ok = np.flatnonzero((good[offsets[1:]] == good[offsets[:-1]]) & np.asarray(lists.is_valid()) & (d > 0))
            x = integers(np.where(np.isfinite(values), values, 0.0))
            raw = [x[a:e].tobytes() for a, e in zip(offsets[ok].tolist(), offsets[ok + 1].tolist(), strict=True)]
            rest = [b.column(1 + i).take(pa.array(ok)) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(d[ok], pa.int32()), pa.array(raw, pa.binary())], schema.names)

    renamed = [F.col(c).alias(f"c{i}") for i, c in enumerate(keep)]
    return df.select(F.col(column).cast("array<double>").alias("v"), *renamed).mapInArrow(run, schema)


def _blocks(batches: Iterator[pa.RecordBatch], at: int = 0) -> Iterator[tuple[int, np.ndarray, pa.RecordBatch]]:
    """Of columns d, x at `at`: for each batch and length the length, the vectors as rows, and the batch's rows."""
    for b in batches:
        length = b.column(at).to_numpy()
        for d in np.unique(length).tolist():
            rows = b.take(pa.array(np.flatnonzero(length == d)))
            step = max(1, min(BLOCK_ROWS, BLOCK_ENTRIES // d))
            for i in range(0, rows.num_rows, step):
                part = rows.slice(i, step)
                yield d, np.frombuffer(b"".join(part.column(at + 1).to_pylist()), np.int64).reshape(-1, d), part


def _moments(fit_list: DataFrame) -> dict[int, tuple[int, tuple[int, ...], int]]:
    """For each length: n, S and the largest absolute entry. Sums are kept in two
    halves of 32 bits in a task and as decimals over all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for d, x, _ in _blocks(batches):
            h = held.setdefault(d, [0, np.zeros(d, np.int64), np.zeros(d, np.int64), np.full(d, 0, np.int64), np.full(d, 0, np.int64)])
            h[0] += len(x)
            h[1] += (x >> 32).sum(axis=0)
            h[2] += (x & 0xFFFFFFFF).sum(axis=0)
            np.minimum(h[3], x.min(axis=0), out=h[3])
            np.maximum(h[4], x.max(axis=0), out=h[4])
        for d, (n, *rest) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([v] * d, t) for v, t in ((d, pa.int32()), (n, pa.int64()))] + [pa.array(np.arange(d), pa.int32()), *map(pa.array, rest)], ["d", "n", "i", "hi", "lo", "low", "high"])

    sums = fit_list.mapInArrow(run, "d int, n long, i int, hi long, lo long, low long, high long").groupBy("d", "i")
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    found: dict[int, list] = {}
    for r in sums.agg(F.sum("n").alias("n"), wide("hi"), wide("lo"), F.min("low").alias("low"), F.max("high").alias("high")).collect():
        found.setdefault(r.d, []).append(r)
    return {d: (rows[0].n, tuple((int(r.hi) << 32) + int(r.lo) for r in sorted(rows, key=lambda r: r.i)), max(max(-r.low, r.high) for r in rows)) for d, rows in found.items()}


def _residues(x: np.ndarray, n: int, sums: tuple[int, ...], p: int) -> np.ndarray:
    """n * x - S modulo p, between -p/2 and p/2, as doubles."""
    r = (x % p * (n % p) - np.array([s % p for s in sums], np.int64)) % p
    return np.where(r > p // 2, r - p, r).astype(np.float64)


def _scatters(fit_list: DataFrame, moments: dict, chosen: dict[int, list[int]]) -> dict[int, np.ndarray]:
    """The exact scatter of each length, as Python's integers."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for d, x, _ in _blocks(batches):
            n, sums, _ = moments[d]
            for p in chosen[d]:
                r = _residues(x, n, sums, p)
                now = total.get((d, p), 0) + np.fmod(r.T @ r, p).astype(np.int64)
                total[d, p] = now % p
        for (d, p), m in total.items():
            lists = pa.ListArray.from_arrays(pa.array(np.arange(d + 1, dtype=np.int32) * d), pa.array(m.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array([d] * d, pa.int32()), pa.array([p] * d, pa.int64()), pa.array(np.arange(d), pa.int32()), lists], ["d", "p", "i", "row"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One running row at a time, from rows sorted by d, p, i."""
        key, row = None, None

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*key, row), (pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64())), strict=True)], ["d", "p", "i", "row"])

        for b in batches:
            for d, p, i, values in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                if (d, p, i) != key:
                    if key is not None:
                        yield told()
                    key, row = (d, p, i), np.zeros(d, np.int64)
                row = (row + values.values.to_numpy()) % p
        if key is not None:
            yield told()

    parts = int(fit_list.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = "d int, p long, i int, row array<long>"
    summed = fit_list.mapInArrow(multiply, schema).repartition(parts, "d", "p", "i").sortWithinPartitions("d", "p", "i").mapInArrow(add, schema)
    rows: dict[int, dict[int, np.ndarray]] = {d: {p: np.zeros((d, d), np.int64) for p in ps} for d, ps in chosen.items()}
    for r in summed.toLocalIterator():
        rows[r.d][r.p][r.i] = r.row
    return {d: remaindered(m) for d, m in rows.items()}


def remaindered(residues: dict[int, np.ndarray]) -> np.ndarray:
    """The integers between -P/2 and P/2 that have these residues; P is the product of the primes."""
    product, out = 1, 0
    for p, r in residues.items():
        lift = (r.astype(object) - out) * pow(product, -1, p) % p
        out, product = out + lift * product, product * p
    return np.where(out * 2 > product, out - product, out)


def _eigen(scatter: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Falling eigenvalues, eigenvectors and trace of scatter / n**3. Python's
    division of integers is correctly rounded, so V has no other error."""
    v = np.array([[a / n**3 for a in row] for row in scatter.tolist()], np.float64).reshape(scatter.shape)
    values, vectors = np.linalg.eigh(v)
    return np.maximum(values[::-1], 0.0), vectors[:, ::-1], sum(scatter[i, i] for i in range(len(scatter))) / n**3


def train(df: DataFrame, column: str = "embedding") -> Model:
    """A fit for each length of vector; none for an empty table. Rows whose vector
    is null or empty or holds null or non-finite entries are not used."""
    fit_list = cut(_vectors(df, column, []).groupBy("d", "x").agg(F.lit(1).alias("one")).select("d", "x"), "whitening-vectors")
    moments = _moments(fit_list)
    chosen: dict[int, list[int]] = {}
    for d, (n, sums, most) in moments.items():
        bound = 2 * n * (n * most + max(map(abs, sums))) ** 2  # no scatter entry is larger than half of it
        product, source = 1, primes(PRIME_BITS)
        chosen[d] = []
        while product <= bound or not chosen[d]:
            chosen[d].append(next(source))
            product *= chosen[d][-1]
    fits = {d: Fit(moments[d][0], moments[d][1], *_eigen(s, moments[d][0])) for d, s in _scatters(fit_list, moments, chosen).items()}
    error = identity_error(fit_list, fits)
    forget(fit_list)
    return Model(fits, error)


def project(y: np.ndarray, fit: Fit, components: int) -> np.ndarray:
    """y / n on the components, over the root of their eigenvalues; NaN for one without variance."""
    w = (y / fit.n).astype(np.float64) @ fit.vectors[:, :components]
    e = fit.values[:components]
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(e > LEAST_SHARE * fit.trace, w / np.sqrt(e), np.nan)


def identity_error(fit_list: DataFrame, fits: dict[int, Fit], components: int = COMPONENTS) -> float | None:
    """The largest absolute entry of whitened's covariance over the fit list minus
    the identity, of all components with variance; None without any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for d, x, _ in _blocks(batches):
            w = np.nan_to_num(project(centred(x, fits[d].n, fits[d].sums), fits[d], components))
            w = np.column_stack([w, np.ones(len(w))])
            total[d] = total.get(d, 0) + w.T @ w
        for d, m in total.items():
            k = len(m)
            yield pa.RecordBatch.from_arrays([pa.array([d] * k * k, pa.int32()), pa.array(np.repeat(np.arange(k), k), pa.int32()), pa.array(np.tile(np.arange(k), k), pa.int32()), pa.array(m.ravel())], ["d", "i", "j", "s"])

    worst = None
    sums: dict[int, dict] = {}
    for r in fit_list.mapInArrow(run, "d int, i int, j int, s double").groupBy("d", "i", "j").agg(F.sum("s").alias("s")).collect():
        sums.setdefault(r.d, {})[r.i, r.j] = r.s
    for d, m in sums.items():
        k, n = min(components, d), fits[d].n
        live = [i for i in range(k) if fits[d].values[i] > LEAST_SHARE * fits[d].trace]
        for i in live:
            for j in live:
                off = abs(m[i, j] / n - m[i, k] / n * (m[j, k] / n) - (i == j))
                worst = off if worst is None else max(worst, off)
    return worst


def whiten(df: DataFrame, model: Model, column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """The other columns of df and component, n, deviation, whitened, explained.

    One row for each valid row of df and each component up to `components` (fewer
    where vectors are shorter). deviation is the exact sum of (n * x - S)**2, null
    where it has more than 38 digits. whitened is null for a component without
    variance (one vector, or equal ones), explained 0 for it. Rows with vectors of
    a length that the fit hasn't, and those that `train` doesn't use, are left
    out. Columns of the results' names are replaced.
    """
    made = T._parse_datatype_string("component int, n long, deviation decimal(38,0), whitened double, explained double")
    keep = [c for c in df.columns if c != column and c not in made.names]
    schema = T.StructType([df.schema[c] for c in keep] + list(made))
    told = df.sparkSession.sparkContext.broadcast(model.fits)
    most = 10**38

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d, x, rows in _blocks(batches, len(keep)):
            if d not in told.value:
                continue
            fit = told.value[d]
            y, k = centred(x, fit.n, fit.sums), min(components, d)
            wide = y.dtype == object or d * max(int(y.max(initial=0)), -int(y.min(initial=0))) ** 2 >= 1 << 63
            deviation = [int(v) for v in ((y.astype(object) if wide else y) ** 2).sum(axis=1)]
            w = project(y, fit, k)
            share = np.where(fit.values[:k] > LEAST_SHARE * fit.trace, fit.values[:k] / (fit.trace or 1.0), 0.0)
            at = pa.array(np.repeat(np.arange(len(x)), k))
            own = [rows.column(i).take(at) for i in range(len(keep))]
            exact = pa.array([None if v >= most else v for v in deviation], pa.decimal128(38, 0)).take(at)
            new = [pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()), pa.array([fit.n] * (k * len(x)), pa.int64()), exact, pa.array(w.ravel(), mask=np.isnan(w.ravel())), pa.array(np.tile(share, len(x)))]
            yield pa.RecordBatch.from_arrays([*own, *new], schema.names)

    return _vectors(df, column, keep).mapInArrow(run, schema)

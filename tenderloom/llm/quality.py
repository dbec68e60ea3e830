"""Quality classifier: logistic regression on hashed word n-grams, trained by
follow-the-regularised-leader updates, scored as sparse dot products.

A text's features are its distinct hashed words and pairs of words (2**BITS
slots), each of value 1 / sqrt(their number). Training is one ordered pass or
more over a bounded sample of labelled rows, chosen and ordered by hash; the
features of the sample are made in parallel, the updates, which follow one
another, in one task, which returns only the non-zero weights (2**BITS at most).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenderloom.llm.common import hashed_words, shingle_hashes, steps, text_buffers
from tenderloom.llm.near import _distinct

BITS = 18
#: Labelled rows that the fit uses at most.
MAX_ROWS = 20_000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.5


def features(offsets: np.ndarray, data: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct slots of each text, and each text's first."""
    w, first = hashed_words(offsets, data)
    pairs, second = shingle_hashes(w, first, 2)
    n, m = np.diff(first), np.diff(second)
    out = np.empty(len(w) + len(pairs), np.uint64)
    start = first[:-1] + second[:-1]
    doc = np.repeat(np.arange(len(n)), n)
    out[np.arange(len(w)) - first[doc] + start[doc]] = w
    doc = np.repeat(np.arange(len(m)), m)
    out[np.arange(len(pairs)) - second[doc] + start[doc] + n[doc]] = pairs ^ np.uint64(0x9E3779B97F4A7C15)
    return _distinct(out & np.uint64((1 << bits) - 1), first + second)


def _features_of(rows: DataFrame, bits: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            offsets, data = text_buffers(b.column(2))
            for i, j in steps(offsets):
                slots, first = features(offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]], bits)
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(slots.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), lists], ["ord", "label", "slots"])

    return rows.select("ord", "label", "text").mapInArrow(run, "ord long, label int, slots array<int>")


class Ftrl:
    """FTRL-proximal: weights follow from the sums z and n of each slot."""

    def __init__(self, bits: int):
        self.z, self.n, self.bias, self.seen = np.zeros(1 << bits), np.zeros(1 << bits), 0.0, 0.0

    def weights(self, slots: np.ndarray) -> np.ndarray:
        z = self.z[slots]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(self.n[slots])) / ALPHA + L2))

    def update(self, slots: np.ndarray, label: int) -> None:
        x = 1 / np.sqrt(max(len(slots), 1))
        w = self.weights(slots)
        g = 1 / (1 + np.exp(-np.clip(self.bias + w.sum() * x, -30, 30))) - label
        self.seen += g * g
        self.bias -= 0.5 * g / (1 + np.sqrt(self.seen))
        n = self.n[slots]
        self.z[slots] += g * x - (np.sqrt(n + (g * x) ** 2) - np.sqrt(n)) / ALPHA * w
        self.n[slots] = n + (g * x) ** 2


def calibrate(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and bias that turn margins into log-odds; the slope is drawn to 1."""
    slope, bias = 1.0, 0.0
    for _ in range(25 if len(margins) else 0):
        p = 1 / (1 + np.exp(-np.clip(slope * margins + bias, -30, 30)))
        v = p * (1 - p) + 1e-9
        g = np.array([((p - labels) * margins).sum() + slope - 1, (p - labels).sum() + 0.1 * bias])
        h = np.array([[(v * margins**2).sum() + 1, (v * margins).sum()], [(v * margins).sum(), v.sum() + 0.1]])
        step = np.linalg.solve(h, g)
        slope, bias = slope - np.clip(step[0], -2, 2), bias - np.clip(step[1], -2, 2)
    return max(slope, 0.1), bias


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, bits: int = BITS, epochs: int = EPOCHS, text: str = "text", label: str = "quality") -> tuple[np.ndarray, float]:
    """Weights by slot, and the bias.

    docs (doc_id, text), labels (doc_id, label of 0 or 1; null: not used). The
    max_rows labelled rows that come first by the hash of doc_id are joined to
    their texts; by that bound they are broadcast. Of rows that share a doc_id one
    text counts (the least by its hash). Without labels all weights
    are 0, and every score is one half.
    """
    chosen = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("label"))
    chosen = chosen.withColumn("ord", F.xxhash64("doc_id")).orderBy("ord", "doc_id", "label").limit(max_rows)
    found = docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id")
    # One text for each label, however many rows share the doc_id; combined before the shuffle.
    rows = found.groupBy("ord", "doc_id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(o, y, x.values.to_numpy()) for b in batches for o, y, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True)]
        held = [(y, x) for _, y, x in sorted(rows, key=lambda r: (r[0], r[1], r[2].tobytes()))]
        model = Ftrl(bits)
        for _ in range(epochs):
            for y, slots in held:
                model.update(slots, y)
        slots = np.arange(1 << bits)
        w = model.weights(slots)
        keep = w != 0
        margins = np.array([model.bias + w[x].sum() / np.sqrt(max(len(x), 1)) for _, x in held])
        slope, bias = calibrate(margins, np.array([y for y, _ in held], float))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(slots[keep], -1), pa.int32()), pa.array(np.append(slope * w[keep], slope * model.bias + bias), pa.float64())], ["slot", "w"])

    found = _features_of(rows, bits).repartition(1).mapInArrow(fit, "slot int, w double").toPandas()
    w = np.zeros(1 << bits)
    slots, values = found["slot"].to_numpy(), found["w"].to_numpy()
    w[slots[slots >= 0]] = values[slots >= 0]
    return w, float(values[slots < 0].sum())


def score(docs: DataFrame, model: tuple[np.ndarray, float], bits: int = BITS, text: str = "text") -> DataFrame:
    """docs with score (0 to 1, higher: label 1 likelier) and predicted (1 from
    0.5 on). A null or empty text scores by the bias alone. Columns of those
    names are replaced, others carried along."""
    keep = [c for c in docs.columns if c not in ("score", "predicted")]
    told = docs.sparkSession.sparkContext.broadcast((model[0].astype(np.float32), model[1]))
    schema = T.StructType([docs.schema[c] for c in keep] + list(T._parse_datatype_string("score double, predicted int")))
    at = keep.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = told.value
        for b in batches:
            offsets, data = text_buffers(b.column(at))
            out = np.empty(b.num_rows)
            for i, j in steps(offsets):
                slots, first = features(offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]], bits)
                n = np.diff(first)
                total = np.bincount(np.repeat(np.arange(j - i), n), weights[slots], minlength=j - i)
                out[i:j] = bias + total / np.sqrt(np.maximum(n, 1))
            out = 1 / (1 + np.exp(-np.clip(out, -30, 30)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out), pa.array((out >= 0.5).astype(np.int32))], schema.names)

    return docs.select(*keep).mapInArrow(run, schema)

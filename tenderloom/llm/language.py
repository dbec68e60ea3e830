"""Language identification by character language models.

One interpolated Kneser-Ney model of order 4 for each language, over lower-case
letters (a character that is no letter is a gap, repeated gaps are one). The
4-grams of all training documents are counted on the executors, all of them are
in the models, and the lower orders follow from the distinct ones. The
probabilities of all languages stand side by side in arrays sorted by the 32-bit
hash of the n-gram (8 bits for a character), so scoring a position is one binary
search. The language with the lowest cross-entropy per predicted character is
chosen.

The highest order is kept in slices of the codes, of at most CELLS cells each
(n-grams times languages). A model of one slice, which four languages with
millions of 4-grams still are, is scored in one pass over the texts; one of
several in a pass for each slice, whose sums are added by text, so that memory
is bounded and the results are the same.

Rejection: a text without letters is `und`; a text whose cross-entropy in its
best language is far beyond those of the training texts is rejected, too:
more than one nat and six deviations beyond their largest, so that clean
texts stay.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenderloom.llm.common import cut, give_back

UNDETERMINED = "und"
#: Cells (4-grams times languages) of a slice of the model, 4 bytes each.
CELLS = 1 << 24
#: Characters that one vectorised step takes; a longer text is a step of its own.
STEP = 1 << 17
_SEP = "\U0010ffff"
_DISCOUNT = 0.75


def _symbols() -> np.ndarray:
    """8-bit symbol of each code point: 0 no letter, 1-26 a-z, others by
    remainder, so that neighbouring letters of a script differ; 255 separates."""
    out = np.zeros(0x110000, np.uint8)
    letters = np.array([c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isalpha()])
    out[letters] = 27 + letters % 228
    out[97:123] = np.arange(1, 27)
    out[65:91] = np.arange(1, 27)
    out[0x10FFFF] = 255
    return out


_TABLE: list[np.ndarray] = []


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """4-gram code and text number of each predicted character, and the number
    of letters of each text."""
    if not _TABLE:
        _TABLE.append(_symbols())
    joined = _SEP * 3 + (_SEP * 3).join(t.replace(_SEP, " ") if _SEP in t else t for t in texts) + _SEP * 3
    s = _TABLE[0][np.frombuffer(joined.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != 0) | (s[:-1] != 0)
    s = s[keep]
    sep = s == 255
    text = np.cumsum(sep) // 3 - 1
    x = np.where(sep, 0, s).astype(np.uint32)
    code = (x[:-3] << np.uint32(24)) | (x[1:-2] << np.uint32(16)) | (x[2:-1] << np.uint32(8)) | x[3:]
    at = np.flatnonzero(~sep[3:])
    doc = text[3:][at]
    return code[at], doc, np.bincount(text[(~sep) & (s != 0)], minlength=len(texts))[: len(texts)]


def _steps(texts: list[str]) -> Iterator[tuple[int, int]]:
    i, total = 0, 0
    for j, t in enumerate(texts):
        if total and total + len(t) > STEP:
            yield i, j
            i, total = j, 0
        total += len(t)
    if i < len(texts):
        yield i, len(texts)
    give_back()


def _added(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their counts."""
    if not len(key):
        return key, n
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], np.add.reduceat(n, first)


def count_grams(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, code, n: 4-gram counts over all texts with a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, langs = [x or "" for x in b.column(1).to_pylist()], b.column(0).to_pylist()
            names = sorted(set(langs))
            number = np.array([names.index(x) for x in langs], np.uint64)
            key, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            for i, j in _steps(texts):
                code, doc, _ = codes(texts[i:j])
                own, many = np.unique((number[i + doc] << np.uint64(32)) | code, return_counts=True)
                key, n = _added(np.concatenate([key, own]), np.concatenate([n, many]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()).take(pa.array((key >> np.uint64(32)).astype(np.int64))), pa.array((key & np.uint64((1 << 32) - 1)).astype(np.int64)), pa.array(n, pa.int64())], ["lang", "code", "n"]
            )

    there = docs.where(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    return there.mapInArrow(run, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def _continuations(code: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams without their first character, and in how many
    distinct n-grams each stands."""
    return np.unique(code & np.uint32((1 << bits) - 1), return_counts=True)


@dataclass
class Top:
    """The highest order between two codes."""

    low: int
    high: int  # exclusive
    keys: np.ndarray  # sorted 4-grams
    logs: np.ndarray  # log-probability of each
    contexts: np.ndarray  # sorted 3-grams that precede
    weights: np.ndarray  # what each leaves to the lower order


@dataclass
class Model:
    """Probabilities, a column for each language, and calibration."""

    langs: list[str]
    keys3: np.ndarray
    probs3: np.ndarray
    contexts2: np.ndarray
    weights2: np.ndarray
    probs2: np.ndarray  # dense, 2**16
    tops: list[Top | Callable[[], Top]]  # slices, or what makes them
    worst: np.ndarray | None = None  # rejected beyond, for each language
    sharpness: float = 1.0

    def lower(self, code: np.ndarray) -> np.ndarray:
        """Order-3 probabilities of 3-gram codes."""
        out = _at(self.contexts2, self.weights2, code >> np.uint32(8), 1.0) * self.probs2[code & np.uint32((1 << 16) - 1)]
        seen, where = _find(self.keys3, code)
        out[seen] = self.probs3[where]
        return out

    def log(self, code: np.ndarray, top: Top | None = None) -> np.ndarray:
        top = top or self.tops[0]
        seen, where = _find(top.keys, code)
        out = np.empty((len(code), len(self.langs)), np.float32)
        out[seen] = top.logs[where]
        rest = code[~seen]
        out[~seen] = np.log(_at(top.contexts, top.weights, rest >> np.uint32(8), 1.0) * self.lower(rest & np.uint32((1 << 24) - 1)))
        return out

    def sums(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Negative log-probability of each text in each language over the slices
        that this model holds, and its predicted characters and letters."""
        out, n, letters = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for i, j in _steps(texts):
            code, doc, letters[i:j] = codes(texts[i:j])
            n[i:j] = np.bincount(doc, minlength=j - i)[: j - i]
            for top in self.tops:
                top = top if isinstance(top, Top) else top()
                inside = (code >= top.low) & (code < top.high)
                own = doc if inside.all() else doc[inside]
                logs = self.log(code if own is doc else code[inside], top)
                for k in range(len(self.langs)):
                    out[i:j, k] -= np.bincount(own, logs[:, k], minlength=j - i)[: j - i]
        return out, n, letters

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per predicted character in each language, and letters."""
        out, n, letters = self.sums(texts)
        return out / np.maximum(n, 1)[:, None], letters

    def decide(self, e: np.ndarray, letters: np.ndarray) -> list[tuple[str, float, float | None, bool]]:
        """Language, score (0 to 1), cross-entropy and whether it is rejected. The
        score is the share of the language by its cross-entropy; beyond the bound
        of rejection it is halved and falls with the distance."""
        rows = []
        for x, n in zip(e, letters, strict=True):
            if not n or not self.langs:
                rows.append((UNDETERMINED, 0.0, None, True))
                continue
            k = int(x.argmin())
            share = 1 / np.exp(-self.sharpness * (x - x[k])).sum()
            beyond = float(x[k] - self.worst[k]) if self.worst is not None else 0.0
            rows.append((self.langs[k], float(share * np.exp(-beyond) / 2 if beyond > 0 else share), float(x[k]), beyond > 0))
        return rows

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float | None, bool]]:
        return self.decide(*self.entropies([t or "" for t in texts]))


def _find(keys: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(keys, code)
    seen = at < len(keys)
    seen[seen] = keys[at[seen]] == code[seen]
    return seen, at[seen]


def _at(keys: np.ndarray, values: np.ndarray, code: np.ndarray, default: float) -> np.ndarray:
    seen, where = _find(keys, code)
    out = np.full((len(code), values.shape[1]), default, np.float32)
    out[seen] = values[where]
    return out


def _align(tables: list[tuple[np.ndarray, np.ndarray]], default) -> tuple[np.ndarray, np.ndarray]:
    """Sorted union of keys and a column for each table."""
    keys = np.unique(np.concatenate([k for k, _ in tables])) if tables else np.zeros(0, np.uint32)
    out = np.stack([default(keys, t) if callable(default) else np.full(len(keys), default) for t in range(len(tables))], axis=1) if tables else np.zeros((0, 0))
    for t, (k, v) in enumerate(tables):
        out[np.searchsorted(keys, k), t] = v
    return keys, out


def _lower_orders(thirds: dict[str, tuple[np.ndarray, np.ndarray]]) -> tuple[Model, dict[str, tuple[np.ndarray, np.ndarray]]]:
    """A model without its highest order, and each language's own order 3."""
    d, langs = _DISCOUNT, sorted(thirds)
    own, seconds, dense = {}, [], []
    for lang in langs:
        c3, n3 = thirds[lang]
        c2, n2 = _continuations(c3, 16)
        c1, n1 = _continuations(c2, 8)
        p1 = np.full(256, d * len(c1) / max(n1.sum(), 1) / 256)
        p1[c1] += (n1 - d) / max(n1.sum(), 1)
        p2 = np.tile(p1, (256, 1))
        head, total, kinds = _heads(c2, n2)
        p2[head] *= (d * kinds / total)[:, None]
        p2 = p2.ravel()
        p2[c2] += (n2 - d) / np.repeat(total, kinds)
        head3, total3, kinds3 = _heads(c3, n3)
        w3 = d * kinds3 / total3
        own[lang] = c3, (n3 - d) / np.repeat(total3, kinds3) + np.repeat(w3, kinds3) * p2[c3 & np.uint32((1 << 16) - 1)]
        seconds.append((head3, w3))
        dense.append(p2)
    contexts2, weights2 = _align(seconds, 1.0)
    probs2 = np.stack(dense, axis=1).astype(np.float32) if dense else np.zeros((1 << 16, 0), np.float32)
    model = Model(langs, np.zeros(0, np.uint32), np.zeros((0, len(langs))), contexts2, weights2, probs2, [])
    model.keys3, model.probs3 = _align([own[lang] for lang in langs], lambda k, t: model.lower(k)[:, t])
    return model, own


def _top(model: Model, own: dict[str, tuple[np.ndarray, np.ndarray]], counts: dict[str, tuple[np.ndarray, np.ndarray]], low: int, high: int) -> Top:
    """The slice of the highest order whose contexts are all between low and high."""
    d, grams, contexts = _DISCOUNT, [], []
    for lang in model.langs:
        code, n = counts.get(lang, (np.zeros(0, np.uint32), np.zeros(0, np.int64)))
        order = np.argsort(code)
        code, n = code[order], n[order]
        head, total, kinds = _heads(code, n)
        w = d * kinds / total
        c3, p3 = own[lang]
        grams.append((code, (n - d) / np.repeat(total, kinds) + np.repeat(w, kinds) * p3[np.searchsorted(c3, code & np.uint32((1 << 24) - 1))]))
        contexts.append((head, w))
    top = Top(low, high, np.zeros(0, np.uint32), np.zeros((0, len(model.langs)), np.float32), *_align(contexts, 1.0))
    keys, probs = _align(grams, lambda k, t: (_at(top.contexts, top.weights, k >> np.uint32(8), 1.0) * model.lower(k & np.uint32((1 << 24) - 1)))[:, t])
    top.keys, top.logs = keys, np.log(probs).astype(np.float32)
    return top


def build(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """The models, of one slice, from each language's distinct 4-grams (uint32)
    and counts."""
    model, own = _lower_orders({lang: _continuations(code, 24) for lang, (code, _) in counts.items()})
    model.tops = [_top(model, own, counts, 0, 1 << 32)]
    return model


def _heads(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts of sorted n-grams, the sum of their counts and their kinds."""
    head, first, kinds = np.unique(code >> np.uint32(8), return_index=True, return_counts=True)
    return head, np.add.reduceat(n, first) if len(first) else n, kinds


def _numbered(table: DataFrame, langs: list[str]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """code and n of each language, as numbers through Arrow."""
    number = F.array_position(F.array(*map(F.lit, langs)), F.col("lang")).cast("int") if langs else F.lit(0)
    got = table.select(number.alias("k"), "code", "n").toArrow()
    k, code, n = (got.column(c).to_numpy() for c in ("k", "code", "n"))
    return {lang: (code[k == i + 1].astype(np.uint32), n[k == i + 1].astype(np.int64)) for i, lang in enumerate(langs)}


def _ranges(counted: DataFrame, most: int) -> list[tuple[int, int]]:
    """Ranges of codes with at most `most` rows each, as far as codes with one
    first pair of characters (2**16 counts at most) allow."""
    heads = sorted((r.head, r["count"]) for r in counted.groupBy(F.shiftright("code", 16).alias("head")).count().collect())
    out, low, held = [], 0, 0
    for head, n in heads:
        if held and held + n > most:
            out.append((low, head << 16))
            low, held = head << 16, 0
        held += n
    return [*out, (low, 1 << 32)]


def _slice(model: Model, own: dict[str, tuple[np.ndarray, np.ndarray]], counted: DataFrame, low: int, high: int) -> Top:
    """The slice between low and high, from the table of counts."""
    return _top(model, own, _numbered(counted.where((F.col("code") >= low) & (F.col("code") < high)), model.langs), low, high)


def train(docs: DataFrame, text: str = "text", lang: str = "lang", cells: int = CELLS) -> Model:
    """The models of all languages in docs[lang] (null: not used).

    Counts are over all of docs, and no n-gram is left out. What comes to the
    driver at once is one slice of the n-grams, the distinct 3-grams (an alphabet
    bounds them). All distinct texts calibrate the scores, by sums that Spark
    makes; a row for each language comes back.
    """
    counted = cut(count_grams(docs, text, lang), "grams")
    langs = sorted(r.lang for r in counted.select("lang").distinct().collect())
    most = max(1, cells // max(1, len(langs)))
    ranges = [(0, 1 << 32)] if counted.count() <= most else _ranges(counted, most)
    if len(ranges) == 1:
        model = build(_numbered(counted, langs))
    else:
        thirds = counted.groupBy("lang", F.col("code").bitwiseAND((1 << 24) - 1).alias("code")).agg(F.count("*").alias("n")).orderBy("code")
        model, own = _lower_orders(_numbered(thirds, langs))
        model.tops = [partial(_slice, replace(model), own, counted, low, high) for low, high in ranges]  # made anew for each pass: one is there at once
    if not langs:
        return model
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("l"), F.xxhash64(text).alias("h"), F.col(text).alias("t"))
    scored = _sums(known.select("t", "l", "h"), model).dropDuplicates(["l", "h"]).where("letters > 0")
    e = scored.select("l", F.transform("sums", lambda x: x / F.greatest("n", F.lit(1))).alias("e")).withColumn("least", F.array_min("e"))
    e = e.select("least", (F.array_position("e", F.col("least")) - 1).alias("k"), F.array_position(F.array(*map(F.lit, langs)), F.col("l")).cast("int").alias("own"), F.transform("e", lambda x: x - F.col("least")).alias("gap"))
    exact = lambda c: F.sum(c.cast("decimal(28,12)")).cast("double")
    lost = lambda x: x * F.get("gap", F.col("own") - 1) + F.log(F.aggregate("gap", F.lit(0.0), lambda t, g: t + F.exp(-x * g)))
    loss = [exact(lost(x)).alias(f"loss{i}") for i, x in enumerate(_SHARPNESS)]
    rows = {r.k: r for r in e.where("own > 0").groupBy("k").agg(F.count("*").alias("n"), F.max("least").alias("most"), exact(F.col("least")).alias("s"), exact(F.col("least") * F.col("least")).alias("s2"), *loss).collect()}
    if rows:
        far = lambda r: r.most + 6 * max(0.0, r.s2 / r.n - (r.s / r.n) ** 2) ** 0.5 + 1
        model.worst = np.array([far(rows[k]) if k in rows else np.inf for k in range(len(langs))])
        model.sharpness = _SHARPNESS[int(np.argmin([sum(rows[k][f"loss{i}"] for k in sorted(rows)) for i in range(len(_SHARPNESS))]))]
    return model


def _sums(texts: DataFrame, model: Model) -> DataFrame:
    """texts (t, and more) without t, with sums, n and letters: the negative
    log-probabilities in every language. A pass for each slice of the model, which
    is made for it and dropped after it; the sums of several are added by the other
    columns."""
    other = [c for c in texts.columns if c != "t"]
    fields = [texts.schema[c] for c in other]
    schema = T.StructType(fields + list(T._parse_datatype_string("sums array<double>, n long, letters long")))

    def scored(told) -> DataFrame:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                sums, n, letters = told.value.sums([x or "" for x in b.column(0).to_pylist()])
                yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(sums.tolist(), pa.list_(pa.float64())), pa.array(n, pa.int64()), pa.array(letters, pa.int64())], schema.names)

        return texts.select("t", *other).mapInArrow(run, schema)

    sent = texts.sparkSession.sparkContext.broadcast
    if len(model.tops) <= 1:
        return scored(sent(model))
    parts = []
    for make in model.tops:
        told = sent(replace(model, tops=[make()]))
        parts.append(cut(scored(told).dropDuplicates(other), "language-sums"))
        told.destroy()
    added = [F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(len(model.langs))]
    whole = reduce(DataFrame.unionByName, parts).groupBy(*other).agg(*added, F.max("n").alias("n"), F.max("letters").alias("letters"))
    return whole.select(*other, F.array(*[f"s{k}" for k in range(len(model.langs))]).alias("sums"), "n", "letters")


_SHARPNESS = [0.5, 1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0]


def identify(docs: DataFrame, model: Model, text: str = "text", lang: str = "lang_pred") -> DataFrame:
    """docs with lang_pred, score, entropy and rejected.

    `und` with score 0, rejected, for a null text or one without letters, and
    for every text if nothing could be learned. Columns of docs with the names
    of the results are replaced; others are carried along. Each slice of the
    model, of bounded size, goes to the executors as a broadcast variable.
    """
    names = [lang, "score", "entropy", "rejected"]
    keep = [c for c in docs.columns if c not in names]
    found = list(T._parse_datatype_string(f"`{lang}` string, score double, entropy double, rejected boolean"))
    schema = T.StructType([docs.schema[c] for c in keep] + found)
    at = keep.index(text)
    kinds = [pa.string(), pa.float64(), pa.float64(), pa.bool_()]

    def columns(rows: list[tuple]) -> list[pa.Array]:
        return list(map(pa.array, list(zip(*rows, strict=True)) or [()] * 4, kinds))

    if len(model.tops) <= 1:
        told = docs.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([*b.columns, *columns(told.value.predict(b.column(at).to_pylist()))], schema.names)

        return docs.select(*keep).mapInArrow(run, schema)

    own = replace(model, tops=[])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.column(3).to_numpy()
            e = np.array(b.column(2).to_pylist()).reshape(len(n), -1) / np.maximum(n, 1)[:, None]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns(own.decide(e, b.column(4).to_numpy()))], ["h1", "h2", *names])

    keys = [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")]
    summed = cut(_sums(docs.select(F.col(text).alias("t"), *keys), model), "language-texts")
    told = summed.select("h1", "h2", "sums", "n", "letters").mapInArrow(decide, T.StructType(list(T._parse_datatype_string("h1 long, h2 long")) + found))
    keyed = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)], *keys)
    return keyed.join(told, ["h1", "h2"]).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], *names)

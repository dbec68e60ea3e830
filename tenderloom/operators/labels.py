"""Labels and the terms they mean: by words in common or by the ratio of their
longest matching blocks, without comparing all with all.

Two strings of T characters together and a ratio of t or more have M >= t * T / 2
characters in matching blocks. Between two blocks at least one character is
unmatched, so there are T - 2 * M + 1 blocks at most, and the strings share at least
M - blocks >= T * (1.5 * t - 1) - 1 pairs of neighbouring characters. Each string
therefore only offers its rarest pairs, as many as it has less those it must
share, and one: strings that share none of them are never compared. Words are
blocked likewise by the Jaccard share, and the characters of strings so short that
they may share no pair.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenderloom.functions.columns import jaccard

LEAST = 0.85


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the characters in longest matching blocks over those of both."""
    return pd.Series([SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def normal(c: Column) -> Column:
    """Lower case, single spaces."""
    return F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def _numbered(items: Column) -> Column:
    """Each item with the number of equal ones before it: a set in place of a bag."""
    s = F.array_sort(items)
    return F.transform(s, lambda x, i: F.concat(x, F.lit("#"), (i - F.array_position(s, x)).cast("string")))


def _prepared(strings: DataFrame, least: float) -> DataFrame:
    """s -> s, words, chars and keys: what it can be found by, each with how many of its kind it offers."""
    s, n = F.col("s"), F.char_length("s")
    rows = strings.select("s", F.split("s", " ").alias("words"), F.transform(F.sequence(F.lit(1), n), lambda i: F.substr(s, i, F.lit(1))).alias("c"), F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substr(s, i, F.lit(2)))).otherwise(F.array().cast("array<string>")).alias("p"))
    rows = rows.select("s", F.array_distinct("words").alias("words"), _numbered(F.col("c")).alias("chars"), F.transform(_numbered(F.col("p")), lambda x: F.concat(F.lit("p"), x)).alias("pairs"))
    must = F.ceil(2 * n / (2 - least) * (1.5 * least - 1) - 1 - 1e-9)
    shared = F.greatest(must, F.lit(1))
    # Two very short strings may share no pair, but so many characters.
    letters = F.when(must < 1, F.transform("chars", lambda x: F.concat(F.lit("c"), x))).otherwise(F.array().cast("array<string>"))
    few = F.struct(letters.alias("keys"), (n - F.ceil(least * n / (2 - least) - 1e-9) + 1).cast("int").alias("offered"))
    words = F.transform("words", lambda w: F.concat(F.lit("w"), w))
    kinds = [F.struct(F.col("pairs").alias("keys"), (F.size("pairs") - shared + 1).cast("int").alias("offered")), F.struct(words.alias("keys"), (F.size("words") - F.ceil(least * F.size("words") - 1e-9) + 1).cast("int").alias("offered"))]
    return rows.select("s", "words", "chars", F.explode(F.array(*kinds, few)).alias("k")).select("s", "words", "chars", "k.keys", "k.offered")


def _offered(rows: DataFrame, rarity: DataFrame) -> DataFrame:
    """s, words, chars, key: the rarest keys of each kind, of one key the rows of a string combine before they meet."""
    counted = rows.select("s", "words", "chars", "offered", F.posexplode("keys").alias("i", "key")).join(rarity, "key")
    kind = F.substring("key", 1, 1)
    g = counted.groupBy("s", "words", "chars", kind.alias("kind"), "offered").agg(F.array_sort(F.collect_list(F.struct("n", "key"))).alias("keys"))
    return g.select("s", "words", "chars", F.explode(F.slice("keys", 1, F.greatest("offered", F.lit(1)))["key"]).alias("key"))


def alike(labels: DataFrame, terms: DataFrame, least: float = LEAST) -> DataFrame:
    """label, term, score of every two whose score is at least `least` (above 2/3):
    the larger of the Jaccard share of their words and the ratio. labels (label),
    terms (term); repeats count once, nulls and strings without letters or digits
    never. A label's length bounds its keys; equal strings score 1."""
    if not 2 / 3 < least <= 1:
        raise ValueError("least must be above 2/3")
    own = labels.select("label", normal(F.col("label")).alias("s")).where("s <> ''").distinct()
    other = terms.select("term", normal(F.col("term")).alias("s")).where("s <> ''").distinct()
    one, two = _prepared(own.select("s").distinct(), least), _prepared(other.select("s").distinct(), least)
    rarity = one.select("keys").union(two.select("keys")).select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    two = _offered(two, rarity).select("key", *[F.col(c).alias(f"{c}2") for c in ("s", "words", "chars")])
    n, m = F.char_length("s"), F.char_length("s2")
    bound = 2 * F.size(F.array_intersect("chars", "chars2")) / (n + m)
    pairs = _offered(one, rarity).join(two, "key").select("s", "s2", "words", "words2", bound.alias("bound")).dropDuplicates(["s", "s2"])
    pairs = pairs.withColumn("jaccard", jaccard(F.col("words"), F.col("words2"))).where((F.col("bound") >= least) | (F.col("jaccard") >= least))
    scored = pairs.withColumn("score", F.greatest("jaccard", ratio("s", "s2"))).where(F.col("score") >= least).select("s", "s2", "score")
    equal = own.select("s").intersect(other.select("s")).select("s", F.col("s").alias("s2"), F.lit(1.0).alias("score"))
    scored = scored.where("s <> s2").union(equal)
    return scored.join(own, "s").join(other.select("term", F.col("s").alias("s2")), "s2").select("label", "term", "score")


def closest(labels: DataFrame, terms: DataFrame, least: float = LEAST) -> DataFrame:
    """label, target, score: for each label that is like a term (term, target) the
    target of the most similar one; ties go to the smallest target."""
    found = alike(labels, terms, least).join(terms.select("term", "target"), "term")
    best = found.groupBy("label").agg(F.min(F.struct((-F.col("score")).alias("s"), "target")).alias("b"))
    return best.select("label", F.col("b.target").alias("target"), (-F.col("b.s")).alias("score"))


def taken_once(records: DataFrame, found: DataFrame) -> DataFrame:
    """record, position, target, score of the labels of a record (record, position,
    label) that get one: in order of position each takes its best target (found: label,
    target, score, and place, which ties go by) that no earlier one has taken."""
    rows = records.join(found, "label", "left").select("record", F.struct("position", (-F.col("score")).alias("s"), "place", "target").alias("x"))
    g = rows.groupBy("record").agg(F.array_sort(F.collect_list("x")).alias("xs"))

    def step(taken: Column, x: Column) -> Column:
        free = x["target"].isNotNull() & ~F.exists(taken, lambda y: (y["position"] == x["position"]) | (y["target"] == x["target"]))
        return F.when(free, F.concat(taken, F.array(x))).otherwise(taken)

    kind = g.schema["xs"].dataType.simpleString()
    chosen = g.select("record", F.explode(F.aggregate("xs", F.array().cast(kind), step)).alias("x"))
    return chosen.select("record", "x.position", F.col("x.target").alias("target"), (-F.col("x.s")).alias("score"))


def assigned(records: DataFrame, terms: DataFrame, least: float = LEAST) -> DataFrame:
    """record, position, label, target, score: the labels of a record, in order of
    position, each with the best target that no earlier one has taken (ties: the
    smallest); without any, target and score are null.

    records (record, position, label), terms (term, target). Distinct labels are
    matched once; a record gathers its labels' targets, as many as both allow.
    """
    found = alike(records.select("label").distinct(), terms, least).join(terms.select("term", "target"), "term").groupBy("label", "target").agg(F.max("score").alias("score"))
    chosen = taken_once(records, found.withColumn("place", F.col("target")))
    return records.select("record", "position", "label").distinct().join(chosen, ["record", "position"], "left")

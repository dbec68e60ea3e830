"""Quality rules by weak supervision, in DataFrame functions only.

Each rule looks at counts of a text and votes that it is good (1), bad (-1) or
abstains (0). Expectation-maximisation over the vote patterns estimates, for each
rule, how often it is right about good texts and about bad ones; a text is kept if
the posterior probability that it is good is at least one half. A rule that says
good of nearly everything so gets no weight, and one that is right about one kind
of junk only suffices for that kind.

Counts are taken within each row, without a shuffle, and written once. Patterns
are counted before the shuffle, 3 ** rules rows at most; the rounds of the
estimation are a fold over an array of them. A hot source or repeated rows add to counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderloom.llm.common import cut

ROUNDS = 20
#: Probabilities of being good before the first round: without and with a vote for bad, of a rule that says bad of no more than half of the texts it votes on.
FIRST = (0.9, 0.1)
#: Bounds of the share of good texts and of the accuracies.
PRIOR_BOUNDS, ACCURACY_BOUNDS = (0.05, 0.95), (0.5, 0.999)
_DELIMITERS = "[ \\t-\\r]"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_capitals", "n_marks", "n_digits", "n_ends"]


def counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs' doc_id and COUNTS of the whole text (null: none).

    Words are runs without delimiters, lines are split at \\n and count with a word
    only. n_repeat_words: words in 3-word windows that occur twice or more.
    n_capitals: pairs of capitals A-Z, n_ends: sentence ends before a delimiter.
    """
    whole = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("t"))
    split = whole.select(
        "doc_id",
        "t",
        F.filter(F.split("t", f"{_DELIMITERS}+"), lambda w: w != "").alias("ws"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike("[^ \\t-\\r]")).alias("ls"),
    )
    w, n = F.col("ws"), F.size("ws")
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.concat_ws(" ", w[i], w[i + 1], w[i + 2]))).otherwise(F.array().cast("array<string>"))
    split = split.select("doc_id", "t", "ws", "ls", windows.alias("triples"))
    t3 = F.col("triples")
    # Only a text with an equal pair of windows is sorted; equal ones are neighbours then.
    some = F.size(F.array_distinct(t3)) < F.size(t3)
    split = split.select("doc_id", "t", "ws", "ls", F.when(some, F.sort_array(F.transform(t3, lambda s, i: F.struct(s.alias("s"), i.alias("i"))))).alias("sorted"))
    s = F.col("sorted")
    pairs = F.zip_with(s, F.slice(s, 2, F.greatest(F.size(s), F.lit(1))), lambda a, b: F.when(a["s"] == b["s"], F.array(*[x["i"] + k for x in (a, b) for k in range(3)])))
    covered = F.size(F.array_distinct(F.flatten(F.filter(pairs, lambda x: x.isNotNull()))))
    count = lambda pattern: F.regexp_count("t", F.lit(pattern))
    found = [
        n,
        F.char_length(F.array_join("ws", "")),
        F.char_length("t") - F.char_length(F.regexp_replace("t", "[#*$%&|<>]", "")),
        F.size("ls") - F.size(F.array_distinct("ls")),
        F.when(s.isNotNull(), covered).otherwise(0),
        F.size("ls"),
        F.size(F.array_distinct("ws")),
        count("[A-Z][A-Z]"),
        count("[!?]"),
        count("[0-9]"),
        count(f"[.!?]({_DELIMITERS}|\\z)"),
    ]
    return split.select("doc_id", *[c.cast("long").alias(name) for c, name in zip(found, COUNTS, strict=True)])


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def votes() -> dict[str, Column]:
    """The rules over COUNTS: at least these limits to be bad, within those to be good."""
    c = {name: F.col(name) for name in COUNTS}
    n, chars, ends = c["n_words"], c["word_chars"], c["n_ends"]
    return {
        "symbols": _vote(10 * c["n_symbols"] >= n, 100 * c["n_symbols"] <= n),
        "capitals": _vote(2 * c["n_capitals"] >= n, 10 * c["n_capitals"] <= n),
        "marks": _vote(2 * c["n_marks"] >= n, 10 * c["n_marks"] <= n),
        "word_length": _vote((chars < 2 * n) | (chars > 12 * n), chars.between(3 * n, 9 * n)),
        "sentences": _vote((ends == 0) | (2 * ends > n), (3 * ends <= n) & (100 * ends >= n)),
        "repetition": _vote(10 * c["n_repeat_words"] > 3 * n, 20 * c["n_repeat_words"] <= 3 * n),
        "vocabulary": _vote(20 * c["n_distinct"] < n, 5 * c["n_distinct"] >= n),
        "lines": _vote(10 * c["n_dup_lines"] > 3 * c["n_lines"], (c["n_dup_lines"] == 0) & (c["n_lines"] >= 2)),
        "digits": _vote(10 * c["n_digits"] > 3 * chars, 20 * c["n_digits"] <= 3 * chars),
    }


def _bounded(x: Column, bounds: tuple[float, float]) -> Column:
    return F.least(F.greatest(x, F.lit(bounds[0])), F.lit(bounds[1]))


def _posterior(vote: Callable[[int], Column], found: Column, n: int) -> Column:
    """The probability that something with these votes is good."""
    odds = found["odds"]
    for i in range(n):
        odds = odds + F.when(vote(i) == 1, found["rules"][i]["up"]).when(vote(i) == -1, found["rules"][i]["down"]).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def _maximised(patterns: Column, n: int, q: Callable[[Column], Column]) -> Column:
    """Accuracies that suit the probabilities q of the patterns best; one row of
    0.9 is added to each share. odds are those of a text without votes; for each
    rule: how often it is right about good texts and about bad ones, where it
    votes, and what its votes for good and bad add to the odds."""

    def parts(r: Column) -> Column:
        good, bad = r["n"] * r["q"], r["n"] * (1 - r["q"])
        return F.array(good, bad, *[F.when(r["v"][i] == sign, x).otherwise(0.0) for i in range(n) for x, sign in ((good, 1), (good, -1), (bad, -1), (bad, 1))])

    def told(sums: Column) -> Column:
        share = lambda i, j: (sums[i] + 0.9) / (sums[i] + sums[j] + 1)
        rules = []
        for i in range(2, 4 * n + 2, 4):
            good = _bounded(share(i, i + 1), ACCURACY_BOUNDS)
            # A vote for good never lowers the odds: right about bad texts at least as often as wrong about good ones.
            bad = F.least(F.greatest(share(i + 2, i + 3), 1 - good), F.lit(ACCURACY_BOUNDS[1]))
            rules.append(F.struct(good.alias("good"), bad.alias("bad"), F.log(good / (1 - bad)).alias("up"), F.log((1 - good) / bad).alias("down")))
        prior = _bounded((sums[0] + 0.9) / (sums[0] + sums[1] + 1), PRIOR_BOUNDS)
        return F.struct(prior.alias("prior"), F.log(prior / (1 - prior)).alias("odds"), F.array(*rules).alias("rules"))

    rows = F.transform(patterns, lambda p: F.struct(p["v"].alias("v"), p["n"].alias("n"), q(p).alias("q")))
    zero = F.array_repeat(F.lit(0.0), 4 * n + 2)
    return F.aggregate(rows, zero, lambda sums, r: F.zip_with(sums, parts(r), lambda a, b: a + b), told)


def estimate(voted: DataFrame, names: list[str], rounds: int = ROUNDS) -> DataFrame:
    """One row, found: what expectation-maximisation tells of the named votes.
    The distinct patterns of votes, 3 ** len(names) at most, are one array."""
    n = len(names)
    counted = voted.groupBy(F.array(*names).alias("v")).agg(F.count("*").cast("double").alias("n"))
    rare = F.array(*[2 * F.sum(F.when(F.col("v")[i] == -1, F.col("n")).otherwise(0.0)) <= F.sum(F.when(F.col("v")[i] != 0, F.col("n")).otherwise(0.0)) for i in range(n)])
    patterns = counted.agg(F.sort_array(F.collect_list(F.struct("v", "n"))).alias("patterns"), rare.alias("rare"))
    p = F.col("patterns")
    doubted = lambda v: F.exists(F.zip_with(v, F.col("rare"), lambda a, b: (a == -1) & b), lambda x: x)
    first = _maximised(p, n, lambda x: F.when(doubted(x["v"]), FIRST[1]).otherwise(FIRST[0]))
    again = lambda found, _: _maximised(p, n, lambda x: _posterior(lambda i: x["v"][i], found, n))
    return patterns.select(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), first, again).alias("found"))


def judge(docs: DataFrame, text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """doc_id, COUNTS, base_failed, posterior, kept for every row of docs.

    base_failed: fewer than 50 words, or more than half of them in repeated
    windows. The accuracies are estimated on the rows that don't fail so; kept is
    false for those that do, else whether the posterior is at least one half. A
    null text is an empty one and fails; rows without doc_id or with a repeated one
    are rows like others. Empty tables give an empty result; other columns aren't
    looked at.
    """
    rules = votes()
    counted = cut(counts(docs, text), "rules-counts")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    voted = counted.withColumn("base_failed", failed).withColumns(rules)
    found = estimate(voted.where("not base_failed"), list(rules), rounds)
    names = list(rules)
    posterior = voted.crossJoin(F.broadcast(found)).withColumn("posterior", _posterior(lambda i: F.col(names[i]), F.col("found"), len(names)))  # one row
    return posterior.select("doc_id", *COUNTS, "base_failed", "posterior", (~F.col("base_failed") & (F.col("posterior") >= 0.5)).alias("kept"))

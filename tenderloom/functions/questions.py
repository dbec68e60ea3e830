"""Questions put to a search: what they ask for, rewritten, and the bonus of hits."""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words of a question, the kind of source they mean and the words to focus on;
# phrases and what they go by as well; the digest's key.
KINDS = (
    ("policy", "Policy", ("policy",)), ("invoice", "Invoice", ("invoice",)), ("purchase order", "PO", ("purchase order", "po")), ("po", "PO", ("purchase order", "po")),
    ("quote", "Quote", ("quote", "quotation")), ("quotation", "Quote", ("quote", "quotation")), ("contract", "Contract", ("contract", "agreement")), ("agreement", "Contract", ("contract", "agreement")),
)
OTHER_WORDS = {"payment terms": ("net terms", "discount period"), "lead time": ("delivery time", "turnaround"), "escalation": ("escalation clause",)}
PERSON = b"rag_hash"


def _asked(low: Column, word: str) -> Column:
    """Whether a word is in a question; the short one as a word of its own."""
    return low.rlike(r"\bpo\b") if word == "po" else low.contains(word)


def _plain(question: Column) -> Column:
    """Single blanks, and numbers of orders written out."""
    return F.regexp_replace(F.btrim(F.regexp_replace(F.coalesce(question, F.lit("")), r"\s+", " ")), r"(?i)\bpo[-\s]?(\d{3,})\b", "purchase order $1")


def rewritten(question: Column) -> Column:
    """The question with numbers of orders written out and the other words for its
    phrases behind it, each once and sorted; null and blank ones are empty."""
    plain = _plain(question)
    more = [F.when(F.lower(plain).contains(p), F.array(*map(F.lit, words))).otherwise(F.array().cast("array<string>")) for p, words in OTHER_WORDS.items()]
    return F.btrim(F.concat_ws(" ", plain, F.array_join(F.array_sort(F.array_distinct(F.concat(*more))), " ")))


def sources_of(question: Column) -> Column:
    """The kinds of source that it asks for, sorted."""
    low = F.lower(_plain(question))
    return F.array_sort(F.array_distinct(F.filter(F.array(*[F.when(_asked(low, w), k) for w, k, _ in KINDS]), lambda x: x.isNotNull())))


def focus_of(question: Column) -> Column:
    """The words to focus on, sorted."""
    low = F.lower(_plain(question))
    every = [F.when(_asked(low, w), F.array(*map(F.lit, words))).otherwise(F.array().cast("array<string>")) for w, _, words in KINDS]
    return F.array_sort(F.array_distinct(F.concat(*every)))


def bonus(collection: Column, kind: Column, source: Column, weights: dict[str, dict[str, float]], policy_asked: Column, focused: Column, in_focus: Column, policies: str = "static_policy") -> Column:
    """What a hit gets on top for its collection and document type: the weights
    (by collection and by document_type), less for policies unless they are asked for, at
    least so much for what is asked for and in focus, next to nothing for policies
    where another kind is in focus."""
    told = lambda c, name: reduce(lambda x, kv: x.when(c == kv[0], float(kv[1])), weights.get(name, {}).items(), F.when(F.lit(False), 0.0)).otherwise(0.0)
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    of_policies, yes = F.coalesce(collection == policies, F.lit(False)), lambda c: F.coalesce(c, F.lit(False))
    is_policy = of_policies | low(kind).contains("policy") | low(source).contains("policy")
    asked, focus, within = yes(policy_asked), yes(focused), yes(in_focus)
    a, b = told(collection, "collection"), told(low(kind), "document_type")
    a, b = F.when(of_policies & ~asked, F.least(a, F.lit(0.08))).otherwise(a), F.when(of_policies & ~asked, F.least(b, F.lit(0.05))).otherwise(b)
    a, b = F.when(is_policy & asked, F.greatest(a, F.lit(0.14))).otherwise(a), F.when(is_policy & asked, F.greatest(b, F.lit(0.1))).otherwise(b)
    away = focus & ~within & ~asked & is_policy
    a = F.when(focus & within, F.greatest(a, F.lit(0.12)) + 0.12).when(away, F.least(a, F.lit(0.02))).otherwise(a)
    b = F.when(focus & within & (low(kind) != ""), F.greatest(b, F.lit(0.1))).when(away, 0.0).otherwise(b)
    return a + b


def signed_vector(words: Column, dims: int = 64) -> Column:
    """Words -> a vector of length 1: each word adds 1 or takes it away in one of `dims`
    places, both by its keyed digest; null without words or where all cancel out."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def fold(texts: pd.Series) -> pd.Series:
        known: dict[str, tuple[int, int]] = {}

        def place(w: str) -> tuple[int, int]:
            if w not in known:
                d = hashlib.blake2b(w.encode(), digest_size=8, person=PERSON).digest()
                known[w] = int.from_bytes(d[:4], "big") % dims, 1 - 2 * (d[4] & 1)
            return known[w]

        def one(own) -> list[float] | None:
            if own is None or not len(own):
                return None
            at = np.array([place(w) for w in own])
            v = np.bincount(at[:, 0], weights=at[:, 1], minlength=dims)
            norm = np.sqrt(v @ v)
            return (v / norm).tolist() if norm else None

        return texts.map(one)

    return fold(words)

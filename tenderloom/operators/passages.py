"""Passages of texts: sentences that answer a query and differ from each other,
and lines by kind with the section that they stand in.

Both work within a row, without a shuffle.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a selection, its share of the text, sentences that enter at a time, and the weight of relevance against novelty.
MOST_CHARS, MOST_SHARE, CONSIDERED, RELEVANCE = 1200, 0.7, 50, 0.75
#: A text of so few sentences that are all short stays as it is.
FEW, SHORT = 3, 120


def sentences(text: str) -> list[str]:
    """Runs up to and with the marks . ! ?, without space around them."""
    return [s for s in (x.strip(" \t\n\v\f\r") for x in re.findall("[^.!?]+[.!?]*", text)) if s]


def words(text: str) -> frozenset[str]:
    """Distinct lower-case runs of a-z and 0-9."""
    return frozenset(re.findall("[a-z0-9]+", text.lower()))


_asked = lru_cache(64)(words)


def likeness(a: frozenset[str], b: frozenset[str]) -> float:
    """The cosine of two sets of words; 0 if either is empty."""
    return len(a & b) / math.sqrt(len(a) * len(b)) if a and b else 0.0


def selected(text: str, query: str, most_chars: int) -> tuple[str, int]:
    """The selection of one text and the number of its sentences."""
    every = sentences(text)
    if len(every) <= FEW and all(len(s) < SHORT for s in every):
        return text[:most_chars], len(every)
    q, ranked = _asked(query), []
    for i, s in enumerate(every):
        w = words(s)
        ranked.append((-min(1.0, 0.1 + 0.9 * len(q & w) / (len(w) + 1)), i, s, w))
    ranked.sort()
    count = Counter(x for *_, w in ranked for x in w)
    # A value only falls as more are chosen, so one is worked out anew when it is the best so far; ties go by rank.
    # The next CONSIDERED enter once the first of them, as yet like nothing, could be the best. Sentences of as many
    # words that differ only in words of no other sentence are as like the rest: they are compared once (`like`).
    heap, fed, limit, chars, chosen, like = [], 0, min(most_chars, math.floor(len(text) * MOST_SHARE)), 0, [], {}
    while (heap or fed < len(ranked)) and (not chosen or chars < limit):
        if fed < len(ranked) and (not heap or heap[0][:2] > (RELEVANCE * ranked[fed][0], fed)):
            for j in range(fed, min(fed + CONSIDERED, len(ranked))):
                heapq.heappush(heap, (RELEVANCE * ranked[j][0], j, 0))
            fed += CONSIDERED
            continue
        _, j, seen = heap[0]
        r, _, s, w = ranked[j]
        if seen < len(chosen):
            kind = frozenset(x for x in w if count[x] > 1), len(w)
            near, seen = like.get(kind, (0.0, 0))
            near = max(near, *(likeness(w, ranked[k][3]) for k in chosen[seen:])) if seen < len(chosen) else near
            like[kind] = near, len(chosen)
            heapq.heapreplace(heap, (RELEVANCE * r + (1 - RELEVANCE) * near, j, len(chosen)))
            continue
        heapq.heappop(heap)
        if chosen and chars + len(s) > limit:
            break
        chosen.append(j)
        chars += len(s) + 1
    return " ".join(ranked[j][2] for j in chosen)[:most_chars], len(chosen)


def select_sentences(docs: DataFrame, query: str, text: str = "text", most_chars: int = MOST_CHARS) -> DataFrame:
    """docs with selection and n_selected: sentences of the text for the query (a
    column of docs), greedily by RELEVANCE * relevance - (1 - RELEVANCE) * the
    likeness to the nearest one chosen; ties go to the more relevant, then the
    earlier one. relevance is 0.1 + 0.9 * (words in common) / (words of the sentence + 1).

    The first one is always taken; the next is as long as they stay, joined by
    spaces, within most_chars and MOST_SHARE of the text. All sentences compete;
    a row's work is a sort of them and the likenesses of those that come up. A text of up to FEW
    sentences, all short, stays. Longer selections are cut at most_chars; a null
    text gives a null selection. Columns of the results' names are replaced.
    """
    kept = [c for c in docs.columns if c not in ("selection", "n_selected")]

    def select(texts: pa.Array, queries: pa.Array) -> pa.Array:
        pairs = ((t.as_py(), q.as_py() or "") for t, q in zip(texts, queries, strict=True))
        return pa.array([None if t is None else selected(t, q, most_chars) for t, q in pairs], pa.struct([("selection", pa.string()), ("n_selected", pa.int32())]))

    picked = F.arrow_udf(select, "selection string, n_selected int")(F.col(text).cast("string"), F.col(query).cast("string"))
    rows = docs.select(*kept, picked.alias("_picked"))
    return rows.select(*kept, "_picked.selection", "_picked.n_selected")


def line_kinds(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, line (from 1), kind, section, name, value of every line that is not
    blank. kind is the first that holds: `table` (a tab, a bar or two spaces inside),
    `key_value` (up to 40 characters, a colon and a value), `title` (capitals only, up
    to 6 words), `heading` (up to 8 words without a mark at the end, beginning with a
    capital or a number), else `paragraph`. section is the number of titles and
    headings up to the line. name and value are those of key_value lines. A null
    text has no line."""
    trimmed = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda s: F.struct(F.regexp_replace(s, "[ \\t-\\r]+$", "").alias("raw"), F.regexp_replace(s, "^[ \\t-\\r]+|[ \\t-\\r]+$", "").alias("s")))
    parts = lambda s: F.size(F.filter(F.split(s, "[ \\t-\\r]+"), lambda w: w != ""))

    def kind(x: Column) -> Column:
        s = x["s"]
        table = F.contains(x["raw"], F.lit("\t")) | F.contains(x["raw"], F.lit("  ")) | F.contains(x["raw"], F.lit(" | "))
        pair = s.rlike("^[A-Za-z][^:\\n]{0,39}:[ \\t]*[^ \\t]")
        title = s.rlike("[A-Z]") & (F.upper(s) == s) & (parts(s) <= 6)
        heading = s.rlike("^[A-Z0-9]") & ~s.rlike("[.!?,;:]$") & (parts(s) <= 8)
        return F.when(table, "table").when(pair, "key_value").when(title, "title").when(heading, "heading").otherwise("paragraph")

    told = F.filter(F.transform(trimmed, lambda x, i: F.struct((i + 1).alias("line"), x["s"].alias("s"), kind(x).alias("kind"))), lambda x: x["s"] != "")
    rows = docs.select(F.col(key).alias("_k"), told.alias("lines"))
    opens = F.transform(F.filter("lines", lambda x: x["kind"].isin("title", "heading")), lambda x: x["line"])
    rows = rows.select("_k", "lines", opens.alias("opens"))
    out = rows.select("_k", "opens", F.explode("lines").alias("x"))
    section = F.size(F.filter("opens", lambda o: o <= F.col("x.line")))
    pair = F.col("x.kind") == "key_value"
    part = lambda n: F.when(pair, F.btrim(F.regexp_extract("x.s", "^([^:]*):(.*)$", n), F.lit(" \t\r\f\x0b")))
    return out.select(F.col("_k").alias(key), F.col("x.line").alias("line"), F.col("x.kind").alias("kind"), section.alias("section"), part(1).alias("name"), part(2).alias("value"))

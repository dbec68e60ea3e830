"""Chunks of texts by paragraphs and sentences, and contexts packed from ranked
hits under a budget.

A document is chunked inside its row. A context is made of a query's first
hits, whose number is a parameter of the search before it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of a chunk, and how many of the chunk before it a chunk repeats at least.
LIMIT, OVERLAP = 1800, 200
#: Characters of a context, and the documents that it holds at least, if it can.
BUDGET, LEAST_DOCUMENTS = 12000, 3
#: Characters of chunks that go back to Spark at once.
AT_ONCE = 1 << 20

_SPACE = " \t\n\x0b\x0c\r"
_AFTER_SENTENCE = re.compile(rf"(?<=[.!?])[{_SPACE}]+")


def _joined(pieces: list[str], limit: int) -> list[str]:
    """Neighbours joined by a space as long as they stay within the limit; a
    longer piece stands alone."""
    out: list[list[str]] = []
    size = 0
    for piece in pieces:
        if not out or size + len(piece) + 1 > limit:
            out.append([])
            size = 0
        out[-1].append(piece)
        size += len(piece) + 1
    return [" ".join(x) for x in out]


def _tail(part: str, least: int) -> str:
    """The last sentences of a part that have `least` characters together."""
    taken: list[str] = []
    size = 0
    for sentence in reversed(_AFTER_SENTENCE.split(part)):
        if size >= least:
            break
        taken.append(sentence)
        size += len(sentence) + 1
    return " ".join(reversed(taken))


def chunked(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[str]:
    """The chunks of one text, see passage_chunks."""
    parts: list[str] = []
    for paragraph in re.split("\n{2,}", text):
        paragraph = paragraph.strip(_SPACE)
        if paragraph:
            parts += [paragraph] if len(paragraph) <= limit else _joined(_AFTER_SENTENCE.split(paragraph), limit)
    chunks: list[list[str]] = []
    size = 0
    for part in parts:
        if not chunks or size + len(part) + 2 > limit:
            lead = _tail(chunks[-1][-1], overlap) if chunks and overlap > 0 else ""
            fits = lead != "" and len(lead) + len(part) + 2 <= limit
            chunks.append([lead] if fits else [])
            size = len(lead) if fits else 0
        chunks[-1].append(part)
        size += len(part) + 2
    return [re.sub(f"[{_SPACE}]+", " ", " ".join(x)) for x in chunks]


def _cut(batches: Iterator[pa.RecordBatch], names: list[str], limit: int, overlap: int) -> Iterator[pa.RecordBatch]:
    """Keys, places and chunks of (key, text), a text at a time: what a worker
    holds beyond the batch is AT_ONCE characters and one text's chunks."""
    for batch in batches:
        keys, texts = batch.column(0), batch.column(1)
        at: list[int] = []
        places: list[int] = []
        out: list[str] = []
        size = 0
        for i in range(len(texts)):
            found = chunked(texts[i].as_py(), limit, overlap)
            at += [i] * len(found)
            places += range(len(found))
            out += found
            size += sum(map(len, found))
            if out and (size >= AT_ONCE or i + 1 == len(texts)):
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(at, pa.int32())), pa.array(places, pa.int32()), pa.array(out, pa.string())], names)
                at, places, out, size = [], [], [], 0


def passage_chunks(docs: DataFrame, key: str, text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """key, chunk (from 0), content: paragraphs (between blank lines) are packed
    as long as a chunk stays within `limit` characters; a longer paragraph is
    cut between sentences first. A chunk begins with the last sentences of the one
    before it that have `overlap` characters together, unless its first part
    leaves no room for them. A sentence longer than the limit is a part of its
    own. Runs of space become one. Null and blank texts have no chunk; other
    columns of docs are left out."""

    names = [key, "chunk", "content"]
    rows = docs.select(F.col(key), F.col(text).alias("_text")).where("_text is not null")
    kept = T.StructType([rows.schema[0], T.StructField("chunk", T.IntegerType(), False), T.StructField("content", T.StringType(), False)])
    return rows.mapInArrow(lambda batches: _cut(batches, names, limit, overlap), kept)


def packed(blocks: list[tuple[str | None, int, int]], budget: int, least: int) -> list[tuple[int, int]]:
    """Positions of blocks (document, length of its mark, length of its text) and
    the characters of text taken, in the order of the context; see packed_context."""
    out: list[tuple[int, int]] = []
    used = 0
    cost = lambda at, n: blocks[at][1] + n

    def room(at: int) -> int:
        return min(blocks[at][2], budget - used - blocks[at][1])

    for at in range(len(blocks)):
        n = room(at)
        if n > 0:
            out.append((at, n))
            used += cost(at, n)
    first: dict[str, int] = {}
    for at, (doc, _, size) in enumerate(blocks):
        if doc is not None and size > 0:
            first.setdefault(doc, at)
    for doc, at in first.items():
        held = [blocks[i][0] for i, _ in out]
        if len(set(held) - {None}) >= min(least, len(first)):
            break
        if doc in held:
            continue
        if room(at) <= 0:
            spare = [j for j, d in enumerate(held) if held.count(d) > 1]
            if not spare:
                continue
            dropped = out.pop(spare[-1])
            used -= cost(*dropped)
        n = room(at)
        if n > 0:
            out.append((at, n))
            used += cost(at, n)
    return out


def packed_context(hits: DataFrame, document: str, text: str, budget: int = BUDGET, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """query_id, place (from 1), rank, document, n_chars, block: the context of
    each query. hits (query_id, rank, document, text) are the first n of a
    ranked search.

    A block is `[document] text` and two line ends. Blocks come in rank order while
    the budget lasts; one that doesn't fit whole is cut, one without room for a
    character is left out. If fewer than `least` documents are in it, the best hit of
    each missing one is added in rank order; where it has no room, the last
    block of a document with several makes some. A null document is `unknown` and
    counts as none; hits with a null or empty text are left out. Equal ranks are
    taken by document, then text.
    """
    schema = "query_id long, place int, rank int, document string, n_chars int, block string"

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["rank", "document", "text"], na_position="last")
        marks = [f"[{'unknown' if d is None else d}] " for d in rows.document]
        chosen = packed([(d, len(m) + 2, len(t)) for d, m, t in zip(rows.document, marks, rows.text, strict=True)], budget, least)
        q, ranks, docs, texts = rows.query_id.iloc[0], list(rows["rank"]), list(rows.document), list(rows.text)
        return pd.DataFrame([(q, place, ranks[at], docs[at], n, f"{marks[at]}{texts[at][:n]}\n\n") for place, (at, n) in enumerate(chosen, 1)], columns=["query_id", "place", "rank", "document", "n_chars", "block"])

    # A text longer than the budget can't be used beyond it.
    rows = hits.select(F.col("query_id").cast("long").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col(document).cast("string").alias("document"), F.substring(text, 1, budget).alias("text")).where("text <> '' and query_id is not null")
    return rows.groupBy("query_id").applyInPandas(pack, schema)

"""Small documents with nulls, empty texts, copies, ties and clashing columns."""

from __future__ import annotations

import random

WORDS = [f"w{i}" for i in range(60)]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def rows() -> list[tuple]:
    base, other = prose(1, 120), prose(2, 300)
    near = base.split()
    near[60] = "changed"
    out = [
        (1, base),
        (2, " ".join(near)),
        (3, base),
        (4, None),
        (5, ""),
        (6, "   \t\n "),
        (7, "one"),
        (8, "one"),
        (9, other),
        (10, prose(3, 40) + " " + " ".join(other.split()[100:150]) + " " + prose(4, 30)),
        (11, "Größe été İstanbul 日本語 text 😀 <|endoftext|> it's 3.14"),
        (12, prose(5, 20000)),
        (13, "A" * 5000),
        (14, "same same " * 200),
        (15, base.upper()),
    ]
    return [*out, out[8], (None, "no id here at all"), (None, None)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, ids string, start int, grp int, media int"


def documents(spark):
    """With extra columns whose names clash with those of results."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y", 1, 2, 3) for i, t in rows()], SCHEMA)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)

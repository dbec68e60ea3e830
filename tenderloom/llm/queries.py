"""The registered query of each corpus operator, with production parameters,
over whole tables; and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderloom.llm import blocks, bpe, language, leaks, licenses, media, near, private, quality, ranked, repeats, rules, whitening
from tenderloom.llm.common import residue


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    found = media.read(media.encode(docs))
    return found.select(
        "doc_id", "n_bytes", F.col("n_samples").alias("payload_bytes"), F.col("sample_sha256").alias("payload_sha256"), "tail_crc32", "media_bytes", "media_sha256", "feature"
    )


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op10_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = blocks.write(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=1)
    return blocks.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.drop_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs.where(residue("doc_id", 4) != 2))
    found = language.identify(docs.select("doc_id", "text", F.coalesce(residue("doc_id", 4) == 2, F.lit(False)).alias("held_out")), model)
    return found.select("doc_id", "held_out", "lang_pred", "score", "entropy", "rejected")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train(docs, labels.where(residue("doc_id", 3) != 1))
    found = quality.score(docs.select("doc_id", "text", F.coalesce(residue("doc_id", 3) == 1, F.lit(False)).alias("held_out")), model)
    return found.select("doc_id", "held_out", "score", "predicted")


def op4_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = private.find(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select("doc_id", *map(count, private.KINDS), F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))


def op8_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(table(spark, sf_dir, "documents"), k=2, percent=80)


def op11_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def op12_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = whitening.train(vectors)
    found = whitening.whiten(vectors, model)
    return found.select("vec_id", "component", "n", F.col("deviation").try_cast("long").alias("deviation"), "whitened", "explained", F.lit(model.identity_error).cast("double").alias("identity_error"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_media": op1_media,
    "op2_bpe": op2_bpe,
    "op3_repeats": op3_repeats,
    "op4_leaks": op4_leaks,
    "op5_private": op5_private,
    "op6_licenses": op6_licenses,
    "op7_language": op7_language,
    "op9_quality": op9_quality,
    "op8_near": op8_near,
    "op10_blocks": op10_blocks,
    "op11_ranked": op11_ranked,
    "op12_rules": op12_rules,
    "op13_whitening": op13_whitening,
}
#: Words of a text, A-Z lower-cased, as a list.
_LOWER_WORDS = r"""list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"""

OP8_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_LOWER_WORDS} AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) < 2 THEN ws ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS sh FROM w),
u AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS s FROM s),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared, min(a.n) AS n, min(b.n) AS m FROM u a JOIN u b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM c WHERE 100 * shared >= 80 * (n + m - shared)),
reach(x, y) AS (SELECT x, y FROM l UNION SELECT reach.x, l.y FROM reach JOIN l ON reach.y = l.x),
least AS (SELECT x AS doc_id, min(y) AS y FROM reach GROUP BY 1)
SELECT s.doc_id, len(sh)::BIGINT AS n_shingles, least(s.doc_id, coalesce(y, s.doc_id)) AS component_id, s.doc_id = least(s.doc_id, coalesce(y, s.doc_id)) AS kept
FROM s LEFT JOIN least ON s.doc_id = least.doc_id
"""

_WORDS = r"""list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"""

OP3_SQL = f"""
WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 33)) AS i, ws FROM w WHERE len(ws) >= 35),
h AS (SELECT doc_id, i, array_to_string(ws[i : i + 34], ' ') AS s FROM g),
r AS (SELECT s FROM h GROUP BY s HAVING count(*) > 1),
p AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM h SEMI JOIN r USING (s)),
d AS (SELECT doc_id, list(p) AS gone FROM p GROUP BY doc_id),
k AS (SELECT w.doc_id, ws, coalesce(gone, []) AS gone, list_filter(range(1, len(ws) + 1), lambda i: NOT list_contains(coalesce(gone, []), i)) AS left_over FROM w LEFT JOIN d USING (doc_id))
SELECT doc_id, len(ws)::BIGINT AS n_words, len(gone)::BIGINT AS n_removed, sha256(array_to_string(list_transform(left_over, lambda i: ws[i]), ' ')) AS kept_sha256 FROM k
"""

_PAIRS = "list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))"
_NORMAL = f"string_split(trim(regexp_replace(translate({{}}, '{licenses.UPPER}', '{licenses.LOWER}'), '[^a-z0-9]+', ' ', 'g')), ' ')"
_NOTICES = ", ".join(f"('{k}', '{v}')" for k, v in sorted(licenses.TEMPLATES.items()))

OP6_SQL = f"""
WITH t0 AS (SELECT license, {_NORMAL.format("body")} AS ws FROM (VALUES {_NOTICES}) v(license, body)),
t AS (SELECT license, {_PAIRS} AS b FROM t0),
g AS (SELECT DISTINCT doc_id, unnest(list_concat(string_split(text, chr(10)), regexp_split_to_array(text, '\\n[ \\t\\r]*\\n'), [text])) AS seg FROM documents),
s0 AS (SELECT doc_id, seg, {_NORMAL.format("seg")} AS ws FROM g),
s AS (SELECT doc_id, seg, {_PAIRS} AS b FROM s0 WHERE len(ws) > 1),
x AS (SELECT doc_id, seg, len(b) AS n, unnest(b) AS p FROM s),
y AS (SELECT license, len(b) AS m, unnest(b) AS p FROM t),
c AS (SELECT doc_id, seg, license, 2.0 * count(*) / (n + m) AS dice FROM x JOIN y USING (p) GROUP BY doc_id, seg, license, n, m),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, seg ORDER BY dice DESC, license) AS k FROM c WHERE dice >= 0.8)
SELECT doc_id, license, count(*) AS n_segments, round(max(dice), 6) AS dice FROM r WHERE k = 1 GROUP BY doc_id, license
"""

_TERMS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

OP11_SQL = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS ts FROM documents),
s AS (SELECT count(*) FILTER (len(ts) > 0) AS n, sum(len(ts))::BIGINT AS l FROM d),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(ts) AS n, unnest(ts) AS term FROM d) GROUP BY ALL),
q AS (SELECT item_id, term, count(*) AS c FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(s.n) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, s GROUP BY term),
x AS (SELECT item_id, doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * p.n * s.n) // s.l))))::BIGINT AS score FROM q JOIN w USING (term) JOIN p USING (term), s GROUP BY ALL HAVING score > 0)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score FROM x QUALIFY rank <= 10
"""

#: The rules, as SQL: when they say bad, when good.
_VOTES = {
    "symbols": ("10 * n_symbols >= n_words", "100 * n_symbols <= n_words"),
    "capitals": ("2 * n_capitals >= n_words", "10 * n_capitals <= n_words"),
    "marks": ("2 * n_marks >= n_words", "10 * n_marks <= n_words"),
    "word_length": ("word_chars < 2 * n_words OR word_chars > 12 * n_words", "word_chars BETWEEN 3 * n_words AND 9 * n_words"),
    "sentences": ("n_ends = 0 OR 2 * n_ends > n_words", "3 * n_ends <= n_words AND 100 * n_ends >= n_words"),
    "repetition": ("10 * n_repeat_words > 3 * n_words", "20 * n_repeat_words <= 3 * n_words"),
    "vocabulary": ("20 * n_distinct < n_words", "5 * n_distinct >= n_words"),
    "lines": ("10 * n_dup_lines > 3 * n_lines", "n_dup_lines = 0 AND n_lines >= 2"),
    "digits": ("10 * n_digits > 3 * word_chars", "20 * n_digits <= 3 * word_chars"),
}
_share = lambda a, b: f"((coalesce(sum({a}), 0) + 0.9) / (coalesce(sum({a}), 0) + coalesce(sum({b}), 0) + 1))"
_part = lambda v, s, q: f"CASE WHEN {v} = {s} THEN n * {q} ELSE 0 END"
_A = {v: f"least(greatest({_share(_part(v, 1, 'q'), _part(v, -1, 'q'))}, 0.5), 0.999)" for v in _VOTES}
_M = "least(greatest((coalesce(sum(n * q), 0) + 0.9) / (coalesce(sum(n), 0) + 1), 0.05), 0.95)::DOUBLE AS prior, " + ", ".join(f"{_A[v]}::DOUBLE AS a_{v}, least(greatest({_share(_part(v, -1, '(1 - q)'), _part(v, 1, '(1 - q)'))}, 1 - {_A[v]}), 0.999)::DOUBLE AS b_{v}" for v in _VOTES)
_ODDS = "ln(prior / (1 - prior)) + " + " + ".join(f"CASE {v} WHEN 1 THEN ln(a_{v} / (1 - b_{v})) WHEN -1 THEN ln((1 - a_{v}) / b_{v}) ELSE 0 END" for v in _VOTES)
_DOUBTED = " OR ".join(f"({v} = -1 AND 2 * sum(CASE WHEN {v} = -1 THEN n ELSE 0 END) OVER () <= sum(CASE WHEN {v} <> 0 THEN n ELSE 0 END) OVER ())" for v in _VOTES)
OP12_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 2)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS p FROM r) GROUP BY doc_id),
s AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines, len(list_distinct(ws)) AS n_distinct,
  len(regexp_extract_all(t, '[A-Z][A-Z]')) AS n_capitals, len(regexp_extract_all(t, '[!?]')) AS n_marks, len(regexp_extract_all(t, '[0-9]')) AS n_digits, len(regexp_extract_all(t, '[.!?]([\x20\x09-\x0D]|\z)')) AS n_ends
  FROM w LEFT JOIN c USING (doc_id)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {", ".join(f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END AS {name}" for name, (bad, good) in _VOTES.items())} FROM s),
p AS (SELECT {", ".join(_VOTES)}, count(*) AS n FROM v WHERE NOT base_failed GROUP BY ALL),
em AS (SELECT 0 AS it, {_M} FROM (SELECT *, CASE WHEN {_DOUBTED} THEN 0.1 ELSE 0.9 END AS q FROM p)
  UNION ALL SELECT it + 1, {_M} FROM (SELECT p.*, it, 1 / (1 + exp(-({_ODDS}))) AS q FROM p, em WHERE it < 20) GROUP BY it)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 1 / (1 + exp(-({_ODDS}))) >= 0.5 AS kept FROM v, (SELECT * FROM em WHERE it = 20)
"""

ORACLE_SQL: dict[str, str] = {"op6_licenses": OP6_SQL, "op3_repeats": OP3_SQL, "op8_near": OP8_SQL, "op11_ranked": OP11_SQL, "op12_rules": OP12_SQL}

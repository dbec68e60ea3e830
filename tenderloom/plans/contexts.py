"""Registered queries of chunks by passages and contexts packed from them, with
the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tenderloom.operators import chunking, reports, retrieval
from tenderloom.plans.more import query
from tenderloom.sources.shared import written

_CUT = "string_split(regexp_replace({}, '([.!?])[ \\t-\\r]+', '\\1' || chr(2) || chr(3), 'g'), chr(2) || chr(3))"

#: passages(doc_id, chunk, content), by two walks: sentences of long paragraphs to parts, parts to chunks.
_PASSAGES = rf"""paragraphs AS (SELECT doc_id, unnest(ps) AS p, unnest(range(len(ps))) AS spot FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n\n+'), lambda s: regexp_replace(s, '^[ \t-\r]+|[ \t-\r]+$', '', 'g')), lambda s: s <> '') AS ps FROM documents WHERE text IS NOT NULL)),
sentences AS (SELECT doc_id, spot, CASE WHEN length(p) <= 1800 THEN [p] ELSE {_CUT.format('p')} END AS ss FROM paragraphs),
walk AS (SELECT doc_id, spot, 1 AS k, 0 AS part, length(ss[1]) + 1 AS n, ss FROM sentences
  UNION ALL SELECT doc_id, spot, k + 1, CASE WHEN n + length(ss[k + 1]) + 1 > 1800 THEN part + 1 ELSE part END, CASE WHEN n + length(ss[k + 1]) + 1 > 1800 THEN 0 ELSE n END + length(ss[k + 1]) + 1, ss FROM walk WHERE k < len(ss)),
parts AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY spot, part) AS i, t, {_CUT.format('t')} AS ss FROM (SELECT doc_id, spot, part, string_agg(ss[k], ' ' ORDER BY k) AS t FROM walk GROUP BY ALL)),
tails AS (SELECT doc_id, i, t, length(t) AS size, array_to_string(list_transform(list_filter(range(1, len(ss) + 1), lambda m: coalesce(list_sum(list_transform(ss[m + 1:], lambda x: length(x) + 1)), 0) < 200), lambda m: ss[m]), ' ') AS tail FROM parts),
filled AS (SELECT doc_id, i, 0 AS chunk, size + 2 AS n, NULL::VARCHAR AS lead, tail FROM tails WHERE i = 1
  UNION ALL SELECT t.doc_id, t.i, CASE WHEN n + size + 2 > 1800 THEN chunk + 1 ELSE chunk END, CASE WHEN n + size + 2 <= 1800 THEN n + size + 2 WHEN length(f.tail) + size + 2 <= 1800 THEN length(f.tail) + size + 2 ELSE size + 2 END, CASE WHEN n + size + 2 > 1800 AND length(f.tail) + size + 2 <= 1800 THEN f.tail END, t.tail FROM filled f JOIN tails t ON t.doc_id = f.doc_id AND t.i = f.i + 1),
passages AS (SELECT doc_id, chunk, regexp_replace(string_agg(coalesce(lead || ' ', '') || t, ' ' ORDER BY i), '[ \t-\r]+', ' ', 'g') AS content FROM filled JOIN tails USING (doc_id, i) GROUP BY ALL)"""


@query(f"""{{recursive}}, {_PASSAGES}
SELECT doc_id, chunk::INTEGER AS chunk, length(content)::INTEGER AS n_chars, sha1(content) AS content_sha1 FROM passages""")
def passages_chunked(t):
    return chunking.passage_chunks(t.raw("documents"), "doc_id").select("doc_id", "chunk", F.char_length("content").alias("n_chars"), F.sha1(F.col("content").cast("binary")).alias("content_sha1"))


@query(f"""{{recursive}}, {_PASSAGES},
cw AS (SELECT doc_id * 100000 + chunk AS c, list_filter(regexp_split_to_array(lower(content), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM passages),
asked AS (SELECT DISTINCT item_id AS query_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS term FROM benchmark WHERE item_id % 100 = 0),
ct AS (SELECT c, size, term, count(*) AS tf FROM (SELECT c, len(w) AS size, unnest(w) AS term FROM cw) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
cd AS (SELECT term, ln((m - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE) + 1) AS idf, mean FROM ct, (SELECT count(*) AS m, avg(len(w)) AS mean FROM cw) GROUP BY term, m, mean),
cs AS (SELECT query_id, c, round(sum((idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * size / mean)))::DECIMAL(28,12))::DOUBLE, 6) AS score FROM ct JOIN cd USING (term) JOIN asked USING (term) GROUP BY ALL),
h AS (SELECT query_id, rank, c, c // 100000 AS d, length(content) AS size, length((c // 100000)::VARCHAR) + 5 AS mark, content FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, c) AS rank FROM cs) JOIN passages p ON p.doc_id * 100000 + p.chunk = c WHERE rank <= 30),
l AS (SELECT query_id, list(struct_pack(rank := rank, d := d, size := size, mark := mark) ORDER BY rank) AS l FROM h GROUP BY 1),
fill AS (SELECT query_id, l, 0 AS k, 0::BIGINT AS used, []::STRUCT(i BIGINT, d BIGINT, n BIGINT, cost BIGINT)[] AS o FROM l
  UNION ALL SELECT query_id, l, k + 1, used + CASE WHEN n > 0 THEN n + l[k + 1].mark ELSE 0 END, CASE WHEN n > 0 THEN list_append(o, struct_pack(i := (k + 1)::BIGINT, d := l[k + 1].d, n := n, cost := n + l[k + 1].mark)) ELSE o END FROM (SELECT *, least(l[k + 1].size, 12000 - used - l[k + 1].mark) AS n FROM fill WHERE k < len(l))),
heads AS (SELECT query_id, list(i ORDER BY i) AS a FROM (SELECT query_id, min(rank) AS i FROM h GROUP BY query_id, d) GROUP BY 1),
more AS (SELECT query_id, l, a, 0 AS k, used, o FROM fill JOIN heads USING (query_id) WHERE k = len(l)
  UNION ALL SELECT query_id, l, a, k + 1, CASE WHEN add THEN left_over + n + x.mark ELSE left_over END, CASE WHEN add THEN list_append(kept, struct_pack(i := a[k + 1], d := x.d, n := n, cost := n + x.mark)) ELSE kept END
  FROM (SELECT *, wanted AND n > 0 AS add FROM (SELECT *, least(x.size, 12000 - left_over - x.mark) AS n FROM (SELECT *, CASE WHEN frees THEN used - o[spare].cost ELSE used END AS left_over, CASE WHEN frees THEN list_concat(o[:spare - 1], o[spare + 1:]) ELSE o END AS kept
    FROM (SELECT *, coalesce(wanted AND least(x.size, 12000 - used - x.mark) <= 0 AND spare IS NOT NULL, false) AS frees FROM (SELECT *, l[a[k + 1]] AS x, NOT list_contains(list_transform(o, lambda y: y.d), l[a[k + 1]].d) AND len(list_distinct(list_transform(o, lambda y: y.d))) < least(3, len(a)) AS wanted, list_max(list_filter(range(1, len(o) + 1), lambda j: len(list_filter(o, lambda y: y.d = o[j].d)) > 1)) AS spare FROM more WHERE k < len(a))))))),
done AS (SELECT query_id, unnest(o) AS x, unnest(range(1, len(o) + 1)) AS place FROM more WHERE k = len(a))
SELECT done.query_id, place::INTEGER AS place, x.i::INTEGER AS rank, x.d::VARCHAR AS document, x.n::INTEGER AS n_chars, md5('[' || x.d || '] ' || content[:x.n] || chr(10) || chr(10)) AS block_md5 FROM done JOIN h ON h.query_id = done.query_id AND h.rank = x.i""")
def contexts_of_passages(t):
    """The 30 best passages of the stated queries, packed with at least three documents."""
    bench = t.raw("benchmark").where("item_id % 100 = 0").select(F.col("item_id").alias("query_id"), "text")
    passages = chunking.passage_chunks(t.raw("documents"), "doc_id").select((F.col("doc_id").cast("long") * 100000 + F.col("chunk")).alias("doc_id"), F.col("content").alias("text"))
    passages = written(passages, "passages")[0]  # read for sizes, terms and texts; cut once
    best = retrieval.bm25(passages, bench, 30)
    hits = passages.join(F.broadcast(best), "doc_id")  # 30 rows of each query, whose terms are broadcast as well
    out = chunking.packed_context(hits.withColumn("document", F.floor(F.col("doc_id") / 100000)), "document", "text")
    return out.select("query_id", "place", "rank", "document", "n_chars", F.md5("block").alias("block_md5"))


@query(
    """{views},
o AS (SELECT o_orderkey AS k, o_orderkey % 4 AS m, o_orderkey // 4 AS j FROM orders),
f AS (SELECT k, m, list_concat(CASE WHEN k % 5 = 0 THEN ['missing:' || ['invoice_id', 'po_id', 'quote_id', 'contract_id'][m + 1]] ELSE [] END,
  CASE WHEN m = 0 AND k % 7 = 0 AND k % 11 > 0 THEN ['buyer'] ELSE [] END, CASE WHEN k % 13 = 0 AND m <> 2 THEN ['dates:' || CASE m WHEN 0 THEN 'due_date' WHEN 1 THEN 'expected_delivery_date' ELSE 'contract_end_date' END] ELSE [] END) AS e,
  list_concat(CASE WHEN m = 0 AND k % 3 = 0 THEN ['vendor'] ELSE [] END, CASE WHEN j % 3 = 2 THEN ['line:2', 'line:3'] ELSE [] END, CASE WHEN j % 3 = 0 AND m < 3 THEN ['no_lines'] ELSE [] END, CASE WHEN m = 0 AND j % 2 = 1 THEN ['order'] ELSE [] END, CASE WHEN k % 17 = 0 THEN ['sign'] ELSE [] END) AS w FROM o)
SELECT k, (100 - list_sum(list_concat([0], list_transform(list_concat(e, w), lambda x: CASE split_part(x, ':', 1) WHEN 'missing' THEN 15 WHEN 'buyer' THEN 20 WHEN 'line' THEN 2 WHEN 'order' THEN 5 WHEN 'sign' THEN 5 ELSE 10 END)))) / 100.0::DOUBLE AS score, len(e) = 0 AS valid, array_to_string(e, ',') AS errors, array_to_string(w, ',') AS warnings FROM f"""
)
def reports_on_documents(t):
    """Headers, lines and texts of each order's document, some of them at odds."""
    k = F.col("o_orderkey")
    m, j = k % 4, F.floor(k / 4)
    pick = lambda *values: F.element_at(F.array(*map(F.lit, values)), (m + 1).cast("int"))
    day = F.col("o_orderdate")
    later = F.date_add(day, F.when(k % 13 == 0, -3).otherwise(30))
    fields = [
        (pick("invoice_id", "po_id", "quote_id", "contract_id"), F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("N"), k))),
        (pick("invoice_date", "order_date", "quote_date", "contract_start_date"), F.date_format(day, "dd/MM/yyyy")),
        (pick("due_date", "expected_delivery_date", "validity_date", "contract_end_date"), F.date_format(later, "yyyy-MM-dd")),
        (pick("invoice_total_incl_tax", "total_amount", "total_amount", "total"), F.col("o_totalprice").cast("string")),
        (F.lit("vendor_name"), F.lit("Acme Trading")),
        (F.lit("supplier_id"), F.lit("S1")),
        (F.lit("buyer_id"), F.concat(F.lit("Buyer "), F.col("o_custkey"))),
        (F.lit("currency"), F.when(k % 2 == 0, "GBP").otherwise("EUR")),
        (pick("po_id", "other", "other", "other"), F.concat(F.when(j % 2 == 1, "none ").otherwise(""), k)),
    ]
    line = lambda s: F.struct(F.lit(s).cast("string").alias("item_description"))
    lines = F.when(j % 3 == 1, F.array(line("bolts"))).when(j % 3 == 2, F.array(line("bolts"), line(None), line(""))).otherwise(F.array().cast("array<struct<item_description:string>>"))
    text = F.concat(
        F.when(k % 3 == 0, "Other Company").otherwise("ACME TRADING Ltd"),
        F.when(k % 11 == 0, "\n").otherwise(F.concat(F.lit("\nBill  To :\n"), F.when(k % 7 == 0, "somebody else").otherwise(F.concat(F.lit("BUYER "), F.col("o_custkey"))), F.lit("\n"))),
        F.when(k % 17 == 0, "100.00").otherwise(F.when(k % 2 == 0, "£100.00").otherwise("100.00 €")),
    )
    docs = t.raw("orders").select(k.alias("k"), pick("Invoice", "Purchase_Order", "Quote", "Contract").alias("doc_type"), F.map_from_arrays(F.array(*[name for name, _ in fields]), F.array(*[value for _, value in fields])).alias("header"), lines.alias("lines"), text.alias("text"))
    out = reports.quality_report(docs, t.raw("orders").select(F.col("o_orderkey").alias("po_id")))
    return out.select("k", "score", "valid", F.array_join("errors", ",").alias("errors"), F.array_join("warnings", ",").alias("warnings"))

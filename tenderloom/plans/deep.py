"""Registered queries of assignment, interval joins, ratios, sentence selection,
passages and packing, with the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tenderloom.operators import labels, passages, threads
from tenderloom.plans.more import query

#: Dispatches and responses out of the events: a user is a workflow of one of two.
_MESSAGES = """e AS (SELECT event_id AS k, (user_id // 2)::VARCHAR AS w, event_type AS subject, 'd' || user_id % 3 AS domain, ts FROM events),
d AS (SELECT k::VARCHAR AS unique_id, w, CASE WHEN k % 7 > 0 THEN subject END AS subject, domain, ts, 'h' || k AS h FROM e WHERE k % 4 < 2),
r AS (SELECT k::VARCHAR AS response_id, w, CASE WHEN k % 9 = 2 THEN (k - 2)::VARCHAR END AS unique_id, subject, CASE WHEN k % 2 = 0 THEN domain ELSE 'x' END AS domain, ts, CASE WHEN k % 5 = 0 THEN 'h' || (k - 2) END AS h FROM e WHERE k % 4 >= 2)"""


def _messages(t):
    k = F.col("event_id")
    e = t.raw("events").select(k, F.floor(F.col("user_id") / 2).cast("string").alias("workflow_id"), F.col("event_type").alias("subject"), F.concat(F.lit("d"), F.col("user_id") % 3).alias("domain"), "ts")
    head = lambda n: F.concat(F.lit(" <H"), n.cast("string"), F.lit("> "))
    sent = e.where(k % 4 < 2).select(k.alias("unique_id"), "workflow_id", F.when(k % 7 > 0, F.col("subject")).alias("subject"), "domain", "ts", F.array(head(k)).alias("headers"))
    got = e.where(k % 4 >= 2).select(k.alias("response_id"), F.when(k % 9 == 2, k - 2).alias("unique_id"), "workflow_id", "subject", F.when(k % 2 == 0, F.col("domain")).otherwise("x").alias("domain"), "ts", F.when(k % 5 == 0, F.array(head(k - 2))).alias("headers"))
    return sent, got


@query(
    f"""{{recursive}}, {_MESSAGES},
rk AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY ts, response_id) AS k FROM r),
p AS (SELECT response_id, d.unique_id AS uid, CASE WHEN r.h = d.h THEN 1.0::DOUBLE ELSE round(least(0.3::DOUBLE + 0.4::DOUBLE * coalesce(d.subject = r.subject, false)::INT + 0.25::DOUBLE * (d.domain = r.domain)::INT + 0.15::DOUBLE * (abs(epoch_us(r.ts) - epoch_us(d.ts)) <= 259200000000)::INT, 1.0::DOUBLE), 4) END AS score FROM r JOIN d USING (w)),
best AS (SELECT response_id, list(struct_pack(s := score, uid := uid) ORDER BY score DESC, uid) AS l FROM p WHERE score >= 0.45 GROUP BY 1),
every AS (SELECT w, list(struct_pack(uid := unique_id, domain := domain)) AS a FROM d GROUP BY 1),
s AS (SELECT w, 0::BIGINT AS k, []::VARCHAR[] AS used, NULL::VARCHAR AS response_id, NULL::VARCHAR AS uid, NULL::DOUBLE AS score, NULL::VARCHAR AS how FROM (SELECT DISTINCT w FROM r)
  UNION ALL
  SELECT w, k, CASE WHEN got.uid IS NULL OR list_contains(used, got.uid) THEN used ELSE list_append(used, got.uid) END, response_id, got.uid, got.score, got.how FROM (
    SELECT s.w, rk.k, s.used, rk.response_id, CASE WHEN len(list_filter(a, lambda x: x.uid = rk.unique_id)) > 0 THEN struct_pack(uid := rk.unique_id, score := 1.0::DOUBLE, how := 'unique-id')
      WHEN len(list_filter(l, lambda x: NOT list_contains(s.used, x.uid))) > 0 THEN struct_pack(uid := list_filter(l, lambda x: NOT list_contains(s.used, x.uid))[1].uid, score := list_filter(l, lambda x: NOT list_contains(s.used, x.uid))[1].s, how := 'score')
      WHEN len(list_filter(a, lambda x: NOT list_contains(s.used, x.uid))) = 1 AND (len(s.used) = 0 OR list_filter(a, lambda x: NOT list_contains(s.used, x.uid))[1].domain = rk.domain) THEN struct_pack(uid := list_filter(a, lambda x: NOT list_contains(s.used, x.uid))[1].uid, score := 0.55::DOUBLE, how := 'sole') END AS got
    FROM s JOIN rk ON rk.w = s.w AND rk.k = s.k + 1 LEFT JOIN best ON best.response_id = rk.response_id LEFT JOIN every ON every.w = s.w))
SELECT w AS workflow_id, response_id, uid AS unique_id, score, how FROM s WHERE uid IS NOT NULL"""
)
def responses_assigned(t):
    return threads.assign_responses(*_messages(t))


@query(
    """{views},
c AS (SELECT event_id AS chain_id, CASE WHEN event_id % 3 > 0 THEN user_id % 50 END AS supplier, CASE WHEN event_id % 5 > 0 THEN event_type END AS box, event_id % 4 AS ti, ts AS created FROM events WHERE event_id % 2 = 0 AND event_id % 6 <> 2),
m AS (SELECT event_id AS message_id, ts, CASE WHEN event_id % 7 = 1 THEN event_id - 1 END AS ref, CASE WHEN event_id % 3 > 0 THEN user_id % 50 END AS supplier, CASE WHEN event_id % 4 = 1 THEN event_type END AS box FROM events WHERE event_id % 2 = 1),
a AS (SELECT message_id, max(struct_pack(t := ti, c := created, i := chain_id)) AS o FROM m JOIN c ON c.chain_id = m.ref AND (m.box IS NULL OR c.box IS NULL OR m.box = c.box) GROUP BY 1),
b AS (SELECT message_id, max(struct_pack(t := ti, c := created, i := chain_id)) AS o FROM m JOIN c ON c.created BETWEEN m.ts - INTERVAL 5 DAY AND m.ts AND (m.box IS NULL OR c.box IS NULL OR m.box = c.box) AND (m.supplier IS NULL OR m.supplier = c.supplier) GROUP BY 1)
SELECT message_id, coalesce(a.o.i, b.o.i) AS chain_id, CASE WHEN a.o IS NOT NULL THEN 'message_id' ELSE 'time_window' END AS via, (CASE WHEN a.o IS NOT NULL THEN 0.75 WHEN supplier IS NOT NULL THEN 0.7 ELSE 0.6 END)::DOUBLE AS score FROM m LEFT JOIN a USING (message_id) LEFT JOIN b USING (message_id) WHERE a.o IS NOT NULL OR b.o IS NOT NULL"""
)
def chains_matched(t):
    e, k = t.raw("events"), F.col("event_id")
    supplier = F.when(k % 3 > 0, F.col("user_id") % 50).alias("supplier_id")
    chains = e.where(k % 2 == 0).select(k.alias("chain_id"), supplier, F.when(k % 5 > 0, F.col("event_type")).alias("mailbox"), (k % 4).alias("thread_index"), F.col("ts").alias("created"), (k % 6 != 2).alias("awaiting"))
    messages = e.where(k % 2 == 1).select(k.alias("message_id"), "ts", F.when(k % 7 == 1, F.array(k - 1, k - 1)).otherwise(F.array().cast("array<bigint>")).alias("refs"), supplier, F.when(k % 4 == 1, F.col("event_type")).alias("mailbox"))
    return threads.best_chains(messages, chains)


_SENTENCES = "list_filter(list_transform(regexp_extract_all(text, '[^.!?]+[.!?]*'), lambda s: regexp_replace(s, '^[ \\t-\\r]+|[ \\t-\\r]+$', '', 'g')), lambda s: s <> '')"
_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda x: x <> ''))"


@query(
    rf"""{{recursive}},
x AS (SELECT doc_id, text, {_SENTENCES} AS a, {_WORDS.format('asked')} AS q FROM documents JOIN (SELECT text AS asked, item_id FROM benchmark) ON item_id = doc_id % 40),
y AS (SELECT doc_id, unnest(a) AS s, unnest(range(len(a))) AS i, q FROM (SELECT doc_id, a, q FROM x)),
z AS (SELECT doc_id, i, s, {_WORDS.format('s')} AS w, q FROM y),
r AS (SELECT doc_id, i, s, w, least(1.0::DOUBLE, 0.1::DOUBLE + 0.9::DOUBLE * len(list_intersect(q, w)) / (len(w) + 1)) AS rel FROM z),
c AS (SELECT doc_id, list(struct_pack(s := s, w := w, rel := rel) ORDER BY rel DESC, i) AS c FROM r GROUP BY 1),
p AS (SELECT doc_id, c, least(1200, floor(length(text) * 0.7::DOUBLE)) AS most FROM c JOIN x USING (doc_id)),
g AS (SELECT doc_id, c, most, []::BIGINT[] AS chosen, list_transform(c, lambda x: 0.0::DOUBLE) AS near, 0::BIGINT AS chars, true AS going FROM p
  UNION ALL
  SELECT doc_id, c, most, CASE WHEN fits THEN list_append(chosen, pick) ELSE chosen END, CASE WHEN fits THEN list_transform(range(1, len(c) + 1), lambda j: greatest(near[j], CASE WHEN len(c[j].w) * len(c[pick].w) > 0 THEN len(list_intersect(c[j].w, c[pick].w)) / sqrt(len(c[j].w) * len(c[pick].w)) ELSE 0 END)) ELSE near END, CASE WHEN fits THEN size ELSE chars END, fits AND size < most AND len(chosen) + 1 < len(c)
  FROM (SELECT *, chars + length(c[pick].s) + 1 AS size, len(chosen) = 0 OR chars + length(c[pick].s) <= most AS fits FROM (SELECT *, list_position(v, list_max(v)) AS pick FROM (SELECT *, list_transform(range(1, len(c) + 1), lambda j: CASE WHEN list_contains(chosen, j) THEN NULL ELSE 0.75::DOUBLE * c[j].rel - 0.25::DOUBLE * near[j] END) AS v FROM g WHERE going)))),
f AS (SELECT doc_id, arg_max(chosen, len(chosen)) AS chosen, any_value(c) AS c FROM g GROUP BY 1)
SELECT doc_id, CASE WHEN short THEN len(a) ELSE coalesce(len(chosen), 0) END::INTEGER AS n_selected, md5(CASE WHEN short THEN text[:1200] ELSE coalesce(array_to_string(list_transform(chosen, lambda j: c[j].s), ' '), '')[:1200] END) AS selection
FROM (SELECT *, len(a) <= 3 AND len(list_filter(a, lambda s: length(s) >= 120)) = 0 AS short FROM x) LEFT JOIN f USING (doc_id)"""
)
def sentences_selected(t):
    items = t.raw("benchmark").select(F.col("item_id").alias("i"), F.col("text").alias("asked"))
    docs = t.raw("documents").select("doc_id", "text").join(F.broadcast(items.where("i < 40")), F.col("doc_id") % 40 == F.col("i"))  # 40 items
    return passages.select_sentences(docs, "asked").select("doc_id", "n_selected", F.md5("selection").alias("selection"))


@query(
    r"""{views},
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS raw, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS line FROM (SELECT page_id AS doc_id, regexp_replace(html, '<[^>]*>', chr(10), 'g') AS t FROM pages UNION ALL SELECT -1 - doc_id, text FROM documents)),
s AS (SELECT doc_id, line, regexp_replace(raw, '[ \t-\r]+$', '') AS raw, regexp_replace(raw, '^[ \t-\r]+|[ \t-\r]+$', '', 'g') AS s, len(list_filter(regexp_split_to_array(raw, '[ \t-\r]+'), lambda x: x <> '')) AS n FROM l),
k AS (SELECT *, CASE WHEN contains(raw, chr(9)) OR contains(raw, '  ') OR contains(raw, ' | ') THEN 'table' WHEN regexp_matches(s, '^[A-Za-z][^:\n]{0,39}:[ \t]*[^ \t]') THEN 'key_value'
  WHEN regexp_matches(s, '[A-Z]') AND upper(s) = s AND n <= 6 THEN 'title' WHEN regexp_matches(s, '^[A-Z0-9]') AND NOT regexp_matches(s, '[.!?,;:]$') AND n <= 8 THEN 'heading' ELSE 'paragraph' END AS kind FROM s WHERE s <> '')
SELECT doc_id, line::INTEGER AS line, kind, (count(*) FILTER (kind IN ('title', 'heading')) OVER (PARTITION BY doc_id ORDER BY line))::INTEGER AS section, CASE WHEN kind = 'key_value' THEN trim(split_part(s, ':', 1)) END AS name, CASE WHEN kind = 'key_value' THEN trim(s[length(split_part(s, ':', 1)) + 2:]) END AS value FROM k"""
)
def lines_by_kind(t):
    pages = t.raw("pages").select(F.col("page_id").alias("doc_id"), F.regexp_replace("html", "<[^>]*>", "\n").alias("text"))
    return passages.line_kinds(pages.unionByName(t.raw("documents").select((-1 - F.col("doc_id")).alias("doc_id"), "text")), "doc_id")


@query(
    """{views},
n AS (SELECT p_partkey AS k, lower(p_name) AS s, string_split(lower(p_name), ' ') AS ws FROM part),
f AS (SELECT s, min(k) AS target FROM n GROUP BY 1)
SELECT k, target, round(CASE WHEN k % 4 IN (0, 2) THEN 1.0::DOUBLE WHEN k % 4 = 1 THEN 2.0::DOUBLE * (length(s) - 1) / (2 * length(s) - 1) ELSE 2.0::DOUBLE * length(s) / (2 * length(s) + 1) END, 9) AS score FROM n JOIN f USING (s) WHERE k % 5 > 0"""
)
def labels_closest(t):
    """Names of parts with a letter lost or added, in capitals or with their words turned round, find their part."""
    part = t.raw("part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("s"))
    turned = F.array_join(F.reverse(F.split("s", " ")), "  ")
    label = F.when(F.col("k") % 4 == 0, F.upper("s")).when(F.col("k") % 4 == 1, F.concat(F.substring("s", 1, 2), F.expr("substring(s, 4)"))).when(F.col("k") % 4 == 2, turned).otherwise(F.concat("s", F.lit("x")))
    asked = part.where("k % 5 > 0").select("k", label.alias("label"))
    found = labels.closest(asked.select("label"), part.select(F.col("s").alias("term"), F.col("k").alias("target")))
    return asked.join(found, "label").select("k", "target", F.round("score", 9).alias("score"))


#: Columns and the labels that mean them, as a table of synonyms has them.
_TERMS = [("invoice number", "invoice_id"), ("invoice no", "invoice_id"), ("invoice date", "invoice_date"), ("due date", "due_date"), ("total amount", "total"), ("supplier name", "supplier"), ("payment terms", "terms")]


@query(
    """{views},
o AS (SELECT o_orderkey AS record, o_orderkey % 4 AS m, CASE WHEN o_orderkey % 3 = 0 THEN 'Invoice Numbers' ELSE 'INVOICE NO.' END AS first FROM orders),
l AS (SELECT record, unnest([1, 2, 3, 4, 5]) AS position, unnest([first, CASE WHEN m = 0 THEN 'Invoce Date' ELSE 'date: invoice' END, 'Invoice Dates', CASE m WHEN 1 THEN 'Suplier name' WHEN 2 THEN 'Remarks' ELSE 'Total Amout' END, 'Payment-Terms']) AS label, unnest(['invoice_id', 'invoice_date', NULL, CASE m WHEN 1 THEN 'supplier' WHEN 2 THEN NULL ELSE 'total' END, 'terms']) AS target FROM o)
SELECT record, position, label, target FROM l"""
)
def labels_assigned(t):
    """Labels of each order's document with slips of the pen; the second label for a date finds its column taken."""
    k = F.col("o_orderkey")
    m = k % 4
    names = [F.when(k % 3 == 0, "Invoice Numbers").otherwise("INVOICE NO."), F.when(m == 0, "Invoce Date").otherwise("date: invoice"), F.lit("Invoice Dates"), F.when(m == 1, "Suplier name").when(m == 2, "Remarks").otherwise("Total Amout"), F.lit("Payment-Terms")]
    records = t.raw("orders").select(k.alias("record"), F.posexplode(F.array(*names)).alias("p", "label")).select("record", (F.col("p") + 1).alias("position"), "label")
    terms = t.spark.createDataFrame(_TERMS, "term string, target string")
    return labels.assigned(records, terms).select("record", "position", "label", "target")

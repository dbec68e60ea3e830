"""Rows completed from other tables: descriptions, headers, nested lines, ids out
of messages and threads, the category nearest to a description."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tenderloom.functions.columns import alias_key, dot, total, words_of
from tenderloom.operators.insight import top_values
from tenderloom.operators.joins import left_known
from tenderloom.operators.retrieval import first_n


def most_common(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """keys and `name`, the value that occurs most often; the smaller of equals."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).count()
    return counts.groupBy(*keys).agg(F.min(F.struct((-F.col("count")).alias("n"), F.col(value).alias("v")))["v"].alias(name))


def described(findings: DataFrame, lines: DataFrame, description: str) -> DataFrame:
    """findings (supplier_id, item_id, po_id) with the most common description of
    lines of the supplier and item, else of the supplier and order, else of the
    supplier. Three aggregates; nulls match nothing."""
    grains = [["supplier_id", "item_id"], ["supplier_id", "po_id"], ["supplier_id"]]
    out = findings
    for i, keys in enumerate(grains):
        out = out.join(most_common(lines.dropna(subset=keys), keys, description, f"_d{i}"), keys, "left")
    return out.withColumn("description", F.coalesce("_d0", "_d1", "_d2")).drop("_d0", "_d1", "_d2")


def with_sources(findings: DataFrame, key: str, sources: str, masters: list[tuple[DataFrame, str]], suppliers: DataFrame) -> DataFrame:
    """findings with the supplier of the first of their source records (an array)
    that a master (table, id column) knows, masters in order; null where it is
    not among the suppliers."""
    refs = findings.select(key, F.posexplode(sources).alias("at", "ref"))
    known = reduce(DataFrame.unionByName, [m.select(F.col(c).alias("ref"), "supplier_id").where("supplier_id is not null and ref is not null").groupBy("ref").agg(F.min("supplier_id").alias("supplier_id")).withColumn("level", F.lit(i)) for i, (m, c) in enumerate(masters)])
    first = refs.join(known, "ref").groupBy(key).agg(F.min(F.struct("at", "level", "supplier_id"))["supplier_id"].alias("supplier_id"))
    valid = first.join(suppliers.select("supplier_id"), "supplier_id", "left_semi")
    return findings.join(valid, key, "left")


def with_headers(lines: DataFrame, headers: DataFrame, key: str) -> DataFrame:
    """Lines with all columns of their headers; a line's column that a header has
    too gets `_line`."""
    own = [F.col(c).alias(f"{c}_line" if c in headers.columns and c != key else c) for c in lines.columns]
    return lines.select(*own).join(headers, key, "left")


def nested(headers: DataFrame, lines: DataFrame, key: str, columns: list[str], order: list[str], n: int) -> DataFrame:
    """The first n headers by the order (a column, descending, then the key) with
    their lines as an array of structs, sorted; an empty one without lines. Only the
    lines of those headers are gathered."""
    some = headers.orderBy(*[F.desc_nulls_last(c) for c in order], key).limit(n)
    gathered = lines.join(some.select(key), key, "left_semi").groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("lines"))
    return some.join(gathered, key, "left").withColumn("lines", F.coalesce("lines", F.array().cast(gathered.schema["lines"].dataType)))


def profiles(lines: DataFrame, contracts: DataFrame, products: DataFrame, n: int = 5) -> DataFrame:
    """supplier_id, sorted contract ids and categories (distinct), and the n most frequent items."""
    held = contracts.groupBy("supplier_id").agg(F.sort_array(F.collect_set("contract_id")).alias("contracts"))
    kinds = lines.join(products.select("item_id", "category"), "item_id").groupBy("supplier_id").agg(F.sort_array(F.collect_set("category")).alias("categories"))
    items = top_values(lines, "supplier_id", "item_id", n).select("supplier_id", F.col("top").alias("items"))
    return held.join(kinds, "supplier_id", "full").join(items, "supplier_id", "full")


def flow_of(asked: DataFrame, flows: DataFrame, names: DataFrame) -> DataFrame:
    """asked (supplier_id, supplier_name) with the id of its flow: by id, else by
    the name's key (the smallest id that bears it), and which of the two it was."""
    by_name = names.select(alias_key(F.col("supplier_name")).alias("_k"), F.col("supplier_id").alias("_n")).where("_k <> ''").join(flows.select(F.col("supplier_id").alias("_n")), "_n", "left_semi").groupBy("_k").agg(F.min("_n").alias("_n"))
    by_id = flows.select("supplier_id", F.col("supplier_id").alias("_i")).distinct()
    out = asked.withColumn("_k", alias_key(F.col("supplier_name"))).join(by_id, "supplier_id", "left").join(by_name, "_k", "left")
    return out.select(*asked.columns, F.coalesce("_i", "_n").alias("flow_id"), F.when(F.col("_i").isNotNull(), "id").when(F.col("_n").isNotNull(), "name").alias("how"))


def first_known(rows: DataFrame, key: str, lookups: list[tuple[Column, DataFrame, str]]) -> DataFrame:
    """rows with supplier_id from the first lookup (value of the row, table with
    supplier_id, its id column) that knows the row's value."""
    out = rows
    for i, (value, table, column) in enumerate(lookups):
        one = table.where(F.col(column).isNotNull()).groupBy(F.col(column).alias(f"_v{i}")).agg(F.min("supplier_id").alias(f"_s{i}"))
        out = out.withColumn(f"_v{i}", value).join(one, f"_v{i}", "left")
    found = F.coalesce(*[F.col(f"_s{i}") for i in range(len(lookups))])
    return out.select(*rows.columns, found.alias("supplier_id"))


#: The token that marks a message with the id of its thread. A fixed value.
THREAD_TOKEN = r"(?i)\b(PROC-WF-[A-Z0-9]{6,})\b"


def message_ids(messages: DataFrame, threads: DataFrame) -> DataFrame:
    """messages (message_id, subject, body, in_reply_to) with unique_id: the token
    of the subject, else of the body, else that of the message it answers in
    threads (message_id, unique_id); upper case."""
    token = lambda c: F.nullif(F.upper(F.regexp_extract(c, THREAD_TOKEN, 1)), F.lit(""))
    known = threads.groupBy(F.col("message_id").alias("in_reply_to")).agg(F.min("unique_id").alias("_t"))
    # A message's own token is taken first: only one without it asks its thread.
    told = messages.withColumn("_own", F.coalesce(token("subject"), token("body")))
    asking = told.select(*messages.columns, "_own", F.when(F.col("_own").isNull(), F.col("in_reply_to")).alias("_asks"))
    out = left_known(asking, known.withColumnRenamed("in_reply_to", "_asks"), "_asks")
    return out.select(*messages.columns, F.coalesce("_own", F.upper("_t")).alias("unique_id"))


def by_identifiers(messages: DataFrame, dispatches: DataFrame) -> DataFrame:
    """messages (message, identifiers array) with the dispatch (dispatch,
    unique_id, message_id, supplier_id) that one of its identifiers names: the token,
    the message id with or without brackets, or the supplier if it has one dispatch only.
    Earlier identifiers count first, then tokens, message ids and suppliers."""
    bare = lambda c: F.lower(F.btrim(F.btrim(c), F.lit("<>")))
    keys = [dispatches.select(bare(F.col(c)).alias("k"), F.lit(i).alias("level"), "dispatch") for i, c in enumerate(("unique_id", "message_id"))]
    lone = dispatches.groupBy(bare(F.col("supplier_id")).alias("k")).agg(F.min("dispatch").alias("dispatch"), F.count("*").alias("n")).where("n = 1").select("k", F.lit(2).alias("level"), "dispatch")
    index = reduce(DataFrame.union, [*keys, lone]).where("k <> ''").groupBy("k").agg(F.min(F.struct("level", "dispatch")).alias("d"))
    asked = messages.select("message", F.posexplode("identifiers").alias("at", "i")).select("message", "at", bare(F.col("i")).alias("k"))
    found = asked.join(index, "k").groupBy("message").agg(F.min(F.struct("at", "d.level", "d.dispatch")).alias("b"))
    return messages.join(found.select("message", F.col("b.dispatch").alias("dispatch"), F.col("b.level").alias("level")), "message", "left").drop("identifiers")


def negotiations(sessions: DataFrame, states: DataFrame) -> DataFrame:
    """sessions (rfq_id, supplier_id, round) with the state of their pair
    (current_round, status), `key` of all three parts and the round that counts."""
    last = states.groupBy("rfq_id", "supplier_id").agg(F.max(F.struct("current_round", "status")).alias("s"))
    out = sessions.join(last, ["rfq_id", "supplier_id"], "left").withColumn("round", F.coalesce("round", "s.current_round", F.lit(0)))
    return out.select(F.concat_ws("|", "rfq_id", "supplier_id", F.col("round").cast("string")).alias("key"), "rfq_id", "supplier_id", "round", F.col("s.status").alias("status"))


def latest_context(sessions: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """The columns of each key's last session and the number of sessions."""
    g = sessions.groupBy(*keys).agg(F.max(F.struct(order, *columns)).alias("s"), F.count("*").alias("n_sessions"))
    return g.select(*keys, f"s.{order}", *[f"s.{c}" for c in columns], "n_sessions")


def active_workflows(sent: DataFrame) -> DataFrame:
    """workflow_id of those whose messages all have an id and at least one waits."""
    g = sent.groupBy("workflow_id").agg(F.bool_and(F.col("message_id").isNotNull()).alias("all_sent"), F.bool_or(F.col("responded_at").isNull()).alias("waits"), F.count("*").alias("n"))
    return g.where("all_sent and waits").select("workflow_id", "n")


def nearest_category(items: DataFrame, products: DataFrame, least: float = 0.45) -> DataFrame:
    """items (item_id, description) and products (product_id, product) -> item_id,
    product_id, similarity of the product whose words are nearest by the cosine of
    word sets, if it reaches the least; the smaller id of equals.

    Equal texts are compared once. Words are ordered from rare to common: two sets of
    that cosine share a word among the first n - least(n * least ** 2) + 1 of each, so
    only those prefixes are joined, and common words rarely among them.
    """
    a = items.select(F.array_sort(F.array_distinct(words_of(F.col("description")))).alias("w"), "item_id").where(F.size("w") > 0)
    b = products.select(F.array_sort(F.array_distinct(words_of(F.col("product")))).alias("w"), "product_id").where(F.size("w") > 0)
    left, right = a.select("w").distinct(), b.groupBy("w").agg(F.min("product_id").alias("product_id"))
    often = right.select(F.explode("w").alias("t")).union(left.select(F.explode("w").alias("t"))).groupBy("t").agg(F.count("*").alias("n"))

    def prefixes(rows: DataFrame, name: str) -> DataFrame:
        spread = rows.select(F.col("w").alias(name), F.explode("w").alias("t")).join(often, "t")
        size = F.size(name)
        keep = size - F.ceil(size * ((least - 1e-6) ** 2)).cast("int") + 1
        ordered = spread.groupBy(name).agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "t"))), lambda x: x["t"]).alias("ts"))  # words of one text
        return ordered.select(name, F.explode(F.slice("ts", F.lit(1), keep)).alias("t"))

    pairs = prefixes(left, "x").join(prefixes(right, "y"), "t").select("x", "y").distinct()
    cosine = F.round(F.size(F.array_intersect("x", "y")) / F.sqrt(F.size("x") * F.size("y").cast("double")), 6)
    scored = pairs.withColumn("s", cosine).where(F.col("s") >= least).join(right.withColumnRenamed("w", "y"), "y")
    best = scored.groupBy(F.col("x").alias("w")).agg(F.min(F.struct((-F.col("s")).alias("s"), "product_id")).alias("b"))
    return a.join(best, "w").select("item_id", F.col("b.product_id").alias("product_id"), (-F.col("b.s")).alias("similarity"))


def distinct_meanings(hits: DataFrame, key: str, n: int = 20, least: float = 0.92, across: int = 20) -> DataFrame:
    """hits (key, doc, item, score, vector of length 1) without those too near a
    better one: within a document, then among the first `across` that are left, of other
    documents too. Only the n best hits of a key are taken, so that a key's fold is
    bounded; item breaks ties."""
    order = [F.col("score").desc(), F.col("item")]
    top = first_n(hits, [key], order, n, "item")
    row = F.struct("rank", "doc", "item", "score", "vector")
    rows = top.groupBy(key).agg(F.sort_array(F.collect_list(row)).alias("h"))
    kind = rows.schema["h"].dataType.simpleString()

    def fold(every: Column, same: bool) -> Column:
        def step(kept: Column, x: Column) -> Column:
            near = F.exists(kept, lambda a: ((a["doc"] == x["doc"]) if same else (a["doc"] != x["doc"])) & (F.round(dot(a["vector"], x["vector"]), 9) >= least))
            return F.when(near, kept).otherwise(F.concat(kept, F.array(x)))

        return F.aggregate(every, F.array().cast(kind), step)

    once = rows.select(key, fold(F.col("h"), True).alias("h"))
    both = once.select(key, F.concat(fold(F.slice("h", 1, across), False), F.slice("h", across + 1, n)).alias("h"))
    return both.select(key, F.posexplode("h").alias("position", "x")).select(key, F.col("position"), "x.doc", "x.item", "x.score")


def merged_lists(rows: DataFrame, keys: list[str], order: str, lists: list[str], values: list[str]) -> DataFrame:
    """Rows of equal keys as one: lists are joined in order without repetitions,
    and a value is the first that is not blank. Meant for few rows of a key."""
    w = Window.partitionBy(*keys).orderBy(order)
    filled = rows.select(*keys, order, *lists, *[F.first(F.when(F.btrim(F.col(c).cast("string")) != "", F.col(c)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias(c) for c in values])
    first = [F.first(c).alias(c) for c in values]
    union = lambda c: F.array_distinct(F.flatten(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(c).alias("l")))).getField("l")))
    return filled.groupBy(*keys).agg(*[union(c).alias(c) for c in lists], *first)


def late_invoices(invoices: DataFrame) -> DataFrame:
    """supplier_id, invoices, late ones, their share, mean days and value."""
    days = F.datediff(F.coalesce("paid_date", "invoice_date"), "due_date")
    late = days > 0
    g = invoices.groupBy("supplier_id").agg(F.count("*").alias("n"), F.count_if(late).alias("n_late"), F.round(F.avg(F.when(late, days)), 4).alias("days_late"), F.round(total(F.when(late, F.col("invoice_amount"))), 2).alias("value_late"))
    return g.withColumn("late_share", F.round(F.col("n_late") / F.col("n"), 6))

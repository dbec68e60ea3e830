"""Joins that find the supplier of a record, and rows for those that have none.

Names meet through their rarest words only, so a word that very many companies
share makes no pairs unless a name has no other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderloom.functions.fields import company_key, core_words, spellings
from tenderloom.operators.joins import left_known

#: Names that are sent to every task; more are shuffled with the runs of the texts.
MOST_BROADCAST = 100_000
_BETWEEN = "[ \\t\\r\\n\\f,;:.!?()]+"


def _rarest_first(side: DataFrame, key: str, words: str, rarity: DataFrame) -> DataFrame:
    """The rows with their words in `by`, the rarest first."""
    rows = side.select(key, F.explode(words).alias("word")).join(rarity, "word")
    order = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("n", "word"))).alias("by"))
    return side.join(order.select(key, F.col("by.word").alias("by")), key)


def _candidates(asked: DataFrame, known: DataFrame, least: float) -> DataFrame:
    """name, supplier_id of all pairs that can match: of two sets of words with a
    Jaccard share of `least` the rarest words meet, all but those they must share and one;
    of a set that the other holds its rarest word does."""
    each = asked.select(F.explode("words").alias("word")).union(known.select(F.explode("s_words").alias("word")))
    rarity = each.groupBy("word").agg(F.count("*").alias("n"))
    own, other = _rarest_first(asked, "name", "words", rarity), _rarest_first(known.dropDuplicates(["supplier_id", "s_low"]), "_k", "s_words", rarity)
    some = lambda n: F.explode(F.slice("by", 1, n)).alias("word")
    prefix = (F.size("by") - F.ceil(least * F.size("by") - 1e-9) + 1).cast("int")
    all_, one = F.size("by"), F.lit(1)
    met = [own.select("name", some(a)).join(other.select("_k", some(b)), "word").select("name", "_k") for a, b in ((prefix, prefix), (one, all_), (all_, one))]
    return met[0].union(met[1]).union(met[2]).distinct()


def match_names(names: DataFrame, suppliers: DataFrame, least: float = 0.5) -> DataFrame:
    """names (name) -> name, supplier_id, how: `exact` ignoring case, else
    `contained` (the key of one holds the other's at word bounds; the longest key),
    else `words` (Jaccard of core words of at least `least`; one word in common
    counts only if either has no other; all of two or more words of the name count
    0.7). Ties go to the smallest supplier_id. Unmatched names have nulls."""
    asked = names.select("name").where("name is not null").distinct().select("name", F.lower(F.btrim("name")).alias("low"), company_key(F.col("name")).alias("key"), core_words(F.col("name")).alias("words"))
    known = suppliers.select("supplier_id", F.lower(F.btrim("supplier_name")).alias("s_low"), company_key(F.col("supplier_name")).alias("s_key"), core_words(F.col("supplier_name")).alias("s_words"))
    exact = asked.join(known, F.col("low") == F.col("s_low")).groupBy("name").agg(F.min("supplier_id").alias("exact"))
    known = known.withColumn("_k", F.struct("supplier_id", "s_low"))
    pairs = _candidates(asked, known, least).join(asked, "name").join(known.dropDuplicates(["supplier_id", "s_low"]), "_k")
    padded = lambda c: F.concat(F.lit(" "), F.col(c), F.lit(" "))
    inside = (F.length("s_key") >= 3) & (F.contains(padded("key"), padded("s_key")) | F.contains(padded("s_key"), padded("key")))
    both, either = F.size(F.array_intersect("words", "s_words")), F.size(F.array_union("words", "s_words"))
    whole, s_whole = both == F.size("words"), both == F.size("s_words")
    share = F.when((both > 1) | whole | s_whole, F.greatest(both / either, F.when(whole & (F.size("words") > 1), 0.7).otherwise(0.0)))
    scored = pairs.select("name", "supplier_id", F.when(inside, F.length("s_key")).alias("contained"), F.when(share >= least, share).alias("share"))
    best = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct((-F.col(c)).alias("s"), "supplier_id")))["supplier_id"].alias(c)
    near = scored.groupBy("name").agg(best("contained"), best("share"))
    out = names.select("name").where("name is not null").distinct().join(exact, "name", "left").join(near, "name", "left")
    how = F.when(F.col("exact").isNotNull(), "exact").when(F.col("contained").isNotNull(), "contained").when(F.col("share").isNotNull(), "words")
    return out.select("name", F.coalesce("exact", "contained", "share").alias("supplier_id"), how.alias("how"))


def named_in_texts(texts: DataFrame, suppliers: DataFrame, key: str, text: str) -> DataFrame:
    """key, supplier_name: the longest name that stands in a text at word bounds, the
    first by name of equals; texts without one have no row. Runs of as many words as
    the names have are looked up; punctuation between words counts as a blank."""
    words = lambda c: F.filter(F.split(F.lower(c), _BETWEEN), lambda w: w != "")
    known = suppliers.select(words(F.col("supplier_name")).alias("w"), "supplier_name").select(F.array_join("w", " ").alias("run"), F.size("w").alias("n"), "supplier_name").where("length(run) >= 3")
    sizes = known.distinct().groupBy("n").count().collect()  # a row for each length
    lengths, few = sorted(r.n for r in sizes), sum(r["count"] for r in sizes) <= MOST_BROADCAST
    rows = texts.select(key, words(F.col(text)).alias("w"))

    def runs(n: int) -> Column:
        starts = F.when(F.size("w") >= n, F.sequence(F.lit(1), F.size("w") - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice("w", i, F.lit(n)), " ")))

    every = F.concat(*[runs(n) for n in lengths]) if lengths else F.array().cast("array<string>")
    # The runs of all texts are never the side that is sent to every task.
    side = known.select("run", "supplier_name").distinct()
    found = rows.select(key, F.explode(every).alias("run")).join(F.broadcast(side) if few else side.hint("merge"), "run")
    return found.groupBy(key).agg(F.min(F.struct((-F.length("supplier_name")).alias("n"), "supplier_name"))["supplier_name"].alias("supplier_name"))


def flow_rows(suppliers: DataFrame, contracts: DataFrame, orders: DataFrame, lines: DataFrame, invoices: DataFrame, invoice_lines: DataFrame, products: DataFrame) -> DataFrame:
    """The procurement flow, one row for each order line and invoice line of the
    same order and supplier (every pair of them, as asked for): orders with their
    lines, the supplier by the line, else by the contract, the supplier's invoices
    of the order and their lines, and the item's product. Orders without any
    partner stay with nulls."""
    by_contract = contracts.select("contract_id", F.col("supplier_id").alias("contract_supplier"))
    line = lines.select("po_id", F.col("supplier_id").alias("line_supplier"), "item_id", "line_total")
    # Contracts meet the bare orders and invoices their own lines, so that the long rows are dealt out as seldom as can be.
    heads = left_known(orders.select("po_id", "contract_id"), by_contract, "contract_id")
    rows = heads.join(line, "po_id", "left").withColumn("supplier_id", F.coalesce("line_supplier", "contract_supplier"))
    billed = invoices.select("po_id", "supplier_id", "invoice_id", "invoice_amount").join(invoice_lines.select("invoice_id", F.col("item_id").alias("invoice_item"), "line_amount"), "invoice_id", "left")
    rows = left_known(rows.join(billed, ["po_id", "supplier_id"], "left"), suppliers.select("supplier_id", "supplier_name"), "supplier_id")
    return left_known(rows, products.select("item_id", "product", "category"), "item_id")


def supplier_of_lines(lines: DataFrame, by_invoice: DataFrame, by_order: DataFrame) -> DataFrame:
    """lines (invoice_id, po_id) with supplier_id: by the invoice, else by the order."""
    invoice = by_invoice.groupBy("invoice_id").agg(F.min("supplier_id").alias("_invoice"))
    order = by_order.groupBy("po_id").agg(F.min("supplier_id").alias("_order"))
    return lines.drop("supplier_id").join(invoice, "invoice_id", "left").join(order, "po_id", "left").withColumn("supplier_id", F.coalesce("_invoice", "_order")).drop("_invoice", "_order")


def with_candidates(rows: DataFrame, candidates: DataFrame, directory: DataFrame, key: str = "supplier_id", name: str = "supplier_name") -> DataFrame:
    """The rows of the candidates, and one row for each candidate without any,
    with its name from the directory and nulls in other columns."""
    wanted = candidates.select(F.nullif(F.btrim(key), F.lit("")).alias(key)).where(F.col(key).isNotNull()).distinct()
    kept = rows.withColumn(key, F.btrim(key)).join(wanted, key, "left_semi")
    missing = wanted.join(rows.select(F.btrim(key).alias(key)), key, "left_anti").join(directory.select(key, name), key, "left")
    return kept.unionByName(missing, allowMissingColumns=True)


def of_suppliers(rows: DataFrame, ids: list[str], names: list[str]) -> DataFrame:
    """Rows of any of the ids, or of any of the names ignoring case."""
    return rows.where(F.col("supplier_id").isin(*ids) | F.lower(F.nullif(F.btrim("supplier_name"), F.lit(""))).isin(*[n.strip().lower() for n in names]))


def by_spellings(rows: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """Rows whose name shares a spelling with a wanted one."""
    asked = wanted.select(F.explode(spellings(F.col(column))).alias("spelling")).distinct()
    own = rows.withColumn("_own", F.explode(spellings(F.col(column))))
    hit = own.join(asked, own["_own"] == asked["spelling"], "left_semi").select(column).distinct()
    return rows.join(hit, column, "left_semi")


def with_fallback(rows: DataFrame, wanted: Column, order: list, most: int = 100) -> DataFrame:
    """The first `most` rows that are wanted; if there are none, of all."""
    marked = rows.withColumn("_wanted", F.coalesce(wanted, F.lit(False)))
    some = marked.agg(F.coalesce(F.max("_wanted"), F.lit(False)).alias("_some"))  # one row
    return marked.crossJoin(F.broadcast(some)).where("_wanted or not _some").drop("_wanted", "_some").orderBy(*order).limit(most)


def merged(primary: DataFrame, secondary: DataFrame, key: Column) -> DataFrame:
    """Rows of both, of each key only those of the primary if it has some; of
    equal ones of a side the least."""
    both = primary.withColumn("_side", F.lit(0)).unionByName(secondary.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    columns = [c for c in both.columns if c != "_side"]
    return both.withColumn("_key", key).groupBy("_key").agg(F.min(F.struct("_side", *columns)).alias("r")).select(*[F.col(f"r.{c}").alias(c) for c in columns])

"""Roll-ups over suppliers, responses, candidates of fields and signals. All are
aggregations that combine before they shuffle; lists are bounded."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tenderloom.functions.columns import rounded, total
from tenderloom.functions.fields import responsiveness
from tenderloom.operators.retrieval import first_n


def response_stats(rows: DataFrame, key: str, asked: str, answered: str) -> DataFrame:
    """key, n_responses, hours (mean, 2 digits) and speed, over answered rows; keys without any are Unknown."""
    hours = (F.unix_date(F.col(answered).cast("date")) - F.unix_date(F.col(asked).cast("date"))) * 24
    out = rows.groupBy(key).agg(F.count(answered).alias("n_responses"), rounded(F.avg(hours.cast("decimal(20,6)"))).alias("hours"))
    return out.withColumn("speed", responsiveness(F.col("hours")))


def negotiation_ready(invited: DataFrame, answered: DataFrame, key: str, member: str, required: int) -> DataFrame:
    """key, n_invited, n_answered, ready: as many distinct answers as required, or as were invited if those are fewer."""
    asked = invited.groupBy(key).agg(F.countDistinct(member).alias("n_invited"))
    got = answered.groupBy(key).agg(F.countDistinct(member).alias("n_answered"))
    out = asked.join(got, key, "left").withColumn("n_answered", F.coalesce("n_answered", F.lit(0)).cast("long"))
    return out.withColumn("ready", F.col("n_answered") >= F.least(F.lit(required), F.col("n_invited")))


def by_sentiment(feedback: DataFrame) -> DataFrame:
    """sentiment, n, and the mean of hits for and against."""
    return feedback.groupBy("sentiment").agg(F.count("*").alias("n"), F.round(F.avg("up"), 4).alias("up"), F.round(F.avg("down"), 4).alias("down"))


def data_profile(tables: dict[str, DataFrame]) -> DataFrame:
    """name, n_rows, n_columns and whether there is any row."""
    one = [df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("name"), "n_rows", F.lit(len(df.columns)).alias("n_columns"), (F.col("n_rows") > 0).alias("filled")) for name, df in sorted(tables.items())]
    return reduce(DataFrame.unionByName, one)


def top_values(rows: DataFrame, key: str, value: str, n: int = 5) -> DataFrame:
    """key, mode, top: the most frequent value, and the n most frequent ones, the
    smaller of equal counts first. Counted before the window."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(key, value).count()
    best = first_n(counts, [key], [F.desc("count"), F.col(value)], n, value).withColumnRenamed("rank", "k").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("k", value))).alias("top"))
    return best.select(key, F.col("top")[0][value].alias("mode"), F.col(f"top.{value}").alias("top"))


def coverage(rows: DataFrame, signals: list[list[str]]) -> Column:
    """The share of signals that are there: one is if its columns sum to more than
    0; columns that rows lack don't count, nor do signals without columns."""
    own = [[c for c in s if c in rows.columns] for s in signals]
    told = [F.when(reduce(Column.__add__, [F.coalesce(F.col(c), F.lit(0)) for c in s]) > 0, 1.0).otherwise(0.0) for s in own if s]
    return reduce(Column.__add__, told) / len(told) if told else F.lit(0.0)


def analytics_context(quotes: DataFrame, price: str, lead: str, terms: Column) -> DataFrame:
    """One row: least and greatest price and lead time, greatest payment days."""
    return quotes.agg(F.min(price).alias("least_price"), F.max(price).alias("greatest_price"), F.min(lead).alias("least_lead"), F.max(lead).alias("greatest_lead"), F.max(terms).alias("greatest_terms"))


def blended_weights(policy: DataFrame, learned: DataFrame, ratio: float = 0.5) -> DataFrame:
    """metric, weight: ratio of the learned and the rest of the policy's, positive
    ones only, summing to 1; without learned ones, or if nothing positive is left,
    the policy's own."""
    both = policy.withColumnRenamed("weight", "p").join(learned.withColumnRenamed("weight", "l"), "metric", "full")
    zero = F.lit(0.0)
    mixed = both.select("metric", "p", (F.coalesce("l", zero) * ratio + F.coalesce("p", zero) * (1 - ratio)).alias("w"), F.count("l").over(Window.partitionBy()).alias("n_learned"))  # a few metrics
    whole = F.sum(F.when(F.col("w") > 0, F.col("w"))).over(Window.partitionBy())
    mixed = mixed.withColumn("whole", whole)
    weight = F.when((F.col("n_learned") > 0) & (F.col("whole") > 0), F.when(F.col("w") > 0, F.col("w") / F.col("whole"))).when(F.col("n_learned") == 0, F.col("p")).otherwise(F.when(F.col("p") > 0, F.col("p")))
    return mixed.select("metric", F.round(weight, 6).alias("weight")).where("weight is not null")


def consensus(candidates: DataFrame, keys: list[str], agreement: float = 0.1, least: float = 0.5) -> DataFrame:
    """candidates (keys, field, value, method, confidence) -> keys, field, value,
    score, n_methods. Values that are equal but for case and blanks are one; its
    score is the best confidence, more if two or more methods agree, and 0.05 for
    each further method, 0.15 at most; never above 1. The best value counts if it
    has the least score; the smaller of equals."""
    same = F.upper(F.regexp_replace(F.btrim("value"), "[ \\t\\r\\n]+", " "))
    rows = candidates.withColumn("same", same).where("same <> ''")
    groups = rows.groupBy(*keys, "field", "same").agg(F.max("confidence").alias("c"), F.countDistinct("method").alias("n_methods"), F.min(F.struct((-F.col("confidence")).alias("c"), "value"))["value"].alias("value"))
    raised = F.when(F.col("n_methods") >= 2, F.least(F.lit(1.0), F.col("c") + agreement)).otherwise(F.col("c"))
    score = F.round(F.least(F.lit(1.0), raised + F.least(0.05 * (F.col("n_methods") - 1), F.lit(0.15))), 3)
    best = groups.withColumn("score", score).groupBy(*keys, "field").agg(F.min(F.struct((-F.col("score")).alias("s"), "same", "value", "score", "n_methods")).alias("b"))
    return best.where(F.col("b.score") >= least).select(*keys, "field", "b.value", "b.score", "b.n_methods")


def field_coverage(found: DataFrame, keys: list[str], fields: dict[str, int]) -> DataFrame:
    """keys, coverage, weighted: shares of the fields (name -> weight) that are found."""
    weight = F.create_map(*[F.lit(x) for k in sorted(fields) for x in (k, fields[k])])
    own = found.where(F.col("field").isin(*fields)).select(*keys, "field").distinct()
    n, all_ = len(fields), sum(fields.values())
    out = found.select(*keys).distinct().join(own, keys, "left").groupBy(*keys)
    return out.agg(F.round(F.count("field") / n, 3).alias("coverage"), F.round(F.coalesce(F.sum(F.try_element_at(weight, "field")), F.lit(0)) / all_, 3).alias("weighted"))


def discrepancies(wanted: DataFrame, records: DataFrame, key: str, checks: dict[str, Column]) -> DataFrame:
    """key, failed: `record` for a wanted key without a record, else the names of
    the checks (true: fails) in order; rows without any are left out."""
    both = wanted.select(key).distinct().join(records.withColumn("_there", F.lit(True)), key, "left")
    told = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in checks.items()]), lambda x: x.isNotNull())
    out = both.select(key, F.when(F.col("_there").isNull(), F.array(F.lit("record"))).otherwise(told).alias("failed"))
    return out.where(F.size("failed") > 0)


def multi_source_share(hits: DataFrame, query: str, source: str) -> DataFrame:
    """One row: queries, and the share that more than one source answers."""
    per = hits.groupBy(query).agg(F.countDistinct(source).alias("n"))
    return per.agg(F.count("*").alias("n_queries"), F.round(F.avg((F.col("n") > 1).cast("double")), 4).alias("share"))


def expected_members(sent: DataFrame, key: str, member: str, time: str, mark: str) -> DataFrame:
    """key, n_expected (distinct members), last (the mark of the latest dispatch)."""
    return sent.groupBy(key).agg(F.countDistinct(member).alias("n_expected"), F.max_by(mark, F.struct(time, mark)).alias("last"))


def best_candidates(candidates: DataFrame, keys: list[str], value: str, confidence: str) -> DataFrame:
    """The value of each key with the highest confidence, the longer of equals, then the greater."""
    best = F.max(F.struct(confidence, F.length(value).alias("n"), value)).alias("b")
    return candidates.where(F.col(value).isNotNull()).groupBy(*keys).agg(best).select(*keys, F.col(f"b.{value}").alias(value), F.col(f"b.{confidence}").alias(confidence))


def steps_of(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Rows of a key in order, with their step and the change of the value since the one before."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("step", F.row_number().over(w)).withColumn("change", rounded(F.col(value) - F.lag(value).over(w)))


def thread(turns: DataFrame, key: str, order: str, role: str, answer: str) -> DataFrame:
    """key, roles (in order, joined), n_turns, last_answer (the place of the last turn of the role)."""
    rows = turns.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, role))).alias("all"), F.max(F.when(F.col(role) == answer, F.col(order))).alias("last_answer"))
    return rows.select(key, F.array_join(F.col(f"all.{role}"), ",").alias("roles"), F.size("all").cast("long").alias("n_turns"), "last_answer")


def rerank_span(hits: DataFrame, query: str, item: str, score: str, n: int = 12, floor: float = 0.0) -> DataFrame:
    """The n best hits of each query of at least the floor, with their rank."""
    return first_n(hits.where(F.col(score) >= floor), [query], [F.desc(score), F.col(item)], n, item)


def unfinished(status: DataFrame, key: str, pending: str) -> DataFrame:
    """Keys of which something is still pending."""
    return status.where(F.col(pending) > 0).select(key).distinct()


def changed_since(rows: DataFrame, column: str, since: Column) -> DataFrame:
    """Rows that changed at or after a time; a filter that reaches the scan."""
    return rows.where(F.col(column) >= since)


def spend_by_level(lines: DataFrame, products: DataFrame, level: Column) -> DataFrame:
    """level, spend, n_items."""
    rows = lines.select("item_id", "line_total").join(products.select("item_id", level.alias("level")), "item_id")
    return rows.groupBy("level").agg(F.round(total(F.col("line_total")), 2).alias("spend"), F.countDistinct("item_id").alias("n_items"))


def offer_bounds(offers: DataFrame) -> DataFrame:
    """One row: the least and largest price and lead time and the longest terms
    of offers (price, lead_days, net_days); nulls don't count."""
    return offers.agg(F.min("price").alias("price_min"), F.max("price").alias("price_max"), F.min("lead_days").alias("lead_min"), F.max("lead_days").alias("lead_max"), F.max("net_days").alias("net_max"))

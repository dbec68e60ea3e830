"""Quote comparison, selection and counter-offers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tenderloom.functions.columns import terms_days, terms_score, total


def quote_summary(quotes: DataFrame) -> DataFrame:
    """Per supplier: quotes, awarded ones, mean cost, share won."""
    g = quotes.groupBy("supplier_id").agg(F.count("*").alias("n_quotes"), F.count_if("awarded").alias("n_awarded"), F.round(total(F.col("total_cost")) / F.count("*"), 2).alias("avg_cost"))
    return g.withColumn("win_rate", F.round(100 * F.col("n_awarded") / F.col("n_quotes"), 2))


def latest_quotes(quotes: DataFrame, n: int = 50) -> DataFrame:
    return quotes.orderBy(F.desc_nulls_last("quote_date"), "quote_id").limit(n)


def compare(quotes: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Per supplier cost, lead time and terms on 0..1 (equal values 1), the
    weighted score in percent, and the distance to the best one (highest score,
    then lowest cost, then smallest id). One row of bounds is broadcast."""
    rows = quotes.withColumn("terms", terms_score(terms_days(F.col("payment_terms"))))
    g = rows.groupBy("supplier_id").agg(F.round(total(F.col("total_cost")) / F.count("*"), 4).alias("cost"), F.round(F.avg("lead_days"), 6).alias("lead"), F.round(F.avg("terms"), 6).alias("terms"), F.count("*").alias("n_quotes"))
    bounds = g.agg(*[f(c).alias(f"_{n}_{c}") for c in ("cost", "lead", "terms") for n, f in (("lo", F.min), ("hi", F.max))])
    out = g.crossJoin(F.broadcast(bounds))
    every = sum(weights.values())

    def part(c: str, higher: bool) -> Column:
        lo, hi, x = F.col(f"_lo_{c}"), F.col(f"_hi_{c}"), F.col(c)
        return F.when(hi == lo, 1.0).otherwise((x - lo) / (hi - lo) if higher else (hi - x) / (hi - lo))

    score = sum((part(c, c == "terms") * (w / every) for c, w in weights.items()), F.lit(0.0))
    out = out.select("supplier_id", "n_quotes", "cost", "lead", "terms", F.round(score * 100, 2).alias("score"))
    best = out.agg(F.min(F.struct((-F.col("score")).alias("s"), "cost", "supplier_id")).alias("b"))
    out = out.crossJoin(F.broadcast(best))
    return out.select("supplier_id", "n_quotes", "cost", "lead", "terms", "score", (F.col("supplier_id") == F.col("b.supplier_id")).alias("recommended"), F.round(-F.col("b.s") - F.col("score"), 2).alias("score_gap"), F.round(F.col("cost") - F.col("b.cost"), 4).alias("cost_gap"))


def cheapest_of_ranked(quotes: DataFrame, ranking: DataFrame, n: int = 3) -> DataFrame:
    """For the first n ranked suppliers with quotes, the cheapest quote of each."""
    best = quotes.groupBy("supplier_id").agg(F.min(F.struct("total_cost", "quote_id")).alias("q"))
    rows = ranking.select("supplier_id", "rank_position").join(best, "supplier_id").orderBy("rank_position", "supplier_id").limit(n)
    return rows.select("rank_position", "supplier_id", F.col("q.quote_id").alias("quote_id"), F.round("q.total_cost", 2).alias("total_cost"))


def latest_round(offers: DataFrame) -> DataFrame:
    """Offers (workflow_id, supplier_id, round, price) of each workflow's last
    round, the lowest of each supplier."""
    last = offers.groupBy("workflow_id").agg(F.max("round").alias("round"))
    return offers.join(last, ["workflow_id", "round"]).groupBy("workflow_id", "round", "supplier_id").agg(F.min("price").alias("price"))


def counter_offers(rows: DataFrame, buffer: float = 0.05, step: float = 0.03, rounds: int = 3) -> DataFrame:
    """rows (offer, target, walkaway, round) with action and counter.

    An offer at or below the target is accepted; one without a positive price
    needs clarification; after the last round the offer is held at the walk-away
    price at most. A first-round gap above 10 % is answered with the larger of
    the target and 88 % of the offer, a second-round one with 60 % of the gap,
    smaller gaps with the middle; later rounds with the target plus a buffer if
    that is below the offer, else a small step.
    """
    offer, target, n = F.col("offer"), F.col("target"), F.col("round")
    gap, middle = offer - target, (offer + F.col("target")) / 2
    wide = gap / target > 0.10
    late = F.when(target * (1 + buffer) < offer, target * (1 + buffer)).otherwise(F.greatest(target, offer * (1 - step)))
    first, second = F.when(wide, F.greatest(target, offer * 0.88)).otherwise(middle), F.when(wide, offer - 0.6 * gap).otherwise(middle)
    bad = offer.isNull() | (offer <= 0)
    action = F.when(bad, "clarify").when(offer <= target, "accept").when(n > rounds, "hold").otherwise("counter")
    price = F.when(bad, None).when(offer <= target, offer).when(n > rounds, F.least(F.coalesce("walkaway", "offer"), offer)).when(n <= 1, first).when(n == 2, second).otherwise(late)
    return rows.withColumns({"action": action, "counter": F.round(price, 2)})


#: Phrases that make an offer a last one.
FINAL = r"final offer|best and final|last price|lowest (we|i) can go|cannot go (any )?lower|take it or leave it|final price"


def final_offers(rows: DataFrame) -> DataFrame:
    """rows (text, offer, walkaway) with is_final and, for final ones, whether
    to accept."""
    final = F.lower(F.coalesce("text", F.lit(""))).rlike(FINAL)
    return rows.withColumns({"is_final": final, "answer": F.when(final, F.when(F.col("offer") <= F.col("walkaway"), "accept").otherwise("decline"))})


def best_offer_of_each(quotes: DataFrame) -> DataFrame:
    """Quotes of an order by cost, then lead time; position 1 is the best."""
    w = Window.partitionBy("po_id").orderBy(F.asc_nulls_last("total_cost"), F.asc_nulls_last("lead_days"), "quote_id")
    return quotes.withColumn("position", F.row_number().over(w)).where("position = 1").select("po_id", "quote_id", "supplier_id", F.round("total_cost", 2).alias("total_cost"))

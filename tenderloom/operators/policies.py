"""Policy rows as tables: parsed details, aliases, the registry of detectors and
the conditions that count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderloom.functions.fields import listed, slug


def details_of(c):
    """The text if it is a JSON object, else an object with it as `text`; null and blank give {}."""
    blank = F.coalesce(F.btrim(c), F.lit("")) == ""
    return F.when(blank, "{}").when(F.get_json_object(c, "$").startswith("{"), c).otherwise(F.to_json(F.struct(c.alias("text"))))


def policy_rows(rows: DataFrame) -> DataFrame:
    """Active policies (status null or 1): policy_id, identifier, slug, sorted
    aliases. The slug is of the name, else of the details' name or identifier, the
    description, the id."""
    # Policies are short and their parsing is long: a file of few bytes is dealt to many tasks, details and slugs are told once.
    active = rows.where(F.coalesce("policy_status", F.lit(1)) == 1).repartition("policy_id")
    active = active.withColumn("_d", details_of(F.col("policy_details")))
    paths = {"_name": "$.policy_name", "_id": "$.identifier", "_pid": "$.policy_identifier", "_rule": "$.rules.name", "_rules": "$.rules.policy_name"}
    parts = active.select("*", *[F.get_json_object("_d", path).alias(c) for c, path in paths.items()])
    key = F.col("policy_id").cast("string")
    ladder = [slug(x) for x in (F.col("policy_name"), F.col("_name"), F.col("_id"), F.col("policy_desc"), key)]
    agents = F.transform(listed(F.coalesce("policy_linked_agents", F.lit(""))), slug)
    told = parts.select("policy_id", F.coalesce("_pid", "_id", key).alias("identifier"), F.array(*ladder).alias("_ladder"), F.array(*[slug(F.col(c)) for c in ("_pid", "_rule", "_rules")]).alias("_more"), agents.alias("_agents"))
    aliases = F.array_sort(F.array_distinct(F.array_compact(F.concat("_ladder", "_more", "_agents"))))
    return told.select("policy_id", "identifier", F.get(F.array_compact("_ladder"), F.lit(0)).alias("slug"), aliases.alias("aliases"))


def registry(detectors: DataFrame, policies: DataFrame) -> DataFrame:
    """detectors (detector) with the policy that names one in its aliases; the
    last policy_id of several, null where none does."""
    named = policies.select("policy_id", F.explode("aliases").alias("detector")).groupBy("detector").agg(F.max("policy_id").alias("policy_id"))
    return detectors.join(named, "detector", "left")


def conditions(rows: DataFrame, keys: list[str], levels: list[str]) -> DataFrame:
    """rows (keys, level, name, value) -> the value of each name from the first level
    that has one; names are equal but for their writing; blanks don't count."""
    rank = F.array_position(F.array(*map(F.lit, levels)), F.col("level"))
    some = rows.where((rank > 0) & (F.btrim("value") != "")).select(*keys, slug(F.col("name")).alias("name"), rank.alias("r"), "value")
    best = some.groupBy(*keys, "name").agg(F.min(F.struct("r", "value")).alias("b"))
    return best.select(*keys, "name", F.col("b.value").alias("value"), F.element_at(F.array(*map(F.lit, levels)), F.col("b.r").cast("int")).alias("level"))

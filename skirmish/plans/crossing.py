"""Bouts of other organisations: known names, one canonical bout of two perspectives, weights, staging, summaries."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clean, names
from ..operators import diagnostics


def known_names(current: DataFrame) -> DataFrame:
    """Compact key of every rated name: name_key, known, known_division. Of two names with one key the later one by name counts."""
    place = [c for c in ("recent_division", "primary_division") if c in current.columns]
    division = F.coalesce(*place, F.lit(None).cast("string")) if place else F.lit(None).cast("string")
    keyed = names.with_name_key(current.where("fighter is not null").select("fighter", F.when(division != "", division).alias("division")), "fighter")
    return keyed.groupBy("name_key").agg(F.max("fighter").alias("known"), F.max_by("division", F.when(F.col("division").isNotNull(), F.col("fighter"))).alias("known_division"))


def canonical(raw: DataFrame, known: DataFrame) -> DataFrame:
    """One bout for each fight_key of both sides' rows (fight_key, ord, fighter, opponent, result, event_name, event_date, org, ...).

    The winner is side a. A decided row goes before any other, then the first by `ord`. Names that are known take the
    known spelling, and the division is the one known of side a, else of side b, else Open Weight. Bouts without a known
    side or a date, and those before the unified rules, are left out.
    """
    rows = names.with_name_key(names.with_name_key(raw, "fighter", "_kf"), "opponent", "_ko")
    for side, key in (("f", "_kf"), ("o", "_ko")):
        rows = rows.join(known.select(F.col("name_key").alias(key), F.col("known").alias(f"_n{side}"), F.col("known_division").alias(f"_d{side}")), key, "left")
    rows = rows.where("(_nf is not null or _no is not null) and event_date is not null").where(F.col("event_date") >= F.lit(clean.ERA_START).cast("date"))
    lost = F.col("result") == "loss"
    decided = F.col("result").isin("win", "loss")
    mine, other = F.coalesce("_nf", "fighter"), F.coalesce("_no", "opponent")
    a, b = F.when(lost, other).otherwise(mine), F.when(lost, mine).otherwise(other)
    division = F.coalesce(F.when(lost, F.col("_do")).otherwise(F.col("_df")), F.when(lost, F.col("_df")).otherwise(F.col("_do")), F.lit("Open Weight"))
    bout = F.struct(
        a.alias("fighter_a"), b.alias("fighter_b"), F.when(decided, a).alias("winner"), F.when(decided, b).alias("loser"), (F.col("result") == "draw").alias("is_draw"), (F.col("result") == "nc").alias("is_nc"),
        division.alias("weight_class"), "event_name", "event_date", "org", "method_class",
    )
    best = rows.groupBy("fight_key").agg(F.min_by(bout, F.struct((~decided).alias("late"), F.col("ord"))).alias("b"))
    return best.select("fight_key", "b.*")


def weighted(bouts: DataFrame, current: DataFrame, rating: str = "mu") -> DataFrame:
    """Canonical bouts with org_weight, by the caliber of their two sides."""
    caliber = diagnostics.strictly_below(current.where(F.col(rating).isNotNull()), rating, F.col("rating_periods") >= 3)
    rows = bouts.withColumn("bout_id", F.col("fight_key"))
    return bouts.join(diagnostics.crossing_weights(rows, caliber).select(F.col("bout_id").alias("fight_key"), F.col("fight_weight").alias("org_weight")), "fight_key")


def summary(bouts: DataFrame) -> DataFrame:
    """Bouts and mean weight of every organisation."""
    return bouts.groupBy("org").agg(F.count(F.lit(1)).alias("bouts"), F.round(F.avg("org_weight"), 3).alias("mean_weight"))


def roster(results: DataFrame, known: DataFrame) -> DataFrame:
    """Known names among the competitors of some organisations' events (event, fighter_name)."""
    event = F.lower("event")
    rows = results.where(event.startswith("pride") | event.startswith("wec") | event.contains("strikeforce") | event.contains("world extreme cagefighting") | event.contains("pride fc"))
    keyed = names.with_name_key(rows.where("fighter_name is not null").select("fighter_name").distinct(), "fighter_name")
    return keyed.join(known, "name_key").select(F.col("known").alias("fighter")).distinct()


def joined(bouts: DataFrame, crossing: DataFrame) -> DataFrame:
    """All bouts of both: own ones weigh 1, the others what their sides' caliber says."""
    return bouts.withColumn("org_weight", F.lit(1.0)).unionByName(crossing, allowMissingColumns=True)


def stage(spark: SparkSession, base: str, new: str, raw: DataFrame) -> DataFrame:
    """A new snapshot folder with the base's tables, the crossing bouts and the organisations' weights; returns the summary."""
    from ..sources.catalog import load

    tables = load(spark, base, register=False)
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{new}/{name}.parquet")
    current = tables["ratings_current"]
    rating = "mu" if "mu" in current.columns else "mu_canonical"
    weighted(canonical(raw, known_names(current)), current, rating).write.mode("overwrite").parquet(f"{new}/crossorg_fights.parquet")
    bouts = spark.read.parquet(f"{new}/crossorg_fights.parquet")
    weights = diagnostics.organisation_weights(bouts, current.withColumnRenamed(rating, "mu")).collect()  # a row for each organisation
    note = spark.createDataFrame([(json.dumps({r.org: r.org_weight for r in weights}, sort_keys=True),)], "value string")
    note.coalesce(1).write.mode("overwrite").text(f"{new}/org_weights.json")
    return summary(bouts)

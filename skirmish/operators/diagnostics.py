"""Calibration, attribution, entropy, coverage and cross-organisation weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.quality import clip
from .spread import totals_before


def probability_bin(p: Column, bins: int) -> Column:
    """Right-closed bins, the first one closed at 0 too."""
    return F.greatest(F.ceil(p * bins) - 1, F.lit(0)).cast("int")


def calibration(rows: DataFrame, bins: int = DEFAULT.bins) -> DataFrame:
    """Predicted and actual rates by bin over all, by division and by stance, in one pass of grouping sets.

    `rows`: p_win, actual, division, stance, a row for each side of each bout.
    """
    rows = rows.withColumns({"prob_bin": probability_bin(F.col("p_win"), bins), "division": F.coalesce("division", F.lit("Unknown")), "stance": F.coalesce("stance", F.lit("Unknown"))})
    sets = [["prob_bin"], ["prob_bin", "division"], ["prob_bin", "stance"]]
    grouped = rows.groupingSets(sets, "prob_bin", "division", "stance").agg(
        F.grouping_id().alias("_g"), F.avg("p_win").alias("predicted_mean"), F.avg("actual").alias("empirical_win_rate"), F.avg((F.col("p_win") - F.col("actual")) ** 2).alias("brier"), F.count(F.lit(1)).alias("n")
    )
    return grouped.select(
        F.when(F.col("_g") == 3, "overall").when(F.col("_g") == 1, "division").otherwise("stance").alias("segment_type"),
        F.when(F.col("_g") == 3, "all").when(F.col("_g") == 1, F.col("division")).otherwise(F.col("stance")).alias("segment_value"),
        "prob_bin", "predicted_mean", "empirical_win_rate", (F.col("empirical_win_rate") - F.col("predicted_mean")).alias("residual"), "brier", "n",
    )


def worst_segments(residuals: DataFrame, segment: str = "division", least: int = 40, top: int = 8) -> DataFrame:
    """The segments whose bins of enough rows are off most, on average."""
    rows = residuals.where((F.col("segment_type") == segment) & (F.col("n") >= least))
    return rows.groupBy("segment_value").agg(F.avg(F.abs("residual")).alias("mean_abs_residual"), F.sum("n").alias("n")).orderBy(F.desc("mean_abs_residual"), "segment_value").limit(top)


def attribution(deltas: DataFrame) -> DataFrame:
    """Each event's change of the method rating, and what integrity, performance and both together add; `deltas`: stream, fighter, event, delta."""
    wide = deltas.groupBy("fighter", "event_date", "event_name", "event_seq").pivot("stream", ["method", "method_integrity", "method_performance", "method_integrity_performance"]).agg(F.first("delta"))
    base = F.col("method")
    i, p, b = (F.coalesce(F.col(c), base) for c in ("method_integrity", "method_performance", "method_integrity_performance"))
    return wide.where("method is not null").select(
        "fighter", "event_date", "event_name", "event_seq", base.alias("base_delta"), (i - base).alias("integrity_delta"), (p - base).alias("performance_delta"),
        (b - base - (i - base) - (p - base)).alias("interaction_delta"), b.alias("combined_delta"),
    )


def entropy(appearances: DataFrame, history: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """How dense the top of each division is by year: entropy of a softmax over the top ratings, their spread and density."""
    rows = appearances.where("division is not null").join(history.select("fighter", "event_seq", "mu"), ["fighter", "event_seq"])
    last = rows.groupBy(F.year("event_date").alias("year"), "division", "fighter").agg(F.max_by("mu", F.struct("event_seq", "bout_id")).alias("mu"))
    w = W.partitionBy("year", "division")
    top = last.withColumns({"k": F.row_number().over(w.orderBy(F.desc("mu"), "fighter")), "all": F.count(F.lit(1)).over(w)}).where(F.col("k") <= cfg.entropy_top)
    top = top.withColumn("e", F.exp((F.col("mu") - F.max("mu").over(w)) / cfg.temperature)).withColumn("p", F.col("e") / F.sum("e").over(w))
    out = top.groupBy("year", "division").agg(
        F.max("all").alias("fighters_in_division"), F.count(F.lit(1)).alias("top_n"), F.avg("mu").alias("top_mu_mean"), F.stddev_pop("mu").alias("top_mu_std"), (F.max("mu") - F.min("mu")).alias("top_mu_range"), F.sum(-F.col("p") * F.log("p")).alias("h")
    )
    return out.select(
        "year", "division", "fighters_in_division", "top_n", "top_mu_mean", "top_mu_std", "top_mu_range", (F.col("top_n") / F.greatest(F.col("top_mu_range") / 100, F.lit(1.0))).alias("density_per_100_mu"),
        F.when(F.col("top_n") > 1, F.col("h") / F.log(F.col("top_n"))).otherwise(0.0).alias("entropy_normalized"),
    )


def strength(appearances: DataFrame, history: DataFrame, top: int = 15) -> DataFrame:
    """Mean of the top year-end ratings by division and year, where enough competitors are rated, and the year's index to 100."""
    eoy = history.groupBy("fighter", F.year("event_date").alias("year")).agg(F.max_by("mu", "event_seq").alias("mu"))
    pairs = appearances.where("division is not null").select("division", F.year("event_date").alias("year"), "fighter").distinct()
    rows = pairs.join(eoy, ["fighter", "year"])
    best = rows.withColumn("k", F.row_number().over(W.partitionBy("division", "year").orderBy(F.desc("mu"), "fighter"))).where(F.col("k") <= top)
    out = best.groupBy("division", "year").agg(F.avg("mu").alias("strength"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= min(5, top))
    return out.withColumn("indexed", 100 * F.col("strength") / F.max("strength").over(W.partitionBy("year")))


def strictly_below(rows: DataFrame, value: str, member: Column) -> DataFrame:
    """`rows` with percentile: the share of the members whose value is strictly less.

    Members are counted by distinct value and summed over the values range by range.
    """
    counts = rows.groupBy(value).agg(F.count_if(member).alias("_here_"))
    run = totals_before(counts, F.col(value).asc(), "_here_").select(value, "_before", "_all")
    return rows.join(run, value).withColumn("percentile", F.try_divide(F.col("_before"), F.col("_all"))).drop("_before", "_all")


def crossing_weights(bouts: DataFrame, caliber: DataFrame, floor: float = 0.5, cap: float = 1.0, unknown: float = 0.30) -> DataFrame:
    """Weight of each bout from its two competitors' caliber (fighter, percentile).

    A competitor without one takes the median caliber of the opponents it met, and `unknown` where none of them has one.
    """
    sides = bouts.select("bout_id", F.explode(F.array(F.struct(F.col("fighter_a").alias("fighter"), F.col("fighter_b").alias("opponent")), F.struct(F.col("fighter_b").alias("fighter"), F.col("fighter_a").alias("opponent")))).alias("s")).select("bout_id", "s.*")
    sides = sides.join(caliber.select("fighter", "percentile"), "fighter", "left").join(caliber.select(F.col("fighter").alias("opponent"), F.col("percentile").alias("opponent_percentile")), "opponent", "left")
    inferred = sides.where("percentile is null").groupBy("fighter").agg(F.median("opponent_percentile").alias("inferred"))
    level = F.coalesce("percentile", "inferred", F.lit(unknown))
    return sides.join(inferred, "fighter", "left").groupBy("bout_id").agg(clip(F.avg(level), floor, cap).alias("fight_weight"))


def organisation_weights(bouts: DataFrame, rated: DataFrame, floor: float = 0.5, cap: float = 0.95, least: int = 3) -> DataFrame:
    """Weight of each organisation: where the median of its established participants stands in the established field."""
    field = rated.where((F.col("rating_periods") >= least) & F.col("mu").isNotNull()).select("fighter", "mu")
    people = bouts.select("org", F.explode(F.array("fighter_a", "fighter_b")).alias("fighter")).where("fighter is not null").distinct()
    median = people.join(field, "fighter", "left").groupBy("org").agg(F.median("mu").alias("mu"))
    marked = median.select("org", "mu").withColumn("in_field", F.lit(False)).unionByName(field.select(F.lit(None).cast("string").alias("org"), "mu").withColumn("in_field", F.lit(True)))
    placed = strictly_below(marked.where("mu is not null"), "mu", F.col("in_field")).where("not in_field").select("org", "percentile")
    return median.select("org").join(placed, "org", "left").select("org", F.when(F.col("percentile").isNull(), floor).otherwise(clip(F.col("percentile"), floor, cap)).alias("org_weight"))

"""Leaderboards and frames behind the analysts' charts. Top-k orders end in a unique key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import names
from . import library
from .labels import backing_column

#: Divisions as the charts know them.
DIVISIONS = (
    "Strawweight", "Flyweight", "Bantamweight", "Featherweight", "Lightweight", "Welterweight", "Middleweight", "Light Heavyweight", "Heavyweight",
    "Women's Strawweight", "Women's Flyweight", "Women's Bantamweight", "Women's Featherweight", "Catch Weight", "Open Weight",
)
#: Bouts that a ten-year period must have.
PERIOD_LEAST = 13


def chart_division(weight_class: Column) -> Column:
    """Division named in a weight class, the longest label first; else what is left of the text."""
    left = F.trim(F.regexp_replace(weight_class, "UFC | Title Bout| Bout", ""))
    out = left
    for label in sorted(DIVISIONS, key=len):  # the last one tested first
        out = F.when(F.lower(left).contains(label.lower()), label).otherwise(out)
    return out


def with_division(bouts: DataFrame) -> DataFrame:
    return bouts.withColumn("division", chart_division(F.col("weight_class")))


def of_fighter(df: DataFrame, text: str) -> DataFrame:
    """Rows whose competitor's compact key holds the key of a text; all rows for a text without letters and digits."""
    key = names.with_name_key(df.sparkSession.createDataFrame([(text or "",)], "q string"), "q").select(F.col("name_key").alias("_q"))
    keyed = names.with_name_key(df, "fighter", "_key").crossJoin(F.broadcast(key))  # one row
    return keyed.where((F.col("_q") == "") | F.col("_key").contains(F.col("_q"))).drop("_key", "_q")


def numbered(top: DataFrame, rating: str) -> DataFrame:
    """A top list with its places; it has n rows."""
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.desc(rating), "fighter")).cast("long"))


def sleeve_ranking(current: DataFrame, rating: str, baseline: str = "mu_canonical", n: int = 25, least: int = 3, division: str | None = None, active_within: int | None = None, query: str = "") -> DataFrame:
    """The top by a sleeve's rating beside its baseline and the difference; a query marks the names that hold it."""
    top = numbered(library.leaderboard(current, rating, n, least, division, active_within).drop("rank"), rating)
    out = top.select("rank", "fighter", F.round(rating, 1).alias("current_rating"), F.round(baseline, 1).alias("baseline_rating"), F.round(F.col(rating) - F.col(baseline), 1).alias("delta_vs_baseline"), "last_event_date")
    if not query:
        return out
    return out.join(of_fighter(out, query).select("rank", F.lit(True).alias("query_match")), "rank", "left").withColumn("query_match", F.coalesce("query_match", F.lit(False)))


def period_leaderboard(current: DataFrame, n: int = 25, least: int = PERIOD_LEAST) -> DataFrame:
    """The top by the best period there is: ten years before five, the smoothed rating first; with the five-year score beside it."""
    ten = ("sustained_peak_headline_mu_whr", "sustained_peak_mu_method_integrity_performance", "five_year_peak_mu_method_integrity_performance", "five_year_peak_mu_canonical")
    five = ("five_year_peak_headline_mu_whr", "five_year_peak_mu_method_integrity_performance", "five_year_peak_mu_canonical")
    rating, beside = (next((c for c in wanted if c in current.columns), wanted[-1]) for wanted in (ten, five))
    top = numbered(library.leaderboard(current, rating, n, least).drop("rank"), rating)
    return top.select("rank", "fighter", F.round(rating, 1).alias("period_rating"), F.round(beside, 1).alias("five_year_rating"), "rating_periods", F.lit(rating).alias("rating_column"))


def gendered_leaderboard(current: DataFrame, rating: str = "mu_canonical", baseline: str = "mu_canonical", n: int = 15, least: int = 3, division: str | None = None) -> DataFrame:
    """The tops of men and women, by the division that a competitor was last in or mainly is in."""
    place = F.coalesce("recent_division", "primary_division") if "primary_division" in current.columns else F.col("recent_division")
    rows = current.withColumn("division", F.coalesce(place, F.lit(""))).where((F.coalesce("rating_periods", F.lit(0)) >= least) & F.col(rating).isNotNull())
    if division:
        rows = rows.where(F.col("division") == division)
    rows = rows.withColumn("gender", F.when(F.col("division").startswith("Women's"), "F").otherwise("M"))
    top = library.top_by_group(rows, "gender", rating, n)
    return top.select("gender", F.col("position").cast("long").alias("rank"), "fighter", F.round(rating, 1).alias("rating"), F.round(F.col(rating) - F.col(baseline), 1).alias("vs_wins"), "division", "last_event_date", "rating_periods")


def tape_leaderboard(current: DataFrame, tape: DataFrame, rating: str, n: int = 25, least: int = 3, active_within: int | None = None) -> DataFrame:
    """A leaderboard with what is known of each body."""
    return numbered(library.leaderboard(current, rating, n, least, None, active_within).drop("rank"), rating).join(tape, "fighter", "left")


#: Orders of a streak table.
STREAK_ORDERS = {"length": ("length", "avg_opp_rating", "title_wins"), "quality": ("avg_opp_rating", "length", "title_wins"), "title_wins": ("title_wins", "length", "avg_opp_rating")}


def rated_streaks(streaks: DataFrame, wins: DataFrame, current: DataFrame, rating: str = "mu") -> DataFrame:
    """Streaks with the mean rating of the opponents beaten, the divisions they were won in and the gender."""
    inside = streaks.select("fighter", "start_date", "end_date").join(wins.select("fighter", "opponent", "event_date", "division"), "fighter").where("event_date between start_date and end_date")
    beaten = inside.join(current.select(F.col("fighter").alias("opponent"), F.col(rating).alias("_r")), "opponent", "left")
    beaten = beaten.groupBy("fighter", "start_date").agg(F.avg("_r").alias("avg_opp_rating"), F.array_sort(F.collect_set("division")).alias("divisions"))
    out = streaks.join(beaten, ["fighter", "start_date"], "left")
    return out.withColumn("gender", F.when(F.exists("divisions", lambda d: d.startswith("Women's")), "F").otherwise("M"))


def streak_table(streaks: DataFrame, n: int = 25, division: str | None = None, gender: str | None = None, sort_by: str = "length") -> DataFrame:
    """The top streaks by length, by the opponents or by title wins, of a division or a gender."""
    if division and division != "All":
        streaks = streaks.where(F.array_contains("divisions", division))
    if gender in ("M", "F"):
        streaks = streaks.where(F.col("gender") == gender)
    order = STREAK_ORDERS.get(sort_by, STREAK_ORDERS["length"])
    return streaks.orderBy(*[F.desc_nulls_last(c) for c in order], "fighter", "start_date").limit(n)


def moved(current: DataFrame, odds: DataFrame, delta: str, n: int = 15, least: float = 0.01) -> DataFrame:
    """The largest moves of a sleeve both ways, with what the market said of these competitors."""
    rows = current.where(F.abs(F.col(delta)) > least)
    return library.extremes(rows, delta, n).join(library.fighter_odds(odds), "fighter", "left").withColumn("n_odds", F.coalesce("n_odds", F.lit(0).cast("long")))


def moved_count(current: DataFrame, delta: str, least: float = 0.01) -> DataFrame:
    """How many competitors a sleeve moves."""
    return current.agg(F.count_if(F.abs(F.col(delta)) > least).alias("moved"), F.count(F.lit(1)).alias("fighters"))


def profile(current: DataFrame, fighter: str) -> DataFrame:
    """A competitor's rating now and its best periods, a row each, those that are known."""
    have = current.columns
    picks = [("Current rating", backing_column(have, "canonical"))]
    for label, view in (("10-year peak", "sustained_peak"), ("5-year peak", "five_year_peak")):
        picks.append((label, next((c for c in (f"{view}_headline_mu_whr", f"{view}_mu_canonical") if c in have), None)))
    parts = [F.struct(F.lit(label).alias("metric"), F.col(c).cast("double").alias("value")) for label, c in picks if c]
    return current.where(F.col("fighter") == fighter).select("fighter", F.explode(F.array(*parts)).alias("m")).select("fighter", "m.*").where("value is not null")


def entropy_lines(entropy: DataFrame, divisions: list[str] | None = None, n: int = 8) -> DataFrame:
    """The yearly crowdedness of some divisions, else of the strongest ones of the newest year."""
    if divisions:
        return entropy.where(F.col("division").isin(*divisions))
    newest = entropy.agg(F.max("year").alias("_y"))
    top = entropy.crossJoin(F.broadcast(newest)).where("year = _y").orderBy(F.desc("top_mu_mean"), "division").limit(n).select("division")  # one row
    return entropy.join(F.broadcast(top), "division", "left_semi")  # n rows


def strength_of_year(strength: DataFrame, year: int) -> DataFrame:
    return strength.where(F.col("year") == year).select("division", "strength", "n")


def merged_metrics(tables: list[tuple[DataFrame, str, str]], current: DataFrame, columns: dict[str, str], prefix: str) -> DataFrame:
    """Ranking tables (fighter, division, fights, score) as one row a competitor with a column for each metric.

    The first table that lists a competitor gives its division and bouts. A score that a table lacks comes from the
    column `prefix` + columns[metric] of `current`, and `filled` names such metrics.
    """
    out = None
    for place, (df, score, metric) in enumerate(tables):
        rows = df.select("fighter", F.struct(F.lit(place).alias("place"), "division", "fights").alias("seed"), F.lit(metric).alias("metric"), F.col(score).cast("double").alias("score"))
        out = rows if out is None else out.unionByName(rows)
    metrics = list(dict.fromkeys(m for _, _, m in tables))
    wide = out.groupBy("fighter").agg(F.min("seed").alias("_s"), *[F.max(F.when(F.col("metric") == m, F.col("score"))).alias(m) for m in metrics])
    backed = {m: prefix + columns[m] for m in metrics if m in columns and prefix + columns[m] in current.columns}
    wide = wide.join(current.select("fighter", *[F.round(c, 1).alias(f"_db_{m}") for m, c in backed.items()]), "fighter", "left")
    filled = F.array_compact(F.array(*[F.when(F.col(m).isNull() & F.col(f"_db_{m}").isNotNull(), F.lit(m)) for m in backed])) if backed else F.array().cast("array<string>")
    scores = [F.coalesce(m, f"_db_{m}").alias(m) if m in backed else F.col(m) for m in metrics]
    return wide.select("fighter", "_s.division", "_s.fights", *scores, F.array_join(filled, ", ").alias("filled"))


def stacked(tables: list[DataFrame]) -> DataFrame:
    """The divisions' tables as one."""
    out = tables[0].select("fighter", "division", "fights", "score")
    for df in tables[1:]:
        out = out.unionByName(df.select("fighter", "division", "fights", "score"))
    return out

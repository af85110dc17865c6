"""Analysts' queries over rating tables: leaderboards, comparisons, movers, audits. Top-k orders end in a unique key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ratings import interval, match_quality, win_probability
from ..operators.spread import totals_before

#: Public names of the rating streams.
LENSES = {"Wins": "canonical", "Finishes": "method", "Clean": "method_integrity", "Strength": "method_performance", "Complete": "method_integrity_performance", "Legacy": "whr"}
TIMES = {"Now": "", "Peak": "five_year_", "Prime": "ten_year_"}


def rating_column(columns: list[str], lens: str, time: str = "Now") -> str | None:
    """The column of a lens and time: a headline before a plain score, and nothing where neither is there."""
    stream = LENSES[lens]
    names = [f"mu_{stream}"] if time == "Now" else [f"{TIMES[time]}headline_mu_{stream}", f"{TIMES[time]}mu_{stream}"]
    return next((n for n in names if n in columns), None)


def stream_of(method: str, integrity: bool = False, performance: bool = False) -> str:
    """Stream of a scoring method with its sleeves; plain wins take none."""
    if method == "canonical" and (integrity or performance):
        raise ValueError("sleeves belong to the method stream")
    return "_".join([method, *["integrity"] * integrity, *["performance"] * performance])


def leaderboard(current: DataFrame, rating: str = "mu", n: int = 25, least: int = 3, division: str | None = None, active_within: int | None = None) -> DataFrame:
    """The top by rating among those with enough periods, of a division, active within some days of the newest event."""
    rows = current.where((F.col("rating_periods") >= least) & F.col(rating).isNotNull())
    if division:
        rows = rows.where(F.col("recent_division") == division)
    if active_within is not None:
        end = current.agg(F.max("last_event_date").alias("_end"))
        rows = rows.crossJoin(F.broadcast(end)).where(F.datediff("_end", "last_event_date") <= active_within).drop("_end")  # one row
    top = rows.orderBy(F.desc(rating), "fighter").limit(n)
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.desc(rating), "fighter")))  # n rows


def ranked(current: DataFrame, rating: str = "mu", least: int = 3) -> DataFrame:
    """Competition ranks among the eligible. Ranks follow from running counts of distinct values, range by range."""
    rows = current.where((F.col("rating_periods") >= least) & F.col(rating).isNotNull())
    above = totals_before(rows.groupBy(rating).count(), F.desc(rating), "count")
    return rows.join(above.select(rating, (F.col("_before") + 1).alias("rank")), rating)


def top_by_group(rows: DataFrame, group: str, rating: str, n: int = 8) -> DataFrame:
    return rows.withColumn("position", F.row_number().over(W.partitionBy(group).orderBy(F.desc(rating), "fighter"))).where(F.col("position") <= n)


def extremes(rows: DataFrame, value: str, n: int = 15) -> DataFrame:
    """The lowest and the highest n, each row once."""
    low = rows.orderBy(F.asc(value), "fighter").limit(n)
    high = rows.orderBy(F.desc(value), "fighter").limit(n)
    return low.union(high).dropDuplicates(["fighter"])


def movers(old: DataFrame, new: DataFrame, rating: str = "mu", top: int = 50, n: int = 20, least: int = 3) -> DataFrame:
    """Largest moves between two snapshots' top ranks; a competitor outside stands one below the last."""
    def top_ranks(df: DataFrame, mark: str) -> DataFrame:
        rows = df.where((F.col("rating_periods") >= least) & F.col(rating).isNotNull()).orderBy(F.desc(rating), "fighter").limit(top)
        return rows.select("fighter", F.row_number().over(W.orderBy(F.desc(rating), "fighter")).alias(f"rank_{mark}"))  # `top` rows

    both = top_ranks(old, "old").join(top_ranks(new, "new"), "fighter", "full_outer")
    a, b = F.coalesce("rank_old", F.lit(top + 1)), F.coalesce("rank_new", F.lit(top + 1))
    status = F.when(F.col("rank_old").isNull(), "Entered").when(F.col("rank_new").isNull(), "Left").when(a > b, "Up").otherwise("Down")
    return both.withColumns({"move": a - b, "status": status}).where("move <> 0").orderBy(F.abs("move").desc(), b, "fighter").limit(n)


def snapshot_deltas(old: DataFrame, new: DataFrame, rating: str = "mu", n: int = 10) -> DataFrame:
    """The largest gains and losses between two snapshots."""
    both = new.select("fighter", F.col(rating).alias("new")).join(old.select("fighter", F.col(rating).alias("old")), "fighter").withColumn("delta", F.col("new") - F.col("old"))
    return extremes(both, "delta", n)


def head_to_head(current: DataFrame, a: str, b: str) -> DataFrame:
    """Two competitors' states, the chance that each wins, and how even the match is."""
    one, two = (current.where(F.col("fighter") == x).select(*[F.col(c).alias(f"{c}_{s}") for c in ("fighter", "mu", "phi")]) for x, s in ((a, "a"), (b, "b")))
    c = F.col
    p = win_probability(c("mu_a"), c("mu_b"), c("phi_b"))
    return one.crossJoin(two).withColumns({"win_a": F.bround(p, 4), "win_b": F.bround(1 - p, 4), "quality": F.bround(match_quality(c("mu_a"), c("phi_a"), c("mu_b"), c("phi_b")), 4)})  # a row each


def records(appearances: DataFrame) -> DataFrame:
    """Wins, losses, draws and methods of every competitor."""
    methods = appearances.where("is_winner").groupBy("fighter", "method_class").count().groupBy("fighter").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(": ", "method_class", "count"))), ", ").alias("win_methods"))
    base = appearances.groupBy("fighter").agg(F.count_if("is_winner").alias("wins"), F.count_if(~F.col("is_winner") & ~F.col("is_draw")).alias("losses"), F.count_if("is_draw").alias("draws"), F.count(F.lit(1)).alias("total"))
    return base.join(methods, "fighter", "left")


def card(current: DataFrame, appearances: DataFrame, fighter: str) -> DataFrame:
    """One competitor: state with its interval, and record."""
    low, high = interval(F.col("mu"), F.col("phi"))
    return current.where(F.col("fighter") == fighter).withColumns({"mu_low": low, "mu_high": high}).join(records(appearances.where(F.col("fighter") == fighter)), "fighter", "left")


def trajectory(history: DataFrame, appearances: DataFrame, fighters: list[str]) -> DataFrame:
    """Rating lines with their band, and the methods won by on each day."""
    low, high = interval(F.col("mu"), F.col("phi"))
    won = appearances.where(F.col("fighter").isin(*fighters) & F.col("is_winner")).groupBy("fighter", "event_seq").agg(F.array_join(F.array_sort(F.collect_set("method_class")), ", ").alias("markers"))
    return history.where(F.col("fighter").isin(*fighters)).join(won, ["fighter", "event_seq"], "left").withColumns({"mu_low": low, "mu_high": high})


def search(current: DataFrame, text: str = "", rating: str = "mu", n: int = 20) -> DataFrame:
    """Competitors whose name holds the text as it is, by rating."""
    return current.where(F.lower("fighter").contains(text.lower())).orderBy(F.desc(rating), "fighter").limit(n)


def density_share(current: DataFrame, rating: str, n: int = 100) -> DataFrame:
    """Divisions' shares of the top n."""
    top = current.where(F.col(rating).isNotNull()).orderBy(F.desc(rating), "fighter").limit(n)
    return top.groupBy("recent_division").agg(F.count(F.lit(1)).alias("n")).withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy()))


def favourite_table(odds: DataFrame) -> DataFrame:
    """Favourites' and underdogs' bouts, wins, draws, rate over decided bouts, and the market's expectation."""
    rows = odds.where("odds_data_quality = 'ok' and favorite is not null")
    p_fav = F.greatest("prob_a", "prob_b")
    sides = F.array(F.struct(F.lit("favorite").alias("side"), F.col("favorite").alias("who"), p_fav.alias("p")), F.struct(F.lit("underdog").alias("side"), F.col("underdog").alias("who"), (1 - p_fav).alias("p")))
    rows = rows.select("winner", "is_draw", F.explode(sides).alias("s")).select("winner", "is_draw", "s.*")
    won = F.coalesce(F.col("winner") == F.col("who"), F.lit(False)) & ~F.col("is_draw")
    out = rows.groupBy("side").agg(F.count(F.lit(1)).alias("bouts"), F.count_if(won).alias("wins"), F.count_if("is_draw").alias("draws"), F.avg("p").alias("expected"))
    return out.withColumn("win_rate", F.try_divide(F.col("wins"), F.col("bouts") - F.col("draws")))


def fighter_odds(odds: DataFrame) -> DataFrame:
    """Bouts with good odds of every competitor and the median market probability."""
    sides = F.array(F.struct(F.col("fighter_a").alias("fighter"), F.col("prob_a").alias("p")), F.struct(F.col("fighter_b").alias("fighter"), F.col("prob_b").alias("p")))
    return odds.where("odds_data_quality = 'ok'").select(F.explode(sides).alias("s")).select("s.*").groupBy("fighter").agg(F.count("p").alias("n_odds"), F.median("p").alias("median_prob"))


def factor_summary(factors: DataFrame) -> DataFrame:
    """Count, least, median and largest multiplier by factor and effect."""
    return factors.groupBy("factor", "effect").agg(F.count(F.lit(1)).alias("n"), F.min("multiplier").alias("least"), F.median("multiplier").alias("median"), F.max("multiplier").alias("most"))


def bout_effects(factors: DataFrame, n: int = 25) -> DataFrame:
    """Bouts' total effect: the product of the factors that aren't neutral, and their names."""
    rows = factors.where("effect <> 'neutral'").groupBy("bout_id", "fighter").agg(F.product("multiplier").alias("total"), F.array_join(F.array_sort(F.collect_set("factor")), ", ").alias("factors"))
    return rows.orderBy(F.abs(F.col("total") - 1).desc(), "bout_id", "fighter").limit(n)


def scorecards(cards: DataFrame) -> DataFrame:
    """Decisions by how the judges' cards fall: all one way, most, both, or other."""
    pairs = F.regexp_extract_all("details_text", F.lit(r"(\d{2})\s*-\s*(\d{2})"), F.lit(0))
    votes = F.transform(pairs, lambda s: F.signum(F.regexp_extract(s, r"^(\d{2})", 1).cast("int") - F.regexp_extract(s, r"(\d{2})$", 1).cast("int")))
    rows = cards.select("bout_id", votes.alias("v")).where("size(v) > 0")
    a, b, n = F.size(F.filter("v", lambda x: x > 0)), F.size(F.filter("v", lambda x: x < 0)), F.size("v")
    kind = F.when((a == n) | (b == n), "unanimous").when((a > 0) & (b > 0), "split").when((a + b >= 2) & (a + b < n), "majority").otherwise("other")
    return rows.select("bout_id", kind.alias("decision"))


def residual_fit(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Rows with their residual from the least-squares line through all of them."""
    line = rows.agg(F.regr_slope(y, x).alias("_k"), F.regr_intercept(y, x).alias("_c"))
    return rows.crossJoin(F.broadcast(line)).withColumn("residual", F.col(y) - F.col("_k") * F.col(x) - F.col("_c")).drop("_k", "_c")  # one row


def pace(rounds: DataFrame, bouts: DataFrame, least: int = 5) -> DataFrame:
    """Strikes a minute and attempts a quarter-hour of competitors with enough bouts; a bout without a duration counts a round for each row."""
    seconds = (F.greatest(F.col("end_round"), F.lit(1)) - 1) * 300 + F.col("end_time_seconds")
    sums = rounds.groupBy("bout_id", "fighter").agg(F.sum("sig_str_landed").alias("strikes"), F.sum("sub_att").alias("attempts"), F.count(F.lit(1)).alias("rounds"))
    rows = sums.join(bouts.select("bout_id", F.when(seconds > 0, seconds).alias("seconds")), "bout_id")
    out = rows.groupBy("fighter").agg(F.count(F.lit(1)).alias("bouts"), F.sum("strikes").alias("strikes"), F.sum("attempts").alias("attempts"), F.sum(F.coalesce("seconds", F.col("rounds") * 300)).alias("seconds")).where(F.col("bouts") >= least)
    return out.select("fighter", "bouts", F.try_divide(F.col("strikes") * 60, "seconds").alias("strikes_per_minute"), F.try_divide(F.col("attempts") * 900, "seconds").alias("attempts_per_15"))


def era_matrix(strength: DataFrame, years: list[int]) -> DataFrame:
    return strength.groupBy("division").pivot("year", years).agg(F.first("indexed"))


def metric_ranks(rows: DataFrame, metrics: list[str], group: str | None = None) -> DataFrame:
    """z-scores and ranks of each metric over all, or by group; with the mean rank and the spread of both."""
    if group:
        w = W.partitionBy(group)
        out = rows.withColumns({f"z_{m}": (F.col(m) - F.avg(m).over(w)) / F.stddev_samp(m).over(w) for m in metrics} | {f"rank_{m}": F.rank().over(w.orderBy(F.col(m).desc_nulls_last())) for m in metrics})
    else:
        line = rows.agg(*[f(m).alias(f"_{k}_{m}") for m in metrics for k, f in (("m", F.avg), ("s", F.stddev_samp))])
        out = rows.crossJoin(F.broadcast(line)).withColumns({f"z_{m}": (F.col(m) - F.col(f"_m_{m}")) / F.col(f"_s_{m}") for m in metrics}).drop(*line.columns)  # one row
        for m in metrics:
            above = totals_before(rows.groupBy(m).count(), F.col(m).desc_nulls_last(), "count")
            above = above.select(F.col(m).alias("_v"), (F.col("_before") + 1).cast("int").alias(f"rank_{m}"))
            out = out.join(above, out[m].eqNullSafe(above["_v"])).drop("_v")
    z, r = [F.col(f"z_{m}") for m in metrics], [F.col(f"rank_{m}") for m in metrics]
    return out.withColumns({"mean_rank": sum(r, F.lit(0.0)) / len(r), "rank_spread": F.greatest(*r) - F.least(*r), "z_spread": F.greatest(*z) - F.least(*z)})


def best_external(rankings: DataFrame) -> DataFrame:
    """Each name's best row of an outside ranking, by points, then rank."""
    return rankings.withColumn("_k", F.row_number().over(W.partitionBy("name_key").orderBy(F.desc("points"), "rank", "division"))).where("_k = 1").drop("_k")


def rank_gap(current: DataFrame, rankings: DataFrame, rating: str = "mu", least: int = 3) -> DataFrame:
    """Own rank against an outside one, over keys of names; own rows without an outside rank stay."""
    return ranked(current, rating, least).join(best_external(rankings).select("name_key", F.col("rank").alias("outside_rank"), "points"), "name_key", "left").withColumn("gap", F.col("outside_rank") - F.col("rank"))


def division_comparison(current: DataFrame, rankings: DataFrame, rating: str = "mu", top: int = 15) -> DataFrame:
    """Mean of the top by division here and in an outside ranking, divisions of either side."""
    mine = top_by_group(current, "recent_division", rating, top).groupBy(F.col("recent_division").alias("division")).agg(F.avg(rating).alias("mean_rating"), F.count(F.lit(1)).alias("n_rated"))
    other = rankings.where(F.col("rank") <= top).groupBy("division").agg(F.avg("points").alias("mean_points"), F.count(F.lit(1)).alias("n_ranked"))
    return mine.join(other, "division", "full_outer")


def context_impact(performance: DataFrame, factors: list[str], n: int = 25, least: float = 1.0001) -> DataFrame:
    """Appearances whose context factors multiply to the most."""
    product = F.lit(1.0)
    for f in factors:
        product = product * F.col(f)
    return performance.withColumn("impact", product).where(F.col("impact") > least).orderBy(F.desc("impact"), "bout_id", "fighter").limit(n)


def recent_rows(rows: DataFrame, fighter: str, n: int = 25) -> DataFrame:
    return rows.where(F.col("fighter") == fighter).orderBy(F.desc("event_seq")).limit(n)


def attribution_totals(attribution: DataFrame, fighter: str) -> DataFrame:
    """What each component has added to a competitor's rating, a row each."""
    parts = ["base_delta", "integrity_delta", "performance_delta", "interaction_delta"]
    sums = attribution.where(F.col("fighter") == fighter).agg(*[F.sum(p).alias(p) for p in parts])
    return sums.select(F.lit(fighter).alias("fighter"), *parts).unpivot(["fighter"], parts, "component", "total")


def odds_history(odds: DataFrame, fighter: str) -> DataFrame:
    """A competitor's market probability and result by bout."""
    mine = F.when(F.col("fighter_a") == fighter, F.col("prob_a")).when(F.col("fighter_b") == fighter, F.col("prob_b"))
    rows = odds.where((F.col("odds_data_quality") == "ok") & mine.isNotNull())
    result = F.when(F.col("is_draw"), "draw").when(F.col("winner") == fighter, "win").otherwise("loss")
    return rows.select("bout_id", "event_date", F.lit(fighter).alias("fighter"), mine.alias("market_prob"), result.alias("result"))


def streak_timeline(history: DataFrame, appearances: DataFrame, fighter: str) -> DataFrame:
    """A competitor's rating by event with its results of the day."""
    outcome = F.when(F.col("is_draw"), "draw").when(F.col("is_winner"), "win").otherwise("loss")
    days = appearances.where(F.col("fighter") == fighter).groupBy("event_seq").agg(F.array_join(F.array_sort(F.collect_list(outcome)), ", ").alias("results"))
    return history.where(F.col("fighter") == fighter).join(days, "event_seq", "left")


def division_summary(current: DataFrame, rating: str = "mu") -> DataFrame:
    """Mean and best rating of every division, and how many stand in it."""
    return current.groupBy("recent_division").agg(F.avg(rating).alias("mean"), F.max(rating).alias("best"), F.count(F.lit(1)).alias("n"))


def residual_cohorts(rows: DataFrame, value: str = "residual") -> DataFrame:
    """Rows above and below nothing: their number and mean size."""
    side = F.when(F.col(value) > 0, "positive").when(F.col(value) < 0, "negative").otherwise("none")
    return rows.groupBy(side.alias("cohort")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(value)).alias("mean_abs"))


def odds_coverage(current: DataFrame, odds: DataFrame) -> DataFrame:
    """Bouts with good odds, all bouts, their share, and the competitors that have any."""
    people = odds.where("odds_data_quality = 'ok'").select(F.explode(F.array("fighter_a", "fighter_b")).alias("fighter")).join(current.select("fighter"), "fighter", "left_semi")
    counts = odds.agg(F.count_if(F.col("odds_data_quality") == "ok").alias("covered"), F.count(F.lit(1)).alias("bouts"))
    return counts.crossJoin(people.agg(F.count_distinct("fighter").alias("fighters"))).withColumn("share", F.try_divide("covered", "bouts"))  # a row each


def integrity_counts(bouts: DataFrame) -> DataFrame:
    """Findings, disqualification wins and missed-weight wins of every competitor, in one aggregate."""
    marks = F.array(
        F.struct(F.when(F.col("ped_confirmed"), F.col("ped_flagged_fighter")).alias("fighter"), F.lit("ped").alias("kind")),
        F.struct(F.when(F.col("method_class") == "DQ", F.col("winner")).alias("fighter"), F.lit("dq").alias("kind")),
        F.struct(F.when(F.col("missed_weight") & (F.col("missed_weight_fighter") == F.col("winner")), F.col("winner")).alias("fighter"), F.lit("weight").alias("kind")),
    )
    rows = bouts.select(F.explode(marks).alias("m")).select("m.*").where("fighter is not null")
    return rows.groupBy("fighter").agg(*[F.count_if(F.col("kind") == k).alias(n) for k, n in (("ped", "ped_confirmed_fights"), ("dq", "dq_wins"), ("weight", "missed_weight_wins"))])

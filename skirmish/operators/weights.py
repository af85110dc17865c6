"""Integrity, performance and dominance tables, and what becomes of them on bouts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions import quality as q
from ..sources.staging import cut
from .context import by_bout, entering, moved
from .reshape import appearances


#: The flags of a bout, and what a bout without them has.
FLAGS = {"ped_confirmed": ("boolean", False), "ped_flagged_fighter": ("string", None), "missed_weight": ("boolean", False), "missed_weight_fighter": ("string", None)}


def flagged(bouts: DataFrame) -> DataFrame:
    """Bouts with all flag columns; those that the input lacks say that nothing was found."""
    return bouts.withColumns({c: F.lit(value).cast(kind) for c, (kind, value) in FLAGS.items() if c not in bouts.columns})


def integrity_appearances(bouts: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Weight of each appearance: only a winner's own flags count against it."""
    bouts = flagged(bouts)
    dq = F.col("method_class") == "DQ"
    rows = appearances(bouts.withColumn("is_dq", dq), keep=("ped_confirmed", "ped_flagged_fighter", "missed_weight", "missed_weight_fighter", "is_dq"))
    mine = {
        "integrity_factor_ped": (F.col("ped_confirmed") & (F.col("ped_flagged_fighter") == F.col("fighter")), cfg.ped_factor),
        "integrity_factor_dq": (F.col("is_dq"), cfg.dq_factor),
        "integrity_factor_missed_weight": (F.col("missed_weight") & (F.col("missed_weight_fighter") == F.col("fighter")), cfg.weight_factor),
    }
    rows = rows.withColumns({name: F.when(q.yes(flag) & F.col("is_winner"), factor).otherwise(1.0) for name, (flag, factor) in mine.items()})
    product = F.col("integrity_factor_ped") * F.col("integrity_factor_dq") * F.col("integrity_factor_missed_weight")
    return rows.select("bout_id", "fighter", *mine, q.clip(product, cfg.sleeve_min, 1.0).alias("integrity_weight"))


def scored(bouts: DataFrame, dominance: DataFrame | None = None, cfg: Config = DEFAULT) -> DataFrame:
    """Bouts with scheduled rounds, duration, the winner's score and decisiveness; with dominance, decisions move up by it."""
    bouts = flagged(bouts)
    won_a, won_b = q.yes(F.col("winner") == F.col("fighter_a")), q.yes(F.col("winner") == F.col("fighter_b"))
    out = bouts.withColumns({"scheduled_rounds": q.scheduled_rounds(F.col("time_format")), "_cards": q.margins(F.col("details_text"), won_a, won_b)})
    seconds = (F.greatest(F.col("end_round"), F.lit(1)) - 1) * 300 + F.col("end_time_seconds")
    method, stored = F.coalesce("method_class", F.lit("")), F.col("method_score_winner") if "method_score_winner" in bouts.columns else F.lit(None).cast("double")
    score = q.result_score(method, F.col("is_draw"), F.col("scheduled_rounds"), F.col("_cards"), stored, cfg)
    score = q.damped_score(
        score,
        F.col("ped_confirmed") & (F.col("ped_flagged_fighter") == F.col("winner")),
        F.col("missed_weight") & (F.col("missed_weight_fighter") == F.col("winner")),
        (method == "DQ") & F.col("winner").isNotNull(),
        cfg,
    )
    out = out.withColumns({
        "bout_seconds": F.when(seconds > 0, seconds), "quality_score": score,
        "decisiveness": q.decisiveness(method, F.col("end_round"), F.col("scheduled_rounds"), F.col("_cards")),
    }).drop("_cards")
    if dominance is not None:
        out = out.join(dominance.select("bout_id", "dominance_a"), "bout_id", "left")
        mine = F.when(won_a, F.col("dominance_a")).when(won_b, -F.col("dominance_a"))
        raised = q.clip(F.col("quality_score") + q.dominance_bonus(mine, cfg), cfg.dominance_floor, 1.0)
        out = out.withColumn("quality_score", F.when(method.startswith("Decision"), raised).otherwise(F.col("quality_score"))).drop("dominance_a")
    return out


def defended(bouts: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """A champion's title win scores no less than the floor; an interim champion's a little lower one."""
    won = {s: q.yes(F.col("winner") == F.col(f"fighter_{s}")) for s in "ab"}
    full = F.col("is_title") & ((won["a"] & F.col("entered_champion_a")) | (won["b"] & F.col("entered_champion_b")))
    interim = F.col("is_interim") & ((won["a"] & F.col("entered_interim_a")) | (won["b"] & F.col("entered_interim_b")))
    least = F.greatest(F.when(full, cfg.defense_floor).otherwise(0.0), F.when(interim, cfg.interim_defense_floor).otherwise(0.0))
    return bouts.withColumn("quality_score", F.when(F.col("quality_score").isNotNull(), F.greatest("quality_score", least)))


def performance_appearances(bouts: DataFrame, prior: DataFrame, odds: DataFrame | None = None, cfg: Config = DEFAULT) -> DataFrame:
    """Performance weight of each appearance, with its factors.

    `bouts` carry scores, both sides' ranks and titles and event_seq; `prior` has prefight_mu by competitor and event.
    The winner's logged factors add up to the bout's signal S; 1 + half the envelope times tanh(S / scale) is the
    winner's weight, and the loser's mirrors it unless a class move down or a layoff makes the loss count more.
    """
    swap = ("division_rank", "p4p_rank", "entered_champion", "entered_interim")
    known = bouts.where("fighter_a is not null and fighter_b is not null")
    brought = ("streak", "prefight_mu", "previous_division", "activity_gap_days")
    rows = known.join(by_bout(entering(appearances(known), prior), brought), "bout_id")
    if odds is None:
        rows = rows.withColumns({f"american_{s}": F.lit(None).cast("double") for s in "ab"})
        ends = rows.sparkSession.range(1).select(*[F.lit(None).cast("double").alias(k) for k in ("most_up", "most_down")])
    else:
        from ..functions.odds import decimal_to_american

        american = [F.coalesce(F.col(f"american_odds_{s}"), decimal_to_american(F.col(f"decimal_odds_{s}"))).alias(f"american_{s}") for s in "ab"]
        priced = cut(odds.where("odds_data_quality = 'ok'").select("bout_id", *american).join(known.select("bout_id"), "bout_id", "left_semi"), "odds")
        up, down = ([F.when(F.col(f"american_{s}") * sign > 0, F.col(f"american_{s}") * sign) for s in "ab"] for sign in (1, -1))
        ends = priced.agg(F.max(F.greatest(*up)).alias("most_up"), F.max(F.greatest(*down)).alias("most_down"))
        rows = rows.join(priced, "bout_id", "left")
    rows = appearances(rows, (*swap, *brought, "american"), ("quality_score", "decisiveness", "bout_seconds", "scheduled_rounds"))
    rows = moved(rows.withColumnRenamed("opponent_prefight_mu", "opponent_mu").drop("opponent_previous_division", "opponent_activity_gap_days", "opponent_american")).fillna({"prefight_mu": cfg.mu0, "opponent_mu": cfg.mu0})
    rows = rows.crossJoin(F.broadcast(ends))  # one row
    c = F.col
    gap = q.effective_rank(c("division_rank"), c("entered_champion"), c("entered_interim"), cfg) - q.effective_rank(c("opponent_division_rank"), c("opponent_entered_champion"), c("opponent_entered_interim"), cfg)
    layoff = q.layoff_level(c("activity_gap_days"), cfg)
    factors = {
        "f_decisiveness": 1 + cfg.decisiveness_amp * q.clip(F.coalesce("decisiveness", F.lit(0.83)), 0.0, 1.0),
        "f_strength": 1 + cfg.quality_amp * q.mu_level(c("opponent_mu"), cfg),
        "f_streak": q.streak_factor(c("opponent_streak"), c("opponent_mu"), cfg),
        "f_odds": q.odds_factor(c("american"), c("most_up"), c("most_down"), cfg),
        "f_rank": 1 + cfg.rank_amp * q.rank_level(c("opponent_division_rank"), c("opponent_entered_champion"), c("opponent_entered_interim"), cfg),
        "f_title": 1 + cfg.title_amp * q.title_level(c("is_title"), c("is_interim"), c("opponent_entered_champion"), c("opponent_entered_interim")),
        "f_p4p": 1 + cfg.p4p_amp * q.top_rank_level(c("opponent_p4p_rank"), cfg),
        "f_class": q.class_factor(c("move"), c("change_fight"), c("is_winner"), c("is_draw"), cfg),
        "f_layoff": q.layoff_factor(layoff, c("is_winner"), c("is_draw"), cfg),
        "f_upset": q.upset_factor(gap, q.upset_odds_level(c("american"), cfg), c("is_winner"), cfg),
    }
    rows = rows.withColumns({k: q.clip(v, cfg.sleeve_min, cfg.sleeve_max) for k, v in factors.items()} | {"upset_rank_gap": gap, "layoff_level": layoff})
    best = F.greatest("f_strength", "f_rank", "f_title", "f_p4p")
    rows = rows.withColumn("signal", F.log("f_decisiveness") + F.log(best) + F.log("f_upset") + F.log("f_streak") + F.log("f_class"))
    rows = rows.withColumn("winner_signal", F.coalesce(F.max(F.when(c("is_winner"), c("signal"))).over(W.partitionBy("bout_id")), F.lit(0.0)))
    swing = (cfg.sleeve_max - cfg.sleeve_min) / 2 * F.tanh(c("winner_signal") / cfg.tanh_scale)
    down = F.when(c("change_fight") & (c("move") == "down"), c("f_class")).otherwise(1.0)
    harder = down * F.when(c("f_layoff") > 1, c("f_layoff")).otherwise(1.0)
    lost = F.when(harder > 1, harder).otherwise(1 - swing) * F.when(c("change_fight") & (c("move") == "up"), c("f_class")).otherwise(1.0)
    weight = F.when(c("is_draw"), 1.0).when(c("is_winner"), 1 + swing).otherwise(lost)
    return rows.withColumn("performance_weight", q.clip(weight, cfg.sleeve_min, cfg.sleeve_max)).drop("most_up", "most_down")


def combined(integrity: DataFrame, performance: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    both = integrity.select("bout_id", "fighter", "integrity_weight").join(performance.select("bout_id", "fighter", "performance_weight"), ["bout_id", "fighter"], "full_outer")
    weight = F.coalesce("integrity_weight", F.lit(1.0)) * F.coalesce("performance_weight", F.lit(1.0))
    return both.withColumn("combined_weight", q.clip(weight, cfg.sleeve_min, cfg.sleeve_max))


STATS = ("sig_str_landed", "sub_att", "ctrl_seconds")


def bout_dominance(rounds: DataFrame, bouts: DataFrame) -> DataFrame:
    """Per bout the sides' differences in three statistics, their z-scores over all bouts, and the sum.

    Both sides' sums come from one aggregate by bout: no self-join.
    """
    side = F.when(F.col("fighter") == F.col("fighter_a"), "a").when(F.col("fighter") == F.col("fighter_b"), "b")
    rows = rounds.join(bouts.select("bout_id", "fighter_a", "fighter_b"), "bout_id").withColumn("side", side).where("side is not null")
    sums = [F.sum(F.when(F.col("side") == s, F.coalesce(q.num(F.col(c).cast("double")), F.lit(0.0)))).alias(f"{c}_{s}") for c in STATS for s in "ab"]
    rows = rows.groupBy("bout_id").agg(*sums).dropna()
    rows = rows.select("bout_id", *[(F.col(f"{c}_a") - F.col(f"{c}_b")).alias(f"{c}_diff") for c in STATS])
    moments = rows.agg(*[f(f"{c}_diff").alias(f"{n}_{c}") for c in STATS for f, n in ((F.avg, "m"), (F.stddev_pop, "s"))])
    rows = rows.crossJoin(F.broadcast(moments))  # one row
    z = {f"z_{c}": F.when(F.col(f"s_{c}") > 0, (F.col(f"{c}_diff") - F.col(f"m_{c}")) / F.col(f"s_{c}")).otherwise(0.0) for c in STATS}
    return rows.withColumns(z).withColumn("dominance_a", sum((F.col(k) for k in z), F.lit(0.0))).select("bout_id", *[f"{c}_diff" for c in STATS], *z, "dominance_a")


def competitor_dominance(dominance: DataFrame, bouts: DataFrame) -> DataFrame:
    mine = F.when(F.col("winner") == F.col("fighter_a"), F.col("dominance_a")).when(F.col("winner") == F.col("fighter_b"), -F.col("dominance_a"))
    rows = bouts.join(dominance.select("bout_id", "dominance_a"), "bout_id").select(F.col("winner").alias("fighter"), mine.alias("d")).dropna()
    return rows.groupBy("fighter").agg(F.count(F.lit(1)).alias("wins"), F.avg("d").alias("mean_dominance"))


def appearance_quality(bouts: DataFrame, prior: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Opponent quality, weight and score of each appearance, for periods and résumés; bouts carry ranks, titles and event_seq."""
    rows = appearances(bouts, ("division_rank", "p4p_rank", "entered_champion", "entered_interim"))
    rows = rows.join(prior.select("event_seq", F.col("fighter").alias("opponent"), F.col("prefight_mu").alias("opponent_mu")), ["event_seq", "opponent"], "left").fillna({"opponent_mu": cfg.mu0})
    c = F.col
    level = q.quality_level(c("opponent_mu"), c("opponent_division_rank"), c("opponent_p4p_rank"), c("opponent_entered_champion"), c("opponent_entered_interim"), c("is_title"), c("is_interim"), cfg)
    rows = rows.withColumn("quality_level", level)
    weight = q.opponent_weight(c("quality_level"), cfg) * F.when(q.yes(c("is_title")) | q.yes(c("is_interim")), cfg.title_weight).otherwise(1.0)
    title = q.yes(c("is_title")) | q.yes(c("is_interim"))
    won = c("actual_score") >= 1.0
    rows = rows.withColumns({"opp_weight": weight, "t_bout": title.cast("int"), "t_win": (title & won).cast("int"), "t_defense": (title & won & (c("entered_champion") | c("entered_interim"))).cast("int")})
    return rows.withColumns({
        "period_weight": q.period_weight(c("actual_score"), c("quality_level"), c("opp_weight"), cfg),
        "adjustment": q.result_adjustment(c("actual_score"), cfg) + q.context_adjustment(c("actual_score"), c("is_title"), c("is_interim"), c("opponent_entered_champion"), c("opponent_entered_interim"), c("opponent_division_rank"), c("opponent_p4p_rank"), cfg),
    })

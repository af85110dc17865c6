"""Opponent quality, performance and integrity factors as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT, Config


def num(c: Column) -> Column:
    """NaN as null: in Spark NaN is the largest number and poisons maxima and means."""
    return F.when(~F.isnan(c), c)


def clip(c: Column, low: float, high: float) -> Column:
    """Between two bounds; null stays null, which greatest and least alone would pass over."""
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def mu_level(mu: Column, cfg: Config = DEFAULT) -> Column:
    return clip((F.coalesce(mu, F.lit(cfg.pivot)) - cfg.pivot) / cfg.mu_scale, 0.0, 1.0)


def top_rank_level(rank: Column, cfg: Config = DEFAULT) -> Column:
    """1 for the first, falling evenly to 1/15 for the fifteenth, 0 for others."""
    return F.when(rank.between(1, cfg.rank_top), (cfg.rank_top + 1 - rank) / cfg.rank_top).otherwise(0.0)


def rank_level(rank: Column, champion: Column, interim: Column, cfg: Config = DEFAULT) -> Column:
    holder = F.when(yes(champion), 1.0).when(yes(interim), 0.85).otherwise(0.0)
    return F.greatest(top_rank_level(rank, cfg), holder)


def title_level(title: Column, interim_title: Column, champion: Column, interim: Column) -> Column:
    """The opponent's belt counts most; an interim bout counts less than a full one, even where both flags stand."""
    bout = F.when(yes(interim_title), 0.55).when(yes(title), 0.65).otherwise(0.0)
    return F.when(yes(champion), 1.0).when(yes(interim), F.greatest(bout, F.lit(0.80))).otherwise(bout)


def quality_level(mu: Column, rank: Column, p4p: Column, champion: Column, interim: Column, title: Column, interim_title: Column, cfg: Config = DEFAULT) -> Column:
    parts = mu_level(mu, cfg), rank_level(rank, champion, interim, cfg), top_rank_level(p4p, cfg), title_level(title, interim_title, champion, interim)
    return clip(F.greatest(*parts), 0.0, 1.0)


def opponent_weight(level: Column, cfg: Config = DEFAULT) -> Column:
    """Logistic in the level, 0 at 0 and the largest weight at 1. The curve's ends are constants."""
    low, high = (1 / (1 + math.exp(-(x - cfg.opp_weight_center) / cfg.opp_weight_temp)) for x in (0.0, 1.0))
    s = 1 / (1 + F.exp(-(clip(F.coalesce(level, F.lit(0.0)), 0.0, 1.0) - cfg.opp_weight_center) / cfg.opp_weight_temp))
    return clip((s - low) / (high - low), 0.0, 1.0) * cfg.opp_weight_max


def streak_factor(streak: Column, mu: Column, cfg: Config = DEFAULT) -> Column:
    level = clip((F.coalesce(mu, F.lit(1500.0)) - 1500) / 650, 0.0, 1.0)
    return 1 + cfg.streak_amp * clip(F.coalesce(streak, F.lit(0)), 0.0, 5.0) / 5 * (0.5 + 0.5 * level)


def class_factor(move: Column, changed: Column, winner: Column, draw: Column, cfg: Config = DEFAULT) -> Column:
    """Only the first bout after a change of class counts."""
    loss = ~yes(winner) & ~yes(draw)
    return (
        F.when(~yes(changed), 1.0)
        .when(yes(winner) & (move == "up"), 1 + cfg.class_up_win)
        .when(loss & (move == "down"), 1 + cfg.class_down_loss)
        .when(loss & (move == "up"), 1 - cfg.class_up_loss)
        .otherwise(1.0)
    )


def layoff_level(days: Column, cfg: Config = DEFAULT) -> Column:
    return F.coalesce(clip((days - cfg.gap_normal) / (cfg.gap_full - cfg.gap_normal), 0.0, 1.0), F.lit(0.0))


def layoff_factor(level: Column, winner: Column, draw: Column, cfg: Config = DEFAULT) -> Column:
    return F.when(~yes(winner) & ~yes(draw), 1 + cfg.layoff_amp * clip(level, 0.0, 1.0)).otherwise(1.0)


def effective_rank(rank: Column, champion: Column, interim: Column, cfg: Config = DEFAULT) -> Column:
    return F.when(yes(champion), 0.0).when(yes(interim), 1.0).otherwise(F.least(F.coalesce(rank.cast("double"), F.lit(cfg.unranked)), F.lit(cfg.unranked)))


def upset_odds_level(american: Column, cfg: Config = DEFAULT) -> Column:
    low, high = cfg.upset_odds
    return F.when(american > 0, clip((american - low) / (high - low), 0.0, 1.0)).otherwise(0.0)


def upset_factor(gap: Column, odds_level: Column, winner: Column, cfg: Config = DEFAULT) -> Column:
    """Open only to winners ranked far enough below; the odds may then add to the ranks."""
    level = F.greatest(clip((gap - cfg.upset_gap) / cfg.upset_scale, 0.0, 1.0), F.coalesce(odds_level, F.lit(0.0)))
    return 1 + cfg.upset_amp * F.when(yes(winner) & (F.coalesce(gap, F.lit(0.0)) >= cfg.upset_gap), level).otherwise(0.0)


def odds_factor(american: Column, most_up: Column, most_down: Column, cfg: Config = DEFAULT) -> Column:
    up = 1 + cfg.odds_up * clip(american / most_up, 0.0, 1.0)
    down = 1 - cfg.odds_down * clip(-american / most_down, 0.0, 1.0)
    return F.when((american > 0) & (most_up > 0), up).when((american < 0) & (most_down > 0), down).otherwise(1.0)


def finish(method: Column) -> Column:
    return method.isin("KO/TKO", "Submission")


def margins(details: Column, winner_is_a: Column, winner_is_b: Column) -> Column:
    """Points by which the winner leads on every card of a details text; null without a winner."""
    pairs = F.regexp_extract_all(details, F.lit(r"(\d{2})\s*-\s*(\d{2})"), F.lit(0))
    lead = F.transform(pairs, lambda s: F.regexp_extract(s, r"^(\d{2})", 1).cast("int") - F.regexp_extract(s, r"(\d{2})$", 1).cast("int"))
    return F.when(winner_is_a, lead).when(winner_is_b, F.transform(lead, lambda m: -m))


def scheduled_rounds(time_format: Column) -> Column:
    """`N Rnd` of a format text, 3 where it names none, 1 at least."""
    named = F.regexp_extract(time_format, r"(\d+)\s*Rnd", 1)
    return F.greatest(F.lit(1), F.coalesce(F.when(named != "", named.cast("int")), F.lit(3)))


def decision_score(method: Column, rounds: Column, cards: Column, cfg: Config = DEFAULT) -> Column:
    sweep = (rounds >= 5) & (F.size(cards) > 0) & F.forall(cards, lambda m: m >= 3)
    return (
        F.when(method.startswith("Decision - Split") | method.startswith("Decision - Majority"), cfg.split_score)
        .when(method.startswith("Decision - Unanimous") & yes(sweep), cfg.sweep_score)
        .otherwise(cfg.unanimous_score)
    )


def result_score(method: Column, draw: Column, rounds: Column, cards: Column, stored: Column, cfg: Config = DEFAULT) -> Column:
    """The winner's score before integrity and title adjustments; null for a draw."""
    score = (
        F.when(method.startswith("Decision"), decision_score(method, rounds, cards, cfg))
        .when(finish(method), cfg.finish_score)
        .when(method == "DQ", cfg.dq_win_score)
        .otherwise(F.coalesce(num(stored), F.lit(cfg.finish_score)))
    )
    return F.when(~yes(draw), score)


def damped_score(score: Column, ped: Column, missed: Column, dq: Column, cfg: Config = DEFAULT) -> Column:
    """No more than each flag on the winner allows."""
    for flag, most in ((ped, cfg.ped_score), (missed, cfg.weight_score), (dq, cfg.dq_score)):
        score = F.when(yes(flag), F.least(score, F.lit(most))).otherwise(score)
    return score


def decisiveness(method: Column, end_round: Column, rounds: Column, cards: Column) -> Column:
    """How decisive a result is, by its method."""
    sweep = (rounds >= 5) & (F.size(cards) > 0) & F.forall(cards, lambda m: m >= rounds)
    return (
        F.when(method == "DQ", 0.70)
        .when(finish(method), F.when(end_round <= 1, 1.00).otherwise(0.95))
        .when(method.startswith("Decision - Split"), 0.78)
        .when(method.startswith("Decision - Majority"), 0.80)
        .when(method.startswith("Decision - Unanimous") & yes(sweep), 0.88)
        .otherwise(0.83)
    )


def dominance_bonus(dominance: Column, cfg: Config = DEFAULT) -> Column:
    level = 1 / (1 + F.exp(-F.coalesce(dominance, F.lit(0.0)) / cfg.dominance_scale))
    return cfg.dominance_amp * clip(2 * level - 1, 0.0, 1.0)


def result_adjustment(score: Column, cfg: Config = DEFAULT) -> Column:
    return F.when(score >= 1.0, cfg.win_bonus).when(score == 0.5, -cfg.draw_penalty).otherwise(-cfg.loss_penalty)


def context_adjustment(score: Column, title: Column, interim_title: Column, champion: Column, interim: Column, rank: Column, p4p: Column, cfg: Config = DEFAULT) -> Column:
    """The strongest of the win's contexts, and a little for a title bout won or lost."""
    contexts = (
        (yes(title), cfg.title_win_bonus), (yes(interim_title), cfg.interim_win_bonus), (yes(champion), cfg.champion_win_bonus), (yes(interim), cfg.interim_champion_win_bonus),
        (yes(rank.between(1, 5)), cfg.top5_bonus), (yes(rank.between(6, 10)), cfg.top10_bonus), (yes(rank.between(11, 15)), cfg.top15_bonus),
        (yes(p4p.between(1, 5)), cfg.p4p5_bonus), (yes(p4p.between(6, 15)), cfg.p4p15_bonus),
    )
    best = F.greatest(*[F.when(mask, value).otherwise(0.0) for mask, value in contexts])
    return F.when(score >= 1.0, best).otherwise(0.0) + F.when(yes(title), cfg.title_bout_bonus).otherwise(0.0)


def period_weight(score: Column, level: Column, weight: Column, cfg: Config = DEFAULT) -> Column:
    return (
        F.when(score >= 1.0, cfg.win_base + weight)
        .when(score > 0.0, cfg.draw_base + 0.5 * weight)
        .otherwise(cfg.loss_base + cfg.loss_quality * (1 - clip(F.coalesce(level, F.lit(0.0)), 0.0, 1.0)))
    )

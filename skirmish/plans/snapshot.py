"""From bouts to all rating tables: the whole job as one lazy plan, cut where a table is used many times."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, GLICKO_STREAMS, Config
from ..functions.ratings import idle_penalty
from ..operators import context, diagnostics, kernels, periods, reshape, weights
from ..operators.spread import components
from ..sources.adapters import sequenced
from ..sources.staging import cut, dropped


def base_history(bouts: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Histories of the two streams without weights: bouts with event_seq and quality_score."""
    return kernels.rate_streams(kernels.for_streams(bouts, {"canonical": {}, "method": {"score": "quality_score"}}), cfg)


def with_context(bouts: DataFrame, history: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Bouts with title lineage and both sides' ranks before the event."""
    apps = reshape.appearances(bouts)
    return context.with_ranks(context.title_lineage(bouts), cut(context.ranks(bouts, apps, history, cfg), "ranks"))


def pooled(bouts: DataFrame) -> DataFrame:
    """Bouts with their pool, named by the least name of all competitors that bouts join: pools are rated side by side."""
    pools = components(bouts, "fighter_a", "fighter_b")
    return bouts.join(pools.withColumnRenamed("name", "fighter_a"), "fighter_a")


def run(bouts: DataFrame, rounds: DataFrame | None = None, odds: DataFrame | None = None, cfg: Config = DEFAULT, lean: bool = False) -> dict[str, DataFrame]:
    """All tables of a rating run. Bouts: one row each with sides, result, division, titles, method and flags.

    `lean` gives the table `current` alone: the same rows, but stored tables go as soon as nothing on the way to it reads them.
    """
    done = dropped if lean else lambda *tables: None
    bouts = sequenced(bouts.where("not coalesce(is_excluded, false)") if "is_excluded" in bouts.columns else bouts)
    bouts = cut(bouts if "pool" in bouts.columns else pooled(bouts), "bouts")
    dominance = cut(weights.bout_dominance(rounds, bouts), "dominance") if rounds is not None else None
    scored = weights.scored(bouts, dominance, cfg)
    base = cut(base_history(scored, cfg), "base")
    canonical = base.where("stream = 'canonical'").drop("stream")
    full = cut(weights.defended(with_context(scored, canonical, cfg), cfg), "context")
    done(*[dominance] if rounds is not None else [])
    prior = context.prefight(canonical)
    integrity = weights.integrity_appearances(bouts, cfg)
    performance = cut(weights.performance_appearances(full, prior, odds, cfg), "performance")
    both = weights.combined(integrity, performance, cfg)
    # all three weights of both sides in one pass
    sides = both.groupBy("bout_id").agg(F.map_from_entries(F.collect_list(F.struct("fighter", F.struct("integrity_weight", "performance_weight", "combined_weight")))).alias("_w"))  # two entries a bout
    org = F.coalesce("org_weight", F.lit(1.0)) if "org_weight" in full.columns else F.lit(1.0)
    names = {"i": "integrity_weight", "p": "performance_weight", "c": "combined_weight"}
    weighted = full.join(sides, "bout_id", "left").withColumns({f"{k}_{s}": F.coalesce(F.col("_w")[F.col(f"fighter_{s}")][v], F.lit(1.0)) * org for k, v in names.items() for s in "ab"}).drop("_w")
    weighted = cut(weighted.withColumns({"o_a": org, "o_b": org}), "weighted")
    sleeved = {s: {"score": "quality_score", "weights": (f"{w}_a", f"{w}_b")} for s, w in zip(GLICKO_STREAMS[2:], "ipc", strict=True)}
    done(performance)
    sleeves = cut(kernels.rate_streams(kernels.for_streams(weighted, sleeved), cfg), "sleeves")
    history = base.unionByName(sleeves)
    smooth = {"whr": {"score": "quality_score", "weights": ("o_a", "o_b")}} | {f"whr_{k.removeprefix('method_')}": v for k, v in sleeved.items()}
    whr = cut(kernels.smooth_streams(kernels.for_streams(weighted, smooth), cfg), "whr")
    done(weighted)

    glicko, whole = list(GLICKO_STREAMS), list(smooth)
    value = ["bout_id", "fighter", "event_seq", "division", "is_title", "actual_score", "opp_weight", "period_weight", "adjustment", "t_bout", "t_win", "t_defense"]
    now, last = cut(kernels.current(history), "now"), cut(newest(whr), "last")
    quality = cut(weights.appearance_quality(full, prior, cfg), "quality")
    done(full)
    lines = quality.select("event_date", "event_name", *value)
    # one after the other, so that no more than one join's exchanges stand at a time
    for name, rows, key, streams in (("glicko", history, "event_seq", glicko), ("whole", whr, "bout_id", whole)):
        beside = cut(periods.side_by_side(rows, ["fighter", key], streams).withColumnRenamed("mus", name), "beside")
        done(*[base, sleeves] if name == "glicko" else [whr])
        before, lines = lines, cut(lines.join(beside, ["fighter", key], "left"), "lines")
        done(before, beside)
    none = {k: F.array(*[F.lit(None).cast("double")] * len(v)) for k, v in (("glicko", glicko), ("whole", whole))}
    rated = lines.where("glicko is not null or whole is not null").withColumn("mus", F.concat(*[F.coalesce(F.col(k), v) for k, v in none.items()])).drop("glicko", "whole")
    best = periods.best_side_by_side(periods.normalised_side_by_side(rated, glicko + whole, cfg), {"five_year": cfg.five_year, "ten_year": cfg.ten_year}, glicko + whole, cfg)
    done(lines)
    current = assembled(now, last, best, bouts, cfg)
    if lean:
        return {"current": current}
    nodes = whr.where("stream = 'whr'").select("fighter", "event_date", "event_name", "event_seq", "mu", "bout_id").join(quality.select(*value).drop("event_seq"), ["fighter", "bout_id"])
    resume = periods.resumes(nodes, cfg=cfg)
    return {
        "bouts": full, "dominance": dominance, "history": history, "whr": whr, "integrity": integrity, "performance": performance, "weights": both, "quality": quality, "periods": best,
        "resume": resume, "primary": periods.primary_divisions(resume), "current": current, "entropy": diagnostics.entropy(reshape.appearances(bouts), canonical, cfg),
        "calibration": diagnostics.calibration(calibration_rows(bouts, canonical, cfg), cfg.bins), "attribution": diagnostics.attribution(context.deltas(history)),
    }


def calibration_rows(bouts: DataFrame, history: DataFrame, cfg: Config = DEFAULT, stances: DataFrame | None = None) -> DataFrame:
    """Both sides' predicted and actual results of decided bouts whose competitors both have enough earlier events."""
    from pyspark.sql import Window as W

    from ..functions.ratings import win_probability

    w = W.partitionBy("fighter").orderBy("event_seq")
    before = history.select("fighter", "event_seq", F.lag("mu").over(w).alias("mu"), F.lag("phi").over(w).alias("phi"), (F.row_number().over(w) - 1).alias("prior"))
    rows = bouts.where("not coalesce(is_draw, false) and winner is not null")
    for s in "ab":
        rows = rows.join(before.select("event_seq", *[F.col(c).alias(f"{c}_{s}") for c in ("fighter", "mu", "phi", "prior")]), ["event_seq", f"fighter_{s}"])
    rows = rows.where((F.col("prior_a") >= cfg.min_prior) & (F.col("prior_b") >= cfg.min_prior))
    p, actual = win_probability(F.col("mu_a"), F.col("mu_b"), F.col("phi_b"), cfg), (F.col("winner") == F.col("fighter_a")).cast("double")
    sides = F.array(F.struct(F.col("fighter_a").alias("fighter"), p.alias("p_win"), actual.alias("actual")), F.struct(F.col("fighter_b").alias("fighter"), (1 - p).alias("p_win"), (1 - actual).alias("actual")))
    out = rows.select("bout_id", "division", F.explode(sides).alias("_s")).select("bout_id", "division", "_s.*")
    return out.join(stances, "fighter", "left") if stances is not None else out.withColumn("stance", F.lit(None).cast("string"))


def recent_divisions(bouts: DataFrame) -> DataFrame:
    """Last division that isn't null of every competitor, and its gender by the division's name."""
    rows = reshape.appearances(bouts).where("division is not null")
    last = rows.groupBy("fighter").agg(F.max_by("division", F.struct("event_date", "event_name", "bout_id")).alias("recent_division"))
    return last.withColumn("gender", F.when(F.col("recent_division").startswith("Women's"), "F").otherwise("M"))


def with_idle_penalty(current: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Months since the last event of all, the penalty for them, and the rating less it; history stays as it was."""
    end = current.agg(F.max("last_event_date").alias("_end"))
    rows = current.crossJoin(F.broadcast(end))  # one row
    months = F.greatest(F.lit(0.0), F.datediff("_end", "last_event_date") / cfg.days_per_month)
    penalty = F.round(idle_penalty(months, F.coalesce("phi", F.lit(cfg.phi0)), cfg), 6)
    return rows.withColumns({"months_inactive": F.round(months, 2), "activity_mu_penalty": penalty, "mu_activity_adjusted": F.col("mu") - penalty}).drop("_end")


def newest(whr: DataFrame) -> DataFrame:
    """Newest smoothed rating of every stream and competitor."""
    return whr.groupBy("stream", "fighter").agg(F.max_by("mu", F.struct("event_seq", "bout_id")).alias("value"))


def assembled(now: DataFrame, last: DataFrame, best: dict[str, DataFrame], bouts: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """One wide row for each competitor: long values by stream, pivoted once. `now` and `last` are the newest states and smoothed ratings."""
    values = now.select("fighter", F.explode(F.array(*[F.struct(F.concat(F.lit(f"{k}_"), F.col("stream")).alias("name"), F.col(k).alias("value")) for k in ("mu", "phi", "sigma")])).alias("v")).select("fighter", "v.*")
    values = values.unionByName(last.select("fighter", F.concat(F.lit("mu_"), F.col("stream")).alias("name"), "value"))
    for label, rows in best.items():
        for column, mark in (("period_score", ""), ("headline_score", "headline_")):
            values = values.unionByName(rows.select("fighter", F.concat(F.lit(f"{label}_{mark}mu_"), F.col("stream")).alias("name"), F.col(column).alias("value")))
    streams = [*GLICKO_STREAMS, "whr", "whr_integrity", "whr_performance", "whr_integrity_performance"]
    names = [f"{k}_{s}" for s in GLICKO_STREAMS for k in ("mu", "phi", "sigma")] + [f"mu_{s}" for s in streams[5:]] + [f"{lab}_{m}mu_{s}" for lab in best for m in ("", "headline_") for s in streams]
    wide = values.groupBy("fighter").pivot("name", names).agg(F.first("value"))
    base = with_idle_penalty(now.where("stream = 'canonical'").drop("stream"), cfg).select("fighter", "last_event_date", "rating_periods", "months_inactive", "activity_mu_penalty")
    return base.join(wide, "fighter").join(recent_divisions(bouts), "fighter", "left").orderBy(F.desc("mu_canonical"), "fighter")


def tuned(bouts: DataFrame, configs: dict[str, Config]) -> DataFrame:
    """Canonical ratings under several parameter sets, side by side: config and current state."""
    out = None
    for name, cfg in configs.items():
        rows = kernels.current(kernels.rate_streams(kernels.for_streams(bouts, {"canonical": {}}), cfg)).withColumn("config", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out

"""Bouts to appearances and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def appearances(bouts: DataFrame, swap: tuple[str, ...] = (), keep: tuple[str, ...] = ()) -> DataFrame:
    """Two rows for each bout, one a side, in one pass over it.

    `swap` names pairs `x_a`, `x_b` by their stem: they come out as `x` and `opponent_x`. Columns in `keep` come along.
    """
    base = [c for c in ("bout_id", "event_date", "event_name", "event_seq", "winner", "is_draw", "division", "is_title", "is_interim", "method_class", *keep) if c in bouts.columns]

    def side(me: str, other: str) -> Column:
        return F.struct(
            F.lit(me).alias("side"),
            F.col(f"fighter_{me}").alias("fighter"),
            F.col(f"fighter_{other}").alias("opponent"),
            *[F.col(f"{x}_{me}").alias(x) for x in swap],
            *[F.col(f"{x}_{other}").alias(f"opponent_{x}") for x in swap],
        )

    rows = bouts.select(*dict.fromkeys(base), F.explode(F.array(side("a", "b"), side("b", "a"))).alias("_side")).select(*dict.fromkeys(base), "_side.*")
    draw = F.coalesce("is_draw", F.lit(False))
    winner = F.coalesce(F.col("winner") == F.col("fighter"), F.lit(False)) & ~draw
    return rows.withColumns({"is_draw": draw, "is_winner": winner, "actual_score": F.when(draw, 0.5).when(winner, 1.0).otherwise(0.0)})


def weights_to_bouts(bouts: DataFrame, weights: DataFrame, weight: str) -> DataFrame:
    """Appearance weights as weight_a and weight_b of each bout, 1 where there is none, times the bout's organisation weight."""
    sides = weights.groupBy("bout_id").agg(F.map_from_entries(F.collect_list(F.struct("fighter", weight))).alias("_w"))  # two entries a bout
    org = F.coalesce("org_weight", F.lit(1.0)) if "org_weight" in bouts.columns else F.lit(1.0)
    return bouts.join(sides, "bout_id", "left").withColumns({f"weight_{s}": F.coalesce(F.col("_w")[F.col(f"fighter_{s}")], F.lit(1.0)) * org for s in "ab"}).drop("_w")


def long_factors(appearances: DataFrame, factors: dict[str, str], ids: list[str]) -> DataFrame:
    """Factor columns as rows (factor label, multiplier, effect), for audits; `factors` maps a column to its label."""
    rows = appearances.select(*ids, *factors).unpivot(ids, list(factors), "factor_column", "multiplier")
    label = F.create_map(*[F.lit(x) for pair in factors.items() for x in pair])[F.col("factor_column")]
    effect = F.when(F.col("multiplier") > 1.0001, "boost").when(F.col("multiplier") < 0.9999, "penalty").otherwise("neutral")
    return rows.select(*ids, label.alias("factor"), "multiplier", effect.alias("effect"))

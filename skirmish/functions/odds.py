"""Market odds as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import num


def american_prob(odds: Column) -> Column:
    odds = num(odds)
    return F.when(odds > 0, 100 / (odds + 100)).when(odds < 0, odds / (odds - 100))


def decimal_prob(odds: Column) -> Column:
    odds = num(odds)
    return F.when(odds > 1, 1 / odds)


def american_to_decimal(odds: Column) -> Column:
    odds = num(odds)
    return F.when(odds > 0, 1 + odds / 100).when(odds < 0, 1 - 100 / odds)


def decimal_to_american(odds: Column) -> Column:
    odds = num(odds)
    return F.when(odds >= 2, (odds - 1) * 100).when(odds > 1, -100 / (odds - 1))


def enriched(odds: DataFrame) -> DataFrame:
    """Raw and vig-free probabilities, data quality, favourite and underdog (none for even odds) of raw odds rows."""
    out = odds.withColumns({f"raw_{s}": F.coalesce(american_prob(F.col(f"american_odds_{s}")), decimal_prob(F.col(f"decimal_odds_{s}"))) for s in "ab"})
    a, b = F.col("raw_a"), F.col("raw_b")
    quality = (
        F.when(a.isNull() & b.isNull(), "missing").when(a.isNull() | b.isNull(), "one_side_missing").when(a + b < 0.85, "negative_vig").when(a + b > 2, "implausible").otherwise("ok")
    )
    out = out.withColumns({"overround": a + b, "odds_data_quality": quality, "prob_a": F.try_divide(a, a + b), "prob_b": F.try_divide(b, a + b)})
    p, q = F.col("prob_a"), F.col("prob_b")
    return out.withColumns({"favorite": F.when(p > q, F.col("fighter_a")).when(q > p, F.col("fighter_b")), "underdog": F.when(p > q, F.col("fighter_b")).when(q > p, F.col("fighter_a"))})

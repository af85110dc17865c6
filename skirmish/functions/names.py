"""Keys for names: folded, with known aliases, and compact."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def _fold(names: pd.Series) -> pd.Series:
    """Compatibility-decomposed without combining marks: SQL has no such function, so Arrow batches go through Python."""
    return names.map(lambda s: "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)), na_action="ignore")


def folded(c: Column) -> Column:
    return F.lower(F.regexp_replace(_fold(c), r"^\s+|\s+$", ""))


def compact(key: Column) -> Column:
    return F.regexp_replace(key, r"[^\p{L}\p{N}]", "")


def with_name_key(df: DataFrame, name: str, out: str = "name_key", aliases: DataFrame | None = None, squeeze: bool = True) -> DataFrame:
    """`df` with the key of a name column; `aliases` (alias, fighter) leads other spellings to one key."""
    keyed = df.withColumn(out, folded(F.col(name)))
    if aliases is not None:
        known = aliases.select(folded(F.col("alias")).alias(out), folded(F.col("fighter")).alias("_key")).dropDuplicates([out])
        keyed = keyed.join(known, out, "left").withColumn(out, F.coalesce("_key", out)).drop("_key")
    return keyed.withColumn(out, compact(F.col(out))) if squeeze else keyed

"""Attaching a dimension to fact rows, whatever the size of the dimension or the skew of its key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup_join(
    fact: DataFrame, dim: DataFrame, key: str, how: str, null_safe: bool = False, shuffled: bool = False
) -> DataFrame:
    """Join facts to a dimension with one row per key, in one lazy join.

    Adaptive execution knows the real sizes when it runs: it broadcasts a dimension that proves
    small, and splits the partition of a hot key among tasks otherwise. ``shuffled`` rules the
    broadcast out. ``null_safe`` lets a missing key match a missing key.
    """
    dim = dim.withColumnRenamed(key, "_dim_key")
    left, right = F.col(key), F.col("_dim_key")
    same = left.eqNullSafe(right) if null_safe else left == right
    return fact.join(dim.hint("merge") if shuffled else dim, same, how).drop("_dim_key")

"""Joining a large table with a table that has one row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialframe.columns import col


def join_keyed(
    large: DataFrame, keyed: DataFrame, names: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Join on ``names``; null keys match each other.

    Spark picks the way by the sizes that it knows or measures: a small keyed table is broadcast,
    otherwise adaptive execution splits a key that has a large share of the rows.
    """
    rest = [c for c in keyed.columns if c not in names]
    right = keyed.select(
        *[col(c).alias(f"__k{i}") for i, c in enumerate(names)], *[col(c) for c in rest]
    )
    on = F.lit(True)
    for i, c in enumerate(names):
        on = on & col(c).eqNullSafe(F.col(f"__k{i}"))
    return large.join(right, on, how).select(
        *[col(c) for c in large.columns], *[col(c) for c in rest])

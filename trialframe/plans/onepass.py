"""Many statistics of many columns in one aggregation.

A statistic per variable is written once as a function of a column.  All variables of a
block are aggregated together (partial aggregation on the map side, one tiny row per task
through the shuffle) and the single result row is turned into one row per variable with
``inline``.  Wide tables are cut into blocks of columns, to stay inside code generation;
with a columnar source every block reads only its own columns, so the bytes read are the
same as with one scan.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialframe.columns import col, num

Spec = dict[str, Callable[[Column], Column]]
BLOCK_COLUMNS = 64


def per_variable(
    df: DataFrame,
    cols: Sequence[str],
    spec: Spec,
    by: Sequence[str] = (),
    as_double: bool = True,
) -> DataFrame:
    """One row per (group, variable) with the statistics of ``spec``; needs at least one column."""
    if not cols:
        raise ValueError("no column to aggregate")
    parts = []
    for start in range(0, len(cols), BLOCK_COLUMNS):
        rows = []
        for position, name in enumerate(cols[start : start + BLOCK_COLUMNS], start):
            source = num(name) if as_double else col(name)
            rows.append(
                F.struct(
                    F.lit(name).alias("variable"),
                    F.lit(position).alias("position"),
                    *[fn(source).alias(out) for out, fn in spec.items()],
                )
            )
        agg = df.groupBy(*[col(b) for b in by]).agg(F.array(*rows).alias("__rows"))
        parts.append(agg.select(*[col(b) for b in by], F.inline("__rows")))
    return reduce(DataFrame.unionByName, parts)


def long_form(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys…, variable, value double) without the missing values."""
    cells = F.array(
        *[F.struct(F.lit(c).alias("variable"), num(c).alias("value")) for c in cols]
    )
    return (
        df.select(*[col(k) for k in keys], F.inline(cells))
        .filter(F.col("value").isNotNull())
    )


def long_strings(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys…, variable, value string) without the missing values."""
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("variable"), col(c).cast("string").alias("value"))
            for c in cols
        ]
    )
    return (
        df.select(*[col(k) for k in keys], F.inline(cells))
        .filter(F.col("value").isNotNull())
    )


def fitted(rows: DataFrame) -> dict[str, dict]:
    """Collect one parameter row per variable (bounded by the number of columns)."""
    return {r["variable"]: r.asDict() for r in rows.collect()}

"""Missing-data reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialframe.columns import col
from trialframe.functions.shape import ratio
from trialframe.operators.explore import profile_table
from trialframe.plans.moments import correlations
from trialframe.plans.onepass import per_variable
from trialframe.sources.dictionary import NO_DESCRIPTION, with_descriptions


def missing_report(df: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """(variable, missing_values, percentage, dtype[, description]), most missing first."""
    report = profile_table(df).select(
        "variable",
        "missing_values",
        (ratio(F.col("missing_values"), F.col("n")) * 100).alias("percentage"),
        "dtype",
    )
    if dictionary is not None:
        report = with_descriptions(report, dictionary, NO_DESCRIPTION)
    return report.orderBy(F.desc("percentage"), F.asc("variable"))


def only_missing(report: DataFrame) -> DataFrame:
    return report.filter("missing_values > 0")


def top_missing(report: DataFrame, n: int = 20) -> DataFrame:
    return (
        only_missing(report).orderBy(F.desc("percentage"), F.asc("variable")).limit(n)
    )


def overview(df: DataFrame) -> DataFrame:
    """One row: rows, columns, missing cells, variables with missing, complete cases; one pass."""
    cols = df.columns
    any_missing = F.lit(False)
    for c in cols:
        any_missing = any_missing | col(c).isNull()
    counts = df.agg(
        F.count("*").alias("n_rows"),
        F.count(F.when(~any_missing, 1)).alias("complete_rows"),
        F.array(*[F.count(F.when(col(c).isNull(), 1)) for c in cols]).alias("m"),
    )
    cells = F.aggregate("m", F.lit(0).cast("long"), lambda a, b: a + b)
    touched = F.size(F.filter("m", lambda v: v > 0))
    p = len(cols)
    return counts.select(
        "n_rows",
        F.lit(p).cast("long").alias("n_columns"),
        cells.alias("missing_cells"),
        (ratio(cells, F.col("n_rows") * p) * 100).alias("pct_missing_cells"),
        touched.cast("long").alias("n_variables_missing"),
        (touched / F.lit(p) * 100).alias("pct_variables_missing"),
        "complete_rows",
        (ratio(F.col("complete_rows"), F.col("n_rows")) * 100).alias("pct_complete_rows"),
    )


def missing_patterns(df: DataFrame, cols) -> DataFrame:
    """Distinct null patterns with counts: the missingness matrix without its repeats."""
    flags = [col(c).isNull().alias(f"{c}__missing") for c in cols]
    return df.select(*flags).groupBy(*[col(f"{c}__missing") for c in cols]).agg(
        F.count("*").alias("n")
    )


def missing_correlation(df: DataFrame, cols, threshold: float | None = None) -> DataFrame:
    """Correlation of missing indicators per pair; null for a constant indicator."""
    flags = df.select(*[col(c).isNull().cast("double").alias(c) for c in cols])
    r = correlations(flags, list(cols)).select("var1", "var2", "r")
    if threshold is None:
        return r
    return r.filter(F.col("r") >= threshold).orderBy(F.desc("r"))


def missing_by_group(df: DataFrame, cols, group: str | Sequence[str]) -> DataFrame:
    """(group, variable, percentage)."""
    by = [group] if isinstance(group, str) else list(group)
    stats = per_variable(
        df, cols, {"percentage": lambda c: F.avg(c.isNull().cast("double")) * 100}, by,
        as_double=False,
    )
    return stats.drop("position")


def missing_by_category(categories: DataFrame, report: DataFrame) -> DataFrame:
    """(category, variable, missing_values, percentage) of variables with missing values."""
    return categories.select("category", "variable").join(only_missing(report), "variable")

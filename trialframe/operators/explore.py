"""Profiles, descriptive statistics, histograms and box-plot statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialframe.columns import col, num, resolve_columns
from trialframe.functions.shape import kurtosis_corrected, ratio, skew_corrected
from trialframe.plans.joins import join_keyed
from trialframe.plans.lineage import written
from trialframe.plans.onepass import fitted, long_form, long_strings, per_variable
from trialframe.plans.quantiles import exact_quantiles, medians


def profile_table(df: DataFrame) -> DataFrame:
    """(variable, position, dtype, n, missing_values, n_present) in one pass."""
    counts = per_variable(
        df, df.columns, {"n": lambda c: F.count(F.lit(1)), "n_present": F.count}, as_double=False
    )
    types = F.create_map(*[F.lit(x) for pair in df.dtypes for x in pair])
    return counts.select(
        "variable",
        "position",
        types[F.col("variable")].alias("dtype"),
        "n",
        (F.col("n") - F.col("n_present")).alias("missing_values"),
        "n_present",
    )


def describe_numeric(df: DataFrame, cols=None, id_col=None, by: Sequence[str] = ()) -> DataFrame:
    """count, mean, std (n−1), min, quartiles, max, missing and corrected skew and kurtosis."""
    cols = resolve_columns(df, cols, [*by, *([id_col] if isinstance(id_col, str) else id_col or [])])
    stats = per_variable(
        df,
        cols,
        {
            "rows": lambda c: F.count(F.lit(1)),
            "count": F.count,
            "mean": F.avg,
            "std": F.stddev_samp,
            "min": F.min,
            "max": F.max,
            "skew": skew_corrected,
            "kurtosis": kurtosis_corrected,
        },
        by,
    )
    quartiles = exact_quantiles(df, cols, [0.25, 0.5, 0.75], by)
    return join_keyed(stats, quartiles, [*by, "variable"], "left").select(
        *[col(b) for b in by],
        "variable",
        "count",
        "mean",
        "std",
        "min",
        F.col("q")[0].alias("q1"),
        F.col("q")[1].alias("median"),
        F.col("q")[2].alias("q3"),
        "max",
        (F.col("rows") - F.col("count")).alias("missing"),
        (ratio(F.col("rows") - F.col("count"), F.col("rows")) * 100).alias("missing_pct"),
        "skew",
        "kurtosis",
    )


def summarize(df: DataFrame, cols, by: Sequence[str] = ()) -> DataFrame:
    """n, mean, median, std (n−1), min, max, missing per (group, variable)."""
    stats = per_variable(
        df,
        cols,
        {
            "rows": lambda c: F.count(F.lit(1)),
            "n": F.count,
            "mean": F.avg,
            "std": F.stddev_samp,
            "min": F.min,
            "max": F.max,
        },
        by,
    )
    return join_keyed(stats, medians(df, cols, by), [*by, "variable"], "left").select(
        *[col(b) for b in by],
        "variable",
        "n",
        "mean",
        "median",
        "std",
        "min",
        "max",
        (F.col("rows") - F.col("n")).alias("missing"),
        (ratio(F.col("rows") - F.col("n"), F.col("rows")) * 100).alias("missing_pct"),
    )


def value_counts(df: DataFrame, cols) -> DataFrame:
    """(variable, value, n, pct) of non-missing values; pct of the variable's values."""
    counts = long_strings(df, cols).groupBy("variable", "value").agg(F.count("*").alias("n"))
    totals = per_variable(df, cols, {"total": F.count}, as_double=False)
    return counts.join(F.broadcast(totals.select("variable", "total")), "variable").select(
        "variable", "value", "n", (F.col("n") / F.col("total") * 100).alias("pct")
    )


def categorical_summary(df: DataFrame, cols) -> DataFrame:
    """(variable, n_distinct, n, missing).  Two-step distinct count: no value set in one task."""
    counts = long_strings(df, cols).groupBy("variable", "value").agg(F.count("*").alias("n"))
    distinct = counts.groupBy("variable").agg(F.count("*").alias("n_distinct"))
    base = per_variable(
        df, cols, {"rows": lambda c: F.count(F.lit(1)), "n": F.count}, as_double=False
    )
    return base.join(distinct, "variable", "left").select(
        "variable",
        F.coalesce("n_distinct", F.lit(0)).cast("long").alias("n_distinct"),
        "n",
        (F.col("rows") - F.col("n")).alias("missing"),
    )


def histogram(
    df: DataFrame, column: str, bins: int | str = "auto", density: bool = False
) -> DataFrame:
    """(bin, lower, upper, n[, density]); equal-width bins, the last one closed; empty bins kept.

    ``bins="auto"`` is Sturges' rule.  One pass for the range, one for the counts.
    """
    got = fitted(per_variable(df, [column], {"n": F.count, "lo": F.min, "hi": F.max}))[column]
    n, lo, hi = got["n"], got["lo"], got["hi"]
    schema = "bin int, lower double, upper double, n long"
    if not n:
        empty = df.sparkSession.createDataFrame([], schema)
        return empty.withColumn("density", F.lit(None).cast("double")) if density else empty
    if bins == "auto":
        bins = (n - 1).bit_length() + 1
    if hi == lo:
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins
    value = num(column)
    which = F.least(F.floor((value - lo) / width), F.lit(bins - 1)).cast("int")
    counts = (
        df.filter(value.isNotNull()).groupBy(which.alias("bin")).agg(F.count("*").alias("n"))
    )
    frame = df.sparkSession.range(bins).select(
        F.col("id").cast("int").alias("bin"),
        (F.lit(lo) + F.col("id") * width).alias("lower"),
        (F.lit(lo) + (F.col("id") + 1) * width).alias("upper"),
    )
    out = frame.join(counts, "bin", "left").select(
        "bin", "lower", "upper", F.coalesce("n", F.lit(0)).cast("long").alias("n")
    )
    if density:
        out = out.withColumn("density", F.col("n") / (F.lit(float(n)) * width))
    return out


def box_stats(df: DataFrame, cols, by: Sequence[str] = ()) -> DataFrame:
    """Quartiles, 1.5·IQR fences, whiskers (outermost values inside the fences), outlier count."""
    quartiles = exact_quantiles(df, cols, [0.25, 0.5, 0.75], by).select(
        *[col(b) for b in by],
        "variable",
        F.col("q")[0].alias("q1"),
        F.col("q")[1].alias("median"),
        F.col("q")[2].alias("q3"),
    )
    iqr = F.col("q3") - F.col("q1")
    fences = written(quartiles.withColumn("low_fence", F.col("q1") - 1.5 * iqr).withColumn(
        "high_fence", F.col("q3") + 1.5 * iqr
    ))
    cells = join_keyed(long_form(df, cols, by), fences, [*by, "variable"])
    v = F.col("value")
    inside = (v >= F.col("low_fence")) & (v <= F.col("high_fence"))
    keys = [col(b) for b in by]
    return cells.groupBy(
        *keys, "variable", "q1", "median", "q3", "low_fence", "high_fence"
    ).agg(
        F.count("*").alias("n"),
        F.min(F.when(inside, v)).alias("whisker_low"),
        F.max(F.when(inside, v)).alias("whisker_high"),
        F.count(F.when(~inside, 1)).alias("n_outliers"),
    )

"""Mean, median and k-nearest-neighbour imputation, and checks of what was imputed."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialframe.columns import col, num, resolve_columns
from trialframe.functions.shape import ratio
from trialframe.functions.tails import t_pvalue
from trialframe.operators.explore import summarize
from trialframe.operators.knn import impute_knn
from trialframe.plans.onepass import fitted, per_variable
from trialframe.plans.quantiles import medians

METHODS = ("mean", "median", "knn")


def targets(df: DataFrame, id_col=None, exclude: Sequence[str] = (), cols=None) -> list[str]:
    """Numeric columns to impute: all but the keys and the excluded ones."""
    return [c for c in resolve_columns(df, cols, id_col) if c not in set(exclude)]


def fill(df: DataFrame, values: dict[str, float | None], flags: bool = False) -> DataFrame:
    """Replace nulls by constants (a projection); ``flags`` adds ``<c>__imputed``."""
    known = {c: v for c, v in values.items() if v is not None}
    out = [
        F.coalesce(num(c), F.lit(float(known[c]))).alias(c) if c in known else col(c)
        for c in df.columns
    ]
    if flags:
        out += [col(c).isNull().alias(f"{c}__imputed") for c in known]
    return df.select(*out)


def impute(
    df: DataFrame,
    method: str = "knn",
    id_col: str | None = None,
    k: int = 5,
    exclude: Sequence[str] = (),
    cols=None,
    flags: bool = False,
    on_unknown: str = "raise",
) -> DataFrame:
    """The table with missing numeric values filled; a column without any value stays null.

    mean and median: one aggregation, then a projection.  An unknown method is an error, or with
    ``on_unknown="keep"`` a warning and the table as it is.
    """
    if method not in METHODS:
        if on_unknown == "keep":
            warnings.warn(f"unknown imputation method {method!r}: nothing imputed", stacklevel=2)
            return df
        raise ValueError(f"unknown imputation method {method!r}, expected one of {METHODS}")
    chosen = targets(df, id_col, exclude, cols)
    if not chosen:
        return df
    if method == "knn":
        if id_col is None:
            raise ValueError("knn imputation needs id_col")
        return impute_knn(df, id_col, chosen, k=k, flags=flags)
    if method == "mean":
        constants = per_variable(df, chosen, {"value": F.avg})
    else:
        constants = medians(df, chosen).withColumnRenamed("median", "value")
    return fill(df, {c: r["value"] for c, r in fitted(constants).items()}, flags)


def imputation_summary(before: DataFrame, after: DataFrame, cols) -> DataFrame:
    """(variable, missing_before, filled, remaining)."""

    def missing(df: DataFrame, name: str) -> DataFrame:
        return per_variable(
            df, cols, {name: lambda c: F.count(F.when(c.isNull(), 1))}
        ).drop("position")

    both = missing(before, "missing_before").join(missing(after, "remaining"), "variable")
    return both.select(
        "variable",
        "missing_before",
        (F.col("missing_before") - F.col("remaining")).alias("filled"),
        "remaining",
    )


def imputed_variables(before: DataFrame, after: DataFrame, cols) -> DataFrame:
    """Variables with fewer nulls after than before."""
    return imputation_summary(before, after, cols).filter("filled > 0")


def before_after(before: DataFrame, after: DataFrame, cols) -> DataFrame:
    """Summary statistics of both tables, with a ``stage`` column."""
    a = summarize(before, cols).withColumn("stage", F.lit("before"))
    b = summarize(after, cols).withColumn("stage", F.lit("after"))
    return a.unionByName(b)


def _status_long(imputed: DataFrame, cols) -> DataFrame:
    """(variable, status, value) from a table imputed with ``flags=True``."""
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("variable"),
                F.when(col(f"{c}__imputed"), "Imputed").otherwise("Original").alias("status"),
                num(c).alias("value"),
            )
            for c in cols
        ]
    )
    return imputed.select(F.inline(cells)).filter(F.col("value").isNotNull())


def imputation_validation(imputed: DataFrame, cols) -> DataFrame:
    """count, mean, median, std, min, max of original and of imputed values."""
    named = _status_long(imputed, cols).withColumnRenamed("variable", "name")
    return summarize(named, ["value"], ["name", "status"]).select(
        F.col("name").alias("variable"), "status", "n", "mean", "median", "std", "min", "max"
    )


def welch_t(long: DataFrame, group: str, first: str, second: str, min_n: int = 5) -> DataFrame:
    """Welch's t-test of two groups per variable of a (variable, group, value) table.

    (variable, n1, n2, t, df, p_value, significant); null below ``min_n`` values per group.
    """
    stats = long.groupBy("variable").agg(
        *[
            fn(F.when(col(group) == which, F.col("value"))).alias(f"{name}{i}")
            for i, which in ((1, first), (2, second))
            for name, fn in (("n", F.count), ("m", F.avg), ("v", F.var_samp))
        ]
    )
    a, b = ratio(F.col("v1"), F.col("n1")), ratio(F.col("v2"), F.col("n2"))
    enough = (F.col("n1") >= min_n) & (F.col("n2") >= min_n) & (a + b > 0)
    t = F.when(enough, (F.col("m1") - F.col("m2")) / F.sqrt(a + b))
    freedom = F.when(
        enough, F.pow(a + b, F.lit(2)) / (a * a / (F.col("n1") - 1) + b * b / (F.col("n2") - 1))
    )
    tested = stats.select("variable", "n1", "n2", t.alias("t"), freedom.alias("df"))
    return tested.withColumn("p_value", F.when(F.col("t").isNotNull(),
                                               t_pvalue(F.col("t"), F.col("df")))).withColumn(
        "significant", F.col("p_value") < 0.05
    )


def imputation_test(imputed: DataFrame, cols) -> DataFrame:
    """Welch test of original against imputed values, per variable."""
    return welch_t(_status_long(imputed, cols), "status", "Original", "Imputed")


"""Variable screening: near-zero variance, collinearity, variance inflation, recommendation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialframe.columns import col, complete_cases, num, resolve_columns
from trialframe.plans.moments import correlation_matrix, correlations
from trialframe.plans.onepass import fitted, long_form, per_variable
from trialframe.sources.dictionary import first_category, variables_of


def near_zero_variance(
    df: DataFrame, threshold: float = 0.01, cols=None, id_col=None
) -> DataFrame:
    """(variable, n_unique, most_common_freq, is_near_zero).

    Flagged when the distinct values are fewer than max(2, ⌊n · threshold⌋).  Values are
    counted first and the counts reduced after, so a dominant value is combined on the map side.
    """
    cols = resolve_columns(df, cols, id_col)
    counts = long_form(df, cols).groupBy("variable", "value").agg(F.count("*").alias("m"))
    found = counts.groupBy("variable").agg(
        F.count("*").alias("n_unique"), F.max("m").alias("top")
    )
    base = per_variable(df, cols, {"n": lambda c: F.count(F.lit(1))})
    unique = F.coalesce("n_unique", F.lit(0)).cast("long")
    limit = F.greatest(F.lit(2), F.floor(F.col("n") * F.lit(threshold)))
    return base.join(found, "variable", "left").select(
        "variable",
        unique.alias("n_unique"),
        F.when(unique > 0, F.col("top") / F.col("n")).otherwise(1.0).alias("most_common_freq"),
        (unique < limit).alias("is_near_zero"),
    )


def correlation(df: DataFrame, cols=None, id_col=None, square: bool = False) -> DataFrame:
    """(var1, var2, r), signed, pairwise complete; ``square`` gives the whole matrix."""
    cols = resolve_columns(df, cols, id_col)
    half = correlations(df, cols).select("var1", "var2", "r")
    if not square:
        return half
    sides = F.array(
        F.struct(F.col("var1").alias("a"), F.col("var2").alias("b")),
        F.struct(F.col("var2").alias("a"), F.col("var1").alias("b")),
    )
    both = half.select(F.inline(sides), "r").select(
        F.col("a").alias("var1"), F.col("b").alias("var2"), "r"
    )
    own = per_variable(df, cols, {"v": F.var_pop}).select(
        F.col("variable").alias("var1"), F.col("variable").alias("var2"),
        F.when(F.col("v") > 0, 1.0).alias("r"),
    )
    return both.unionByName(own)


def collinear_pairs(df: DataFrame, threshold: float = 0.85, cols=None, id_col=None) -> DataFrame:
    """(var1, var2, correlation) with |r| ≥ threshold, strongest first."""
    half = correlations(df, resolve_columns(df, cols, id_col))
    strong = half.withColumn("correlation", F.abs("r")).filter(F.col("correlation") >= threshold)
    return strong.select("var1", "var2", "correlation").orderBy(
        F.desc("correlation"), "var1", "var2"
    )


def correlation_network(
    df: DataFrame, threshold: float = 0.5, cols=None, id_col=None
) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes): var1, var2, r, width 1–10 by min–max of |r|; node, degree."""
    cols = resolve_columns(df, cols, id_col)
    edges = correlations(df, cols).filter(F.abs("r") >= threshold).select("var1", "var2", "r")
    span = edges.agg(F.min(F.abs("r")).alias("lo"), F.max(F.abs("r")).alias("hi")).first()
    lo, hi = span["lo"] or 0.0, span["hi"] or 0.0
    width = (
        F.lit(1.0) + (F.abs("r") - lo) / (hi - lo) * 9.0 if hi > lo else F.lit(1.0)
    )
    ends = edges.select(F.explode(F.array("var1", "var2")).alias("node"))
    degree = ends.groupBy("node").agg(F.count("*").alias("degree"))
    names = variables_of(df.select(*[col(c) for c in cols])).select(
        F.col("variable").alias("node")
    )
    nodes = names.join(degree, "node", "left").select(
        "node", F.coalesce("degree", F.lit(0)).cast("long").alias("degree")
    )
    return edges.withColumn("width", width), nodes


def vif_from_correlation(r: np.ndarray) -> list[float]:
    """diag(R⁻¹); for a singular R, ∞ where the column is a combination of the others."""
    p = len(r)
    if np.linalg.cond(r) < 1e12:
        return [float(v) for v in np.diag(np.linalg.inv(r))]
    out = []
    for i in range(p):
        rest = [j for j in range(p) if j != i]
        r2 = float(r[i, rest] @ np.linalg.pinv(r[np.ix_(rest, rest)]) @ r[rest, i])
        out.append(float("inf") if r2 >= 1 - 1e-10 else 1.0 / (1.0 - r2))
    return out


def vif(df: DataFrame, cols=None, id_col=None) -> DataFrame:
    """(variable, vif) on complete cases, highest first; null for a column without spread.

    Spark computes the p × p correlation; only that matrix is inverted on the driver.
    Empty with fewer than two columns or without complete rows.
    """
    cols = resolve_columns(df, cols, id_col)
    spark, schema = df.sparkSession, "variable string, vif double"
    if len(cols) < 2:
        return spark.createDataFrame([], schema)
    whole = complete_cases(df, cols).select(*[num(c).alias(c) for c in cols])
    spread = fitted(per_variable(whole, cols, {"n": F.count, "v": F.var_pop}))
    if not spread[cols[0]]["n"]:
        return spark.createDataFrame([], schema)
    moving = [c for c in cols if (spread[c]["v"] or 0.0) > 0]
    values = dict(zip(moving, vif_from_correlation(correlation_matrix(whole, moving))))
    rows = [(c, values.get(c)) for c in cols]
    return spark.createDataFrame(rows, schema).orderBy(F.desc("vif"))


def high_vif(table: DataFrame, limit: float = 5.0, top: int = 20) -> DataFrame:
    return table.filter(F.col("vif") > limit).orderBy(F.desc("vif"), "variable").limit(top)


def recommend_variables(
    df: DataFrame,
    near_zero_threshold: float = 0.01,
    collinearity_threshold: float = 0.85,
    vif_threshold: float = 5.0,
    force_include: Sequence[str] = (),
    id_col=None,
) -> tuple[DataFrame, DataFrame]:
    """(decisions, summary).

    decisions: (variable, recommended, reasons array) for every column; a column is left out
    for near-zero variance, as the second of a collinear pair, or for a high VIF, unless forced.
    summary: one row of counts.
    """
    cols = resolve_columns(df, None, id_col)
    spark = df.sparkSession
    nzv = near_zero_variance(df, near_zero_threshold, cols).filter("is_near_zero")
    pairs = collinear_pairs(df, collinearity_threshold, cols) if len(cols) > 1 else None
    inflated = vif(df, cols).filter(F.col("vif") > vif_threshold)
    # All three are at most p (or p²) rows of names.
    low = [r["variable"] for r in nzv.select("variable").collect()]
    second = [r["var2"] for r in pairs.select("var2").collect()] if pairs is not None else []
    high = [r["variable"] for r in inflated.select("variable").collect()]
    reasons: dict[str, list[str]] = {c: [] for c in df.columns}
    for names, why in ((low, "near_zero_variance"), (sorted(set(second)), "collinear"),
                       (high, "high_vif")):
        for c in names:
            reasons[c].append(why)
    forced = set(force_include)
    decisions = [(c, c in forced or not why, why) for c, why in sorted(reasons.items())]
    table = spark.createDataFrame(
        decisions, "variable string, recommended boolean, reasons array<string>"
    )
    counts = [(len(df.columns), len(low), len(second), len(high), len(forced),
               sum(1 for _, ok, _ in decisions if ok))]
    summary = spark.createDataFrame(
        counts,
        "total_variables long, near_zero_variables long, highly_correlated_pairs long, "
        "high_vif_variables long, force_included_variables long, recommended_variables long",
    )
    return table, summary


def recommended_names(decisions: DataFrame) -> list[str]:
    return sorted(r["variable"] for r in decisions.filter("recommended").collect())


def recommended_by_category(
    decisions: DataFrame, patterns: Mapping[str, Sequence[str]] | None = None
) -> DataFrame:
    """(category, variable) of recommended variables, by the first category that matches."""
    return first_category(decisions.filter("recommended"), patterns).select(
        "category", "variable"
    )


def default_force_include(df: DataFrame) -> list[str]:
    """Treatment and outcome variables, which screening must not lose."""
    from trialframe.sources.dictionary import CATEGORY_PATTERNS

    marks = CATEGORY_PATTERNS["treatment"] + CATEGORY_PATTERNS["outcome"]
    return [c for c in df.columns if any(m in c.lower() for m in marks)]


def ols_trend(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: n, slope, intercept, r2 of y on x over complete pairs."""
    a, b = num(x), num(y)
    return df.agg(
        F.regr_count(b, a).alias("n"),
        F.regr_slope(b, a).alias("slope"),
        F.regr_intercept(b, a).alias("intercept"),
        F.regr_r2(b, a).alias("r2"),
    )

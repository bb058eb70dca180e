"""Column expressions for shape, effect sizes, scaling and power transforms."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom as a double; null instead of an error when the bottom is 0 (ANSI mode)."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def correlation_of(x: Column, y: Column) -> Column:
    """Pearson correlation over complete pairs (aggregate); null without spread.

    The built-in ``corr`` fails on a column without spread when ANSI mode is on.
    """
    return ratio(F.regr_sxy(y, x), F.sqrt(F.regr_sxx(y, x) * F.regr_syy(y, x)))


def skew_corrected(c: Column) -> Column:
    """Bias-corrected skewness G1 (aggregate); null below 3 values, 0 without variance."""
    n = F.count(c).cast("double")
    g1 = F.when(F.var_pop(c) > 0, F.skewness(c)).otherwise(0.0)
    return F.when(n >= 3, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def kurtosis_corrected(c: Column) -> Column:
    """Bias-corrected excess kurtosis G2 (aggregate); null below 4 values, 0 without variance."""
    n = F.count(c).cast("double")
    g2 = F.kurtosis(c)
    value = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)
    return F.when(n >= 4, F.when(F.var_pop(c) > 0, value).otherwise(0.0))


def eta_squared(f: Column, df_between: Column, df_within: Column) -> Column:
    """F·df1 / (F·df1 + df2); NaN when F is missing or the denominator is not positive."""
    top = f * df_between
    bottom = top + df_within
    ok = f.isNotNull() & ~F.isnan(f) & (bottom > 0) & (df_within > 0)
    return F.when(ok, top / bottom).otherwise(F.lit(math.nan))


def cramers_v(chi2: Column, n: Column, k: Column, r: Column) -> Column:
    """√(χ² / (n·(min(k, r) − 1))); NaN where undefined."""
    low = F.least(k, r) - 1
    ok = chi2.isNotNull() & ~F.isnan(chi2) & (n > 0) & (low > 0)
    return F.when(ok, F.sqrt(chi2 / (n * low))).otherwise(F.lit(math.nan))


def effect_band(eta: Column) -> Column:
    """Words for an effect size (.01 / .06 / .14)."""
    return (
        F.when(eta >= 0.14, "large")
        .when(eta >= 0.06, "medium")
        .when(eta >= 0.01, "small")
        .otherwise("negligible")
    )


def silhouette_band(s: Column) -> Column:
    """Words for a mean silhouette (.7 / .5 / .25)."""
    return (
        F.when(s > 0.7, "strong")
        .when(s > 0.5, "reasonable")
        .when(s > 0.25, "weak")
        .otherwise("no substantial structure")
    )


def balance_class(smd: Column) -> Column:
    return F.when(smd < 0.1, "good").when(smd < 0.2, "acceptable").when(smd.isNotNull(), "poor")


def yeo_johnson_expr(x: Column, lam: float) -> Column:
    """ψ(x, λ) of Yeo and Johnson (2000)."""
    positive = (
        F.log1p(x) if abs(lam) < 1e-12 else F.expm1(F.log1p(x) * lam) / lam
    )
    other = 2.0 - lam
    negative = (
        -F.log1p(-x) if abs(other) < 1e-12 else -F.expm1(F.log1p(-x) * other) / other
    )
    return F.when(x >= 0, positive).otherwise(negative)


def yeo_johnson_of(x: Column, lam: Column) -> Column:
    """ψ(x, λ) with λ in a column."""
    other = 2.0 - lam
    positive = F.when(F.abs(lam) < 1e-12, F.log1p(x)).otherwise(F.expm1(F.log1p(x) * lam) / lam)
    negative = F.when(F.abs(other) < 1e-12, -F.log1p(-x)).otherwise(
        -F.expm1(F.log1p(-x) * other) / other
    )
    return F.when(x >= 0, positive).otherwise(negative)

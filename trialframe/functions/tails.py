"""Tail probabilities of the F, t, chi-square and normal distributions.

Used on result tables (one row per variable or test), as Arrow UDFs over whole columns.
Incomplete beta and gamma functions by series and continued fractions; see the
"Handbook of Mathematical Functions" (Abramowitz and Stegun), 6.5 and 26.5.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_TINY = 1e-300
# Beyond this the continued fraction is slow, and the chi-square limit is exact to ~1e-12.
_LARGE_DF = 2e5


def _log_beta(a: float, b: float) -> float:
    return math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)


def _beta_fraction(a: float, b: float, x: float) -> float:
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > _TINY else _TINY)
    h = d
    for m in range(1, 20_000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for step in (even, odd):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > _TINY else _TINY)
            c = 1.0 + step / c
            c = c if abs(c) > _TINY else _TINY
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(a * math.log(x) + b * math.log1p(-x) - _log_beta(a, b))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x)."""
    if x <= 0.0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1.0
            term *= x / k
            total += term
        return 1.0 - front * total
    b = x + 1.0 - a
    c = 1.0 / _TINY
    d = 1.0 / b
    h = d
    for i in range(1, 20_000):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = 1.0 / (d if abs(d) > _TINY else _TINY)
        c = b + an / c
        c = c if abs(c) > _TINY else _TINY
        h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return front * h


def f_tail(f: float, d1: float, d2: float) -> float:
    """P(F > f) with d1 and d2 degrees of freedom."""
    if not (d1 > 0 and d2 > 0) or math.isnan(f):
        return math.nan
    if math.isinf(f):
        return 0.0
    if f <= 0:
        return 1.0
    if d2 > _LARGE_DF:
        return gamma_upper(d1 / 2.0, 0.5 * (d2 + d1 / 2.0 - 1.0) * math.log1p(d1 * f / d2))
    return beta_inc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


def t_tail(t: float, df: float) -> float:
    """Two-sided P(|T| > |t|)."""
    return f_tail(t * t, 1.0, df)


def chi2_tail(x: float, df: float) -> float:
    """P(X > x) with df degrees of freedom."""
    if not df > 0 or math.isnan(x):
        return math.nan
    return gamma_upper(df / 2.0, x / 2.0)


def normal_tail(z: float) -> float:
    """P(Z > z)."""
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def _vector(fn, *series: pd.Series) -> pd.Series:
    columns = [s.astype("float64").to_numpy() for s in series]
    out = [fn(*row) for row in zip(*columns)]
    return pd.Series(np.asarray(out, dtype="float64"))


def f_pvalue(f: Column, d1: Column, d2: Column) -> Column:
    @F.pandas_udf("double")
    def tail(it: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b, c in it:
            yield _vector(f_tail, a, b, c)

    return tail(f.cast("double"), d1.cast("double"), d2.cast("double"))


def t_pvalue(t: Column, df: Column) -> Column:
    @F.pandas_udf("double")
    def tail(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in it:
            yield _vector(t_tail, a, b)

    return tail(t.cast("double"), df.cast("double"))


def chi2_pvalue(x: Column, df: Column) -> Column:
    @F.pandas_udf("double")
    def tail(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in it:
            yield _vector(chi2_tail, a, b)

    return tail(x.cast("double"), df.cast("double"))

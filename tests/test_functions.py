import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialframe.functions import shape, tails
from trialframe.functions.shapiro import shapiro_wilk


def test_f_tail_known_value():
    assert 1 - tails.f_tail(4.0, 2, 9) == pytest.approx(0.9428427735828099, rel=1e-12)


@pytest.mark.parametrize("d2", [3, 40, 1_000, 150_000, 250_000, 10_000_000])
@pytest.mark.parametrize("f", [0.1, 1.0, 3.7, 12.0])
def test_f_tail_closed_form_for_two_degrees(f, d2):
    assert tails.f_tail(f, 2, d2) == pytest.approx((1 + 2 * f / d2) ** (-d2 / 2), rel=1e-9)


def test_f_tail_is_continuous_where_the_limit_takes_over():
    a, b = tails.f_tail(1.7, 5, 1.99e5), tails.f_tail(1.7, 5, 2.01e5)
    assert a == pytest.approx(b, rel=1e-6)


def test_t_tail_closed_forms():
    # One degree of freedom is Cauchy; two degrees have an algebraic tail.
    assert tails.t_tail(1.0, 1) == pytest.approx(0.5, rel=1e-12)
    t = 2.3
    assert tails.t_tail(t, 2) == pytest.approx(1 - t / math.sqrt(2 + t * t), rel=1e-12)


def test_chi2_tail_closed_form():
    for x in (0.3, 2.0, 9.0, 60.0):
        want = math.exp(-x / 2) * (1 + x / 2 + (x / 2) ** 2 / 2)
        assert tails.chi2_tail(x, 6) == pytest.approx(want, rel=1e-12)
        assert tails.chi2_tail(x, 1) == pytest.approx(math.erfc(math.sqrt(x / 2)), rel=1e-10)


def test_tails_undefined():
    assert math.isnan(tails.f_tail(math.nan, 1, 2))
    assert math.isnan(tails.f_tail(1, 0, 2))
    assert math.isnan(tails.chi2_tail(1, 0))
    assert tails.f_tail(math.inf, 1, 2) == 0.0


def test_pvalue_columns(spark):
    df = spark.createDataFrame([(4.0, 2, 9), (None, 2, 9)], "f double, a int, b int")
    got = [r[0] for r in df.select(tails.f_pvalue(F.col("f"), F.col("a"), F.col("b"))).collect()]
    assert got[0] == pytest.approx(1 - 0.9428427735828099)
    assert got[1] is None or math.isnan(got[1])


def test_shapiro_published_example():
    # Weights of eleven men, from the literature on the test.
    w, p = shapiro_wilk(np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236.0]))
    assert w == pytest.approx(0.79, abs=0.003)
    assert p == pytest.approx(0.0067, abs=0.0005)


def test_shapiro_behaviour():
    rng = np.random.default_rng(0)
    w, p = shapiro_wilk(rng.normal(size=2_000))
    assert w > 0.99 and p > 0.01
    w, p = shapiro_wilk(rng.exponential(size=500))
    assert p < 1e-10
    assert math.isnan(shapiro_wilk(np.array([1.0, 2.0]))[0])
    assert shapiro_wilk(np.full(10, 3.0)) == (1.0, 1.0)
    w, p = shapiro_wilk(np.array([1.0, 2.0, 3.0]))
    assert w == pytest.approx(1.0) and p == pytest.approx(1.0, abs=1e-6)


def _one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_eta_squared(spark):
    def eta(f, a, b):
        return _one(spark, shape.eta_squared(F.lit(f).cast("double"), F.lit(a), F.lit(b)))

    assert eta(5.0, 2, 10) == pytest.approx(0.5)
    assert math.isnan(eta(5.0, 2, 0))
    assert math.isnan(eta(math.nan, 2, 10))
    assert math.isnan(eta(1.0, 1, -1))


def test_cramers_v(spark):
    def v(x, n, k, r):
        return _one(spark, shape.cramers_v(F.lit(x), F.lit(n), F.lit(k), F.lit(r)))

    assert v(10.0, 100, 3, 2) == pytest.approx(math.sqrt(0.1))
    for case in ((10.0, 100, 1, 2), (10.0, 100, 3, 1), (10.0, 0, 3, 2), (math.nan, 100, 3, 2)):
        assert math.isnan(v(*case))


def test_corrected_shape(spark):
    x = [1.0, 2.0, 2.0, 3.0, 9.0, None]
    df = spark.createDataFrame([(v,) for v in x], "x double")
    r = df.agg(shape.skew_corrected(F.col("x")).alias("s"),
               shape.kurtosis_corrected(F.col("x")).alias("k")).first()
    import pandas as pd

    assert r["s"] == pytest.approx(pd.Series(x).skew())
    assert r["k"] == pytest.approx(pd.Series(x).kurt())
    flat = spark.createDataFrame([(2.0,)] * 5, "x double").agg(
        shape.skew_corrected(F.col("x")).alias("s"),
        shape.kurtosis_corrected(F.col("x")).alias("k")).first()
    assert flat["s"] == 0 and flat["k"] == 0


def test_bands(spark):
    assert _one(spark, shape.effect_band(F.lit(0.2))) == "large"
    assert _one(spark, shape.effect_band(F.lit(0.001))) == "negligible"
    assert _one(spark, shape.silhouette_band(F.lit(0.6))) == "reasonable"
    assert _one(spark, shape.balance_class(F.lit(0.15))) == "acceptable"


@pytest.mark.parametrize("lam", [-1.5, 0.0, 0.7, 2.0, 3.1])
def test_yeo_johnson_branches(spark, lam):
    xs = [-3.2, -0.5, 0.0, 0.4, 7.0]

    def psi(x):
        if x >= 0:
            return math.log1p(x) if lam == 0 else ((x + 1) ** lam - 1) / lam
        return -math.log1p(-x) if lam == 2 else -((1 - x) ** (2 - lam) - 1) / (2 - lam)

    df = spark.createDataFrame([(x, lam) for x in xs], "x double, l double")
    for r in df.select("x", shape.yeo_johnson_expr(F.col("x"), lam).alias("a"),
                       shape.yeo_johnson_of(F.col("x"), F.col("l")).alias("b")).collect():
        assert r["a"] == pytest.approx(psi(r["x"]))
        assert r["b"] == pytest.approx(psi(r["x"]))

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import trialframe as tf
from trialframe.operators import explore, impute, knn, missing, power, quality, reduce, screen
from trialframe.plans import moments, onepass
from trialframe.plans.quantiles import exact_quantiles
from trialframe.sources import dictionary as words
from trialframe.sources import tables

TRIAL = pd.DataFrame(
    {
        "PatientID": range(1, 11),
        "Age": [65, 70, 58, 72, 61, 67, 75, 63, 69, 66],
        "Gender": list("FMFMFMFMFM"),
        "tDCS": [0, 1, 0, 1, 0, 1, 0, 1, 0, 1],
        "Medication": [0, 0, 1, 1, 0, 0, 1, 1, 0, 0],
        "WOMAC_pain_baseline": [7.5, 8.0, 6.5, 7.0, 8.5, 7.2, 6.8, 7.7, 8.1, 7.3],
        "WOMAC_pain_6m": [None, 6.0, 5.5, 6.5, 7.0, 6.1, 5.8, 6.4, 7.2, 6.0],
        "WOMAC_function_baseline": [25.0, 30.0, 24.5, 31.5, 28.0, 27.0, 29.0, 26.0, 30.5, 28.5],
        "WOMAC_function_6m": [22.0, 27.0, 21.0, None, 25.0, 24.0, 26.0, 23.0, 28.0, 25.5],
    }
)
DICT = [
    ("PatientID", "Patient identifier"), ("Age", "Age in years"), ("Gender", "Gender (M/F)"),
    ("tDCS", "Active stimulation"), ("Medication", "Active medication"),
    ("WOMAC_pain_baseline", "Pain at baseline"), ("WOMAC_pain_6m", "Pain at 6 months"),
    ("WOMAC_function_baseline", "Function at baseline"),
    ("WOMAC_function_6m", "Function at 6 months"),
]


@pytest.fixture(scope="module")
def trial(spark):
    return tf.nan_to_null(spark.createDataFrame(TRIAL))


@pytest.fixture(scope="module")
def dictionary(spark):
    return words.from_rows(spark, DICT)


# ------------------------------------------------------------ sources


def test_load_precedence_and_errors(spark, trial, tmp_path):
    with pytest.raises(ValueError):
        tables.load_study(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        tables.load_study(spark, str(tmp_path / "absent"))
    data, d = tables.load_study(spark, str(tmp_path / "absent"), uploaded=trial)
    assert data.count() == 10 and d is None
    with pytest.raises(ValueError):
        tables.read_table(spark, str(tmp_path), "xlsx")


@pytest.mark.parametrize("fmt", ["csv", "parquet", "json", "orc"])
def test_round_trip(spark, trial, dictionary, tmp_path, fmt):
    path = str(tmp_path / "deep" / "er" / fmt)
    tables.save_table(trial, path, fmt)
    back = tables.read_table(spark, path, fmt, trial.schema)
    assert back.count() == 10
    assert sorted(back.columns) == sorted(trial.columns)
    assert back.filter("WOMAC_pain_6m is null").count() == 1


def test_load_with_dictionary_and_nan(spark, dictionary, tmp_path):
    spark.createDataFrame([(1, float("nan")), (2, 3.0)], "id int, `a.0` double").write.parquet(
        str(tmp_path / "t"))
    spark.createDataFrame([("a.0", "first", "H1")], "x string, y string, z string").write.parquet(
        str(tmp_path / "d"))
    data, d = tables.load_study(spark, str(tmp_path / "t"), str(tmp_path / "d"))
    assert data.filter("`a.0` is null").count() == 1
    assert d.columns == ["variable", "description", "z", "ord"]


def test_export_with_metadata(spark, trial, tmp_path):
    steps = spark.createDataFrame([("imputation", "method", "mean")], "step string, key string, value string")
    tables.export(trial, str(tmp_path / "out"), "csv", steps)
    assert spark.read.json(str(tmp_path / "out" / "metadata")).first()["value"] == "mean"
    assert spark.read.option("header", True).csv(str(tmp_path / "out" / "data")).count() == 10


def test_dtype_counts_and_preview(trial):
    got = {r["dtype"]: r["n_columns"] for r in tables.dtype_counts(trial).collect()}
    assert got == {"bigint": 4, "string": 1, "double": 4}
    assert tf.preview(trial, ["Age", "nope"], 3).count() == 3


def test_attach_by_key(trial):
    out = tables.attach_from(trial.select("PatientID"), trial, "PatientID", ["Age"])
    assert {r["PatientID"]: r["Age"] for r in out.collect()} == dict(
        zip(TRIAL["PatientID"], TRIAL["Age"]))


# ------------------------------------------------------------ columns and dictionary


def test_split_and_resolve(trial):
    nums, cats = tf.split_columns(trial, "PatientID")
    assert "PatientID" not in nums and cats == ["Gender"]
    assert tf.resolve_columns(trial, ["Gender", "Age", "x"]) == ["Age"]
    assert tf.resolve_columns(trial, [], "PatientID") == nums


def test_dotted_names(spark):
    df = spark.createDataFrame([(1, 2.0, None), (2, 4.0, 1.0)], "id int, `a.0` double, `a.5` double")
    got = {r["variable"]: r["mean"] for r in explore.describe_numeric(df, None, "id").collect()}
    assert got == {"a.0": 3.0, "a.5": 1.0}
    assert impute.impute(df, "mean", "id").filter("`a.5` is null").count() == 0
    assert words.drop_category(df).columns == ["id", "a.0"]
    assert reduce.pca(df.na.fill(5.0), ["a.0", "a.5"], id_col="id").samples_used == 2


def test_description_rules(spark, dictionary):
    asked = spark.createDataFrame(
        [("Age",), ("age",), ("pain_6M",), ("unknown",), ("WOMAC",)], "variable string")
    got = {r["variable"]: r["description"]
           for r in words.describe_variables(asked, dictionary).collect()}
    assert got == {"Age": "Age in years", "age": "Age in years", "pain_6M": "Pain at 6 months",
                   "unknown": None, "WOMAC": "Pain at baseline"}


def test_description_first_row_wins(spark):
    d = words.from_rows(spark, [("b.x", "one"), ("B", "two"), ("b", "three"), ("B", "four")])
    asked = spark.createDataFrame([("B",), ("b",), ("X",)], "variable string")
    got = {r["variable"]: r["description"] for r in words.describe_variables(asked, d).collect()}
    assert got == {"B": "two", "b": "three", "X": "one"}


def test_missing_report_with_descriptions(trial, dictionary):
    rows = missing.missing_report(trial, dictionary).collect()
    assert rows[0]["missing_values"] == 1 and rows[0]["percentage"] == pytest.approx(10.0)
    assert {r["variable"] for r in rows if r["missing_values"]} == {
        "WOMAC_pain_6m", "WOMAC_function_6m"}
    assert next(r for r in rows if r["variable"] == "Age")["description"] == "Age in years"


def test_categories(spark, trial, dictionary):
    v = words.variables_of(trial)
    got = words.categorize(v)
    pairs = {(r["category"], r["variable"]) for r in got.collect()}
    assert ("demographic", "Age") in pairs and ("baseline", "WOMAC_pain_baseline") in pairs
    assert ("treatment", "tDCS") in pairs and ("pain_assessment", "WOMAC_pain_6m") in pairs
    report = missing.missing_report(trial)
    held = missing.missing_by_category(got, report)
    assert {r["variable"] for r in held.collect()} == {"WOMAC_pain_6m", "WOMAC_function_6m"}
    detail = words.category_detail(got, report, dictionary)
    assert detail.filter("category = 'demographic' and variable = 'Age'").first()[
        "description"] == "Age in years"
    assert {r["variable"] for r in words.baseline_variables(v).collect()} >= {
        "Age", "Gender", "WOMAC_pain_baseline"}


def test_dictionary_summary(dictionary):
    assert words.dictionary_summary(dictionary).first()["n_rows"] == 9
    assert words.search_dictionary(dictionary, "6 MONTHS$").count() == 2


# ------------------------------------------------------------ quantiles and moments


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({
        "g": rng.choice(["a", "b", None], 5_000),
        "x": rng.normal(size=5_000), "y": np.where(rng.random(5_000) < 0.4, 7.0, rng.random(5_000)),
        "z": np.where(rng.random(5_000) < 0.3, np.nan, rng.integers(0, 4, 5_000)),
    })
    df = tf.nan_to_null(spark.createDataFrame(pdf)).repartition(7)
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    rows = exact_quantiles(df, ["x", "y", "z"], probs).collect()
    assert len(rows) == 3
    for r in rows:
        want = np.percentile(pdf[r["variable"]].dropna(), [100 * p for p in probs])
        assert r["q"] == pytest.approx(want)
    for r in exact_quantiles(df.filter("g is not null"), ["x", "z"], [0.5], ["g"]).collect():
        want = pdf[pdf["g"] == r["g"]][r["variable"]].median()
        assert r["q"][0] == pytest.approx(want)


def test_bracket_beyond_the_sketch(spark, monkeypatch):
    """Force real brackets: a coarse sketch and few cells on skewed, repetitive data."""
    from trialframe.plans import quantiles

    monkeypatch.setattr(quantiles, "ACCURACY", 50)
    monkeypatch.setattr(quantiles, "CELLS", 7)
    rng = np.random.default_rng(5)
    x = np.concatenate([np.full(6_000, 3.0), rng.exponential(size=9_000), rng.normal(50, 1, 3_000)])
    df = spark.createDataFrame(pd.DataFrame({"x": x})).repartition(5)
    probs = [0.01, 0.25, 0.5, 0.75, 0.83, 0.99]
    got = exact_quantiles(df, ["x"], probs).first()["q"]
    assert got == pytest.approx(np.percentile(x, [100 * p for p in probs]))


def test_correlations_match_pandas(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 5)) + 1e6
    x[:, 1] = x[:, 0] + rng.normal(size=400) * 0.1
    x[rng.random(x.shape) < 0.1] = np.nan
    pdf = pd.DataFrame(x, columns=list("abcde"))
    pdf["k"] = 4.0
    df = tf.nan_to_null(spark.createDataFrame(pdf))
    want = pdf.corr()
    for r in moments.correlations(df, list("abcdek")).collect():
        w = want.loc[r["var1"], r["var2"]]
        if math.isnan(w):
            assert r["r"] is None
        else:
            assert r["r"] == pytest.approx(w, abs=1e-6)


def test_wide_tables_are_cut_into_blocks(spark):
    n = onepass.BLOCK_COLUMNS * 2 + 3
    df = spark.range(4).select(*[(F.col("id") + i).alias(f"v{i}") for i in range(n)])
    got = onepass.per_variable(df, df.columns, {"m": F.avg}).collect()
    assert {r["variable"]: r["m"] for r in got} == {f"v{i}": 1.5 + i for i in range(n)}


# ------------------------------------------------------------ imputation


def test_mean_and_median(trial):
    for method, fn in (("mean", "mean"), ("median", "median")):
        out = impute.impute(trial, method, "PatientID").toPandas().sort_values("PatientID")
        for c in ("WOMAC_pain_6m", "WOMAC_function_6m"):
            assert out[c].isna().sum() == 0
            hole = TRIAL[c].isna().to_numpy()
            assert out[c].to_numpy()[hole][0] == pytest.approx(getattr(TRIAL[c], fn)(), abs=1e-3)


def test_knn_bounds_and_invalid_method(trial):
    out = impute.impute(trial, "knn", "PatientID", k=2).toPandas()
    assert out["WOMAC_pain_6m"].between(0, 10).all()
    assert out["WOMAC_function_6m"].between(0, 68).all()
    with pytest.raises(ValueError):
        impute.impute(trial, "bogus", "PatientID")
    held = impute.impute(trial, "mean", "PatientID", exclude=["WOMAC_pain_6m"])
    assert held.filter("WOMAC_pain_6m is null").count() == 1


def _knn_by_hand(x: np.ndarray, k: int) -> np.ndarray:
    m, s = np.nanmean(x, axis=0), np.nanstd(x, axis=0)
    s[s == 0] = 1
    z = (x - m) / s
    out = z.copy()
    p = x.shape[1]
    for i in range(len(z)):
        both = ~np.isnan(z[i]) & ~np.isnan(z)
        count = both.sum(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            d = np.where(count > 0, np.where(both, (z - z[i]) ** 2, 0).sum(axis=1) * p / count, np.inf)
        for j in np.flatnonzero(np.isnan(z[i])):
            ok = np.flatnonzero(~np.isnan(z[:, j]) & np.isfinite(d))
            near = ok[np.argsort(d[ok], kind="stable")][:k]
            out[i, j] = z[near, j].mean() if len(near) else 0.0
    return out * s + m


@pytest.mark.parametrize("blocks", [False, True])
def test_knn_matches_brute_force(spark, monkeypatch, blocks):
    if blocks:  # many cells, salts and slots
        monkeypatch.setattr(knn, "SAMPLE_ROWS", 120)
        monkeypatch.setattr(knn, "CELL_SAMPLE_ROWS", 6)
        monkeypatch.setattr(knn, "DONOR_BLOCK", 9)
        monkeypatch.setattr(knn, "RECEIVER_BLOCK", 4)
    rng = np.random.default_rng(11)
    x = rng.normal(size=(400, 4))
    x[:130] = x[0]  # a third of the rows are copies
    x[:, 2] += 2 * x[:, 0]
    x[rng.random(x.shape) < 0.15] = np.nan
    x[7] = np.nan
    pdf = pd.DataFrame(x, columns=list("abcd"))
    pdf["id"] = range(400)
    df = tf.nan_to_null(spark.createDataFrame(pdf)).repartition(5)
    out = impute.impute(df, "knn", "id", k=4, flags=True).toPandas().sort_values("id")
    assert out[list("abcd")].to_numpy() == pytest.approx(_knn_by_hand(x, 4), abs=1e-9)
    assert (out["a__imputed"].to_numpy() == np.isnan(x[:, 0])).all()


def test_knn_string_ids_empty_column_and_few_donors(spark):
    df = spark.createDataFrame(
        [("p", 1.0, None, None), ("q", 2.0, 5.0, None), ("r", None, None, None)],
        "id string, a double, b double, empty double")
    out = {r["id"]: r for r in impute.impute(df, "knn", "id", k=5).collect()}
    assert out["p"]["b"] == 5.0 and out["r"]["b"] == 5.0 and out["r"]["a"] == 1.5
    assert out["q"]["empty"] is None


def test_imputation_records(trial):
    after = impute.impute(trial, "mean", "PatientID", flags=True)
    cols = ["WOMAC_pain_6m", "Age"]
    got = {r["variable"]: (r["missing_before"], r["filled"], r["remaining"])
           for r in impute.imputation_summary(trial, after, cols).collect()}
    assert got == {"WOMAC_pain_6m": (1, 1, 0), "Age": (0, 0, 0)}
    assert [r["variable"] for r in impute.imputed_variables(trial, after, cols).collect()] == [
        "WOMAC_pain_6m"]
    assert impute.before_after(trial, after, cols).count() == 4
    status = impute.imputation_validation(after, ["WOMAC_pain_6m"]).collect()
    assert {r["status"]: r["n"] for r in status} == {"Original": 9, "Imputed": 1}
    test = impute.imputation_test(after, ["WOMAC_pain_6m"]).first()
    assert test["t"] is None and test["p_value"] is None  # fewer than five imputed values


def test_welch_value(spark):
    a, b = [1.0, 2, 3, 4, 5, 6], [2.0, 4, 6, 8, 10]
    rows = [("v", "a", float(x)) for x in a] + [("v", "b", float(x)) for x in b]
    r = impute.welch_t(
        spark.createDataFrame(rows, "variable string, g string, value double"), "g", "a", "b").first()
    va, vb = np.var(a, ddof=1) / 6, np.var(b, ddof=1) / 5
    assert r["t"] == pytest.approx((np.mean(a) - np.mean(b)) / math.sqrt(va + vb))
    assert r["df"] == pytest.approx((va + vb) ** 2 / (va**2 / 5 + vb**2 / 4))
    assert 0.1 < r["p_value"] < 0.2 and r["significant"] is False


# ------------------------------------------------------------ screening


def test_vif_edge_cases(spark, trial):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 3))
    pdf = pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "c": x[:, 0] + x[:, 1], "k": 1.0})
    got = {r["variable"]: r["vif"] for r in screen.vif(spark.createDataFrame(pdf)).collect()}
    assert got["a"] == math.inf and got["c"] == math.inf and got["k"] is None
    assert screen.vif(trial.select("Age")).count() == 0
    empty = spark.createDataFrame([(1.0, None), (None, 2.0)], "a double, b double")
    assert screen.vif(empty).count() == 0
    pdf["c"] = x[:, 2]
    free = {r["variable"]: r["vif"] for r in screen.vif(spark.createDataFrame(pdf[list("abc")])).collect()}
    r = np.corrcoef(pdf[list("abc")].to_numpy().T)
    assert free["a"] == pytest.approx(np.diag(np.linalg.inv(r))[0])


def test_near_zero_variance_all_null(spark):
    df = spark.createDataFrame([(1.0, None)] * 5, "a double, b double")
    got = {r["variable"]: r for r in screen.near_zero_variance(df).collect()}
    assert got["b"]["n_unique"] == 0 and got["b"]["most_common_freq"] == 1.0
    assert got["a"]["is_near_zero"] and got["a"]["most_common_freq"] == 1.0


def test_recommendation(spark):
    rng = np.random.default_rng(4)
    a = rng.normal(size=300)
    pdf = pd.DataFrame({"id": range(300), "a": a, "a2": a * 2 + rng.normal(size=300) * 0.01,
                        "k": 1.0, "free": rng.normal(size=300), "name": "x"})
    df = spark.createDataFrame(pdf)
    decisions, summary = screen.recommend_variables(df, id_col="id", force_include=["a"])
    assert screen.recommended_names(decisions) == ["a", "free", "id", "name"]
    s = summary.first()
    assert s["total_variables"] == 6 and s["near_zero_variables"] == 1
    assert s["highly_correlated_pairs"] == 1 and s["recommended_variables"] == 4
    groups = screen.recommended_by_category(decisions).collect()
    assert {r["variable"] for r in groups} == {"a", "free", "id", "name"}
    square = screen.correlation(df, ["a", "a2", "k"], square=True).collect()
    assert len(square) == 9


def test_force_include_default(spark):
    df = spark.range(1).select(F.lit(1).alias("tx.group"), F.lit(1).alias("WOMAC.Pain.Differ"),
                               F.lit(1).alias("BMI"))
    assert screen.default_force_include(df) == ["tx.group", "WOMAC.Pain.Differ"]


# ------------------------------------------------------------ quality


def test_outlier_edge_cases(spark):
    df = spark.createDataFrame([(i, 5.0, None, float(i)) for i in range(9)] + [(9, 5.0, None, 90.0)],
                               "id int, flat double, empty double, x double")
    for method, limit in (("iqr", 1.5), ("zscore", 2.5), ("modified_zscore", 3.5)):
        got = {r["variable"]: r["n_outliers"] for r in
               quality.detect_outliers(df, method, limit, None, "id").collect()}
        assert got == {"flat": 0, "x": 1}, method
        rows = quality.outlier_rows(df, "id", method, limit).collect()
        assert [(r["id"], r["variable"], r["value"]) for r in rows] == [(9, "x", 90.0)]
    with pytest.raises(ValueError):
        quality.detect_outliers(df, "other")


def test_transform_rules(spark):
    df = spark.createDataFrame([(-2.0, "a"), (0.0, "b"), (None, "c"), (7.0, "d")], "x double, s string")
    out, applied = quality.apply_transformations(df, {"x": "log", "s": "log", "nope": "sqrt"})
    assert applied.count() == 1 and applied.first()["offset"] == 3.0
    assert [r["x"] for r in out.orderBy("s").collect()] == pytest.approx(
        [0.0, math.log(3), None, math.log(10)])
    out, applied = quality.apply_transformations(df, {"x": "sqrt"})
    assert applied.first()["offset"] == pytest.approx(2.01)
    out, applied = quality.apply_transformations(df, {"x": "cube"})
    assert applied.count() == 0


def _lambda_by_hand(x):
    def psi(lam):
        pos, neg = x >= 0, x < 0
        out = np.empty_like(x)
        out[pos] = np.log1p(x[pos]) if abs(lam) < 1e-12 else ((x[pos] + 1) ** lam - 1) / lam
        out[neg] = -np.log1p(-x[neg]) if abs(lam - 2) < 1e-12 else -((1 - x[neg]) ** (2 - lam) - 1) / (2 - lam)
        return out

    def ll(lam):
        return -len(x) / 2 * np.log(psi(lam).var()) + (lam - 1) * (np.sign(x) * np.log1p(np.abs(x))).sum()

    lo, hi = -4.0, 4.0
    for _ in range(200):
        a, b = lo + (hi - lo) * 0.382, lo + (hi - lo) * 0.618
        lo, hi = (lo, b) if ll(a) > ll(b) else (a, hi)
    return (lo + hi) / 2


def test_yeo_johnson_lambda(spark):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"e": rng.exponential(size=800) * 3, "n": rng.normal(size=800) ** 3,
                        "k": 2.0})
    fit = quality.fit_yeo_johnson(spark.createDataFrame(pdf), ["e", "n", "k"])
    for c in ("e", "n"):
        assert fit[c]["lambda"] == pytest.approx(_lambda_by_hand(pdf[c].to_numpy()), abs=1e-4)
    out, _ = quality.apply_transformations(spark.createDataFrame(pdf), {"e": "yeo-johnson"})
    r = out.agg(F.avg("e").alias("m"), F.stddev_pop("e").alias("s")).first()
    assert r["m"] == pytest.approx(0, abs=1e-9) and r["s"] == pytest.approx(1)
    assert fit["k"]["lambda"] == 1.0


def test_yeo_johnson_gaps_blocks_and_overflow(spark, monkeypatch):
    from trialframe.plans import blocks

    rng = np.random.default_rng(4)
    x = rng.gamma(2.0, 3.0, size=3000) - 2
    gaps = [None if i % 7 == 0 else float(v) for i, v in enumerate(x)]
    huge = [float(v) * 1e60 for v in rng.normal(size=3000)]
    df = spark.createDataFrame(list(zip(gaps, huge, [None] * 3000, [3.0] + [None] * 2999)),
                               "g double, huge double, none double, once double").repartition(5)
    # Small blocks, and sums added level by level in Spark.
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 256)
    monkeypatch.setattr(blocks, "DRIVER_BYTES", 1)
    monkeypatch.setattr(blocks, "TASK_BYTES", 1 << 14)
    fit = quality.fit_yeo_johnson(df, ["g", "huge", "none", "once"])
    kept = np.array([v for v in gaps if v is not None])
    lam = _lambda_by_hand(kept)
    assert fit["g"]["lambda"] == pytest.approx(lam, abs=1e-4)
    y = power.transformed_values(kept, np.array([fit["g"]["lambda"]]))[0]
    assert (fit["g"]["mean"], fit["g"]["sd"]) == pytest.approx((y.mean(), y.std()))
    assert np.isfinite([fit["huge"][k] for k in ("lambda", "mean", "sd")]).all()
    assert fit["none"] == {"lambda": 1.0, "mean": None, "sd": 1.0}
    assert fit["once"] == {"lambda": 1.0, "mean": 3.0, "sd": 1.0}
    assert quality.fit_yeo_johnson(df, []) == {}


def test_scaling_edge_cases(spark):
    df = spark.createDataFrame([(1.0, 3.0, None), (1.0, 5.0, None), (1.0, None, None)],
                               "flat double, x double, empty double")
    out, details = quality.standardize(df, "zscore")
    assert [r["flat"] for r in out.collect()] == [0.0, 0.0, 0.0]
    assert {r["variable"] for r in details.collect()} == {"flat", "x"}
    out, details = quality.standardize(df, "minmax")
    assert [r["flat"] for r in out.collect()] == [1.0, 1.0, 1.0]
    assert [r["x"] for r in out.collect()] == [0.0, 1.0, None]
    out, _ = quality.standardize(df, "robust")
    assert [r["x"] for r in out.collect()] == [-1.0, 1.0, None]


def test_shapiro_sample_and_effect(spark):
    df = spark.range(20_000).select("id", (F.col("id") % 97).cast("double").alias("x"),
                                    F.lit(1.0).alias("k"))
    got = {r["variable"]: r for r in quality.shapiro(df, None, "id").collect()}
    assert got["x"]["n_tested"] == 5_000 and not got["x"]["is_normal"]
    skews, shapes = quality.transform_effect(
        df.select("id", (F.col("x") * F.col("x")).alias("x")), "x", "sqrt", 10)
    assert skews.count() == 2 and shapes.agg(F.sum("n")).first()[0] == 40_000


def test_recommendation_ladder(spark):
    rows = [("a", 0.2), ("b", 3.0), ("c", 1.5), ("d", -3.0), ("e", -1.2), ("f", 0.8),
            ("g", math.nan)]
    df = spark.createDataFrame(rows, "variable string, skewness double").withColumn(
        "is_normal", F.col("variable") == "f")
    got = {r["variable"]: r["recommendation"]
           for r in quality.recommend_transformations(df).collect()}
    assert got == {"a": "none", "b": "log", "c": "sqrt", "d": "square", "e": "square", "f": "none",
                   "g": "yeo-johnson"}
    counts = quality.recommendation_counts(quality.recommend_transformations(df))
    assert {r["recommendation"]: r["n"] for r in counts.collect()}["square"] == 2


# ------------------------------------------------------------ profiles


def test_profile_histogram_box(spark, trial):
    h = explore.histogram(trial, "Age", 5)
    assert h.agg(F.sum("n")).first()[0] == 10 and h.count() == 5
    counts, _ = np.histogram(TRIAL["Age"], 5)
    assert [r["n"] for r in h.orderBy("bin").collect()] == list(counts)
    flat = spark.createDataFrame([(1.0,)] * 3, "x double")
    assert explore.histogram(flat, "x", 4, True).agg(F.sum("n")).first()[0] == 3
    none = spark.createDataFrame([(None,)], "x double")
    assert explore.histogram(none, "x").count() == 0
    s = explore.summarize(trial, ["WOMAC_pain_6m"]).first()
    assert s["n"] == 9 and s["missing"] == 1 and s["median"] == pytest.approx(6.1)
    box = explore.box_stats(trial, ["Age"]).first()
    assert box["median"] == 66.5 and box["n_outliers"] == 0


# ------------------------------------------------------------ reduction


def test_pca_matches_numpy(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 4)) @ rng.normal(size=(4, 4)) + 100
    pdf = pd.DataFrame(x, columns=list("abcd"))
    pdf["id"] = range(300)
    pdf.loc[5, "a"] = np.nan
    fit = reduce.pca(tf.nan_to_null(spark.createDataFrame(pdf)), None, None, True, "id")
    z = pdf.dropna()[list("abcd")].to_numpy()
    z = (z - z.mean(axis=0)) / z.std(axis=0)
    values, vectors = np.linalg.eigh(np.cov(z.T))
    want = values[::-1] / values.sum()
    got = [r["explained_variance"] for r in fit.variance.orderBy("component").collect()]
    assert got == pytest.approx(want) and fit.samples_used == 299
    scores = fit.scores.toPandas().sort_values("id")
    assert np.abs(scores["PC1"].to_numpy()) == pytest.approx(np.abs(z @ vectors[:, -1]), abs=1e-8)
    load = fit.loadings.toPandas().pivot(index="variable", columns="component", values="loading")
    assert load.to_numpy().T @ load.to_numpy() == pytest.approx(np.eye(4), abs=1e-9)
    for c in load:
        assert load[c].iloc[load[c].abs().argmax()] > 0
    k = reduce.optimal_components(fit.variance, 0.75)
    assert reduce.transform(fit, k).columns == ["id", *[f"PC{i + 1}" for i in range(k)]]
    assert reduce.transform(fit, 99).columns[-1] == "PC4"
    assert reduce.optimal_components(fit.variance, 2.0) == 4
    points, arrows = reduce.biplot(fit)
    reach = scores[["PC1", "PC2"]].abs().to_numpy().max()
    tip = max(max(abs(r["x"]), abs(r["y"])) for r in arrows.collect())
    assert tip == pytest.approx(0.8 * reach)
    top = reduce.top_loadings(fit.loadings, 2, words.from_rows(spark, [("a", "first")]))
    assert top.count() == 8 and "description" in top.columns
    assert reduce.signed_loadings(fit.loadings, 1).groupBy("component").count().count() == 4


def test_pca_without_rows(spark):
    df = spark.createDataFrame([(1.0, None), (None, 2.0)], "a double, b double")
    with pytest.raises(ValueError):
        reduce.pca(df)


def test_famd_without_complete_rows(spark):
    df = spark.createDataFrame([(1.0, None, "A"), (2.0, 5.0, None), (None, 6.0, "C")],
                               "numeric_col1 double, numeric_col2 double, categorical_col1 string")
    with pytest.raises(ValueError, match="No data remaining for FAMD after removing rows with missing values."):
        reduce.famd(df)


def _mixed(n, levels, seed):
    rng = np.random.default_rng(seed)
    city = rng.integers(0, levels, n)
    effect = rng.normal(size=levels)
    return pd.DataFrame({
        "id": np.arange(n), "a": effect[city] + rng.normal(size=n), "b": rng.normal(size=n),
        "flat": 1.0, "city": [f"c{v}" for v in city],
        "size": np.where(effect[city] + rng.normal(size=n) > 0, "big", "small")})


def test_famd_by_products_equals_the_covariance_way(spark):
    df = spark.createDataFrame(_mixed(600, 12, 5)).repartition(3)
    # Beyond the third, components have equal variance here: any basis of them will do.
    want = reduce.famd(df, k=3, id_col="id")
    got = reduce.famd(df, k=3, id_col="id", covariance_levels=0)
    for a, b, keys in ((want.variance, got.variance, ["component"]),
                       (want.loadings, got.loadings, ["variable", "component"]),
                       (want.scores, got.scores, ["id"])):
        a, b = (t.toPandas().sort_values(keys).reset_index(drop=True) for t in (a, b))
        pd.testing.assert_frame_equal(a, b[a.columns], rtol=1e-6, atol=1e-7)
    with pytest.raises(ValueError, match="more than 5 levels"):
        reduce.famd(df, k=2, max_levels=5)


def test_famd_of_five_thousand_levels(spark):
    pdf = _mixed(15_000, 5_000, 8)
    fit = reduce.famd(spark.createDataFrame(pdf), ["a", "b"], ["city", "size"], 2, "id")
    p, x = pdf["city"].nunique(), pdf[["a", "b"]]
    z = (x - x.mean()) / x.std(ddof=0)
    parts = [z.to_numpy()]
    for c in ("city", "size"):
        mark = pd.get_dummies(pdf[c]).to_numpy(dtype=np.float64)
        share = mark.mean(axis=0)
        parts.append((mark - share) / np.sqrt(share))
    m = np.hstack(parts)
    v = np.random.default_rng(0).normal(size=(m.shape[1], 12))
    for _ in range(60):
        v = np.linalg.qr(m.T @ (m @ v))[0]
    top = np.linalg.eigvalsh(v.T @ (m.T @ (m @ v)))[::-1][:2] / len(pdf) / (2 + p)
    got = [r["explained_variance"] for r in fit.variance.orderBy("component").collect()]
    assert got == pytest.approx(list(top), rel=1e-6)
    one = fit.scores.toPandas()
    assert len(one) == len(pdf) and one["Dim1"].var(ddof=0) == pytest.approx(top[0] * (2 + p), rel=1e-6)


def test_famd_of_one_large_variable_keeps_its_levels_in_a_table(spark):
    df = spark.createDataFrame(_mixed(600, 12, 5)).repartition(3)
    want = reduce.famd(df, k=2, id_col="id")
    got = reduce.famd(df, k=2, id_col="id", covariance_levels=5)
    for a, b, keys in ((want.variance, got.variance, ["component"]),
                       (want.loadings, got.loadings, ["variable", "component"]),
                       (want.scores, got.scores, ["id"])):
        a, b = (t.toPandas().sort_values(keys).reset_index(drop=True) for t in (a, b))
        pd.testing.assert_frame_equal(a, b[a.columns], rtol=1e-6, atol=1e-7)


def test_famd_of_more_levels_than_the_driver_takes(spark):
    n = 210_000
    df = spark.range(2 * n).select((F.col("id") % n).cast("string").alias("part"),
                                   (F.col("id") % 7 + F.col("id") % n % 3).cast("double").alias("x"))
    i = np.arange(2 * n)
    x = (i % 7 + i % n % 3).astype(float)
    mean = (x[:n] + x[n:]) / 2
    eta = math.sqrt(2 * ((mean - x.mean()) ** 2).sum() / (2 * n * x.var()))
    got = reduce.famd(df, ["x"], ["part"], 1).variance.first()["explained_variance"]
    assert got == pytest.approx((1 + eta) / n, rel=1e-9)


def test_famd_inertia_and_coordinates(spark):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"id": range(500), "a": rng.normal(size=500), "b": rng.normal(size=500),
                        "c": rng.choice(list("xyz"), 500), "d": rng.choice(list("uv"), 500)})
    pdf["a"] += (pdf["c"] == "x") * 2
    fit = reduce.famd(spark.createDataFrame(pdf), k=10, id_col="id")
    shares = [r["explained_variance"] for r in fit.variance.orderBy("component").collect()]
    assert fit.n_components == 5 and sum(shares) == pytest.approx(1.0)
    # Eigenvalues times the inertia (2 + 2 + 1) are the squared correlations summed up.
    coords = fit.loadings.toPandas()
    for k in range(1, 6):
        mine = coords[coords["component"] == k]
        total = sum(v**2 if n in "ab" else v for n, v in zip(mine["variable"], mine["loading"]))
        assert total == pytest.approx(shares[k - 1] * 5, abs=1e-8)


def test_closer_radius_still_holds_the_nearest():
    from trialframe.operators import knn

    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 4))
    x[rng.random(x.shape) < 0.15] = np.nan
    k, cells = 5, knn.Cells(x)
    ask = x[np.isnan(x).any(axis=1) & ~np.isnan(x).all(axis=1)][:400]
    first = knn._radius2(ask, x[:200], k)
    at = cells.locate(x)
    members = [np.flatnonzero(at == c) for c in range(len(cells.low))]
    reached = cells.bounds2(ask) <= (first * (1 + 1e-9))[:, None]
    closer = knn._closer2(ask, first, x, members, reached, k)
    assert np.allclose(closer, knn._radius2(ask, x, k)) and closer.sum() < first.sum() / 2

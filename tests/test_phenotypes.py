import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import trialframe as tf
from trialframe.operators import cluster, groups, kmeans, validate, ward
from trialframe.operators import phenotype as pheno
from trialframe.operators.features import clustering_columns, prepare_features
from trialframe.plans import pipeline


def blobs(n=150, p=3, centers=3, seed=0, spread=0.3):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centers, p)) * 4
    which = rng.integers(0, centers, n)
    x = c[which] + rng.normal(size=(n, p)) * spread
    pdf = pd.DataFrame(x, columns=[f"v{i}" for i in range(p)])
    pdf.insert(0, "id", range(n))
    return pdf, which


@pytest.fixture(scope="module")
def blob(spark):
    pdf, which = blobs()
    return spark.createDataFrame(pdf).repartition(4), pdf, which


@pytest.fixture(scope="module")
def feats(blob):
    return prepare_features(blob[0], "id")


# ------------------------------------------------------------ features


def test_prepare_features(spark):
    df = spark.createDataFrame(
        [(1, 1.0, None, 5.0, "a"), (2, None, None, 5.0, "b"), (3, 3.0, None, None, "c")],
        "id int, x double, empty double, flat double, s string")
    f = prepare_features(df, "id")
    assert f.names == ["x"] and f.n == 3
    got = {r[0]: r[-1][0] for r in f.frame.collect()}
    x = np.array([1.0, 2.0, 3.0])
    want = (x - x.mean()) / x.std()
    assert [got[i] for i in (1, 2, 3)] == pytest.approx(want)
    none = prepare_features(df.select("id", "empty"), "id")
    assert none.names == []
    with pytest.raises(ValueError):
        kmeans.kmeans(none)
    assert clustering_columns(df, "id") == ["x", "empty", "flat"]


# ------------------------------------------------------------ k-means


def test_kmeans_finds_blobs_and_counts(feats, blob):
    frame, models = kmeans.kmeans(feats, [2, 3, 500], n_init=5)
    assert sorted(models) == [2, 3]
    assert models[3].inertia < models[2].inertia
    got = frame.select("id", "kmeans_3").toPandas().sort_values("id")["kmeans_3"].to_numpy()
    assert len(set(zip(got, blob[2]))) == 3  # the labels are the blobs, renamed
    assert models[3].sizes.sum() == 150


def test_models_of_every_world_are_settled(feats):
    wanted = [
        (3, kmeans.World()),
        (2, kmeans.World("bootstrap", 1, 0.8)),
        (2, kmeans.World("uniform", 0, 1.0, ((-1.0, 1.0),) * 3)),
    ]
    rows = feats.frame.select(kmeans.row_hash("id", 42).alias("h"), "x").collect()
    h, x = np.array([r["h"] for r in rows]), np.array([r["x"] for r in rows])
    for m in kmeans.fit_models(feats, wanted, 2):
        seen, w = kmeans._view(m.world, x, h)
        w = np.ones(len(seen)) if w is None else w
        d = ((seen[:, None, :] - m.centers[None]) ** 2).sum(axis=2)
        near = d.argmin(axis=1)
        assert m.inertia == pytest.approx((d.min(axis=1) * w).sum())
        assert m.sizes == pytest.approx(np.bincount(near, w, m.k))
        means = np.array([np.average(seen[near == c], axis=0, weights=w[near == c]) for c in range(m.k)])
        assert np.abs(means - m.centers).max() < 0.02


def test_seeds_come_from_all_rows(spark):
    """A far group of three rows among thousands is a seed, wherever it lies; few distinct rows do."""
    df = spark.range(6_000).select("id", F.when(F.col("id") % 2_000 == 7, 1e6).otherwise(
        F.col("id") % 10).cast("double").alias("x"))
    _, models = kmeans.kmeans(prepare_features(df, "id", ["x"]), [2], n_init=1)
    assert sorted(models[2].sizes) == [3, 5_997]
    flat = spark.range(40).select("id", (F.col("id") % 2).cast("double").alias("x"))
    _, models = kmeans.kmeans(prepare_features(flat, "id", ["x"]), [2, 5], n_init=2)
    assert models[2].inertia == pytest.approx(0) and models[5].sizes.sum() == 40


def test_hash_draws():
    h = np.arange(200_000, dtype="int64") * 7_919
    u = kmeans.unit(h, 3)
    assert 0 <= u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.005
    assert abs(np.corrcoef(u, kmeans.unit(h, 4))[0, 1]) < 0.01
    w = kmeans.poisson_weights(h, 0, 0.8)
    assert abs(w.mean() - 0.8) < 0.01 and abs(w.var() - 0.8) < 0.02


def test_centers_table(spark, feats):
    _, models = kmeans.kmeans(feats, [2], n_init=2)
    assert kmeans.centers_table(feats.frame, feats, models).count() == 2 * 3


# ------------------------------------------------------------ Ward


def ward_by_hand(x, k):
    groups_ = [[i] for i in range(len(x))]
    while len(groups_) > k:
        best = None
        for a, b in itertools.combinations(range(len(groups_)), 2):
            ca, cb = x[groups_[a]].mean(axis=0), x[groups_[b]].mean(axis=0)
            na, nb = len(groups_[a]), len(groups_[b])
            cost = na * nb / (na + nb) * ((ca - cb) ** 2).sum()
            if best is None or cost < best[0]:
                best = (cost, a, b)
        _, a, b = best
        groups_[a] += groups_.pop(b)
    return {frozenset(g) for g in groups_}


@pytest.mark.parametrize("driver", [1_000, 8])
def test_ward_matches_sequential_merging(spark, driver):
    pdf, _ = blobs(60, 2, 4, seed=3, spread=1.5)
    pdf.loc[40:, ["v0", "v1"]] = pdf.loc[:19, ["v0", "v1"]].to_numpy()  # copies
    f = prepare_features(spark.createDataFrame(pdf).repartition(3), "id")
    out = ward.ward(f, [1, 2, 3, 5, 9], driver_clusters=driver, block_rows=13)
    got = out.toPandas().sort_values("id")
    x = np.array(got["x"].tolist())
    for k in (1, 2, 3, 5, 9):
        labels = got[f"agglomerative_{k}"].to_numpy()
        mine = {frozenset(np.flatnonzero(labels == c)) for c in set(labels)}
        assert mine == ward_by_hand(x, k), k
        assert set(labels) == set(range(k))


@pytest.mark.parametrize("p,cells", [(2, 7), (2, 20), (3, 16), (1, 5), (20, 12)])
def test_ward_cells_give_the_same_tree(spark, p, cells):
    """Cells with walls, pair rounds in between, and the last cell without walls."""
    pdf, _ = blobs(70, p, 5, seed=p, spread=1.2)
    f = prepare_features(spark.createDataFrame(pdf).repartition(3), "id")
    out = ward.ward(f, [1, 2, 4, 7, 15, 40], driver_clusters=2, block_rows=30, cell_clusters=cells)
    got = out.toPandas().sort_values("id")
    x = np.array(got["x"].tolist())
    for k in (1, 2, 4, 7, 15, 40):
        labels = got[f"agglomerative_{k}"].to_numpy()
        assert {frozenset(np.flatnonzero(labels == c)) for c in set(labels)} == ward_by_hand(x, k), k


@pytest.mark.parametrize("p,leaf", [(2, 9), (4, 6), (20, 8)])
def test_ward_leaves_find_the_nearest_of_all(spark, p, leaf):
    """Searches in the own leaf and in those that may hold a cheaper one; with many dimensions all pairs."""
    pdf, _ = blobs(90, p, 5, seed=p, spread=1.2)
    f = prepare_features(spark.createDataFrame(pdf).repartition(3), "id")
    clusters = f.frame.select(F.col("id").cast("long").alias("cid"), (F.col("id") % 4 + 1).cast("double").alias("n"),
                              "x", (F.col("id") % 3 > 0).alias("fresh")).cache()
    want = {tuple(r) for r in ward._nearest(clusters, 90, p, 30).select("cid", "lo", "hi").collect()}
    found = ward._nearest_by_leaf(clusters, 90, p, leaf, 0)
    assert found is not None or p == 20
    if found is not None:
        assert {tuple(r) for r in found.select("cid", "lo", "hi").collect()} == want and len(want) == 60
    out = ward.ward(f, [2, 5, 15], driver_clusters=2, block_rows=30, cell_clusters=5, leaf_clusters=leaf)
    got = out.toPandas().sort_values("id")
    x = np.array(got["x"].tolist())
    for k in (2, 5, 15):
        labels = got[f"agglomerative_{k}"].to_numpy()
        assert {frozenset(np.flatnonzero(labels == c)) for c in set(labels)} == ward_by_hand(x, k), k


def test_ward_cuts_between_far_groups(spark, monkeypatch):
    """No cell or leaf holds rows of two far groups, and cells that lie apart give the same tree."""
    rng = np.random.default_rng(6)
    group = np.repeat(np.arange(10), 12)
    x = np.eye(10)[group] * 5 + rng.normal(0, 0.05, (120, 10))
    one, wide = ward._gap(rng.random((300, 3))), ward._gap(x)
    assert one is None and abs(wide[1] - 2.5) < 0.5
    monkeypatch.setattr(ward, "GAP_CLUSTERS", 8)
    leaf = ward._split(x, 120, 40, 0.5).of(x)
    assert all(len(set(group[leaf == c])) == 1 for c in set(leaf)) and len(set(leaf)) >= 10
    pdf = pd.DataFrame({"id": range(120)} | {f"v{i}": x[:, i] for i in range(10)})
    f = prepare_features(spark.createDataFrame(pdf).repartition(3), "id")
    out = ward.ward(f, [2, 10, 13], driver_clusters=8, block_rows=50, cell_clusters=40, leaf_clusters=20)
    got = out.toPandas().sort_values("id")
    z = np.array(got["x"].tolist())
    for k in (2, 10, 13):
        labels = got[f"agglomerative_{k}"].to_numpy()
        assert {frozenset(np.flatnonzero(labels == c)) for c in set(labels)} == ward_by_hand(z, k), k


def test_blocks_of_a_larger_table_stay_few():
    from trialframe.plans.blockpairs import BLOCKS, count_blocks

    assert [count_blocks(n, 2_048, 800) for n in (1, 2_048, 5_000)] == [1, 1, 3]
    assert count_blocks(100_000, 2_048, 800) == count_blocks(1_000_000, 2_048, 800) == BLOCKS
    assert count_blocks(10_000_000, 2_048, 800) == 120  # no more than 64 MB of rows


def test_ward_rounds_keep_plans_small(spark):
    """The size that Spark expects of a round's tables does not grow from round to round."""
    rng = np.random.default_rng(6)
    rows = [(i, 1.0, 0.0, rng.random(3).tolist()) for i in range(150)]
    clusters, near = spark.createDataFrame(rows, "cid long, n double, h double, x array<double>"), None
    for _ in range(5):
        clusters, _, near, _ = ward._pair_round(clusters, near, 150, 3, 64)
    for t in (clusters, near):
        size = t._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
        assert int(str(size)) < 1 << 40
    assert clusters.agg(F.sum("n")).first()[0] == 150


def test_ward_cell_leaves_what_walls_may_hide():
    """Merges of a cell are merges of the whole, and a wall right beside a point blocks it."""
    rng = np.random.default_rng(8)
    x = rng.random((300, 2))
    ids, one = np.arange(300), np.ones(300)
    low, high = np.array([-np.inf, -np.inf]), np.array([0.5, np.inf])
    inside = x[:, 0] < 0.5
    open_, none = np.full(2, -np.inf), np.full(2, np.inf)
    whole, _ = ward._merge_inside(ids, one, one * 0, x, open_, none, 1.0)
    part, left = ward._merge_inside(ids[inside], one[inside], one[inside] * 0, x[inside], low, high, 1.0)
    assert len(whole) == 299 and {m[:2] for m in part} <= {m[:2] for m in whole}
    assert 0.2 < len(part) / inside.sum() < 1 and len(left[0]) + len(part) == inside.sum()
    assert left[1].sum() == inside.sum()


def test_ward_cut_inside_spark_rounds(spark):
    """Two far pairs merge in the first round at a cost above later merges."""
    line = np.random.default_rng(4).random(30)
    rows = [(i, float(v)) for i, v in enumerate(line)] + [(30, 500.0), (31, 540.0)]
    f = prepare_features(spark.createDataFrame(rows, "id int, v double"), "id")
    out = ward.ward(f, [2, 3, 4], driver_clusters=3, block_rows=8).toPandas().sort_values("id")
    x = np.array(out["x"].tolist())
    for k in (2, 3, 4):
        labels = out[f"agglomerative_{k}"].to_numpy()
        mine = {frozenset(np.flatnonzero(labels == c)) for c in set(labels)}
        assert mine == ward_by_hand(x, k), k


# ------------------------------------------------------------ validation


def silhouette_by_hand(x, labels):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    out = []
    for i in range(len(x)):
        own = labels == labels[i]
        if own.sum() == 1:
            out.append(0.0)
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, labels == c].mean() for c in set(labels) - {labels[i]})
        out.append((b - a) / max(a, b))
    return np.mean(out)


def labelled_frame(spark):
    pdf, which = blobs(90, 2, 3, seed=5, spread=2.0)
    x = pdf[["v0", "v1"]].to_numpy()
    x[60:] = x[0]
    single = np.zeros(90, dtype=int)
    single[7] = 4
    rows = [(int(i), [float(v) for v in x[i]], int(which[i]), int(single[i]), 1) for i in range(90)]
    df = spark.createDataFrame(rows, "id int, x array<double>, a_3 int, b_2 int, c_1 int")
    return df.repartition(4), x, which, single


def test_silhouette_blocks_copies_and_single_cluster(spark):
    df, x, which, single = labelled_frame(spark)
    rows = validate.silhouette(df, ["a_3", "b_2", "c_1"], "id", 2, block_rows=11).collect()
    got = {r["labeling"]: r["silhouette"] for r in rows}
    assert got["a_3"] == pytest.approx(silhouette_by_hand(x, which), abs=1e-6)
    assert got["b_2"] == pytest.approx(silhouette_by_hand(x, single), abs=1e-6)
    assert math.isnan(got["c_1"])
    with pytest.raises(ValueError):
        validate.silhouette(df, ["a_3"], "id", 2, "cosine")


def test_calinski_and_within(spark):
    df, x, which, _ = labelled_frame(spark)
    w = sum(((x[which == c] - x[which == c].mean(axis=0)) ** 2).sum() for c in set(which))
    b = sum((which == c).sum() * ((x[which == c].mean(axis=0) - x.mean(axis=0)) ** 2).sum()
            for c in set(which))
    got = {r["labeling"]: r["within_ss"] for r in validate.within_ss(df, ["a_3", "c_1"], 2).collect()}
    assert got["a_3"] == pytest.approx(w)
    ch = {r["labeling"]: r["calinski"] for r in validate.calinski_harabasz(df, ["a_3", "c_1"], 2).collect()}
    assert ch["a_3"] == pytest.approx((b / 2) / (w / 87)) and math.isnan(ch["c_1"])


def jaccard_by_hand(a, b):
    both = either = 0
    for i, j in itertools.combinations(range(len(a)), 2):
        s, t = a[i] == a[j], b[i] == b[j]
        both += s and t
        either += s or t
    return both / either if either else 0.0


def test_jaccard(spark):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 3, 60), rng.integers(0, 4, 60)
    df = spark.createDataFrame([(int(i), int(j)) for i, j in zip(a, b)] + [(1, None)], "a int, b int")
    assert validate.jaccard(df, "a", "b").first()["jaccard"] == pytest.approx(jaccard_by_hand(a, b))
    alone = spark.createDataFrame([(1, 2), (2, 3)], "a int, b int")
    assert validate.jaccard(alone, "a", "b").first()["jaccard"] == 0.0


def test_bootstrap_is_stable_on_blobs(feats):
    r = validate.bootstrap_stability(feats, "kmeans", 3, 12, n_init=3).first()
    assert r["n_pairs"] == 66 and r["mean_jaccard"] > 0.95 and r["is_stable"]
    again = validate.bootstrap_stability(feats, "kmeans", 3, 12, n_init=3).first()
    assert again["mean_jaccard"] == r["mean_jaccard"]
    with pytest.raises(ValueError):
        validate.bootstrap_stability(feats, "other", 3, 2)


@pytest.mark.parametrize("method", ["agglomerative", "gmm"])
def test_bootstrap_other_methods(feats, method):
    r = validate.bootstrap_stability(feats, method, 3, 3).first()
    assert r["n_pairs"] == 3 and r["mean_jaccard"] > 0.4


def test_contingency_equals_pair_loops(spark):
    rng = np.random.default_rng(3)
    l = rng.integers(-1, 3, size=(40, 4))
    df = spark.createDataFrame([([int(v) for v in r],) for r in l], "l array<int>").repartition(3)
    got = validate._pair_jaccard(validate._contingency(df, 4, 3), 4, 3)
    want = []
    for i, j in itertools.combinations(range(4), 2):
        ok = (l[:, i] >= 0) & (l[:, j] >= 0)
        want.append(jaccard_by_hand(l[ok, i], l[ok, j]))
    assert got == pytest.approx(want)


def test_gap(spark, feats):
    table, k = validate.gap_statistic(feats, range(2, 6), 4, 3)
    rows = table.orderBy("k").collect()
    assert [r["k"] for r in rows] == [2, 3, 4, 5] and k == 3
    assert sum(r["is_optimal"] for r in rows) == 1
    boxed, _ = validate.gap_statistic(feats, [2, 3], 3, 2, box="feature")
    assert boxed.count() == 2
    fallback = validate.gap_rule(spark.createDataFrame(
        [(2, 0.1, 0.01), (3, 0.3, 0.01), (4, 0.6, 0.01)], "k int, gap double, s double"))
    assert fallback.filter("is_optimal").first()["k"] == 2


def test_optimal_k(spark):
    m = spark.createDataFrame(
        [("kmeans", 2, 0.5, 40), ("kmeans", 3, 0.9, 4), ("kmeans", 4, 0.5, 20), ("gmm", 2, 0.3, 1),
         ("gmm", 3, math.nan, 30)],
        "method string, k int, silhouette double, min_size int")
    got = {r["method"]: r for r in validate.optimal_k(m, 10).collect()}
    assert got["kmeans"]["optimal_k"] == 2 and got["kmeans"]["valid_k"] == [2, 4]
    assert got["gmm"]["optimal_k"] is None and got["gmm"]["valid_k"] == [3]
    best = cluster.best_configuration(m).first()
    assert (best["method"], best["k"]) == ("kmeans", 3)
    assert cluster.silhouette_pivot(m).count() == 3


def test_gmm(feats):
    frame, criteria = cluster.gmm(feats, [2, 3])
    rows = frame.select("gmm_3", "gmm_3_probability").collect()
    for r in rows:
        assert sum(r["gmm_3_probability"]) == pytest.approx(1.0)
        assert int(np.argmax(r["gmm_3_probability"])) == r["gmm_3"]
    for r in criteria.collect():
        free = r["k"] * 3 + r["k"] * 6 + r["k"] - 1
        assert r["aic"] == pytest.approx(-2 * r["log_likelihood"] + 2 * free)
        assert r["bic"] == pytest.approx(-2 * r["log_likelihood"] + free * math.log(150))


def test_unknown_method(feats):
    with pytest.raises(ValueError):
        cluster.cluster(feats, "dbscan")


# ------------------------------------------------------------ groups


def test_treatment_columns(spark):
    assert groups.treatment_column(["a", "TX.Group", "tx.group"]) == "tx.group"
    assert groups.treatment_column(["a", "Treatment"]) == "Treatment"
    assert groups.treatment_column(["a"]) is None
    df = spark.createDataFrame([(0,), (1,), (2,), (3,), (9,)], "`tx.group` int")
    got = {r[0]: (r["treatment_group"], r["has_tdcs"], r["has_meditation"])
           for r in groups.with_treatment(df).collect()}
    assert got[1] == ("tDCS + Meditation", 1, 1) and got[9] == (None, 0, 0)
    with pytest.raises(ValueError):
        groups.with_treatment(df.toDF("x"))


def test_factorial_groups(spark):
    df = spark.createDataFrame([(0, 0), (1, 0), (0, 1), (1, 1), (None, 1)], "tDCS int, Medication int")
    out = groups.factorial_groups(df, "tDCS", "Medication", "tDCS", "Medication").collect()
    assert [r["treatment_group"] for r in out] == [
        "Control", "tDCS Only", "Medication Only", "tDCS + Medication", None]


def test_anova_and_smd_edges(spark):
    df = spark.createDataFrame(
        [("a", 1.0, 5.0, None), ("a", 1.0, 6.0, None), ("b", 1.0, 8.0, 2.0), ("b", 1.0, None, 3.0)],
        "g string, flat double, x double, half double")
    got = {r["variable"]: r for r in groups.anova(df, ["flat", "x", "half"], "g").collect()}
    assert got["flat"]["f_statistic"] is None and got["flat"]["eta_squared"] == 0.0
    assert got["half"]["f_statistic"] is None and got["half"]["n_groups"] == 1
    assert got["x"]["f_statistic"] == pytest.approx((2 / 3 * 2.5**2) / 0.5)
    smd = {r["variable"]: r for r in groups.smd_balance(df, ["flat", "x", "half"], "g", "a").collect()}
    assert smd["flat"]["smd"] == 0.0 and smd["flat"]["assessment"] == "good"
    assert "half" not in smd  # the reference group has no value
    other = {r["variable"]: r for r in groups.smd_balance(df, ["half"], "g", "b").collect()}
    assert other["half"]["smd"] is None and other["half"]["assessment"] is None


def test_baseline_table_absent_values(spark):
    df = spark.createDataFrame(
        [("a", 1.0, "x"), ("a", 2.0, "y"), ("b", None, None)], "g string, v double, c string")
    got = {r["variable"]: r for r in groups.baseline_table(df, ["v", "c", "nope"], "g").collect()}
    assert got["v"]["a"] == "1.50 ± 0.71" and got["v"]["b"] == "nan ± nan"
    assert got["c"]["a"] == "x (50.0%)" and got["c"]["b"] == "N/A"


# ------------------------------------------------------------ characterization


def test_characterize_cases(spark):
    # The fixture of the contract.
    df = spark.createDataFrame(pd.DataFrame({
        "ID": range(12),
        "Age": [25, 30, 28, 45, 50, 48, 60, 65, 62, 20, 40, 55],
        "Severity": ["Mild", "Moderate", "Mild", "Severe", "Moderate", "Severe", "Mild", "Severe",
                     "Moderate", "Mild", "Moderate", "Severe"],
        "Outcome": [100, 150, 120, 200, 250, 220, 90, 180, 160, 110, 240, 190]}))
    labels = spark.createDataFrame(
        list(zip(range(12), [0, 0, 0, 1, 1, 1, 2, 2, 2, 0, 1, 2])), "ID long, Cluster int")
    out = pheno.characterize_labels(df, labels, "ID", ["Age", "Severity", "Outcome", "Absent"])
    assert out.columns == ["Variable", "TestType", "Statistic", "PValue", "CorrectedPValue",
                           "RejectNullFDR", "EffectSize"]
    got = {r["Variable"]: r for r in out.collect()}
    assert got["Age"]["TestType"] == "ANOVA" and got["Age"]["PValue"] < 0.05
    assert got["Severity"]["TestType"] == "Chi-Square" and 0 <= got["Severity"]["EffectSize"] <= 1
    assert got["Absent"]["TestType"] == "Error_VariableNotFoundInSource"
    assert math.isnan(got["Absent"]["PValue"]) and got["Absent"]["RejectNullFDR"] is None
    assert got["Age"]["CorrectedPValue"] >= got["Age"]["PValue"]
    assert pheno.characterize(df.limit(0).withColumn("Cluster", F.lit(1)), "Cluster", ["Age"]).count() == 0
    assert pheno.characterize(df, "Cluster", ["Age"]).count() == 0
    none = pheno.characterize(df.withColumn("Cluster", F.lit(1)), "Cluster", [])
    assert none.count() == 0 and none.columns == out.columns


@pytest.mark.parametrize("rows, schema, kind", [
    ([(1.0, 0), (2.0, 0), (3.0, 0)], "v double, Cluster int", "InsufficientClusters"),
    ([(10.0, 0), (None, 0), (20.0, 1), (21.0, 1)], "v double, Cluster int", "ANOVA_NotEnoughGroups"),
    ([(10.0, 0), (11.0, 0), (None, 1), (None, 1)], "v double, Cluster int", "ANOVA_NotEnoughGroups"),
    ([("A", 0), ("A", 0), ("A", 1)], "v string, Cluster int", "ChiSquare_SmallTable"),
    ([("A", 0), ("B", 0), ("C", 0)], "v string, Cluster int", "InsufficientClusters"),
])
def test_untestable(spark, rows, schema, kind):
    r = pheno.compare_variable(spark.createDataFrame(rows, schema), "v").first()
    assert r["TestType"] == kind and math.isnan(r["PValue"])


def test_single_value_cluster_is_left_out(spark):
    rows = [(float(x), 0) for x in (1, 2, 3, 4, 5)] + [(float(x), 1) for x in (6, 7, 8, 9, 10)]
    schema = "v double, Cluster int"
    want = pheno.compare_variable(spark.createDataFrame(rows, schema), "v").first()
    got = pheno.compare_variable(spark.createDataFrame(rows + [(99.0, 2)], schema), "v").first()
    assert got == want and got["TestType"] == "ANOVA" and got["Statistic"] == pytest.approx(25.0)


def test_equal_means_but_for_rounding(spark):
    rows = [(x, c) for c in range(3) for x in ((0.1, 0.2, 0.3) if c % 2 else (0.3, 0.1, 0.2))]
    r = pheno.compare_variable(spark.createDataFrame(rows, "v double, Cluster int"), "v").first()
    assert r["TestType"] == "ANOVA_NoVarianceOrSameMean" and r["PValue"] == 1.0


def test_no_variance(spark):
    df = spark.createDataFrame([(10.0, i // 3) for i in range(6)], "v double, Cluster int")
    r = pheno.compare_variable(df, "v").first()
    assert (r["TestType"], r["PValue"], r["Statistic"], r["EffectSize"]) == (
        "ANOVA_NoVarianceOrSameMean", 1.0, 0.0, 0.0)


def test_numeric_and_categorical_fixture(spark):
    # The fixture of the contract.
    cl = [0, 0, 0, 1, 1, 1, 2, 2, 2, 0, 1, 2]
    df = spark.createDataFrame(
        list(zip([10, 12, 11, 20, 22, 21, 30, 32, 31, 15, 25, 35], ["A", "B", "A", "B", "A", "B", "C", "A", "C", "B", "C", "A"], cl)),
        "NumericVar long, CategoricalVar string, Cluster int")
    r = pheno.compare_variable(df, "NumericVar").first()
    assert r["TestType"] == "ANOVA" and r["PValue"] < 0.05 and 0 <= r["EffectSize"] <= 1
    r = pheno.compare_variable(df, "CategoricalVar").first()
    t = pd.crosstab(pd.Series(["A", "B", "A", "B", "A", "B", "C", "A", "C", "B", "C", "A"]), pd.Series(cl)).to_numpy()
    e = t.sum(1, keepdims=True) * t.sum(0, keepdims=True) / 12
    assert r["Statistic"] == pytest.approx(((t - e) ** 2 / e).sum())


def test_benjamini_hochberg(spark):
    p = [0.01, 0.04, 0.03, 0.005, None, 0.2]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(p)], "i int, p_value double")
    got = {r["i"]: r["corrected_p"] for r in pheno.benjamini_hochberg(df).collect()}
    assert got == pytest.approx({0: 0.025, 1: 0.05, 2: 0.05, 3: 0.025, 4: None, 5: 0.2})


# ------------------------------------------------------------ phenotypes


def test_profiles_and_assignments(spark, feats, blob):
    frame, _ = kmeans.kmeans(feats, [3], n_init=3)
    wide = pheno.phenotype_profile_wide(frame, "kmeans_3", feats.names).toPandas()
    assert wide["N_Samples"].sum() == 150 and len(wide.columns) == 2 + 2 * 3
    comparison = pheno.compare_phenotypes(frame, "kmeans_3", feats.names)
    assert pheno.count_significant(comparison).first()["n_significant"] >= 1
    out = pheno.assignments(frame, "kmeans", 3, feats.names, "id", {1: "Middle"})
    names = {r["Phenotype"]: r["Phenotype_Name"] for r in out.collect()}
    assert names == {0: "Phenotype_1", 1: "Middle", 2: "Phenotype_3"}
    with pytest.raises(ValueError):
        pheno.assignments(frame, "gmm", 3, feats.names, "id")
    points = pheno.cluster_scatter(feats, frame, "kmeans_3")
    assert points.columns == ["id", "kmeans_3", "PC1", "PC2"] and points.count() == 150
    z = pheno.zscore_profile(frame, "kmeans_3", feats.names, 2)
    assert z.count() == 6
    pdf = blob[1].set_index("id")
    lab = frame.select("id", "kmeans_3").toPandas().set_index("id")["kmeans_3"]
    for r in z.collect():
        v = pdf[r["variable"]]
        assert r["z"] == pytest.approx((v[lab == r["phenotype"]].mean() - v.mean()) / v.std())


# ------------------------------------------------------------ workflows


def test_prepare_and_report(spark, tmp_path):
    rng = np.random.default_rng(0)
    a = rng.normal(size=120)
    pdf = pd.DataFrame({"ID": range(120), "a": a, "twin": a + rng.normal(size=120) * 0.01,
                        "b": rng.exponential(size=120) ** 2, "c": rng.normal(size=120), "k": 1.0})
    pdf.loc[::7, "b"] = np.nan
    df = tf.nan_to_null(spark.createDataFrame(pdf))
    config = tf.PrepConfig("ID", knn_neighbors=3, apply_transformations=True,
                           standardize_variables=True)
    out, results = tf.prepare(df, config)
    assert "twin" not in out.columns and "k" not in out.columns and "ID" in out.columns
    assert out.filter("b is null").count() == 0 and out.count() == 120
    summary = {r["step"]: r["completed"] for r in pipeline.steps_summary(results["steps"]).collect()}
    assert all(summary.values()) and len(summary) == 6
    report = pipeline.pipeline_report(df, out, results["steps"])
    assert report.filter("metric = 'column_reduction_pct'").first()["value"] is not None
    assert pipeline.report_statistics(out, "ID").count() == len(out.columns) - 1
    assert results["imputation"].filter("variable = 'b'").first()["filled"] == 18


def test_prepare_with_reduction(spark):
    pdf, _ = blobs(80, 4, 3, seed=2, spread=1.0)
    df = spark.createDataFrame(pdf)
    out, results = tf.prepare(df, tf.PrepConfig(
        "id", impute_method="mean", screen_variables=False, apply_reduction=True))
    assert out.columns[0] == "id" and out.columns[1] == "PC1" and out.count() == 80
    with pytest.raises(ValueError):
        tf.prepare(df, tf.PrepConfig("id", "mean", screen_variables=False, reduction_method="x"))


def test_discover(spark, blob):
    found = tf.discover(blob[0], "id", methods=("kmeans", "agglomerative"), ks=range(2, 5), n_init=3)
    assert found.k in (2, 3) and found.method in ("kmeans", "agglomerative")
    assert found.assignments.count() == 150
    assert found.metrics.count() == 6
    assert found.profile.count() == 3 * found.k
    fast = tf.discover(blob[0], "id", ks=[2, 3], n_init=2, metric="sqeuclidean")
    assert fast.k in (2, 3)
    with pytest.raises(ValueError):
        tf.discover(blob[0], "id", ks=[2], n_init=1, min_cluster_size=1_000)


# ------------------------------------------------------------ contract


def test_entry_and_registry(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).count() == 4
    queries, sql = contract.queries(), contract.oracle_sql()
    assert set(sql) <= set(queries)


# ------------------------------------------------------------ work in tiles and tasks


@pytest.mark.parametrize("tile", [(3, 5), (64, 16), (256, 512)])
def test_silhouette_by_tiles(spark, monkeypatch, tile):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(90, 3))
    x[80:] = x[:10]
    label = rng.integers(0, 4, 90)
    other = [None if i % 7 == 0 else int(i % 3) for i in range(90)]
    df = spark.createDataFrame(
        [(i, x[i].tolist(), int(label[i]), other[i]) for i in range(90)],
        "id long, x array<double>, a int, b int")
    monkeypatch.setattr(validate, "TILE", tile)
    found = {r["labeling"]: r["silhouette"]
             for r in validate.silhouette(df, ["a", "b"], "id", 3, block_rows=40).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    for name, l in (("a", label), ("b", np.array([-1 if v is None else v for v in other]))):
        scores = []
        for i in np.flatnonzero(l >= 0):
            mean = {c: d[i, (l == c)].sum() / ((l == c).sum() - (c == l[i])) for c in set(l) - {-1}}
            near = min(v for c, v in mean.items() if c != l[i])
            scores.append((near - mean[l[i]]) / max(near, mean[l[i]]))
        assert math.isclose(found[name], sum(scores) / 90, abs_tol=1e-7)  # rows without a label count as 0


def test_kmeans_rows_are_dealt_out_by_work(spark, monkeypatch):
    """One partition of few bytes but many distances is worked by several tasks, every row once."""
    from trialframe.plans import blocks

    pdf, _ = blobs(600, 2, 4, seed=3)
    feats = prepare_features(spark.createDataFrame(pdf).coalesce(1), "id")
    monkeypatch.setattr(blocks, "TASK_CELLS", 500)
    packed = kmeans.packed(feats, 1, centers=10)
    assert packed.tasks == min(12, spark.sparkContext.defaultParallelism) > 1
    found = packed.reduce(lambda data: np.sum([[len(h), *x.sum(axis=0)] for h, x in data] or [[0, 0, 0]], axis=0), size=3)
    packed.release()
    assert np.allclose(found, [600, 0, 0], atol=1e-8)


@pytest.mark.parametrize("weighted", [False, True])
def test_kmeans_step(weighted):
    rng = np.random.default_rng(4)
    x, centers = rng.normal(size=(50, 3)), rng.normal(size=(2, 4, 3))
    centers[1, 2] = centers[1, 0]  # of equal centers the first one counts
    w = rng.integers(0, 3, 50).astype(float) if weighted else np.ones(50)
    weight, cost, total = kmeans._step(x, w if weighted else None, centers)
    for m in range(2):
        d = ((x[:, None] - centers[m][None]) ** 2).sum(axis=2)
        near = d.argmin(axis=1)
        for c in range(4):
            own = near == c
            assert math.isclose(weight[4 * m + c], w[own].sum())
            assert math.isclose(cost[4 * m + c], (w * d.min(axis=1))[own].sum(), abs_tol=1e-9)
            assert np.allclose(total[4 * m + c], (w[:, None] * x)[own].sum(axis=0))

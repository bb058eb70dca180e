"""Gaussian mixtures against plain expectation-maximisation, and the packed rows they read."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialframe.operators import cluster, kmeans, mixture, validate
from trialframe.operators.features import prepare_features
from trialframe.plans import blocks


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(11)
    shapes = [np.array([[1.0, 0.6], [0.6, 0.8]]), np.array([[0.3, -0.2], [-0.2, 0.9]]), np.eye(2) * 0.2]
    x = np.concatenate([rng.multivariate_normal(m, s, n) for m, s, n in zip(
        ([0, 0], [4, 1], [1, 5]), shapes, (150, 100, 60))])
    return x


@pytest.fixture(scope="module")
def feats(spark, cloud):
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(cloud)], "id long, a double, b double")
    return prepare_features(df.repartition(5), "id", ["a", "b"])


def rows_of(feats):
    rows = feats.frame.select(kmeans.row_hash("id", 42).alias("h"), "x").collect()
    return np.array([r["h"] for r in rows]), np.array([r["x"] for r in rows])


def plain_em(x, w, means, hard, steps, ridge):
    """(weights, means, covariances, log-likelihood) after some steps from hard labels."""
    n, p = x.shape
    r = np.eye(len(means))[hard]
    for step in range(steps + 2):
        if step:
            logs = np.stack([
                math.log(a) - 0.5 * (p * math.log(2 * math.pi) + np.linalg.slogdet(s)[1]
                                     + np.einsum("ni,ij,nj->n", x - m, np.linalg.inv(s), x - m))
                for a, m, s in zip(weights, means, covs)], axis=1)
            top = logs.max(1, keepdims=True)
            ll = top[:, 0] + np.log(np.exp(logs - top).sum(1))
            r = np.exp(logs - ll[:, None])
            if step == steps + 1:
                return weights, means, covs, (ll * w).sum()
        rw = r * w[:, None]
        size = rw.sum(0) + mixture.EMPTY
        weights, means = size / size.sum(), rw.T @ x / size[:, None]
        covs = [((x - m).T * rw[:, c]) @ (x - m) / size[c] + ridge * np.eye(p) for c, m in enumerate(means)]


@pytest.mark.parametrize("world", [kmeans.World(), kmeans.World("bootstrap", 3, 0.8)])
def test_equals_plain_expectation_maximisation(feats, world):
    h, x = rows_of(feats)
    seen, w = kmeans._view(world, x, h)
    w = np.ones(len(x)) if w is None else w
    wanted = [(k, world) for k in (1, 2, 3, 4)]
    starts = kmeans.fit_restarts(feats, wanted, 1, 42)
    found = mixture.fit_mixtures(feats, wanted, 1, 42)
    for s, m in zip(starts, found):
        hard = ((seen[:, None] - s.centers[None]) ** 2).sum(2).argmin(1)
        weights, means, covs, ll = plain_em(seen, w, s.centers, hard, m.iterations, mixture.RIDGE)
        assert m.converged and m.rows == pytest.approx(w.sum())
        assert m.weights == pytest.approx(weights) and np.allclose(m.means, means)
        assert np.allclose(m.covariances, covs) and m.log_likelihood == pytest.approx(ll)


def test_restarts_and_worlds_in_one_fit(feats):
    one = mixture.fit_mixtures(feats, [(4, kmeans.World())], 1, 7)[0]
    worlds = [(4, kmeans.World()), (2, kmeans.World("bootstrap", 0, 0.8)), (3, kmeans.World())]
    many = mixture.fit_mixtures(feats, worlds, 4, 7)
    assert many[0].log_likelihood >= one.log_likelihood - 1e-9
    assert [m.k for m in many] == [4, 2, 3]
    capped = mixture.fit_mixtures(feats, [(4, kmeans.World())], 1, 7, max_iter=1)[0]
    assert capped.iterations == 1 and not capped.converged and math.isfinite(capped.log_likelihood)


def test_tables_and_labels(spark, feats, cloud):
    frame, models = mixture.gmm(feats, [3, 2, 1_000])
    assert sorted(models) == [2, 3]
    rows = frame.orderBy("id").collect()
    for r in rows:
        assert sum(r["gmm_3_probability"]) == pytest.approx(1)
        assert int(np.argmax(r["gmm_3_probability"])) == r["gmm_3"]
    true = np.repeat([0, 1, 2], [150, 100, 60])
    agree = sum(np.bincount(true[[r["gmm_3"] == c for r in rows]], minlength=3).max() for c in range(3))
    assert agree >= 300
    table = mixture.mixture_table(frame, models)
    got = {(r.k, r.component): r for r in table.collect()}
    assert len(got) == 5 and sum(r.weight for r in got.values() if r.k == 3) == pytest.approx(1)
    assert np.allclose(got[3, 1].covariance, models[3].covariances[1])
    c = {r.k: r for r in mixture.mixture_criteria(frame, models).collect()}
    free = 3 * 2 + 3 * 3 + 2
    assert c[3].bic == pytest.approx(-2 * c[3].log_likelihood + free * math.log(310))
    assert c[3].aic == pytest.approx(-2 * c[3].log_likelihood + 2 * free)
    assert c[3].bic < c[2].bic
    assert cluster.cluster(feats, "gmm", [2])[1].columns == ["k", "log_likelihood", "bic", "aic"]


def test_repeated_rows_and_lonely_components(spark):
    """Fewer distinct rows than components: covariances shrink to the ridge, nothing breaks."""
    df = spark.range(60).select("id", (F.col("id") % 2).cast("double").alias("a"), (F.col("id") % 2 * 2).cast("double").alias("b"))
    _, models = mixture.gmm(prepare_features(df, "id"), [2, 4])
    assert models[2].weights == pytest.approx([0.5, 0.5])
    assert np.allclose(models[2].covariances, mixture.RIDGE * np.eye(2), atol=1e-9)
    assert np.isfinite(models[4].log_likelihood) and models[4].weights.sum() == pytest.approx(1)


def test_bootstrap_of_mixtures(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(m, 0.3, (40, 2)) for m in (0, 6, 12)])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double")
    t = validate.bootstrap_stability(prepare_features(df, "id"), "gmm", 3, n_bootstrap=8).first()
    assert t.n_pairs == 28 and t.mean_jaccard > 0.95 and t.is_stable


@pytest.mark.parametrize("driver_bytes,cell", [(1 << 26, 1 << 24), (64, 1 << 24), (8, 16)])
def test_sums_by_levels(spark, monkeypatch, driver_bytes, cell):
    df = spark.range(1000).repartition(17).select("id", F.array(F.col("id").cast("double"), F.lit(1.0)).alias("x"))
    monkeypatch.setattr(blocks, "TASK_BYTES", 64)
    b = blocks.pack(df.select(F.col("id").alias("h"), "x"), 1000, 2)
    assert b.tasks == 17
    monkeypatch.setattr(blocks, "DRIVER_BYTES", driver_bytes)

    def work(data):
        total = np.zeros(6)
        for h, x in data:
            total += [*x.sum(0), h.sum(), len(x), 1, 0]
        return total

    monkeypatch.setattr(blocks, "CELL_BYTES", cell)
    found = b.reduce(work, size=6)
    assert found[:4].tolist() == [499_500, 1000, 499_500, 1000]
    most = b.reduce(lambda data: np.array([max((x[:, 0].max() for _, x in data), default=0.0)]),
                    lambda parts: np.max(parts, axis=0), 1)
    assert most.tolist() == [999.0]
    b.release()


def test_one_vector_reaches_the_driver_however_many_tasks(spark, monkeypatch):
    df = spark.range(400).repartition(40).select("id", F.array(F.col("id").cast("double")).alias("x"))
    monkeypatch.setattr(blocks, "TASK_BYTES", 8)
    b = blocks.pack(df.select(F.col("id").alias("h"), "x"), 400, 1)
    seen, size = [], 1 << 15  # 256 kB a task
    plain = type(b.frame).collect
    monkeypatch.setattr(type(b.frame), "collect", lambda t: seen.append(plain(t)) or seen[-1])
    found = b.reduce(lambda data: np.full(size, sum(x.sum() for _, x in data)), size=size)
    assert b.tasks == 40 and found.tolist() == [400 * 399 / 2] * size
    assert [len(rows) for rows in seen] == [1]
    b.release()


def test_no_rows(spark):
    b = blocks.pack(spark.createDataFrame([], "h long, x array<double>"), 0, 2)
    assert b.reduce(lambda data: np.array([float(sum(len(x) for _, x in data))])).tolist() in ([0.0], [])

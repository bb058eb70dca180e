"""Gaussian mixtures with full covariances, for many k, restarts and replicates at the same time.

One pass over the packed rows advances every mixture by one step of expectation-maximisation: a
task computes the responsibilities in the log domain and sends, per component, their sum and the
first and second moments about the current mean, which keeps the covariance free of
cancellation.  The driver adds the moments, takes Cholesky factors of p × p matrices and decides
by the mean log-likelihood which mixtures go on.  Every mixture starts from a k-means fit.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialframe.columns import col
from trialframe.operators.features import Features
from trialframe.operators.kmeans import World, _pieces, _view, by_world, fit_restarts, packed
from trialframe.plans.arrays import square_distances, to_lists, to_matrix
from trialframe.plans.blocks import Blocks

MAX_ITER = 100
#: A mixture is done when the mean log-likelihood of a row gains less.
TOLERANCE = 1e-3
#: Added to the diagonal of every covariance, so that it stays positive definite.
RIDGE = 1e-6
#: Added to the rows of every component, so that an empty one has a mean and a covariance.
EMPTY = 10 * float(np.finfo("float64").eps)


@dataclass
class Mixture:
    """Weights, means and covariances of k components, in the units of the features."""

    k: int
    world: World
    means: np.ndarray
    weights: np.ndarray | None = None  # None: rows still go to the nearest mean, as k-means left them
    covariances: np.ndarray | None = None
    log_likelihood: float = -math.inf  # of all rows under these parameters
    rows: float = 0.0
    iterations: int = 0
    converged: bool = False
    settled: bool = False  # parameters are final, their likelihood is not known yet

    def whitener(self) -> tuple[np.ndarray, np.ndarray]:
        """Per component: W with |(x - mean) W|² the Mahalanobis distance; log weight and density at 0."""
        p = self.means.shape[1]
        whites, constants = np.zeros((self.k, p, p)), np.zeros(self.k)
        for c in range(self.k):
            lower = np.linalg.cholesky(self.covariances[c])
            whites[c] = np.linalg.solve(lower, np.eye(p)).T
            weight = math.log(self.weights[c]) if self.weights[c] > 0 else -math.inf
            constants[c] = weight - 0.5 * p * math.log(2 * math.pi) - np.log(np.diag(lower)).sum()
        return whites, constants


def log_joint(x: np.ndarray, means: np.ndarray, whites: np.ndarray, constants: np.ndarray) -> np.ndarray:
    """log(weight · density) of every row and component, for the components of any mixtures."""
    c, p = means.shape
    y = x @ whites.transpose(1, 0, 2).reshape(p, c * p) - np.einsum("ci,cij->cj", means, whites).ravel()
    return constants - 0.5 * (y.reshape(len(x), c, p) ** 2).sum(axis=2)


def responsibilities(joint: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(probability of each component, log-likelihood) per row, of one mixture."""
    top = joint.max(axis=1, keepdims=True)
    part = np.exp(joint - top)
    total = part.sum(axis=1, keepdims=True)
    return part / total, (top + np.log(total))[:, 0]


def _moments(blocks: Blocks, models: Sequence[Mixture], which: Sequence[int]):
    """{mixture: (log-likelihood, rows, N, S1, S2)}: sums of the responsibilities and of the moments
    about the current means, by one pass."""
    p = blocks.width
    views = {world: [i for members in groups.values() for i in members]
             for world, groups in by_world(models, which).items()}
    order = [i for members in views.values() for i in members]
    wide = 1 + p + p * p
    starts = dict(zip(order, np.cumsum([0] + [2 + models[i].k * wide for i in order]).tolist()))
    size = sum(2 + models[i].k * wide for i in order)
    parts = {}
    for world, members in views.items():
        soft = [i for i in members if models[i].weights is not None]
        made = [models[i].whitener() for i in soft]
        parts[world] = (
            [i for i in members if models[i].weights is None], soft,
            np.concatenate([models[i].means for i in soft]) if soft else None,
            np.concatenate([w for w, _ in made]) if soft else None,
            np.concatenate([c for _, c in made]) if soft else None)
    means = {i: models[i].means for i in order}
    settled = {i for i in order if models[i].settled}  # only their likelihood is asked for
    widest = max(p * sum(models[i].k for i in members) for members in views.values())

    def work(data: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        total = np.zeros(size)
        for h, raw in _pieces(data, widest):
            for world, (hard, soft, centers, whites, constants) in parts.items():
                x, w = _view(world, raw, h)
                shares = {}
                for i in hard:
                    near = square_distances(x, means[i]).argmin(axis=1)
                    shares[i] = np.eye(len(means[i]))[near], np.zeros(len(x))
                if soft:
                    joint, at = log_joint(x, centers, whites, constants), 0
                    for i in soft:
                        shares[i] = responsibilities(joint[:, at:at + len(means[i])])
                        at += len(means[i])
                for i, (r, ll) in shares.items():
                    at = starts[i]
                    total[at] += ll.sum() if w is None else (ll * w).sum()
                    total[at + 1] += len(x) if w is None else w.sum()
                    if i in settled:
                        continue
                    r = r if w is None else r * w[:, None]
                    out = total[at + 2:at + 2 + r.shape[1] * wide].reshape(r.shape[1], wide)
                    for c, mean in enumerate(means[i]):
                        z = x - mean
                        rz = z * r[:, c:c + 1]
                        out[c, 0] += r[:, c].sum()
                        out[c, 1:1 + p] += rz.sum(axis=0)
                        out[c, 1 + p:] += (rz.T @ z).ravel()
        return total

    found = blocks.reduce(work, size=size)
    result = {}
    for i in order:
        at, k = starts[i], models[i].k
        part = found[at + 2:at + 2 + k * wide].reshape(k, wide)
        result[i] = (float(found[at]), float(found[at + 1]), part[:, 0], part[:, 1:1 + p],
                     part[:, 1 + p:].reshape(k, p, p))
    return result


def _maximised(m: Mixture, n: np.ndarray, s1: np.ndarray, s2: np.ndarray, ridge: float) -> None:
    n = n + EMPTY
    shift = s1 / n[:, None]
    cov = s2 / n[:, None, None] - shift[:, :, None] * shift[:, None, :]
    cov = (cov + cov.transpose(0, 2, 1)) / 2
    m.means = m.means + shift
    m.covariances = cov + ridge * np.eye(cov.shape[1])
    m.weights = n / n.sum()


def fit_mixtures(
    feats: Features, wanted: Sequence[tuple[int, World]], n_init: int = 1, seed: int = 42,
    max_iter: int = MAX_ITER, tol: float = TOLERANCE, ridge: float = RIDGE,
    blocks: Blocks | None = None,
) -> list[Mixture]:
    """The likeliest of ``n_init`` restarts for every (k, world), in the order of ``wanted``.

    A restart begins with the clusters of a k-means fit of its own, and ends when a step gains
    less than ``tol`` in the mean log-likelihood, or after ``max_iter`` steps.  A component that
    lost its rows keeps its place with a weight near 0.
    """
    own = blocks or packed(feats, seed, n_init * sum(k for k, _ in wanted) * (1 + feats.width))
    starts = fit_restarts(feats, wanted, n_init, seed, blocks=own)
    models = [Mixture(m.k, m.world, m.centers) for m in starts]
    todo = list(range(len(models)))
    while todo:
        stats = _moments(own, models, todo)
        left = []
        for i in todo:
            m, (ll, rows, n, s1, s2) = models[i], stats[i]
            m.rows = rows
            if m.settled:
                m.log_likelihood = ll
                continue
            if m.weights is not None:
                m.iterations += 1
                m.converged = abs(ll - m.log_likelihood) <= tol * rows
                m.settled = m.converged or m.iterations >= max_iter
                m.log_likelihood = ll
            _maximised(m, n, s1, s2, ridge)
            left.append(i)
        todo = left
    if blocks is None:
        own.release()
    return [max(models[i:i + n_init], key=lambda m: m.log_likelihood)
            for i in range(0, len(models), n_init)]


def posterior_udf(models: Sequence[Mixture], p: int):
    """x → array<double>: the probabilities of all components of every mixture, one after another."""
    ks = [m.k for m in models]
    made = [m.whitener() for m in models]
    means = np.concatenate([m.means for m in models])
    whites, constants = (np.concatenate([w[j] for w in made]) for j in range(2))

    @F.arrow_udf("array<double>")
    def posterior(x: pa.Array) -> pa.Array:
        rows, out = to_matrix(x, p), np.zeros((len(x), sum(ks)))
        step = max(64, (1 << 22) // max(1, p * sum(ks)))
        for i in range(0, len(rows), step):
            joint, at = log_joint(rows[i:i + step], means, whites, constants), 0
            for k in ks:
                out[i:i + step, at:at + k] = responsibilities(joint[:, at:at + k])[0]
                at += k
        return to_lists(out, pa.float64())

    return posterior


def gmm(
    feats: Features, ks: Sequence[int] = range(2, 7), seed: int = 42, max_iter: int = MAX_ITER,
    n_init: int = 1, tol: float = TOLERANCE, ridge: float = RIDGE,
) -> tuple[DataFrame, dict[int, Mixture]]:
    """(frame with ``gmm_<k>`` and ``gmm_<k>_probability`` per k, fitted mixtures).

    k above n is skipped.  Labels are the likeliest components, ties the first.
    """
    ks = [k for k in ks if k <= feats.n]
    if not feats.names or not ks:
        raise ValueError("no feature or no possible k")
    fitted = fit_mixtures(feats, [(k, World()) for k in ks], n_init, seed, max_iter, tol, ridge)
    models = dict(zip(ks, fitted))
    seen = feats.frame.withColumn("__p", posterior_udf(list(models.values()), feats.width)("x"))
    at, out = 1, []
    for k in ks:
        share = F.slice("__p", at, k)
        out += [(F.array_position(share, F.array_max(share)) - 1).cast("int").alias(f"gmm_{k}"),
                share.alias(f"gmm_{k}_probability")]
        at += k
    return seen.select(*[col(c) for c in feats.frame.columns], *out), models


def mixture_criteria(df: DataFrame, models: dict[int, Mixture]) -> DataFrame:
    """(k, log_likelihood, bic, aic): of all rows, under the fitted parameters."""
    rows = []
    for k, m in models.items():
        p = m.means.shape[1]
        free = k * p + k * p * (p + 1) / 2 + k - 1
        rows.append((k, m.log_likelihood, -2 * m.log_likelihood + free * math.log(m.rows),
                     -2 * m.log_likelihood + 2 * free))
    return df.sparkSession.createDataFrame(rows, "k int, log_likelihood double, bic double, aic double")


def mixture_table(df: DataFrame, models: dict[int, Mixture]) -> DataFrame:
    """(k, component, weight, mean, covariance, iterations, converged), in scaled units."""
    rows = [
        (k, c, float(m.weights[c]), m.means[c].tolist(), m.covariances[c].tolist(), m.iterations, m.converged)
        for k, m in models.items() for c in range(k)
    ]
    return df.sparkSession.createDataFrame(
        rows, "k int, component int, weight double, mean array<double>, "
        "covariance array<array<double>>, iterations int, converged boolean")

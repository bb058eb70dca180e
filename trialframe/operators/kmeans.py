"""K-means for many k, restarts and replicates at the same time.

One pass over the packed rows advances every model.  The centers of all models are stacked into
one matrix product, and a task sends (weight, cost, sum of x) of all clusters as one vector;
the driver gets models × k × (p + 2) numbers.  So ten restarts of five values of k, or the
hundreds of fits of a gap statistic, cost as many scans as the slowest of them.

Seeds come from all rows (k-means||, Bahmani et al. 2012): a few passes draw candidates, each
with a chance in proportion to its squared distance from those before, the last one counts the
rows nearest to each, and every restart picks its centers among them by k-means++.

Replicate data are never stored.  A row's weight in a bootstrap replicate (Poisson, the
large-table form of drawing with replacement) and its stand-in in a uniform reference are
functions of a hash of its id, the same in every pass and on every retry.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialframe.columns import col
from trialframe.operators.features import Features
from trialframe.plans.arrays import square_distances, to_lists, to_matrix
from trialframe.plans.blocks import Blocks, pack

#: Passes that draw seed candidates, and how many each draws per cluster of the largest k.
SEED_ROUNDS = 4
OVERSAMPLING = 2
MAX_ITER = 300
TOLERANCE = 1e-4


@dataclass(frozen=True)
class World:
    """What a model sees of a row: the data, a bootstrap replicate, or a uniform reference."""

    kind: str = "data"
    replicate: int = 0
    fraction: float = 1.0
    box: tuple[tuple[float, float], ...] = ()


@dataclass
class Model:
    k: int
    world: World
    centers: np.ndarray
    restart: int = 0
    done: bool = False
    inertia: float = math.nan
    sizes: np.ndarray | None = None
    means: np.ndarray | None = None


def unit(h: np.ndarray, stream: int) -> np.ndarray:
    """Uniform numbers in [0, 1) from 64-bit row hashes (the SplitMix64 finaliser)."""
    step = (0x9E3779B97F4A7C15 * (stream + 1)) & 0xFFFFFFFFFFFFFFFF
    with np.errstate(over="ignore"):
        z = h.astype("uint64") + np.uint64(step)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z = z ^ (z >> np.uint64(31))
    return (z >> np.uint64(11)).astype("float64") / float(1 << 53)


def poisson_weights(h: np.ndarray, replicate: int, mean: float) -> np.ndarray:
    """How often a row occurs in a replicate."""
    term, total, steps = math.exp(-mean), 0.0, []
    for i in range(1, 40):
        total += term
        steps.append(total)
        term *= mean / i
    return np.searchsorted(np.array(steps), unit(h, 1_000_003 + replicate), side="right").astype(
        "float64"
    )


def _view(world: World, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    if world.kind == "bootstrap":
        return x, poisson_weights(h, world.replicate, world.fraction)
    if world.kind == "uniform":
        out = np.empty_like(x)
        for j, (lo, hi) in enumerate(world.box):
            out[:, j] = lo + (hi - lo) * unit(h, 7_919 * (world.replicate + 1) + j)
        return out, None
    return x, None


def row_hash(id_col: str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), col(id_col))


#: Distances that a task holds at once.
CELLS = 1 << 22


def _pieces(blocks: Iterator[tuple[np.ndarray, np.ndarray]], width: int):
    """Blocks cut so that ``width`` numbers per row fit ``CELLS``."""
    step = max(64, CELLS // max(width, 1))
    for h, x in blocks:
        for i in range(0, len(x), step):
            yield h[i:i + step], x[i:i + step]


def _step(x: np.ndarray, w: np.ndarray | None, centers: np.ndarray):
    """(weight, cost, sum of x) per cluster when rows go to their nearest center.

    ``centers`` is models x k x p: one product with all of them.  Centers stand cluster by cluster
    and rows are innermost, so that the nearest one is found by k comparisons of long rows.
    """
    m, k, p = centers.shape
    flat = centers.transpose(1, 0, 2).reshape(k * m, p)
    d = (-2.0 * flat) @ x.T
    d += (flat * flat).sum(axis=1)[:, None]
    d = d.reshape(k, m, len(x))
    best, near = d[0].copy(), np.zeros((m, len(x)), np.min_scalar_type(k))
    for j in range(1, k):  # later clusters that are nearer have larger numbers
        np.maximum(near, (d[j] < best) * near.dtype.type(j), out=near)
        np.minimum(best, d[j], out=best)
    best = np.maximum(best + (x * x).sum(axis=1), 0.0)
    for j in range(k):  # the distances make room for the weights
        d[j] = near == j
    if w is not None:
        d *= w
    weight, total = d.sum(axis=2), (d.reshape(k * m, len(x)) @ x).reshape(k, m, p)
    best = best if w is None else best * w
    place = near + k * np.arange(m)[:, None]  # costs are added row by row: equal fits tie as they are
    cost = np.bincount(place.ravel(), weights=best.ravel(), minlength=m * k)
    return weight.T.ravel(), cost, total.transpose(1, 0, 2).reshape(m * k, p)


def _moved(centers: np.ndarray, weight: np.ndarray, total: np.ndarray) -> np.ndarray:
    """New centers; a cluster without rows stays where it is."""
    return np.where(weight[:, None] > 0, total / np.maximum(weight, 1e-300)[:, None], centers)


def by_world(models: Sequence, which: Sequence[int]) -> dict[World, dict[int, list[int]]]:
    """world -> k -> models: what a pass can do together."""
    out: dict[World, dict[int, list[int]]] = {}
    for i in which:
        out.setdefault(models[i].world, {}).setdefault(models[i].k, []).append(i)
    return out


def _statistics(blocks: Blocks, models: Sequence[Model], which: Sequence[int]):
    """{model: (weights, cost, sums)} of the current centers, by one pass."""
    p, views = blocks.width, by_world(models, which)
    stacked = {w: [np.stack([models[i].centers for i in members]) for members in groups.values()]
               for w, groups in views.items()}
    order = [i for groups in views.values() for members in groups.values() for i in members]
    rows = sum(models[i].k for i in order)
    widest = max((sum(len(i) * k for k, i in g.items()) for g in views.values()), default=1)

    def work(data: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        total = np.zeros((rows, p + 2))
        for h, raw in _pieces(data, widest):
            at = 0
            for world, groups in stacked.items():
                x, w = _view(world, raw, h)
                for centers in groups:
                    end = at + centers.shape[0] * centers.shape[1]
                    weight, cost, s = _step(x, w, centers)
                    total[at:end, 0] += weight
                    total[at:end, 1] += cost
                    total[at:end, 2:] += s
                    at = end
        return total.ravel()

    found = blocks.reduce(work, size=rows * (p + 2)).reshape(rows, p + 2)
    out, at = {}, 0
    for i in order:
        part = found[at:at + models[i].k]
        out[i] = part[:, 0], part[:, 1], part[:, 2:]
        at += models[i].k
    return out


def _drawn(blocks: Blocks, worlds: Sequence[World], have: dict[int, np.ndarray], many: int,
           step: int) -> dict[int, np.ndarray]:
    """``many`` more candidates per world, drawn without replacement with a chance by d².

    A row's key is −log(u) / d², u from its hash; the smallest keys are the draw (Efraimidis and
    Spirakis 2006).  A task sends its ``many`` smallest, so the draw needs one pass and no total.
    """
    p = blocks.width

    def smallest(rows: np.ndarray) -> np.ndarray:
        """The ``many`` rows of each world that come first by key, then by their numbers."""
        rows = rows[np.lexsort(rows.T[::-1])]
        start = np.searchsorted(rows[:, 0], rows[:, 0])
        return rows[np.arange(len(rows)) - start < many]

    def merge(parts: list[np.ndarray]) -> np.ndarray:
        return smallest(np.concatenate(parts).reshape(-1, p + 2)).ravel()

    def work(data: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        best = np.zeros((0, p + 2))
        for h, raw in _pieces(data, max(len(c) for c in have.values()) + p):
            found = [best]
            for i, world in enumerate(worlds):
                x, w = _view(world, raw, h)
                chance = np.ones(len(x)) if w is None else w
                if len(have[i]):
                    chance = chance * square_distances(x, have[i]).min(axis=1)
                there = np.flatnonzero(chance > 1e-12)
                u = unit(h[there], 15_485_863 + 4_096 * i + step)
                key = -np.log1p(-u) / chance[there]
                found.append(np.column_stack([np.full(len(there), float(i)), key, x[there]]))
            best = smallest(np.concatenate(found))
        return best.ravel()

    rows = blocks.reduce(work, merge, size=many * len(worlds) * (p + 2)).reshape(-1, p + 2)
    return {i: np.concatenate([c, rows[rows[:, 0] == i, 2:]]) for i, c in have.items()}


def _candidates(blocks: Blocks, worlds: Sequence[World], k: int):
    """(candidates, rows nearest to each) of every world; at most 8 k of them, from all rows."""
    p = blocks.width
    have = {i: np.zeros((0, p)) for i in range(len(worlds))}
    for step in range(SEED_ROUNDS):
        have = _drawn(blocks, worlds, have, OVERSAMPLING * k, step)
    models = [Model(len(have[i]), world, have[i]) for i, world in enumerate(worlds)]
    counts = _statistics(blocks, models, [i for i in range(len(models)) if models[i].k])
    return {world: (have[i], counts[i][0]) if i in counts else (np.zeros((1, p)), np.ones(1))
            for i, world in enumerate(worlds)}


def _spread_seeds(x: np.ndarray, weight: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++ seeding (Arthur and Vassilvitskii 2007) among weighted candidates."""
    def pick(mass: np.ndarray, many: int) -> np.ndarray:
        mass = mass if mass.sum() > 0 else np.ones(len(x))
        ends = np.cumsum(mass)
        return np.minimum(np.searchsorted(ends, rng.random(many) * ends[-1], "right"), len(x) - 1)

    chosen = [x[pick(weight, 1)[0]]]
    near = ((x - chosen[0]) ** 2).sum(axis=1)
    for _ in range(1, k):
        tries = pick(near * weight, 2 + int(math.log(k)))
        options = [np.minimum(near, ((x - x[t]) ** 2).sum(axis=1)) for t in tries]
        best = int(np.argmin([(o * weight).sum() for o in options]))
        chosen.append(x[tries[best]])
        near = options[best]
    return np.array(chosen)


def _tolerance(world: World) -> float:
    """Allowed squared shift: relative to the variance of a (scaled or uniform) feature."""
    if world.kind != "uniform":
        return TOLERANCE
    return TOLERANCE * float(np.mean([(hi - lo) ** 2 / 12 for lo, hi in world.box]))


def packed(feats: Features, seed: int, centers: int) -> Blocks:
    """The rows of a feature matrix with the hash that their replicates follow, for passes over all
    ``centers`` together."""
    return pack(feats.frame.select(row_hash(feats.id_col, seed).alias("h"), "x"), feats.n, feats.width, centers)


def fit_models(
    feats: Features, wanted: Sequence[tuple[int, World]], n_init: int = 10, seed: int = 42,
    max_iter: int = MAX_ITER, blocks: Blocks | None = None,
) -> list[Model]:
    """The best of ``n_init`` restarts for every (k, world), in the order of ``wanted``."""
    models = fit_restarts(feats, wanted, n_init, seed, max_iter, blocks)
    return [min(models[i:i + n_init], key=lambda m: m.inertia) for i in range(0, len(models), n_init)]


def fit_restarts(
    feats: Features, wanted: Sequence[tuple[int, World]], n_init: int = 10, seed: int = 42,
    max_iter: int = MAX_ITER, blocks: Blocks | None = None,
) -> list[Model]:
    """All restarts of every (k, world), those of one next to each other.

    A restart stops by its own shift; the pass that moves the others gives its final cost.
    """
    own = blocks or packed(feats, seed, n_init * sum(k for k, _ in wanted))
    worlds = list(dict.fromkeys(world for _, world in wanted))
    seeds = _candidates(own, worlds, max(k for k, _ in wanted))
    models = [
        Model(k, world, _spread_seeds(*seeds[world], k, np.random.default_rng([seed, number, r])), r)
        for number, (k, world) in enumerate(wanted)
        for r in range(n_init)
    ]
    todo, passes = list(range(len(models))), 0
    while todo:
        stats = _statistics(own, models, todo)
        for i in todo:
            m, (w, cost, s) = models[i], stats[i]
            moved = _moved(m.centers, w, s)
            if m.done or passes >= max_iter:
                m.done, m.inertia, m.sizes, m.means = True, float(cost.sum()), w, moved
                continue
            m.done = float(((moved - m.centers) ** 2).sum()) <= _tolerance(m.world)
            m.centers = moved
        todo = [i for i in todo if models[i].means is None]
        passes += 1
    if blocks is None:
        own.release()
    return models


def labels_udf(models: Sequence[Model], p: int):
    """x → array<int> with the nearest center of every model."""
    centers = [m.centers for m in models]

    @F.arrow_udf("array<int>")
    def nearest(x: pa.Array) -> pa.Array:
        rows = to_matrix(x, p)
        found = [square_distances(rows, c).argmin(axis=1) for c in centers]
        return to_lists(np.stack(found, axis=1).astype("int32"), pa.int32())

    return nearest


def kmeans(
    feats: Features, ks: Sequence[int] = range(2, 7), n_init: int = 10, seed: int = 42
) -> tuple[DataFrame, dict[int, Model]]:
    """(frame with a column ``kmeans_<k>`` per k, fitted models).  k above n is skipped."""
    ks = [k for k in ks if k <= feats.n]
    if not feats.names or not ks:
        raise ValueError("no feature or no possible k")
    models = dict(zip(ks, fit_models(feats, [(k, World()) for k in ks], n_init, seed)))
    nearest = labels_udf(list(models.values()), feats.width)
    labelled = feats.frame.withColumn("__l", nearest("x"))
    return (
        labelled.select(
            *[col(c) for c in feats.frame.columns],
            *[F.col("__l")[i].alias(f"kmeans_{k}") for i, k in enumerate(ks)],
        ),
        models,
    )


def centers_table(df: DataFrame, feats: Features, models: dict[int, Model]) -> DataFrame:
    """(k, cluster, variable, center) in scaled units."""
    rows = [
        (k, c, v, float(m.centers[c, j]))
        for k, m in models.items()
        for c in range(k)
        for j, v in enumerate(feats.names)
    ]
    return df.sparkSession.createDataFrame(
        rows, "k int, cluster int, variable string, center double"
    )

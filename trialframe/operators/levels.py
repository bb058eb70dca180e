"""Factor analysis of mixed data with many levels, without a covariance of levels × levels.

The indicator matrix is never formed: a row is its z-scores and one level number per categorical
variable.  A pass over the packed rows multiplies the covariance by a block of vectors, and a
block Krylov iteration with restarts finds the leading components from such products.

Where only one variable has many levels, its own block of the covariance is the identity less a
projection that no other block sees.  The components then lie in the space of the other features
and of their means by level: a matrix of twice as many rows as there are other features, however
many levels there are.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialframe.columns import col
from trialframe.plans.arrays import array_sum, to_lists, to_matrix
from trialframe.plans.blocks import pack
from trialframe.plans.lineage import written

#: Vectors beyond the wanted ones in a block, blocks kept before a restart, and passes at most.
MORE, KEPT, PASSES = 8, 6, 200


def leading(product: Callable[[np.ndarray], np.ndarray], size: int, k: int, tolerance: float = 1e-9,
            seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues and their vectors of a symmetric matrix known by its products.

    Every step adds the residuals of the leading Ritz vectors to the basis; when the basis is
    full it is replaced by these vectors, which needs no product.  Ends when all residuals are below
    ``tolerance`` times the largest eigenvalue, or with a warning after ``PASSES`` products.
    """
    width = min(size, k + MORE)
    block = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, width)))[0]
    basis, image = np.empty((size, 0)), np.empty((size, 0))
    for turn in range(PASSES):
        basis, image = np.hstack([basis, block]), np.hstack([image, product(block)])
        small = basis.T @ image
        values, vectors = np.linalg.eigh((small + small.T) / 2)
        values, vectors = values[::-1][:width], vectors[:, ::-1][:, :width]
        ritz, mapped = basis @ vectors, image @ vectors
        rest = mapped - ritz * values
        if np.linalg.norm(rest[:, :k], axis=0).max() <= tolerance * max(values[0], 1e-300):
            break
        if basis.shape[1] + width > max(KEPT, 2) * width:
            basis, image = ritz, mapped
        scale = np.linalg.norm(rest, axis=0).max()
        for _ in range(2):
            rest = rest - basis @ (basis.T @ rest)
        q, strength, _ = np.linalg.svd(rest, full_matrices=False)
        block = q[:, strength > 1e-10 * scale][:, :size - basis.shape[1]]
        block = block - basis @ (basis.T @ block)
        if not block.shape[1]:
            break
        block = np.linalg.qr(block)[0]
    else:
        warnings.warn("components are close to each other: not all of them have converged", stacklevel=2)
    return values[:k], ritz[:, :k]


def _scored(x: np.ndarray, a: np.ndarray, b: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Rows of z-scores and level numbers times a block of vectors."""
    wide = len(a)
    out = x[:, :wide] @ a - shift
    for c in range(wide, x.shape[1]):
        out += b[x[:, c].astype(np.int64)]
    return out


def fit_levels(
    whole: DataFrame, keep: Sequence[str], z: Sequence[Column], cats: Sequence[str],
    levels: Sequence[tuple[str, str, int]], k: int, n: int, prefix: str,
) -> tuple[DataFrame, np.ndarray]:
    """(scores: ``keep`` and the dimensions, share of variance of each dimension).

    ``whole`` has complete rows, ``levels`` all (variable, value, count) in order.  Driver and tasks
    hold some blocks of (z-scores + levels) × (k + 8) numbers; no task holds more rows than
    a block.
    """
    spark = whole.sparkSession
    share = np.array([m for _, _, m in levels], float) / n
    root = np.sqrt(share)[:, None]
    wide, size = len(z), len(z) + len(levels)
    numbers = written(spark.createDataFrame(
        [(v, text, i) for i, (v, text, _) in enumerate(levels)], "variable string, value string, code int"))
    coded = whole.select(*[col(c) for c in keep], *[e.alias(f"__z{i}") for i, e in enumerate(z)],
                         *[col(c).cast("string").alias(f"__t{i}") for i, c in enumerate(cats)])
    for i, c in enumerate(cats):
        own = numbers.where(F.col("variable") == c).select(F.col("value").alias(f"__t{i}"),
                                                           F.col("code").alias(f"__l{i}"))
        coded = coded.join(own, f"__t{i}")
    coded = coded.select(*[col(c) for c in keep], F.array(
        *[F.col(f"__z{i}") for i in range(wide)],
        *[F.col(f"__l{i}").cast("double") for i in range(len(cats))]).alias("__x"))
    blocks = pack(coded.select(F.lit(0).cast("long").alias("h"), F.col("__x").alias("x")), n, wide + len(cats))

    def parts(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return v[:wide], v[wide:] / root, (v[wide:] * root).sum(axis=0)

    def product(v: np.ndarray) -> np.ndarray:
        many = v.shape[1]
        shared = spark.sparkContext.broadcast(parts(v))

        def work(rows: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
            out, total = np.zeros((size, many)), np.zeros((1, many))
            for _, x in rows:
                t = _scored(x, *shared.value)
                total += t.sum(axis=0)
                out[:wide] += x[:, :wide].T @ t
                for c in range(wide, x.shape[1]):
                    code = x[:, c].astype(np.int64)
                    order = np.argsort(code, kind="stable")
                    found, first = np.unique(code[order], return_index=True)
                    out[wide + found] += np.add.reduceat(t[order], first, axis=0)
            return np.concatenate([out, total]).ravel()

        got = blocks.reduce(work, size=(size + 1) * many).reshape(-1, many)
        shared.unpersist()
        return np.concatenate([got[:wide], (got[wide:-1] - share[:, None] * got[-1]) / root]) / n

    try:
        values, vectors = leading(product, size, k)
    finally:
        blocks.release()
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), range(k)])
    shared = spark.sparkContext.broadcast(parts(vectors * np.where(signs == 0, 1.0, signs)))
    names = [f"{prefix}{i + 1}" for i in range(k)]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = _scored(to_matrix(batch.column(batch.num_columns - 1), wide + len(cats)), *shared.value)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *[pa.array(t[:, i]) for i in range(k)]],
                names=[*batch.schema.names[:-1], *names])

    kept = [f for f in coded.schema.fields if f.name != "__x"]
    scores = coded.mapInArrow(score, T.StructType([*kept, *[T.StructField(c, T.DoubleType()) for c in names]]))
    # A z-score has variance 1, the indicators of a variable have that of their number less one.
    return scores, np.maximum(values, 0.0) / (wide + len(levels) - len(cats))


def _gram(frame: DataFrame, p: int) -> np.ndarray:
    """Sum of w x xᵀ over a frame of (w double, x array<double>): a task sends p × p numbers."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((p, p))
        for batch in batches:
            x = to_matrix(batch.column(1), p)
            total += x.T @ (x * batch.column(0).to_numpy(zero_copy_only=False)[:, None])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(p), pa.int32()), to_lists(total, pa.float64())], names=["i", "s"])

    rows = frame.mapInArrow(work, "i int, s array<double>").groupBy("i").agg(
        array_sum("s", p).alias("s")).orderBy("i").collect()
    return np.array([r["s"] for r in rows]).reshape(p, p)


def _dot(x: Column, weights: np.ndarray) -> Column:
    terms = F.zip_with(x, F.array(*[F.lit(float(w)) for w in weights]), lambda a, b: a * b)
    return F.aggregate(terms, F.lit(0.0), lambda a, b: a + b)


def fit_one_large(
    whole: DataFrame, keep: Sequence[str], z: Sequence[Column], cats: Sequence[str], large: str,
    levels: Sequence[tuple[str, str, int]], total: int, k: int, n: int, prefix: str,
) -> tuple[DataFrame, np.ndarray] | None:
    """As ``fit_levels`` where only ``large`` has many levels; ``levels`` are those of the others.

    ``total`` counts all levels.  The means by level stay a table.  Null when fewer than ``k``
    components are told apart by the other features.
    """
    marks = [((col(v).cast("string") == F.lit(text)).cast("double") - m / n) / (m / n) ** 0.5
             for v, text, m in levels]
    p = len(z) + len(marks)
    if not p:
        return None
    coded = whole.select(*[col(c) for c in keep], F.array(*z, *marks).alias("__f"),
                         col(large).cast("string").alias("__t"))
    means = written(coded.groupBy("__t").agg(
        (F.count("*") / n).alias("share"), F.array(*[F.avg(F.col("__f")[i]) for i in range(p)]).alias("__m")))
    own = _gram(coded.select(F.lit(1.0 / n).alias("w"), "__f"), p)
    strength, axes = np.linalg.eigh(_gram(means.select("share", "__m"), p))
    there = strength > 1e-13 * max(1.0, float(strength.max()))
    root, axes = np.sqrt(strength[there]), axes[:, there]
    tie = axes * root
    values, vectors = np.linalg.eigh(np.block([[own, tie], [tie.T, np.eye(len(root))]]))
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    if len(values) < k or values[-1] < 1 - 1e-9:
        return None
    direct, by_level = vectors[:p], (axes / root) @ vectors[p:]
    # The sign makes the largest entry positive, among the levels' too.
    entry = [F.sqrt("share") * _dot(F.col("__m"), by_level[:, i]) for i in range(k)]
    far = means.agg(*[F.max_by(e, F.abs(e)).alias(f"e{i}") for i, e in enumerate(entry)]).first()
    first = direct[np.abs(direct).argmax(axis=0), range(k)]
    signs = np.sign([far[i] if abs(far[i]) > abs(first[i]) else first[i] for i in range(k)])
    signs[signs == 0] = 1.0
    scores = coded.join(means.select("__t", "__m"), "__t").select(*[col(c) for c in keep], *[
        (_dot(F.col("__f"), direct[:, i] * signs[i]) + _dot(F.col("__m"), by_level[:, i] * signs[i]))
        .alias(f"{prefix}{i + 1}") for i in range(k)])
    return scores, np.maximum(values, 0.0) / (len(z) + total - len(cats))

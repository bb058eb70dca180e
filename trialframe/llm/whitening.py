"""Whitening of integer vectors, each distinct vector fitted and whitened once.

Equal vectors are grouped (partial counts first), so copies cost a counter.  The covariance is a
sum of weighted matrix products of centred vectors, one per task, added row by row in Spark; only
its p x p numbers come to the driver.  Every distinct vector is then whitened once and rows get
their result by a join on the vector.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialframe.llm.common import release, store

#: A vector with more than one in so many rows is joined by broadcast, so there are fewer than this.
HOT = 1024


def usable(vector: str) -> Column:
    """Not null, without null or non-finite entries."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(False))


def integers(vector: str, scale: int = 256) -> Column:
    """floor(scale * c) of every entry in double precision, as longs (ends of the range at most)."""
    edge = float(1 << 53)
    return F.transform(F.col(vector).cast("array<double>"), lambda c: F.floor(
        F.least(F.greatest(c * scale, F.lit(-edge)), F.lit(edge))).cast("long"))


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(places, vectors as a matrix) of each vector length of a batch."""
    x = batch.column("x")
    sizes = x.value_lengths().to_numpy()
    flat = x.flatten().to_numpy()
    start = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    for p in np.unique(sizes):
        at = np.flatnonzero(sizes == p)
        yield int(p), at, flat[start[at][:, None] + np.arange(p)]


def _exact_sums(x: np.ndarray, w: np.ndarray) -> list[int]:
    """Weighted column sums as whole numbers of any size."""
    if len(x) and int(np.abs(x).max(initial=0)) * int(w.sum()) < 1 << 62:
        return (x * w[:, None]).sum(0).tolist()
    return [sum(int(a) * int(b) for a, b in zip(col, w)) for col in x.T]


def fit(distinct: DataFrame, weights: str = "one") -> dict[int, dict]:
    """n, exact sums S and the eigenvectors of the covariance per vector length.

    ``distinct``: x (array<long>, each once) and copies.  ``weights``: "one" counts every
    distinct vector once, "copies" as often as it occurs.  The covariance has divisor n and is
    taken from vectors centred on S/n.  The values come by falling eigenvalue.
    """
    if weights not in ("one", "copies"):
        raise ValueError(f"weights must be one or copies, not {weights}")

    def weight(batch: pa.RecordBatch, at: np.ndarray) -> np.ndarray:
        return batch.column("copies").to_numpy()[at] if weights == "copies" else np.ones(len(at), np.int64)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[int, int] = {}
        total: dict[int, list[int]] = {}
        for batch in batches:
            for p, at, x in _matrices(batch):
                w = weight(batch, at)
                n[p] = n.get(p, 0) + int(w.sum())
                total[p] = [a + b for a, b in zip(total.get(p, [0] * p), _exact_sums(x, w))]
        rows = [(p, i, str(s)) for p in n for i, s in enumerate([n[p], *total[p]])]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["p", "i", "s"])

    found = (distinct.mapInArrow(sums, "p long, i long, s string")
             .groupBy("p", "i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect())
    model: dict[int, dict] = {}
    for r in sorted(found):
        part = model.setdefault(r["p"], {"n": 0, "S": []})
        if r["i"] == 0:
            part["n"] = int(r["s"])
        else:
            part["S"].append(int(r["s"]))
    mean = {p: np.array([s / m["n"] for s in m["S"]]) for p, m in model.items()}

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for p, at, x in _matrices(batch):
                z = x - mean[p]
                total[p] = total.get(p, 0) + (z * weight(batch, at)[:, None]).T @ z
        rows = [(p, i, row) for p, v in total.items() for i, row in enumerate(v)]
        if rows:
            p, i, v = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(i), pa.array(v, pa.list_(pa.float64()))],
                                             names=["p", "i", "v"])

    def add(group: pa.Table) -> pa.Table:
        rows = group.column("v").combine_chunks()
        v = rows.flatten().to_numpy().reshape(len(rows), -1).sum(0)
        return group.slice(0, 1).select(["p", "i"]).append_column(
            "v", pa.array([v], pa.list_(pa.float64())))

    ddl = "p long, i long, v array<double>"
    if any(model):
        for r in distinct.mapInArrow(products, ddl).groupBy("p", "i").applyInArrow(add, ddl).collect():
            model[r["p"]].setdefault("V", np.zeros((r["p"], r["p"])))[r["i"]] = np.array(r["v"]) / model[r["p"]]["n"]
    for p, m in model.items():
        v = m.pop("V", np.zeros((p, p)))
        values, vectors = np.linalg.eigh((v + v.T) / 2)
        m |= {"trace": float(np.trace(v)), "values": values[::-1], "vectors": vectors[:, ::-1], "mean": mean[p]}
    return model


def _deviation(x: np.ndarray, n: int, s: list[int]) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2 as whole numbers; null beyond 64 bits."""
    top = max([abs(n) * int(np.abs(x).max(initial=0)) + max(map(abs, s), default=0), 1])
    if top * top * max(1, len(s)) < 1 << 62:
        d = x * n - np.array(s, np.int64)
        return (d * d).sum(1).tolist()
    found = [sum((n * int(a) - b) ** 2 for a, b in zip(row, s)) for row in x]
    return [v if v < 1 << 63 else None for v in found]


def whiten(df: DataFrame, id_col: str, vector: str, components: int = 4, scale: int = 256,
           weights: str = "one") -> DataFrame:
    """``id_col``, component, n, deviation, whitened, explained, identity_error per row and component.

    Rows whose vector is null or holds a null, NaN or infinity are left out; other columns are not
    used, and ids may be null or repeat: every row comes back.  Entries become floor(scale * c),
    held to 2^53 at either end.  Vectors of different lengths are different spaces, each with its
    own n, components and error; one with fewer entries than ``components`` has that many
    components, an empty vector none.  Where a component has no variance (one distinct vector,
    a constant or dependent dimension) whitened is null, and explained too if nothing varies;
    such components take no part in identity_error (null if all are such).  A deviation beyond
    64 bits is null.

    ``identity_error`` is measured: the covariance of the whitened values over the distinct
    vectors, by two more aggregations.  Rows of vectors that make up more than 1/1024 of all rows
    get their result from a broadcast of at most 1023 vectors, others by a shuffled join.
    """
    rows = df.where(usable(vector)).select(F.col(id_col).alias("id"), integers(vector, scale).alias("x"))
    distinct = store(rows.groupBy("x").agg(F.count("*").alias("copies")), "vectors")
    model = fit(distinct, weights)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, at, x in _matrices(batch):
                m, k = model[p], min(p, components)
                e = m["values"][:k]
                there = e > max(m["values"][0] if p else 0, 0) * p * 1e-14
                z = (x - m["mean"]) @ m["vectors"][:, :k] / np.sqrt(np.where(there, e, 1))
                share = (e / m["trace"]).tolist() if m["trace"] > 0 else [None] * k
                lists = pa.list_(pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("x").take(pa.array(at)), batch.column("copies").take(pa.array(at)),
                     pa.array(np.full(len(at), m["n"])), pa.array(_deviation(x, m["n"], m["S"]), pa.int64()),
                     pa.array([[v if ok else None for v, ok in zip(row, there)] for row in z.tolist()], lists),
                     pa.array([share] * len(at), lists)],
                    names=["x", "copies", "n", "deviation", "z", "share"])

    done = store(distinct.mapInArrow(
        apply, "x array<long>, copies long, n long, deviation long, z array<double>, share array<double>"),
        "whitened")
    release(distinct)
    error = _identity_error(done, components, weights)
    total = done.agg(F.sum("copies")).first()[0] or 0
    done = done.join(error, F.size("x") == F.col("p")).drop("p")
    hot = done.where(F.col("copies") * HOT > total).drop("copies")
    rest = done.where(F.col("copies") * HOT <= total).drop("copies")
    found = rows.join(F.broadcast(hot), "x").unionByName(
        rows.join(F.broadcast(hot.select("x")), "x", "left_anti").join(rest, "x"))
    return found.select(
        "id", "n", "deviation", "identity_error",
        F.posexplode(F.arrays_zip("z", "share")).alias("place", "v"),
    ).select(F.col("id").alias(id_col), (F.col("place") + 1).alias("component"), "n", "deviation",
             F.col("v.z").alias("whitened"), F.col("v.share").alias("explained"), "identity_error")


def _identity_error(done: DataFrame, components: int, weights: str) -> DataFrame:
    """p, identity_error: the whitened values' covariance against the identity, centred first."""
    w = F.col("copies") if weights == "copies" else F.lit(1)
    z = [F.get("z", F.lit(i)) for i in range(components)]
    p = F.size("x").alias("p")
    means = store(done.groupBy(p).agg(F.sum(w).alias("m"), *[
        (F.sum(v * w) / F.sum(w)).alias(f"m{i}") for i, v in enumerate(z)]), "means")
    centred = done.withColumn("p", F.size("x")).join(means, "p")  # a row per length: Spark knows its size
    d = [v - F.col(f"m{i}") for i, v in enumerate(z)]
    pairs = [(i, j) for i in range(components) for j in range(i, components)]
    sums = centred.groupBy("p").agg(*[
        F.abs(F.sum(d[i] * d[j] * w) / F.sum(w) - (1.0 if i == j else 0.0)).alias(f"e{i}_{j}") for i, j in pairs])
    parts = [F.coalesce(F.col(f"e{i}_{j}"), F.lit(-1.0)) for i, j in pairs]
    worst = F.greatest(*parts) if len(parts) > 1 else parts[0]
    out = store(sums.select("p", F.when(worst >= 0, worst).alias("identity_error")), "error")
    release(means)
    return out

"""How good and how stable a clustering is."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialframe.columns import col
from trialframe.operators.features import Features
from trialframe.operators.kmeans import World, fit_models, poisson_weights, row_hash
from trialframe.operators.mixture import Mixture, fit_mixtures, log_joint
from trialframe.plans.arrays import array_sum, square_distances, to_lists, to_matrix
from trialframe.plans.blockpairs import BLOCK_ROWS, over_block_pairs, tiles

MAX_CLUSTERS = 1_000
#: Rows and columns of the distances that are worked at once: 1 MB, for a core's cache.
TILE = 256, 512


def _label_counts(df: DataFrame, labels: Sequence[str]) -> list[dict[int, int]]:
    """Rows per label of each labeling (at most MAX_CLUSTERS numbers each)."""
    rows = cluster_sizes(df, labels).limit(MAX_CLUSTERS * len(labels) + 1).collect()
    if len(rows) > MAX_CLUSTERS * len(labels):
        raise ValueError(f"more than {MAX_CLUSTERS} clusters in a labeling")
    out: list[dict[int, int]] = [{} for _ in labels]
    where = {name: i for i, name in enumerate(labels)}
    for r in rows:
        out[where[r["labeling"]]][r["label"]] = r["n"]
    return out


def cluster_sizes(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """(labeling, label, n) of integer label columns."""
    cells = F.array(
        *[F.struct(F.lit(c).alias("labeling"), col(c).cast("int").alias("label")) for c in labels]
    )
    return (
        df.select(F.inline(cells)).filter(F.col("label").isNotNull())
        .groupBy("labeling", "label").agg(F.count("*").alias("n"))
    )


def silhouette_values(
    df: DataFrame, labels: Sequence[str], id_col: str, width: int,
    metric: str = "euclidean", block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(x, labels…, n, s array<double>): silhouettes of distinct (x, labels) with multiplicity.

    ``euclidean`` needs all pairs of distinct rows; distances are computed once for all
    labelings.  ``sqeuclidean`` has a closed form in cluster sums and needs one scan.
    """
    counts = _label_counts(df, labels)
    codes = [sorted(c) for c in counts]
    points = df.groupBy("x", *[col(c).cast("int").alias(c) for c in labels]).agg(
        F.count("*").alias("n")
    )
    starts = np.cumsum([0, *[len(c) for c in codes]])
    total = int(starts[-1])
    if metric == "sqeuclidean":
        sums = _square_sums(df, points, labels, codes, width)
    elif metric == "euclidean":
        sums = _pair_sums(points, labels, codes, starts, total, width, block_rows)
    else:
        raise ValueError(f"unknown metric {metric!r}")
    scores = []
    for i, name in enumerate(labels):
        sizes = F.array(*[F.lit(float(counts[i][c])) for c in codes[i]])
        part = F.slice(F.col("s"), int(starts[i]) + 1, len(codes[i]))
        own = F.array_position(F.array(*[F.lit(c) for c in codes[i]]), F.col(name)).cast("int")
        n_own = F.element_at(sizes, own)
        a = F.element_at(part, own) / (n_own - 1)
        means = F.zip_with(part, sizes, lambda s, m: s / m)
        others = F.filter(means, lambda v, j: j != own - 1)
        b = F.array_min(others)
        score = F.when(n_own > 1, F.coalesce((b - a) / F.nullif(F.greatest(a, b), F.lit(0.0)),
                                             F.lit(0.0))).otherwise(0.0)
        scores.append(F.when(F.lit(len(codes[i]) > 1), score))
    return sums.select("x", *[col(c) for c in labels], "n", F.array(*scores).alias("s"))


def _pair_sums(points, labels, codes, starts, total, p, block_rows):
    """Sum of distances from every point to every cluster of every labeling."""
    keyed = points.withColumn(
        "pid", F.xxhash64("x", *[col(c) for c in labels])
    )
    n = points.count()
    lookup = [{c: j for j, c in enumerate(cs)} for cs in codes]

    def work(left: pa.Table, right: pa.Table | None) -> pa.Table:
        def parts(t, rows):
            w = t.column("n").to_numpy().astype("float64")
            slots = np.full((t.num_rows, len(labels)), -1)
            for i, name in enumerate(labels):
                slots[:, i] = [lookup[i].get(v, -1) for v in t.column(name).to_pylist()]
            order = np.lexsort(slots.T)  # rows of the same clusters stand together
            slots, w = slots[order], w[order]
            cut = []
            for at in tiles(len(slots), rows):
                own = slots[at]
                new = np.r_[True, (own[1:] != own[:-1]).any(axis=1)]
                first, run = np.flatnonzero(new), np.cumsum(new) - 1
                times = np.zeros((len(own), len(first)))  # rows x runs of rows of the same clusters
                times[np.arange(len(own)), run] = w[at]
                mark = np.zeros((len(first), total))
                for i in range(len(labels)):
                    of = own[first, i]
                    mark[np.flatnonzero(of >= 0), starts[i] + of[of >= 0]] = 1.0
                cut.append((at, [times, mark] if len(first) < total else [times @ mark]))
            return to_matrix(t.column("x"), p)[order], cut, t.column("pid").to_numpy()[order]

        # A block with itself is worked in both orders and adds to its rows only.
        a, cut_a, ia = parts(left, TILE[0])
        b, cut_b, ib = parts(left if right is None else right, TILE[1])
        # |a|² + |b|² − 2ab as one product, in a buffer that a core's cache holds
        a = np.column_stack([-2.0 * a, (a * a).sum(axis=1), np.ones(len(a))])
        b = np.column_stack([b, np.ones(len(b)), (b * b).sum(axis=1)]).T
        sa, sb = np.zeros((len(ia), total)), np.zeros((len(ib), total))
        room = np.empty(TILE[0] * TILE[1])
        for j, of_b in cut_b:
            columns = np.ascontiguousarray(b[:, j])
            for i, of_a in cut_a:
                m, k = i.stop - i.start, j.stop - j.start
                d = np.matmul(a[i], columns, out=room[:m * k].reshape(m, k))
                if right is None:
                    same = np.arange(max(i.start, j.start), min(i.stop, j.stop))
                    d[same - i.start, same - j.start] = 0.0
                np.sqrt(np.maximum(d, 0.0, out=d), out=d)
                sa[i] += reduce(np.matmul, of_b, d)
                if right is not None:
                    sb[j] += reduce(np.matmul, of_a[1:], d.T @ of_a[0])
        ids, sums = (ia, sa) if right is None else (np.concatenate([ia, ib]), np.concatenate([sa, sb]))
        return pa.table({"pid": pa.array(ids), "s": to_lists(sums, pa.float64())})

    found = over_block_pairs(
        keyed, "pid", n, work, "pid long, s array<double>", block_rows, 8 * (p + 2 * total))
    added = found.groupBy("pid").agg(array_sum("s", total).alias("s"))
    return keyed.join(added, "pid")


def _square_sums(df, points, labels, codes, p):
    """Σ‖x − y‖² over a cluster = m·‖x − c‖² + w, from the clusters' means c and spreads w."""
    moments = _cluster_moments(df, labels, p, codes)
    means = np.concatenate([m.means for m in moments])
    sizes = np.concatenate([m.sizes for m in moments])
    spread = np.concatenate([m.within for m in moments])

    @F.arrow_udf("array<double>")
    def sums(x: pa.Array) -> pa.Array:
        d = square_distances(to_matrix(x, p), means)
        return to_lists(d * sizes + spread, pa.float64())

    return points.withColumn("s", sums("x"))


def silhouette(
    df: DataFrame, labels: Sequence[str], id_col: str, width: int,
    metric: str = "euclidean", block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(labeling, silhouette): mean over all rows; NaN with fewer than two clusters."""
    values = silhouette_values(df, labels, id_col, width, metric, block_rows)
    means = values.agg(
        *[
            (F.sum(F.col("s")[i] * F.col("n")) / F.sum(F.when(F.col("s")[i].isNotNull(),
                                                              F.col("n")))).alias(f"m{i}")
            for i in range(len(labels))
        ]
    )
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("labeling"),
                     F.coalesce(F.col(f"m{i}"), F.lit(math.nan)).alias("silhouette"))
            for i, c in enumerate(labels)
        ]
    )
    return means.select(F.inline(rows))


@dataclass
class Moments:
    """Sizes, means and within sums of squares of the clusters of one labeling."""

    sizes: np.ndarray
    means: np.ndarray
    within: np.ndarray


def _slots(batch: pa.RecordBatch, codes: Sequence[Sequence[int]]) -> list[np.ndarray]:
    """Per labeling (columns 1 …): the cluster's position, −1 where there is no label."""
    out = []
    for i, known in enumerate(codes):
        raw = batch.column(i + 1).to_numpy(zero_copy_only=False).astype("float64")
        at = np.searchsorted(known, np.nan_to_num(raw, nan=0.0))
        out.append(np.where(np.isnan(raw), -1, at).astype("int64"))
    return out


def _cluster_moments(
    df: DataFrame, labels: Sequence[str], p: int, codes: Sequence[Sequence[int]] | None = None
) -> list[Moments]:
    """Two passes for all labelings together: sums, then squared distances to the own mean.

    A task sends on one row per cluster; clusters × p numbers reach the driver.
    """
    codes = codes or [sorted(c) for c in _label_counts(df, labels)]
    starts = np.cumsum([0, *[len(c) for c in codes]])
    total = int(starts[-1])
    known = [np.array(c, dtype="float64") for c in codes]
    source = df.select("x", *[col(c).cast("int") for c in labels])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = np.zeros(total), np.zeros((total, p))
        for batch in batches:
            x = to_matrix(batch.column(0), p)
            for i, at in enumerate(_slots(batch, known)):
                hot = np.zeros((len(x), len(codes[i])))
                ok = at >= 0
                hot[np.flatnonzero(ok), at[ok]] = 1.0
                n[starts[i] : starts[i + 1]] += hot.sum(axis=0)
                s[starts[i] : starts[i + 1]] += hot.T @ x
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(total), pa.int32()), pa.array(n), to_lists(s, pa.float64())],
            names=["slot", "n", "s"],
        )

    n, mean = np.zeros(total), np.zeros((total, p))
    for r in source.mapInArrow(sums, "slot int, n double, s array<double>").groupBy("slot").agg(
        F.sum("n").alias("n"), array_sum("s", p).alias("s")
    ).collect():
        n[r["slot"]] = r["n"]
        mean[r["slot"]] = np.array(r["s"]) / max(r["n"], 1.0)

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.zeros(total)
        for batch in batches:
            x = to_matrix(batch.column(0), p)
            for i, at in enumerate(_slots(batch, known)):
                ok = at >= 0
                off = x[ok] - mean[starts[i] + at[ok]]
                w[starts[i] : starts[i + 1]] += np.bincount(
                    at[ok], weights=(off * off).sum(axis=1), minlength=len(codes[i])
                )
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(total), pa.int32()), pa.array(w)], names=["slot", "w"]
        )

    within = np.zeros(total)
    for r in source.mapInArrow(squares, "slot int, w double").groupBy("slot").agg(
        F.sum("w").alias("w")
    ).collect():
        within[r["slot"]] = r["w"]
    cuts = list(zip(starts[:-1], starts[1:]))
    return [Moments(n[a:b], mean[a:b], within[a:b]) for a, b in cuts]


def within_ss(df: DataFrame, labels: Sequence[str], width: int) -> DataFrame:
    """(labeling, within_ss): squared distances to the own cluster's mean."""
    rows = [
        (name, float(m.within.sum()))
        for name, m in zip(labels, _cluster_moments(df, labels, width))
    ]
    return df.sparkSession.createDataFrame(rows, "labeling string, within_ss double")


def calinski_harabasz(df: DataFrame, labels: Sequence[str], width: int) -> DataFrame:
    """(labeling, calinski) = (B / (k − 1)) / (W / (n − k)); NaN with fewer than two clusters."""
    rows = []
    for name, m in zip(labels, _cluster_moments(df, labels, width)):
        k, n, w = len(m.sizes), m.sizes.sum(), m.within.sum()
        value = math.nan
        if k > 1 and n > k:
            grand = (m.sizes[:, None] * m.means).sum(axis=0) / n
            between = float((m.sizes * ((m.means - grand) ** 2).sum(axis=1)).sum())
            # Identical rows within every cluster: the score is 1 by convention.
            value = (between / (k - 1)) / (float(w) / (n - k)) if w > 0 else 1.0
        rows.append((name, float(value)))
    return df.sparkSession.createDataFrame(rows, "labeling string, calinski double")


# ---------------------------------------------------------------- agreement of labelings


def _pairs(n):
    return n * (n - 1) / 2


def _exact_pairs(n):
    """The same for a column, exact beyond 2^53."""
    n = n.cast("decimal(19,0)")
    return ((n * (n - 1)) / 2).cast("decimal(38,0)")


def jaccard(df: DataFrame, first: str, second: str) -> DataFrame:
    """One row: co-membership Jaccard of two label columns over rows with both labels.

    From the contingency table: pairs together in both / in either; 0 when there are none.
    """
    a, b = col(first), col(second)
    table = df.filter(a.isNotNull() & b.isNotNull()).groupBy(
        a.alias("a"), b.alias("b")
    ).agg(F.count("*").alias("n"))
    total = F.coalesce(F.sum(_exact_pairs(F.col("n"))), F.lit(0)).cast("decimal(38,0)")
    both = table.agg(total.alias("both"))
    left = table.groupBy("a").agg(F.sum("n").alias("n")).agg(total.alias("left"))
    right = table.groupBy("b").agg(F.sum("n").alias("n")).agg(total.alias("right"))
    one = both.withColumn("one", F.lit(1)).join(left.withColumn("one", F.lit(1)), "one").join(
        right.withColumn("one", F.lit(1)), "one"
    )
    either = (F.col("left") + F.col("right") - F.col("both")).cast("decimal(38,0)")
    share = F.col("both").cast("double") / either.cast("double")
    return one.select(
        F.col("both").cast("long").alias("pairs_both"),
        either.cast("long").alias("pairs_either"),
        F.when(either > 0, share).otherwise(0.0).alias("jaccard"),
    )


def bootstrap_stability(
    feats: Features, method: str = "kmeans", k: int = 3, n_bootstrap: int = 100,
    fraction: float = 0.8, seed: int = 42, n_init: int = 10,
) -> DataFrame:
    """One row: mean, sd, min of the pairwise Jaccard of bootstrap clusterings, is_stable.

    A row occurs Poisson(fraction) times in a replicate; rows that occur keep one label.  All
    contingency tables of all replicate pairs come from one pass over the rows' labels.
    """
    if method == "kmeans":
        worlds = [World("bootstrap", b, fraction) for b in range(n_bootstrap)]
        models = fit_models(feats, [(k, w) for w in worlds], n_init, seed)
        labelled = _replicate_labels(feats, models, seed, fraction)
    elif method == "gmm":
        worlds = [World("bootstrap", b, fraction) for b in range(n_bootstrap)]
        labelled = _replicate_labels(feats, fit_mixtures(feats, [(k, w) for w in worlds], 1, seed), seed, fraction)
    elif method == "agglomerative":
        labelled = _refit_labels(feats, k, n_bootstrap, fraction, seed)
    else:
        raise ValueError(f"unknown method {method!r}")
    tables = _contingency(labelled, n_bootstrap, k)
    scores = _pair_jaccard(tables, n_bootstrap, k)
    mean = float(np.mean(scores)) if len(scores) else math.nan
    row = (method, k, n_bootstrap, len(scores), mean,
           float(np.std(scores)) if len(scores) else math.nan,
           float(np.min(scores)) if len(scores) else math.nan, mean >= 0.75)
    return feats.frame.sparkSession.createDataFrame(
        [row],
        "method string, k int, n_bootstrap int, n_pairs long, mean_jaccard double, "
        "std_jaccard double, min_jaccard double, is_stable boolean",
    )


def _replicate_labels(feats: Features, models, seed: int, fraction: float) -> DataFrame:
    """One array per row: its label in each replicate, −1 where it does not occur."""
    p = feats.width

    def labeller(m):
        if isinstance(m, Mixture):
            parts = m.means, *m.whitener()
            return lambda x: log_joint(x, *parts).argmax(axis=1)
        centers = m.centers
        return lambda x: square_distances(x, centers).argmin(axis=1)

    labellers = [labeller(m) for m in models]

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = to_matrix(batch.column(1), p)
            h = batch.column(0).to_numpy(zero_copy_only=False)
            out = np.full((len(x), len(labellers)), -1, dtype="int32")
            for b, nearest in enumerate(labellers):
                there = poisson_weights(h, b, fraction) > 0
                out[there, b] = nearest(x[there])
            yield pa.RecordBatch.from_arrays([to_lists(out, pa.int32())], names=["l"])

    return feats.frame.select(row_hash(feats.id_col, seed), "x").mapInArrow(label, "l array<int>")


def _refit_labels(feats: Features, k, n_bootstrap, fraction, seed) -> DataFrame:
    """The same for Ward, which is fitted one replicate at a time, on weighted rows."""
    from dataclasses import replace

    from trialframe.operators.ward import ward

    def times(b: int):
        @F.arrow_udf("double")
        def weight(h: pa.Array) -> pa.Array:
            return pa.array(poisson_weights(h.to_numpy(zero_copy_only=False), b, fraction))

        return weight(row_hash(feats.id_col, seed))

    parts = []
    for b in range(n_bootstrap):
        sample = feats.frame.withColumn("__w", times(b)).filter("__w > 0")
        rep = replace(feats, frame=sample, cached=False)
        parts.append(ward(rep, [k], weights="__w").select(
            col(feats.id_col).alias("id"), F.lit(b).alias("b"),
            col(f"agglomerative_{k}").alias("label")))
    long = reduce(DataFrame.unionByName, parts)
    labels = F.array(*[
        F.coalesce(F.max(F.when(F.col("b") == b, F.col("label"))), F.lit(-1))
        for b in range(n_bootstrap)
    ])
    return long.groupBy("id").agg(labels.alias("l")).select("l")


def _contingency(labelled: DataFrame, replicates: int, k: int) -> np.ndarray:
    """Counts of all label pairs of all replicate pairs: (replicates·k)² numbers."""
    width = replicates * k

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            l = to_matrix(batch.column(0), replicates).astype("int64")
            hot = np.zeros((len(l), width), dtype="float32")
            row, rep = np.nonzero(l >= 0)
            hot[row, rep * k + l[row, rep]] = 1.0
            total += hot.T @ hot
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(width), pa.int32()), to_lists(total, pa.float64())],
            names=["i", "s"],
        )

    partial = labelled.mapInArrow(count, "i int, s array<double>")
    if width <= 1_000:
        rows = partial.groupBy("i").agg(array_sum("s", width).alias("s")).collect()
    else:
        cells = partial.select("i", F.posexplode("s").alias("j", "v")).groupBy("i", "j").agg(
            F.sum("v").alias("v")
        )
        rows = cells.groupBy("i").agg(
            F.transform(F.sort_array(F.collect_list(F.struct("j", "v"))), lambda t: t["v"])
            .alias("s")
        ).collect()
    out = np.zeros((width, width))
    for r in rows:
        out[r["i"]] = r["s"]
    return out


def _pair_jaccard(tables: np.ndarray, replicates: int, k: int) -> list[float]:
    scores = []
    for i in range(replicates):
        for j in range(i + 1, replicates):
            t = tables[i * k : (i + 1) * k, j * k : (j + 1) * k]
            if t.sum() == 0:
                continue
            both = _pairs(t).sum()
            either = _pairs(t.sum(axis=1)).sum() + _pairs(t.sum(axis=0)).sum() - both
            scores.append(float(both / either) if either > 0 else 0.0)
    return scores


# ---------------------------------------------------------------- choosing k


def gap_statistic(
    feats: Features, ks: Sequence[int] = range(2, 7), n_references: int = 10, n_init: int = 10,
    seed: int = 42, box: str = "global",
) -> tuple[DataFrame, int]:
    """(k, gap, s, log_w, is_optimal) and the chosen k (k-means only).

    References are uniform over the range of all features together (``box="global"``) or of
    each feature (``"feature"``).  gap = mean log W_ref − log W; s = σ·√(1 + 1/B); the choice is
    the first k with gap(k) ≥ gap(k+1) − s(k+1), else the first k.
    """
    ks = [k for k in ks if k <= feats.n]
    if not ks:
        raise ValueError("no possible k")
    if box not in ("global", "feature"):
        raise ValueError("box is 'global' or 'feature'")
    edges = tuple(feats.box) if box == "feature" else tuple(
        (feats.low, feats.high) for _ in feats.names
    )
    wanted = [(k, World()) for k in ks] + [
        (k, World("uniform", b, 1.0, edges)) for k in ks for b in range(n_references)
    ]
    models = fit_models(feats, wanted, n_init, seed)
    rows = []
    for i, k in enumerate(ks):
        start = len(ks) + i * n_references
        reference = np.log([m.inertia for m in models[start : start + n_references]])
        w = math.log(models[i].inertia) if models[i].inertia > 0 else -math.inf
        rows.append((k, float(reference.mean() - w),
                     float(reference.std() * math.sqrt(1 + 1 / n_references)), w))
    table = gap_rule(feats.frame.sparkSession.createDataFrame(
        rows, "k int, gap double, s double, log_w double"))
    chosen = table.filter("is_optimal").select("k").first()["k"]
    return table, int(chosen)


def gap_rule(table: DataFrame) -> DataFrame:
    """Marks the chosen k of a (k, gap, s) table with one row per k."""
    w = Window.orderBy("k")
    passes = table.withColumn(
        "__ok", F.col("gap") >= F.lead("gap").over(w) - F.lead("s").over(w)
    )
    every = Window.partitionBy()
    first_ok = F.min(F.when(F.col("__ok"), F.col("k"))).over(every)
    chosen = F.coalesce(first_ok, F.min("k").over(every))
    return passes.withColumn("is_optimal", F.col("k") == chosen).drop("__ok")


def optimal_k(metrics: DataFrame, min_cluster_size: int = 10) -> DataFrame:
    """(method, optimal_k, silhouette, valid_k array): the highest silhouette among the k whose
    smallest cluster is large enough; null when there is none."""
    valid = F.col("min_size") >= min_cluster_size
    scored = valid & F.col("silhouette").isNotNull() & ~F.isnan("silhouette")
    return metrics.groupBy("method").agg(
        F.max_by("k", F.when(scored, F.struct("silhouette", -F.col("k")))).alias("optimal_k"),
        F.max(F.when(scored, F.col("silhouette"))).alias("silhouette"),
        F.sort_array(F.collect_list(F.when(valid, F.col("k")))).alias("valid_k"),
    )

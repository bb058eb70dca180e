"""Exact k-nearest-neighbour imputation without comparing all pairs of rows.

Distance between two rows (z-scored with the population σ): √(p / shared · Σ (x − y)²) over
the columns that both have, p being the number of columns.  A missing value becomes the mean
of the k nearest rows that have it; with fewer than k comparable rows, of all of them; with
none, the column mean.  Ties go to the smaller id.

How the work is kept small and spread out:

* Only rows with a gap ("receivers") search.  A sample of rows gives every receiver a radius
  within which its k neighbours surely lie: from a few rows first, then from those rows of a sample
  in proportion to the table that lie within it.  So a radius holds about as many rows, and a cell as
  many donors, in a large table as in a small one.
* The rows that give values ("donors") are put in cells that a few threshold splits of the
  sample define.  A receiver is sent only to cells that its radius reaches, found with a
  lower bound of the distance to the cell.  Rows lacking the split column have a branch of
  their own, so incomplete donors are searched as well.
* Cells with many donors or receivers (copies of one row cannot be split by thresholds) are
  salted into blocks of bounded size; each block sends on at most k donors per gap.

The radius and bound only rule out rows that cannot be neighbours, so results are exact.
Equal rows are searched for once, and of equal donors only the k with the smallest ids can
ever be chosen, so copies cost nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialframe.columns import col, num
from trialframe.plans.onepass import fitted, per_variable

SAMPLE_ROWS = 4_000
#: Of a larger table one row in so many is in the sample, up to a number that every task can hold.
SAMPLE_SHARE = 16
MOST_SAMPLE_ROWS = 65_536
CELL_SAMPLE_ROWS = 60
DONOR_BLOCK = 20_000
RECEIVER_BLOCK = 10_000


class Cells:
    """Threshold splits with three branches: at most, above, missing."""

    def __init__(self, sample: np.ndarray):
        self.p = sample.shape[1]
        self.nodes: list[tuple] = []
        self.lo: list[np.ndarray] = []
        self.hi: list[np.ndarray] = []
        self._grow(sample, np.full(self.p, -np.inf), np.full(self.p, np.inf), frozenset())
        self.low, self.high = np.array(self.lo), np.array(self.hi)

    def _leaf(self, lo, hi) -> int:
        self.lo.append(lo)
        self.hi.append(hi)
        self.nodes.append(("leaf", len(self.lo) - 1))
        return len(self.nodes) - 1

    def _grow(self, rows, lo, hi, absent) -> int:
        best, spread, cut = None, 0.0, 0.0
        if len(rows) > CELL_SAMPLE_ROWS:
            for j in range(self.p):
                if j in absent:
                    continue
                x = rows[:, j]
                x = x[~np.isnan(x)]
                if len(x) * 2 < len(rows) or len(x) < 2:
                    continue
                t = float(np.sort(x)[(len(x) - 1) // 2])
                if t < x.max() and x.std() > spread:
                    best, spread, cut = j, float(x.std()), t
        if best is None:
            return self._leaf(lo, hi)
        here = len(self.nodes)
        self.nodes.append(())
        x = rows[:, best]
        upper, lower = hi.copy(), lo.copy()
        upper[best], lower[best] = cut, cut
        left = self._grow(rows[x <= cut], lo, upper, absent)
        right = self._grow(rows[x > cut], lower, hi, absent)
        gone = self._grow(rows[np.isnan(x)], lo, hi, absent | {best})
        self.nodes[here] = ("split", best, cut, left, right, gone)
        return here

    def locate(self, x: np.ndarray) -> np.ndarray:
        """Cell of every row."""
        out = np.empty(len(x), dtype="int32")
        stack = [(0, np.arange(len(x)))]
        while stack:
            at, rows = stack.pop()
            if not len(rows):
                continue
            node = self.nodes[at]
            if node[0] == "leaf":
                out[rows] = node[1]
                continue
            _, j, cut, left, right, gone = node
            v = x[rows, j]
            stack += [(left, rows[v <= cut]), (right, rows[v > cut]), (gone, rows[np.isnan(v)])]
        return out

    def bounds2(self, x: np.ndarray) -> np.ndarray:
        """Squared lower bounds of the distance from rows to cells."""
        total = np.zeros((len(x), len(self.low)))
        for j in range(self.p):
            v = x[:, j, None]
            gap = np.maximum(np.maximum(self.low[None, :, j] - v, v - self.high[None, :, j]), 0.0)
            total += np.where(np.isnan(v), 0.0, gap) ** 2
        present = np.maximum((~np.isnan(x)).sum(axis=1), 1)
        return total * (self.p / present)[:, None]


def distances2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances over shared columns, scaled up to all; inf without a shared column."""
    p = a.shape[1]
    total = np.zeros((len(a), len(b)))
    shared = np.zeros((len(a), len(b)))
    for j in range(p):
        d = a[:, j, None] - b[None, :, j]
        ok = ~np.isnan(d)
        shared += ok
        total += np.where(ok, d, 0.0) ** 2
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(shared > 0, total * p / shared, np.inf)


def _radius2(x: np.ndarray, sample: np.ndarray, k: int) -> np.ndarray:
    """Squared search radius per row: the k-th sample distance, for its worst gap."""
    out = np.zeros(len(x))
    have = ~np.isnan(sample)
    for start in range(0, len(x), 500):
        part = x[start : start + 500]
        d = distances2(part, sample)
        for j in range(x.shape[1]):
            gap = np.isnan(part[:, j])
            if not gap.any():
                continue
            near = d[np.ix_(gap, have[:, j])]
            if near.shape[1] < k:
                reach = np.full(int(gap.sum()), np.inf)
            else:
                reach = np.partition(near, k - 1, axis=1)[:, k - 1]
            view = out[start : start + 500]
            view[gap] = np.maximum(view[gap], reach)
    return out


def _closer2(x: np.ndarray, radius: np.ndarray, sample: np.ndarray,
             members: Sequence[np.ndarray], reached: np.ndarray, k: int) -> np.ndarray:
    """The radius again, from all sample rows of the cells that the first one reaches."""
    rows, p = x.shape
    best = np.full((rows, p, k), np.inf)
    gaps = np.isnan(x)
    for c in np.flatnonzero(reached.any(axis=0)):
        if not len(members[c]):
            continue
        who = np.flatnonzero(reached[:, c])
        y = sample[members[c]]
        d, have = distances2(x[who], y), ~np.isnan(y)
        for j in range(p):
            some = np.flatnonzero(gaps[who, j])
            if not len(some) or not have[:, j].any():
                continue
            near = np.concatenate([best[who[some], j], d[np.ix_(some, have[:, j])]], axis=1)
            best[who[some], j] = np.partition(near, k - 1, axis=1)[:, :k]
    worst = np.where(gaps, best.max(axis=2), 0.0).max(axis=1)
    return np.minimum(radius, worst)


def _matrix(series: pd.Series, p: int) -> np.ndarray:
    return np.array(series.tolist(), dtype="float64").reshape(len(series), p)


def neighbours(
    df: DataFrame, id_col: str, x: Column, p: int, k: int
) -> tuple[DataFrame, DataFrame]:
    """(id, var int, donor, d2, value): the k nearest donors of every gap, and the searches
    (id, x), one per distinct row with a gap.  ``x``: z-scored values, NaN for a gap."""
    spark = df.sparkSession
    id_type = df.schema[id_col].dataType.simpleString()
    rows = df.select(col(id_col).alias("id"), x.alias("x"))
    many = min(MOST_SAMPLE_ROWS, max(SAMPLE_ROWS, rows.count() // SAMPLE_SHARE))
    sample_rows = rows.orderBy(F.xxhash64("id"), "id").limit(many).select("x").collect()
    sample = np.array([r["x"] for r in sample_rows], dtype="float64").reshape(-1, p)
    cells = Cells(sample)
    shared = spark.sparkContext.broadcast((cells, sample))  # at most MOST_SAMPLE_ROWS rows
    n_cells = len(cells.low)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        splits, _ = shared.value
        for batch in batches:
            yield batch.assign(cell=splits.locate(_matrix(batch["x"], p)))

    def reach(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        splits, known = shared.value
        at = splits.locate(known)
        order = np.argsort(at, kind="stable")
        members = np.split(order, np.searchsorted(at[order], np.arange(1, n_cells)))
        for batch in batches:
            x_all, found = _matrix(batch["x"], p), []
            for start in range(0, len(x_all), 1_000):
                x = x_all[start : start + 1_000]
                radius, bounds = _radius2(x, known[:SAMPLE_ROWS], k), splits.bounds2(x)
                ok = bounds <= (radius * (1 + 1e-9))[:, None]
                if len(known) > SAMPLE_ROWS:
                    radius = _closer2(x, radius, known, members, ok, k)
                    ok = bounds <= (radius * (1 + 1e-9))[:, None]
                found += [np.flatnonzero(row).astype("int32") for row in ok]
            yield batch.assign(cells=found)

    copies = Window.partitionBy("x").orderBy("id")
    donors = (
        rows.withColumn("copy", F.row_number().over(copies)).filter(F.col("copy") <= k)
        .select("id", "x")
        .mapInPandas(place, f"id {id_type}, x array<double>, cell int")
    )
    has_gap = F.exists("x", lambda v: F.isnan(v))
    searches = rows.filter(has_gap).groupBy("x").agg(F.min("id").alias("id")).select("id", "x")
    receivers = (
        searches.mapInPandas(reach, f"id {id_type}, x array<double>, cells array<int>")
        .select("id", "x", F.explode("cells").alias("cell"))
    )
    # Cell sizes decide the salts: at most n_cells numbers come back.
    per_cell = {r["cell"]: r["n"] for r in donors.groupBy("cell").agg(
        F.count("*").alias("n")).collect()}
    wants = {r["cell"]: r["n"] for r in receivers.groupBy("cell").agg(
        F.count("*").alias("n")).collect()}
    salts = F.array(*[F.lit(math.ceil(per_cell.get(i, 1) / DONOR_BLOCK)) for i in range(n_cells)])
    slots = F.array(*[F.lit(math.ceil(wants.get(i, 1) / RECEIVER_BLOCK)) for i in range(n_cells)])
    n_salt, n_slot = salts[F.col("cell")], slots[F.col("cell")]
    mix = F.xxhash64("id", F.lit(17))
    d = donors.withColumn("salt", F.pmod(mix, n_salt).cast("int")).withColumn(
        "slot", F.explode(F.sequence(F.lit(0), n_slot - 1))
    )
    r = receivers.withColumn("slot", F.pmod(mix, n_slot).cast("int")).withColumn(
        "salt", F.explode(F.sequence(F.lit(0), n_salt - 1))
    )

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            give = right.sort_values("id", kind="stable")
            y = _matrix(give["x"], p)
            gid = give["id"].to_numpy()
            have = ~np.isnan(y)
            x_all, ids = _matrix(left["x"], p), left["id"].to_numpy()
            for start in range(0, len(x_all), 256):
                x = x_all[start : start + 256]
                d2 = distances2(x, y)
                for j in range(p):
                    gap = np.flatnonzero(np.isnan(x[:, j]))
                    offer = np.flatnonzero(have[:, j])
                    if not len(gap) or not len(offer):
                        continue
                    near = d2[np.ix_(gap, offer)]
                    top = np.argsort(near, axis=1, kind="stable")[:, :k]
                    dist = np.take_along_axis(near, top, axis=1)
                    keep = np.isfinite(dist)
                    row, _ = np.nonzero(keep)
                    who = offer[top[keep]]
                    found.append(
                        pd.DataFrame(
                            {
                                "id": ids[start + gap[row]],
                                "var": np.full(len(who), j, dtype="int32"),
                                "donor": gid[who],
                                "d2": dist[keep],
                                "value": y[who, j],
                            }
                        )
                    )
        if found:
            return pd.concat(found, ignore_index=True)
        return pd.DataFrame({"id": left["id"].iloc[:0], "var": pd.Series(dtype="int32"),
                             "donor": left["id"].iloc[:0], "d2": pd.Series(dtype="float64"),
                             "value": pd.Series(dtype="float64")})

    keys = ("cell", "salt", "slot")
    found = (
        r.groupBy(*keys)
        .cogroup(d.groupBy(*keys))
        .applyInPandas(
            search, f"id {id_type}, var int, donor {id_type}, d2 double, value double"
        )
    )
    w = Window.partitionBy("id", "var").orderBy("d2", "donor")
    near = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return near, searches


def impute_knn(
    df: DataFrame, id_col: str, cols: Sequence[str], k: int = 5, flags: bool = False
) -> DataFrame:
    """Fill the gaps of numeric columns from the k nearest rows.  ``id_col`` must be unique."""
    moments = fitted(per_variable(df, cols, {"n": F.count, "mean": F.avg, "sd": F.stddev_pop}))
    # A column without any value takes no part and stays null; without spread it is divided by 1.
    used = [c for c in cols if moments[c]["n"]]
    for c in used:
        moments[c]["sd"] = moments[c]["sd"] or 1.0
    marks = [col(c).isNull().alias(f"{c}__imputed") for c in used] if flags else []
    if not used:
        return df
    x = F.array(*[
        F.coalesce((num(c) - moments[c]["mean"]) / moments[c]["sd"], F.lit(float("nan")))
        for c in used
    ])
    near, searches = neighbours(df, id_col, x, len(used), k)
    means = (
        near.groupBy("id", "var").agg(F.avg("value").alias("z"))
        .groupBy("id")
        .agg(*[F.max(F.when(F.col("var") == i, F.col("z"))).alias(f"__z{i}")
               for i in range(len(used))])
    )
    filled = searches.join(means, "id").drop("id").withColumnRenamed("x", "__found")
    gap = F.lit(False)
    for c in used:
        gap = gap | col(c).isNull()
    order = {c: i for i, c in enumerate(used)}

    def value(c: str):
        m = moments[c]
        z = F.coalesce(F.col(f"__z{order[c]}"), F.lit(0.0))
        return F.coalesce(num(c), z * m["sd"] + m["mean"]).alias(c)

    # Complete rows are not shuffled: only rows with a gap meet the results.
    whole = df.filter(~gap).select(
        *[num(c).alias(c) if c in order else col(c) for c in df.columns], *marks
    )
    mended = df.filter(gap).withColumn("__x", x).join(
        filled, F.col("__x") == F.col("__found"), "left"
    ).select(
        *[value(c) if c in order else col(c) for c in df.columns], *marks
    )
    return whole.unionByName(mended)

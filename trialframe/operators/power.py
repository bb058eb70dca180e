"""Maximum-likelihood Yeo–Johnson exponents of many variables.

The profile likelihood of a λ needs the variance of the transformed values.  The values are packed
once; a pass gives (n, mean, M2) per variable and grid point from every block, and two such
triples of disjoint rows are merged by Chan's formula, so a task sends one short vector.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialframe.columns import num
from trialframe.plans.blocks import pack

#: (steps to each side, distance) of the grids: −6 … 6 first, then around the best λ.
GRIDS = ((24, 1 / 4), (8, 1 / 32), (8, 1 / 256))
# A record: n, Σ sign(x)·ln(1+|x|), smallest, largest, then the means and the M2 of all grid points.
HEAD = 4


def _record(points: int) -> int:
    """Length of a record: a power of two, so that cutting a long vector tears none."""
    return 1 << (HEAD + 2 * points - 1).bit_length()


def transformed_values(x: np.ndarray, lam: np.ndarray) -> np.ndarray:
    """ψ(x, λ), one row per λ."""
    size = np.log1p(np.abs(x))[None, :]
    up = (x >= 0)[None, :]
    power = np.where(up, lam[:, None], 2.0 - lam[:, None])
    flat = np.abs(power) < 1e-12
    return np.where(up, 1.0, -1.0) * np.where(flat, size, np.expm1(power * size) / np.where(flat, 1.0, power))


def _moments(x: np.ndarray, grid: np.ndarray) -> np.ndarray:
    points = grid.shape[1]
    out = np.zeros((len(grid), _record(points)))
    out[:, 2], out[:, 3] = np.inf, -np.inf
    for c, lam in enumerate(grid):
        v = x[:, c][~np.isnan(x[:, c])]
        if len(v):
            y = transformed_values(v, lam)
            mean = y.mean(axis=1)
            out[c, :HEAD] = len(v), (np.sign(v) * np.log1p(np.abs(v))).sum(), v.min(), v.max()
            out[c, HEAD:HEAD + points] = mean
            out[c, HEAD + points:HEAD + 2 * points] = ((y - mean[:, None]) ** 2).sum(axis=1)
    return out


def _join(a: np.ndarray, b: np.ndarray, points: int) -> np.ndarray:
    """Records of two disjoint sets of rows as records of all of them."""
    out = np.zeros_like(a)
    n = a[:, :1] + b[:, :1]
    share = np.divide(b[:, :1], n, out=np.zeros_like(n), where=n > 0)
    mean, m2 = slice(HEAD, HEAD + points), slice(HEAD + points, HEAD + 2 * points)
    delta = b[:, mean] - a[:, mean]
    out[:, 0], out[:, 1] = n[:, 0], a[:, 1] + b[:, 1]
    out[:, 2], out[:, 3] = np.minimum(a[:, 2], b[:, 2]), np.maximum(a[:, 3], b[:, 3])
    out[:, mean] = a[:, mean] + delta * share
    out[:, m2] = a[:, m2] + b[:, m2] + delta ** 2 * a[:, :1] * share
    return out


def _pass(blocks, grid: np.ndarray) -> np.ndarray:
    """One record per variable over all rows; ``grid`` is variables × λ."""
    points, width = grid.shape[1], _record(grid.shape[1])

    def merge(parts: list[np.ndarray]) -> np.ndarray:
        total = parts[0].reshape(-1, width)
        with np.errstate(over="ignore", invalid="ignore"):
            for more in parts[1:]:
                total = _join(total, more.reshape(-1, width), points)
        return total.ravel()

    def work(rows: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        total = _moments(np.empty((0, len(grid))), grid).ravel()
        with np.errstate(over="ignore", invalid="ignore"):
            for _, x in rows:
                total = merge([total, _moments(x, grid).ravel()])
        return total

    return blocks.reduce(work, merge, len(grid) * width).reshape(-1, width)


def fit_yeo_johnson(df: DataFrame, cols: Sequence[str]) -> dict[str, dict]:
    """Maximum-likelihood λ per variable, with mean and σ of the transformed values.

    The profile likelihood −n/2·ln var(ψ) + (λ−1)·Σ sign(x)·ln(1+|x|) of all variables is read on
    three grids, each around the best λ of the one before; a parabola through the best point of
    the last grid and its neighbours gives the final λ.  A λ whose variance overflows is left
    out.  Constant and empty variables keep λ = 1 and σ = 1 (mean null if empty).
    """
    cols = list(cols)
    if not cols:
        return {}
    rows = df.select(F.lit(0).cast("long").alias("h"), F.array(*[num(c) for c in cols]).alias("x"))
    blocks = pack(rows, df.count(), len(cols))
    try:
        best, varies = np.zeros(len(cols)), np.ones(len(cols), bool)
        for turn, (steps, distance) in enumerate(GRIDS):
            grid = best[:, None] + np.arange(-steps, steps + 1) * distance
            found = _pass(blocks, grid)
            points = grid.shape[1]
            if not turn:
                varies = found[:, 3] > found[:, 2]
            v = found[:, HEAD + points:HEAD + 2 * points] / np.maximum(found[:, :1], 1.0)
            usable = np.isfinite(v) & (v > 0)
            fit = np.where(usable, -found[:, :1] / 2 * np.log(np.where(usable, v, 1.0))
                           + (grid - 1.0) * found[:, 1:2], -np.inf)
            at = fit.argmax(axis=1)
            best = np.where(varies, grid[np.arange(len(cols)), at], 1.0)
        for c in np.flatnonzero(varies & (at > 0) & (at < points - 1)):
            low, top, high = fit[c, at[c] - 1:at[c] + 2]
            bend = low - 2 * top + high
            if np.isfinite(bend) and bend < 0:
                best[c] += 0.5 * distance * (low - high) / bend
        last = _pass(blocks, best[:, None])
    finally:
        blocks.release()
    out = {}
    for c, name in enumerate(cols):
        n, mean, m2 = last[c, 0], last[c, HEAD], last[c, HEAD + 1]
        sd = float(np.sqrt(m2 / n)) if varies[c] and n else 0.0
        out[name] = {"lambda": float(best[c]), "mean": float(mean) if n else None, "sd": sd or 1.0}
    return out

"""Shapiro–Wilk W and its p-value for one bounded sample (Royston 1995, algorithm AS R94)."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

from trialframe.functions.tails import normal_tail

# Published polynomial coefficients, lowest power first.
_A_LAST = (0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056)
_A_NEXT = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
_SMALL_MEAN = (0.5440, -0.39978, 0.025054, -6.714e-4)
_SMALL_SD = (1.3822, -0.77857, 0.062767, -0.0020322)
_LARGE_MEAN = (-1.5861, -0.31082, -0.083751, 0.0038915)
_LARGE_SD = (-0.4803, -0.082676, 0.0030302)
_GAMMA = (-2.273, 0.459)


def _poly(coefficients, x: float) -> float:
    return sum(c * x**i for i, c in enumerate(coefficients))


def _weights(n: int) -> np.ndarray:
    """Coefficients of the ordered sample, antisymmetric and of unit length."""
    if n == 3:
        return np.array([-math.sqrt(0.5), 0.0, math.sqrt(0.5)])
    inv = NormalDist().inv_cdf
    scores = np.array([inv((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    length2 = float(scores @ scores)
    unit = scores / math.sqrt(length2)
    root = 1.0 / math.sqrt(n)
    last = _poly(_A_LAST, root) + unit[-1]
    a = np.empty(n)
    if n > 5:
        nxt = _poly(_A_NEXT, root) + unit[-2]
        rest = length2 - 2 * scores[-1] ** 2 - 2 * scores[-2] ** 2
        scale = math.sqrt(rest / (1 - 2 * last**2 - 2 * nxt**2))
        a[2:-2] = scores[2:-2] / scale
        a[-2], a[1] = nxt, -nxt
    else:
        scale = math.sqrt((length2 - 2 * scores[-1] ** 2) / (1 - 2 * last**2))
        a[1:-1] = scores[1:-1] / scale
    a[-1], a[0] = last, -last
    return a


def shapiro_wilk(values: np.ndarray) -> tuple[float, float]:
    """(W, p); NaN below three values, (1, 1) for a constant sample."""
    x = np.sort(np.asarray(values, dtype="float64"))
    n = len(x)
    if n < 3:
        return math.nan, math.nan
    centred = x - x.mean()
    total = float(centred @ centred)
    if x[-1] == x[0] or total == 0.0:
        return 1.0, 1.0
    w = min(float(_weights(n) @ centred) ** 2 / total, 1.0)
    if n == 3:
        p = 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75)))
        return w, max(p, 0.0)
    if w >= 1.0:
        return w, 1.0
    y = math.log1p(-w)
    if n <= 11:
        limit = _poly(_GAMMA, n)
        if y >= limit:
            return w, 1e-99
        y = -math.log(limit - y)
        mean, sd = _poly(_SMALL_MEAN, n), math.exp(_poly(_SMALL_SD, n))
    else:
        ln = math.log(n)
        mean, sd = _poly(_LARGE_MEAN, ln), math.exp(_poly(_LARGE_SD, ln))
    return w, normal_tail((y - mean) / sd)

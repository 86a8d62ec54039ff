"""A slice sampler for one-dimensional densities (Neal 2003): step out, then shrink."""

from __future__ import annotations

import math

import numpy as np


def mode(log_density, lo: float, hi: float, steps: int = 80) -> float:
    """Golden-section search on (lo, hi), for densities with one mode there."""
    g = (math.sqrt(5) - 1) / 2
    a, b = lo, hi
    for _ in range(steps):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if log_density(c) >= log_density(d) else (c, b)
    return (a + b) / 2


def width(log_density, at: float) -> float:
    """About two standard deviations by the curvature at the mode."""
    h = max(abs(at), 1e-3) * 1e-3
    curve = (log_density(at + h) - 2 * log_density(at) + log_density(at - h)) / (h * h)
    return 2 / math.sqrt(-curve) if curve < 0 and math.isfinite(curve) else max(abs(at), 1.0)


def slice_sample(log_density, x: float, r: np.random.Generator, lo: float = 0.0, hi: float = math.inf, w: float | None = None, steps: int = 1) -> float:
    if w is None:
        top = hi if math.isfinite(hi) else max(10 * abs(x), 10.0)
        # any width will do: a round one does not carry the rounding of sums behind the density into the draw
        w = float(f"{width(log_density, mode(log_density, lo + 1e-9, top)):.2g}")
    for _ in range(steps):
        level = log_density(x) - r.exponential()
        a = max(lo, x - w * r.random())
        b = min(hi, a + w)
        for _ in range(100):
            if a <= lo or log_density(a) <= level:
                break
            a = max(lo, a - w)
        for _ in range(100):
            if b >= hi or log_density(b) <= level:
                break
            b = min(hi, b + w)
        while True:
            y = a + (b - a) * r.random()
            if y > lo and log_density(y) > level:
                x = y
                break
            a, b = (y, b) if y < x else (a, y)
            if b - a < 1e-14 * max(1.0, abs(x)):
                break
    return x

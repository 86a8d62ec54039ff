"""Scalar functions that Spark lacks, each as a column expression and, where sampling needs it, in numpy.

SQL texts are shared between Spark and the oracle, so both sides evaluate one formula."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Chebyshev coefficients of the complementary error function, relative error 1.2e-7 (fixed values, Press et al.).
_ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def phi_sql(x: str) -> str:
    """Normal distribution function of the SQL expression x, in SQL that Spark and DuckDB share."""
    z = f"(abs({x}) / 1.4142135623730951)"
    t = f"(1.0 / (1.0 + 0.5 * {z}))"
    poly = f"({_ERFC[-1]!r})"
    for c in _ERFC[-2:0:-1]:
        poly = f"({c!r} + {t} * {poly})"
    tail = f"(0.5 * {t} * exp(-{z} * {z} + ({_ERFC[0]!r}) + {t} * {poly}))"
    return f"(CASE WHEN ({x}) >= 0 THEN 1.0 - {tail} ELSE {tail} END)"


def phi_column(x: Column) -> Column:
    z = F.abs(x) / math.sqrt(2)
    t = F.lit(1.0) / (F.lit(1.0) + z * 0.5)
    poly = F.lit(_ERFC[-1])
    for c in _ERFC[-2:0:-1]:
        poly = t * poly + c
    tail = t * F.exp(-z * z + _ERFC[0] + t * poly) * 0.5
    return F.when(x >= 0, F.lit(1.0) - tail).otherwise(tail)


def phi(x: np.ndarray) -> np.ndarray:
    z = np.abs(x) / math.sqrt(2)
    t = 1 / (1 + 0.5 * z)
    poly = _ERFC[-1]
    for c in _ERFC[-2:0:-1]:
        poly = c + t * poly
    tail = 0.5 * t * np.exp(-z * z + _ERFC[0] + t * poly)
    return np.where(x >= 0, 1 - tail, tail)


def phi_inverse(p: np.ndarray) -> np.ndarray:
    """Normal quantiles: a rational start in the tail variable (Abramowitz and Stegun 26.2.23), then Newton steps."""
    p = np.clip(np.asarray(p, float), 1e-300, 1 - 1e-16)
    q = np.minimum(p, 1 - p)
    t = np.sqrt(-2 * np.log(q))
    x = t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t**3)
    for _ in range(3):
        upper = phi(-x)
        x = x + (upper - q) / np.maximum(np.exp(-0.5 * x * x) / math.sqrt(2 * math.pi), 1e-300)
    return np.where(p < 0.5, -x, x)


def chi2_cdf(x: float, df: float) -> float:
    """By the series of the lower incomplete gamma function, or the continued fraction of the upper."""
    a, x = df / 2, x / 2
    if x <= 0:
        return 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-16 * abs(total):
            n += 1
            term *= x / n
            total += term
        return front * total
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / max(an * d + b, tiny) if an * d + b > 0 else 1 / min(an * d + b, -tiny)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1 - front * h


def chi2_quantile(p: float, df: float) -> float:
    lo, hi = 0.0, max(1.0, df)
    while chi2_cdf(hi, df) < p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, df) < p else (lo, mid)
    return (lo + hi) / 2


def u01(*parts: Column) -> Column:
    """A number in [0, 1) from the md5 of the parts joined by |; the same in any engine and on any partition."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *(p.cast("string") for p in parts))), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def u01_sql(*parts: str) -> str:
    """DuckDB's text of u01."""
    return "(('0x' || substr(md5(" + " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts) + "), 1, 8))::BIGINT / 4294967296.0)"

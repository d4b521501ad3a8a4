"""Statistics that SQL lacks, in numpy, as Arrow-batched functions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def betainc(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function by its continued fraction (Lentz)."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float))
    swap = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    lg = np.vectorize(math.lgamma, otypes=[float])
    with np.errstate(all="ignore"):
        front = np.exp(lg(p + q) - lg(p) - lg(q) + p * np.log(z) + q * np.log1p(-z)) / p
        tiny = 1e-300
        f = np.ones_like(z)
        c, d = np.ones_like(z), 1 - (p + q) * z / (p + 1)
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        f = d.copy()
        for m in range(1, 300):
            for num in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
                d = 1 + num * d
                d = 1 / np.where(np.abs(d) < tiny, tiny, d)
                c = 1 + num / np.where(np.abs(c) < tiny, tiny, c)
                step = c * d
                f = f * step
            if np.all(np.abs(step - 1) < 1e-14):
                break
        out = front * f
    out = np.where(z <= 0, 0.0, out)
    return np.where(swap, 1 - out, out)


def chi2_cdf(x: float, k: float) -> float:
    """P(X <= x) for chi-square of k degrees: the lower incomplete gamma function, as a series or a continued fraction."""
    a, z = k / 2, x / 2
    if z <= 0:
        return 0.0
    front = math.exp(a * math.log(z) - z - math.lgamma(a))
    if z < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-16 * abs(total):
            n += 1
            term *= z / n
            total += term
        return front * total
    b, c = z + 1 - a, 1e300
    d = 1 / b
    f = d
    for i in range(1, 10_000):
        num = -i * (i - a)
        b += 2
        d = 1 / (num * d + b or 1e-300)
        c = b + num / c
        f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return 1 - front * f


def chi2_quantile(p: float, k: float) -> float:
    """The x at which chi2_cdf(x, k) = p, by bisection."""
    low, high = 0.0, max(1.0, k)
    while chi2_cdf(high, k) < p:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi2_cdf(middle, k) < p else (low, middle)
    return (low + high) / 2


def t_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    t, df = np.asarray(t, float), np.asarray(df, float)
    with np.errstate(all="ignore"):
        return np.where(df > 0, betainc(df / 2, 0.5, df / (df + t * t)), np.nan)


@F.pandas_udf(DoubleType())  # a type, not its name: workers import this without a session
def student_p(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p of Student's t."""
    out = pd.Series(t_two_sided(t.to_numpy(float), df.to_numpy(float)))
    return out.where(t.notna().to_numpy() & out.notna(), None)


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


ADJUSTMENTS = ("bonferroni", "sidak", "holm", "holm-sidak", "simes-hochberg", "fdr_bh", "fdr_by")


def adjust(p: np.ndarray, method: str = "bonferroni") -> np.ndarray:
    """p values adjusted for their number: of the family-wise error (bonferroni, sidak, holm, holm-sidak, simes-hochberg) or of the false discovery rate (fdr_bh, fdr_by)."""
    if method not in ADJUSTMENTS:
        raise ValueError(f"adjust: {method} is none of {', '.join(ADJUSTMENTS)}")
    n = len(p)
    if method == "bonferroni":
        return np.minimum(p * n, 1)
    if method == "sidak":
        return 1 - (1 - p) ** n
    order = np.argsort(p, kind="stable")
    up, rank = p[order], np.arange(1, n + 1)
    if method in ("holm", "holm-sidak"):
        one = up * (n - rank + 1) if method == "holm" else 1 - (1 - up) ** (n - rank + 1)
        one = np.maximum.accumulate(one)
    else:
        one = up * (n - rank + 1) if method == "simes-hochberg" else up * n / rank * (np.sum(1 / rank) if method == "fdr_by" else 1)
        one = np.minimum.accumulate(one[::-1])[::-1]
    out = np.empty(n)
    out[order] = np.minimum(one, 1)
    return out

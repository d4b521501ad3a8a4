"""Thresholds on a feature's distribution, and classes by them.

A group's histogram (256 bins between its smallest and largest value) is one aggregate; the threshold is found on the
histogram, which has a fixed size whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BINS = 256


def histogram(df: DataFrame, value: str, by: Sequence[str] = (), min_val: float | None = None, max_val: float | None = None, bins: int = BINS) -> DataFrame:
    """by, lo, hi, bin, n (bins with rows). Values strictly inside the window only."""
    x = F.col(value)
    df = df.filter(x.isNotNull())
    df = df if min_val is None else df.filter(x > min_val)
    df = df if max_val is None else df.filter(x < max_val)
    by = list(by)
    ends = df.groupBy(*by).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    rows = df.select(*by, value)
    rows = rows.join(ends, by) if by else rows.join(F.broadcast(ends), how="cross")  # one row
    at = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((x - F.col("lo")) / F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))).cast("int")
    return rows.withColumn("bin", at).groupBy(*by, "lo", "hi", "bin").agg(F.count(F.lit(1)).alias("n"))


def otsu_sql(hist: DataFrame, by: Sequence[str] = (), bins: int = BINS) -> DataFrame:
    """by, bin, threshold by between-class variance, with windows over the histogram; the first of equal bins."""
    by = list(by)
    center = F.col("lo") + (F.col("bin") + 0.5) * (F.col("hi") - F.col("lo")) / bins
    grid = hist.select(*by, "lo", "hi").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    full = grid.join(hist.select(*by, "bin", "n"), [*by, "bin"], "left").fillna(0, ["n"]).withColumn("c", center)
    up = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    w1, s1 = F.sum("n").over(up), F.sum(F.col("n") * F.col("c")).over(up)
    w2, s2 = F.sum("n").over(whole) - w1, F.sum(F.col("n") * F.col("c")).over(whole) - s1
    between = w1 * w2 * F.pow(F.try_divide(s1, w1) - F.try_divide(s2, w2), 2)
    scored = full.withColumn("v", F.round(F.coalesce(between, F.lit(0.0)), 6)).filter(F.col("bin") < bins - 1)
    return scored.groupBy(*by).agg(F.max_by(F.struct("bin", "c"), F.struct("v", -F.col("bin"))).alias("m")).select(*by, F.col("m.bin").alias("bin"), F.col("m.c").alias("threshold"))


# Thresholds on a histogram: (counts, centres) -> one or more.


def otsu(n: np.ndarray, c: np.ndarray) -> list[float]:
    w1 = np.cumsum(n).astype(float)
    w2 = np.cumsum(n[::-1])[::-1].astype(float)
    with np.errstate(all="ignore"):
        m1, m2 = np.cumsum(n * c) / w1, (np.cumsum((n * c)[::-1]) / np.cumsum(n[::-1]))[::-1]
        v = w1[:-1] * w2[1:] * (m1[:-1] - m2[1:]) ** 2
    return [float(c[int(np.nanargmax(v))])]


def isodata(n: np.ndarray, c: np.ndarray) -> list[float]:
    """The first centre that lies at most a bin's width below the middle of the two sides' means."""
    low = np.cumsum(n).astype(float)
    high = low[-1] - low
    with np.errstate(all="ignore"):
        lm, hm = np.cumsum(n * c) / low, ((n * c).sum() - np.cumsum(n * c)) / high
        d = (lm + hm) / 2 - c
    ok = np.flatnonzero((low > 0) & (high > 0) & (d >= 0) & (d < c[1] - c[0]))
    return [float(c[ok[0]])] if len(ok) else [float(c[0])]


def yen(n: np.ndarray, c: np.ndarray) -> list[float]:
    p = n / n.sum()
    a, b = np.cumsum(p), np.cumsum(p * p)
    rest = np.cumsum((p * p)[::-1])[::-1]
    with np.errstate(all="ignore"):
        crit = np.log((a[:-1] * (1 - a[:-1])) ** 2 / (b[:-1] * rest[1:]))
    crit[~np.isfinite(crit)] = -np.inf
    return [float(c[int(crit.argmax())])]


def triangle(n: np.ndarray, c: np.ndarray) -> list[float]:
    """The bin farthest from the line between the peak and the longer tail's end."""
    filled = np.flatnonzero(n)
    lo, hi, peak = filled[0], filled[-1], int(n.argmax())
    if lo == hi:
        return [float(c[lo])]
    flip = peak - lo < hi - peak
    if flip:
        n = n[::-1]
        lo, peak = len(n) - hi - 1, len(n) - peak - 1
    width, height = peak - lo, n[peak]
    norm = np.hypot(width, height)
    x = np.arange(width)
    far = height / norm * x - width / norm * n[lo : peak]
    at = int(far.argmax()) + lo
    return [float(c[len(n) - at - 1 if flip else at])]


def mean(n: np.ndarray, c: np.ndarray) -> list[float]:
    return [float((n * c).sum() / n.sum())]


def li(n: np.ndarray, c: np.ndarray) -> list[float]:
    """Iterated minimum cross-entropy on the values shifted by their minimum."""
    x = c - c[0]
    t, last = float((n * x).sum() / n.sum()), -1.0
    tolerance = (c[1] - c[0]) / 2
    while abs(t - last) > tolerance:
        last = t
        fore = x > t
        nf, nb = n[fore].sum(), n[~fore].sum()
        if not nf or not nb:
            break
        mf, mb = (n[fore] * x[fore]).sum() / nf, (n[~fore] * x[~fore]).sum() / nb
        if mb <= 0:
            break
        t = float((mb - mf) / (np.log(mb) - np.log(mf)))
    return [t + float(c[0])]


def minimum(n: np.ndarray, c: np.ndarray, most: int = 10_000) -> list[float]:
    """Smooth by a window of three until two maxima are left; the valley between. A distribution with one maximum has none."""
    h = n.astype(float)
    for _ in range(most):
        h = np.convolve(np.pad(h, 1, mode="edge"), np.ones(3) / 3, "valid")
        rise = np.sign(np.diff(h))
        rise = rise[rise != 0]
        peaks = int(((rise[:-1] > 0) & (rise[1:] < 0)).sum()) + int(len(rise) and rise[0] < 0) + int(len(rise) and rise[-1] > 0)
        if peaks <= 2:
            break
    tops = [i for i in range(len(h)) if (i == 0 or h[i] > h[i - 1]) and h[i] >= h[min(i + 1, len(h) - 1)]]
    if len(tops) != 2:
        return []
    return [float(c[tops[0] + int(h[tops[0] : tops[1] + 1].argmin())])]


def multi_otsu(n: np.ndarray, c: np.ndarray, classes: int = 3) -> list[float]:
    """The splits into classes with the largest between-class variance: a dynamic programme over prefixes of the histogram.

    best[j] is the most that the first j bins give in as many classes as were placed; a class more is one comparison of all ends with
    all beginnings. Of equal splits the first is taken, from the last threshold on."""
    if classes < 2:
        raise ValueError("multi_otsu: two classes at least")
    p = n / n.sum()
    w, s = np.concatenate([[0], np.cumsum(p)]), np.concatenate([[0], np.cumsum(p * c)])
    with np.errstate(all="ignore"):
        gain = np.where(w[None] - w[:, None] > 0, (s[None] - s[:, None]) ** 2 / (w[None] - w[:, None]), 0.0)  # of bins i..j-1
    gain[np.tril_indices(len(gain))] = -np.inf  # a class has a bin at least
    best, ways = gain[0], []
    for _ in range(classes - 1):
        total = best[:, None] + gain
        ways.append(total.argmax(0))
        best = total.max(0)
    if not np.isfinite(best[-1]):
        raise ValueError("multi_otsu: fewer bins than classes")
    at, cuts = len(n), []
    for way in reversed(ways):
        at = int(way[at])
        cuts.append(at)
    return [float(c[i - 1]) for i in reversed(cuts)]


METHODS: dict[str, Callable[..., list[float]]] = {"otsu": otsu, "isodata": isodata, "yen": yen, "triangle": triangle, "mean": mean, "li": li, "minimum": minimum, "multi_otsu": multi_otsu}


def find_thresholds(df: DataFrame, value: str, by: Sequence[str] = (), method: str | Callable = "otsu", min_val: float | None = None, max_val: float | None = None, bins: int = BINS) -> DataFrame:
    """by, thresholds: of each group. The group's histogram goes to numpy, never its rows; `mean` is the rows' exact mean."""
    by = list(by)
    if method == "mean":
        x = F.col(value)
        inside = (F.lit(True) if min_val is None else x > min_val) & (F.lit(True) if max_val is None else x < max_val)
        return df.filter(x.isNotNull() & inside).groupBy(*by).agg(F.array(F.avg(value)).alias("thresholds"))
    func = METHODS[method] if isinstance(method, str) else method
    hist = histogram(df, value, by, min_val, max_val, bins)

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        lo, hi = float(group["lo"].iloc[0]), float(group["hi"].iloc[0])
        n = np.zeros(bins, np.int64)
        n[group["bin"].to_numpy()] = group["n"].to_numpy()
        centers = lo + (np.arange(bins) + 0.5) * (hi - lo) / bins
        found = [lo] if hi == lo else func(n, centers)
        out = group.iloc[:1][by].copy()
        out["thresholds"] = [found]
        return out

    keyed = hist.groupBy(*by) if by else hist.withColumn("_all", F.lit(1)).groupBy("_all")
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in hist.select(*by).schema) + "thresholds array<double>"
    return keyed.applyInPandas(solve, schema)


def assign_by_threshold(df: DataFrame, value: str, by: Sequence[str] = (), new_var: str = "Thresh_Assigned", method: str | Callable = "otsu", labels: dict[int, str] | None = None, **window) -> DataFrame:
    """The number of thresholds strictly below each value, or its label."""
    found = find_thresholds(df, value, by, method, **window)
    out = df.join(found, list(by)) if by else df.join(F.broadcast(found), how="cross")  # one row
    cls = F.size(F.filter("thresholds", lambda t: t < F.col(value)))
    if labels:
        named = F.create_map(*[F.lit(x) for k, v in labels.items() for x in (k, v)])
        cls = F.element_at(named, cls)
    return out.withColumn(new_var, F.when(F.col(value).isNotNull(), cls)).drop("thresholds")

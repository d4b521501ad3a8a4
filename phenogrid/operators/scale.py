"""Normalisation against a control population, and element-wise transforms.

Statistics are grouped aggregates (hash aggregation with partial sums), joined back by group key; AQE broadcasts them while
they are small. Rows are never collected by group.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phenogrid.functions import expr as X
from phenogrid.functions import gram
from phenogrid.functions.scratch import kept


def _one(c: Column) -> Column:
    """A scale, with zero replaced by one."""
    return F.when(c == 0, F.lit(1.0)).otherwise(c)


def _join(df: DataFrame, stats: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.join(stats, list(by)) if by else df.join(F.broadcast(stats), how="cross")  # without keys the statistics are one row


def normalize(df: DataFrame, feats: Sequence[str], by: Sequence[str] = (), method: str = "standard", pop_var: str | None = None, norm_pop: object = None, eps: float = 0.0, drop_missing: bool = False) -> DataFrame:
    """Centre and scale each feature by its group's statistics: `standard` (mean, deviation), `robust` (median, quartile range),
    `mad_robust` (median, 1.4826 MAD + eps; a zero divisor gives NULL) or `min_max`. Statistics come from the rows with
    pop_var == norm_pop if those are given, and apply to all rows of the group. Zero scales count as 1, but for mad_robust."""
    df = df.filter(X.all_valid(by)) if by else df
    base = df if norm_pop is None else df.filter(F.col(pop_var) == F.lit(norm_pop))

    def stats(f: str) -> list[Column]:
        return {
            "standard": lambda: [F.avg(f).alias(f"_a_{f}"), F.stddev_pop(f).alias(f"_b_{f}")],
            "min_max": lambda: [F.min(f).alias(f"_a_{f}"), (F.max(f) - F.min(f)).alias(f"_b_{f}")],
            "robust": lambda: [F.percentile(f, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"_q_{f}")],
        }[method]()

    if method == "mad_robust":
        # in one group under a key where there are none
        keys = list(by) or ["_all"]
        base = base.select(*by, *feats) if by else base.select(F.lit(0).alias("_all"), *feats)
        grouped = X.medians(base, keys, feats)
        off = base.join(grouped, keys).select(*keys, *[F.abs(F.col(f) - F.col(f"_a_{f}")).alias(f) for f in feats])
        grouped = grouped.join(X.medians(off, keys, feats).select(*keys, *[F.col(f"_a_{f}").alias(f"_b_{f}") for f in feats]), keys)
        grouped = kept(grouped) if by else df.sparkSession.range(1).select(F.lit(0).alias("_all")).join(grouped, "_all", "left").drop("_all")
    else:
        grouped = X.grouped(base, by, feats, stats) if by else base.agg(*[c for f in feats for c in stats(f)])
    if method == "robust":
        grouped = grouped.select(*by, *[c for f in feats for c in (F.get(f"_q_{f}", F.lit(1)).alias(f"_a_{f}"), (F.get(f"_q_{f}", F.lit(2)) - F.get(f"_q_{f}", F.lit(0))).alias(f"_b_{f}"))])
    out = _join(df, grouped, by)
    scaled = {}
    for f in feats:
        b = F.col(f"_b_{f}")
        scaled[f] = X.div(F.col(f) - F.col(f"_a_{f}"), b * X.MAD_SCALE + eps if method == "mad_robust" else _one(b))
    out = out.withColumns(scaled).drop(*[f"_{k}_{f}" for k in "ab" for f in feats])
    return out.filter(X.all_valid(feats)) if drop_missing else out


@dataclass
class RobustMAD:
    """Median and scaled MAD of the rows it is fitted on, for other rows: (x - median) / (1.4826 MAD + epsilon); a zero divisor gives NULL."""

    feats: Sequence[str]
    epsilon: float = 0.0
    median: dict[str, float] = field(default_factory=dict)
    mad: dict[str, float] = field(default_factory=dict)

    def fit(self, df: DataFrame) -> RobustMAD:
        self.median = df.agg(*[X.median(f).alias(f) for f in self.feats]).first().asDict()
        known = {f: m for f, m in self.median.items() if m is not None}
        off = df.agg(*[X.median(F.abs(F.col(f) - F.lit(m))).alias(f) for f, m in known.items()]).first() if known else None
        self.mad = off.asDict() if off else {}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({f: X.div(F.col(f) - F.lit(self.median[f]), F.lit(self.mad.get(f)) * X.MAD_SCALE + self.epsilon) for f in self.feats})


def transform(df: DataFrame, feats: Sequence[str], method: str) -> DataFrame:
    """sqrt, log or log1p of each feature; what has no real result is NULL."""
    one = {"sqrt": lambda c: F.when(c >= 0, F.sqrt(c)), "log": lambda c: F.when(c > 0, F.ln(c)), "log1p": lambda c: F.when(c > -1, F.log1p(c))}[method]
    return df.withColumns({f: one(F.col(f)) for f in feats})


def exact_quantiles(df: DataFrame, feats: Sequence[str], levels: np.ndarray) -> dict[str, np.ndarray]:
    """Exact quantiles of each feature, linear between neighbours, at evenly spaced levels from 0 to 1.

    Distinct values are counted and placed by ranges; each says which levels' neighbours it is. Only those come to the driver:
    features times levels times two numbers."""
    q = len(levels)
    rows = X.long(df.select(*[F.col(f).cast("double").alias(f) for f in feats]), [], feats).filter("value is not null")
    at = X.placed(rows.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n")), ["feature"])
    # level k of q lies at k * (total - 1) / (q - 1), in whole numbers: between floor and floor + 1
    first, last, span = F.col("before"), F.col("before") + F.col("n") - 1, F.col("total") - 1
    low = F.when(span == 0, 0).otherwise(F.ceil(X.div((first - 1) * (q - 1), span) - 1e-6) - 1)
    high = F.when(span == 0, q - 1).otherwise(F.floor(X.div((last + 1) * (q - 1), span) + 1e-6) + 1)
    got = at.withColumn("k", F.explode(F.sequence(F.greatest(low, F.lit(0)).cast("int"), F.least(F.greatest(high, low), F.lit(q - 1)).cast("int")))).withColumn("lower", F.floor(F.col("k").cast("long") * span / F.lit(float(q - 1)) + F.lit(1e-9)))
    got = got.withColumn("is_low", F.col("lower").between(first, last)).withColumn("is_high", F.least(F.col("lower") + 1, span).between(first, last)).filter("is_low or is_high")
    out = {f: np.full(q, np.nan) for f in feats}
    ends = {f: np.full(q, np.nan) for f in feats}
    parts = {f: np.zeros(q) for f in feats}
    for r in got.select("feature", "k", "value", "is_low", "is_high", (F.col("k") * span / F.lit(float(q - 1)) - F.col("lower")).alias("part")).collect():
        if r.is_low:
            out[r.feature][r.k] = r.value
        if r.is_high:
            ends[r.feature][r.k] = r.value
        parts[r.feature][r.k] = max(0.0, r.part)
    return {f: out[f] * (1 - parts[f]) + ends[f] * parts[f] for f in feats}


def transform_quantile(df: DataFrame, feats: Sequence[str], n_quantiles: int = 1000, normal: bool = False) -> DataFrame:
    """Each value's place among n reference quantiles, linear between them, as a share in [0, 1]; the mean of the places from the left and right on ties.

    References are exact quantiles of all rows; values find their place by binary search, in Arrow batches."""
    refs = exact_quantiles(df, feats, np.linspace(0, 1, n_quantiles))
    n = n_quantiles

    def place(x: np.ndarray, _) -> np.ndarray:
        out = np.full_like(x, np.nan)
        for j, f in enumerate(feats):
            q, v = refs[f], x[:, j]
            if np.isnan(q).any():
                continue  # no values
            below, upto = np.searchsorted(q, v, "left"), np.searchsorted(q, v, "right")
            a = np.clip(below - 1, 0, n - 1)
            b = np.minimum(below, n - 1)
            with np.errstate(all="ignore"):
                between = (below - 1 + (v - q[a]) / (q[b] - q[a])) / (n - 1)
            got = np.where(upto > below, (below + upto - 1) / 2 / (n - 1), between)
            out[:, j] = np.where(np.isnan(v), np.nan, np.where(below == n, 1.0, np.where(upto == 0, 0.0, got)))
        return out

    out = gram.applied(df, feats, list(feats), place)
    return out.withColumns({f: normal_quantile(F.col(f)) for f in feats}) if normal else out


# Coefficients of a published rational approximation of the normal quantile (26.2.23 in Abramowitz and Stegun).
_NUM, _DEN = (2.515517, 0.802853, 0.010328), (1.0, 1.432788, 0.189269, 0.001308)


def normal_quantile(p: Column) -> Column:
    """The normal quantile to 4.5e-4; p is kept off 0 and 1 by 1e-7."""
    p = F.greatest(F.lit(1e-7), F.least(F.lit(1 - 1e-7), p))
    t = F.sqrt(-2 * F.ln(F.least(p, 1 - p)))
    num = _NUM[0] + t * (_NUM[1] + t * _NUM[2])
    den = _DEN[0] + t * (_DEN[1] + t * (_DEN[2] + t * _DEN[3]))
    return F.signum(p - 0.5) * (t - num / den)


def power_lambdas(df: DataFrame, feats: Sequence[str], method: str = "yeo-johnson", low: float = -2.0, high: float = 3.0, step: float = 0.25, rounds: int = 3) -> dict[str, float]:
    """Each feature's exponent of largest likelihood: a grid of exponents is scored in one aggregate, then refined around the best."""

    def shifted(c: Column, lam: float) -> Column:
        if method == "box-cox":
            return F.ln(c) if abs(lam) < 1e-12 else (F.pow(c, F.lit(lam)) - 1) / lam
        up = F.log1p(c) if abs(lam) < 1e-12 else (F.pow(c + 1, F.lit(lam)) - 1) / lam
        down = -F.log1p(-c) if abs(lam - 2) < 1e-12 else -(F.pow(1 - c, F.lit(2 - lam)) - 1) / (2 - lam)
        return F.when(c >= 0, up).otherwise(down)

    best = {f: 1.0 for f in feats}
    grids = {f: np.arange(low, high + step / 2, step) for f in feats}
    for _ in range(rounds):
        aggs = []
        for f in feats:
            c = F.col(f)
            jac = F.ln(c) if method == "box-cox" else F.signum(c) * F.log1p(F.abs(c))
            c = F.when(c > 0, c) if method == "box-cox" else c
            aggs += [F.struct(F.count(c), F.sum(jac)).alias(f"_n_{f}")] + [F.var_pop(shifted(c, float(x))).alias(f"_{i}_{f}") for i, x in enumerate(grids[f])]
        row = df.agg(*aggs).first()
        for f in feats:
            n, jac = row[f"_n_{f}"]
            scores = [-n / 2 * np.log(v) + (x - 1) * jac if (v := row[f"_{i}_{f}"]) else -np.inf for i, x in enumerate(grids[f])]
            best[f] = float(grids[f][int(np.argmax(scores))]) if n else 1.0
            width = grids[f][1] - grids[f][0]
            grids[f] = np.linspace(best[f] - width, best[f] + width, 9)
    return best


def transform_power(df: DataFrame, feats: Sequence[str], method: str = "yeo-johnson", lambdas: dict[str, float] | None = None) -> DataFrame:
    """Box-Cox (positive values; others NULL) or Yeo-Johnson with each feature's best exponent; not standardised."""
    lambdas = lambdas or power_lambdas(df, feats, method)
    out = {}
    for f in feats:
        c, lam = F.col(f), lambdas[f]
        if method == "box-cox":
            out[f] = F.when(c > 0, F.ln(c) if abs(lam) < 1e-12 else (F.pow(c, F.lit(lam)) - 1) / lam)
        else:
            up = F.log1p(c) if abs(lam) < 1e-12 else (F.pow(c + 1, F.lit(lam)) - 1) / lam
            down = -F.log1p(-c) if abs(lam - 2) < 1e-12 else -(F.pow(1 - c, F.lit(2 - lam)) - 1) / (2 - lam)
            out[f] = F.when(c >= 0, up).otherwise(down)
    return df.withColumns(out)

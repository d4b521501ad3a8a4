"""Motility of tracks: geometry of the path, and serial dependence of a sequence of states.

A track is packed once, by one shuffle, to an array in order of time; its measures are computed in numpy on Arrow batches of
packed tracks. (The same formulas as nested array expressions ran two orders of magnitude slower: a lambda's inner sums are
evaluated again for each element.) A track is the largest thing that one row holds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


def pack(df: DataFrame, track: str, time: str, values: Column, min_len: int, store: Sequence[str] = ()) -> DataFrame:
    """track, path (values in order of time), and the first frame's `store` columns, of tracks with at least min_len frames."""
    rows = df.filter(F.col(track).isNotNull())
    at = F.struct(F.col(time).alias("t"), values.alias("p"))
    packed = rows.groupBy(track).agg(F.array_sort(F.collect_list(at)).alias("_s"), *[F.min_by(F.col(c), F.col(time)).alias(c) for c in store])
    return packed.filter(F.size("_s") >= min_len).select(track, *store, F.transform("_s", lambda s: s["p"]).alias("path"))


def _each(packed: DataFrame, names: Sequence[str], measure: Callable[[np.ndarray], dict[str, float]]) -> DataFrame:
    """Replace path by the measures of it, in Arrow batches; NaN becomes NULL."""
    keep = [f for f in packed.schema.fields if f.name != "path"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [measure(np.array(x, float)) for x in b.column(b.schema.get_field_index("path")).to_pylist()]
            cols = [pa.array([None if not np.isfinite(g[n]) else float(g[n]) for g in got], pa.float64()) for n in names]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(f.name)) for f in keep] + cols, [f.name for f in keep] + list(names))

    return packed.mapInArrow(run, StructType([*keep, *[StructField(n, DoubleType()) for n in names]]))


def avg_ranks(x: np.ndarray) -> np.ndarray:
    s = np.sort(x)
    return (np.searchsorted(s, x, "left") + np.searchsorted(s, x, "right") + 1) / 2


def slope(x: np.ndarray, y: np.ndarray) -> float:
    d = x - x.mean()
    return float(d @ (y - y.mean()) / (d @ d)) if len(x) > 1 and d @ d > 0 else np.nan


def mcor(path: np.ndarray) -> float:
    """Spread of the correlation matrix's eigenvalues: how much of the path lies along one line. |r| in two dimensions; NaN if a coordinate is constant."""
    if (path.std(0) == 0).any():
        return np.nan
    d = path.shape[1]
    return float(np.std(np.linalg.eigvalsh(np.corrcoef(path.T)), ddof=1) / d**0.5) if d > 1 else 1.0


def hurst(d: np.ndarray) -> float:
    """Slope of log2 mean rescaled range on log2 length, over blocks of N / 2**i; NaN with fewer than three lengths. Lengths without a block of spread are left out on both sides."""
    n = len(d)
    if n < 4:
        return np.nan
    top = int(np.log2(n)) - 1
    top -= 2**top >= n
    x, y = [], []
    for i in range(top):
        size = n // 2**i
        block = d[: n // size * size].reshape(-1, size)
        walk = np.cumsum(block - block.mean(1, keepdims=True), axis=1)
        spread = block.std(1)
        if (ok := spread > 0).any():
            x.append(np.log2(size))
            y.append(np.log2(((walk.max(1) - walk.min(1))[ok] / spread[ok]).mean()))
    return slope(np.array(x), np.array(y)) if len(x) >= 3 else np.nan


def path_measures(path: np.ndarray, fpu: int, msd_max_tau: int | None, kurtosis_max_tau: int, autocorr_max_tau: int, code_compatible: bool) -> dict[str, float]:
    """All measures of one path (frames x dimensions)."""
    with np.errstate(all="ignore"):
        n = len(path)
        d = np.linalg.norm(np.diff(path, axis=0), axis=1)
        whole = len(d) // fpu * fpu
        v = d[:whole].reshape(-1, fpu).sum(1)
        taus = np.arange(1, min(n - 1, msd_max_tau or n - 1) + 1)
        msd = np.array([((path[t:] - path[:-t]) ** 2).sum(1).mean() for t in taus])
        alpha = slope(np.log(taus), np.log(msd)) if len(taus) and (msd > 0).all() else np.nan
        limit = np.interp(np.clip(1 - alpha / 2, 0, 1), np.linspace(0, 1, len(v)), np.sort(v)) if len(v) and np.isfinite(alpha) else np.nan
        act, idle = v[v >= limit], v[v < limit]
        steps = np.diff(path[::fpu], axis=0)
        length = np.linalg.norm(steps, axis=1)
        angle = np.arccos(np.clip((steps[:-1] * steps[1:]).sum(1) / (length[:-1] * length[1:]), -1, 1))  # undefined where a step has no length
        speed = v[: len(angle)]
        angle, speed = angle[: len(speed)], speed
        some = lambda a, f: float(f(a)) if len(a) else 0.0
        deg = lambda a: float(np.nanmean(a) * 180 / np.pi) if np.isfinite(a).any() else 0.0
        origin = float(np.linalg.norm(path[-1] - path[0]))
        m, var = d.mean(), d.var()
        third = ((d - m) ** 3).mean() / var**1.5
        k = len(d)
        out = {
            "Length": n, "AccumDisplacement": d.sum(), "DisplacementFromOrigin": origin, "DirectionalityRatio": origin / d.sum(),
            "GyrationRadius": path.var(0).sum() ** 0.5, "AvgSpeed": v.mean(), "StdSpeed": v.std(), "MedianSpeed": np.median(v),
            "MADSpeed": np.median(np.abs(v - np.median(v))), "MinSpeed": v.min(initial=np.inf), "MaxSpeed": v.max(initial=-np.inf),
            "ActiveRatio": len(act) / len(v) if np.isfinite(limit) else np.nan, "AvgActiveSpeed": some(act, np.mean), "AvgIdlingSpeed": some(idle, np.mean),
            "StdActiveSpeed": some(act, np.std), "StdIdlingSpeed": some(idle, np.mean if code_compatible else np.std),
            "AvgTurnAngle": deg(angle), "AvgActiveTurnAngle": deg(angle[speed >= limit]), "AvgIdlingTurnAngle": deg(angle[speed < limit]),
            "Linearity": mcor(path), "Monotonicity": mcor(np.stack([avg_ranks(c) for c in path.T], 1)), "MSDalpha": alpha,
            "NonGaussAlpha2": (d**4).mean() / (3 * (d**2).mean() ** 2) - 1, "AvgDisplacement": m, "StdDisplacement": d.std(),
            "SkewDisplacement": third * (k * (k - 1)) ** 0.5 / (k - 2) if k > 2 else np.nan, "Hurst": hurst(d),
        }
        for t in range(1, kurtosis_max_tau + 1):
            dt = np.linalg.norm(path[t:] - path[:-t], axis=1) if t < n else np.empty(0)
            out[f"DisplacementKurtosis_{t}"] = ((dt - dt.mean()) ** 4).mean() / dt.var() ** 2 - 3 if len(dt) else np.nan
        for t in range(1, autocorr_max_tau + 1):
            out[f"DisplacementAC_{t}"] = ((d[:-t] - m) * (d[t:] - m)).sum() / (k - t) / var if t < k else np.nan
            out[f"VelocityAC_{t}"] = (steps[:-t] * steps[t:]).sum(1).mean() / (steps**2).sum(1).mean() if t < len(steps) else np.nan
    return out


def motility(df: DataFrame, track: str, time: str, coords: Sequence[str] | None = None, rep: str | None = None, fpu: int = 1, min_len: int = 30, msd_max_tau: int | None = None, kurtosis_max_tau: int = 3, autocorr_max_tau: int = 10, store: Sequence[str] = (), code_compatible: bool = False) -> DataFrame:
    """The motility profile of each track of at least min_len frames, over coordinate columns or an embedding column. code_compatible sets StdIdlingSpeed to the average idling speed."""
    values = F.col(rep).cast("array<double>") if rep else F.array(*[F.col(c).cast("double") for c in coords or ()])

    def measure(path: np.ndarray) -> dict[str, float]:
        return path_measures(path, fpu, msd_max_tau, kurtosis_max_tau, autocorr_max_tau, code_compatible)

    names = list(measure(np.arange(8.0).reshape(4, 2)))
    out = _each(pack(df, track, time, values, max(min_len, 3), store), names, measure)
    return out.withColumn("Length", F.col("Length").cast("int"))


def state_measures(s: np.ndarray, states: Sequence[object], max_tau: int) -> dict[str, float]:
    """Dispersion and serial dependence of a sequence of state codes."""
    m, n = len(states), len(s)
    p = np.bincount(s, minlength=m) / n
    sq, top, ent = float(p @ p), p.max(), float((p[p > 0] * np.log(p[p > 0])).sum())

    def joint(t: int) -> np.ndarray:
        return np.bincount(s[:-t] * m + s[t:], minlength=m * m).reshape(m, m) / max(1, n - t)

    with np.errstate(all="ignore"):
        out = {"Length": n, "Entropy": -ent / np.log(m) if m > 1 else np.nan, "Gini": m / (m - 1) * (1 - sq) if m > 1 else np.nan, "Chebycheff": m / (m - 1) * (1 - top) if m > 1 else np.nan, "TransitionProb": (s[1:] != s[:-1]).mean()}
        out |= {f"DwellTime_{x}": p[i] for i, x in enumerate(states)}
        j = joint(1)
        row = j.sum(1, keepdims=True)
        w, v = np.linalg.eig(np.divide(j, row, out=np.zeros_like(j), where=row > 0).T)
        flow = np.abs(np.real(v[:, int(np.argmax(np.real(w)))]))
        out |= {f"StationaryDist_{x}": flow[i] / flow.sum() for i, x in enumerate(states)}
        e, spread = np.outer(p, p), np.outer(p * (1 - p), p * (1 - p))
        flat = 1 - sq < 1e-12
        for t in range(1, max_tau + 1):
            j = joint(t)
            phi2 = float(np.divide((j - e) ** 2, e, out=np.zeros_like(j), where=e > 0).sum())
            gk = float(np.divide(j * j, p[None], out=np.zeros_like(j), where=p[None] > 0).sum())
            info = float((j[j > 0] * np.log(j[j > 0] / e[j > 0])).sum()) if (e[j > 0] > 0).all() else np.nan
            psi = ((j - e) ** 2)[spread > 0] / spread[spread > 0]
            out |= {
                f"CohenKappa_{t}": 0.0 if flat else (np.trace(j) - sq) / (1 - sq), f"CramerVi_{t}": (phi2 / (m - 1)) ** 0.5 if m > 1 else 0.0,
                f"Sakoda_{t}": (m * phi2 / ((m - 1) * (1 + phi2))) ** 0.5 if m > 1 else 0.0, f"GKTau_{t}": 0.0 if flat else (gk - sq) / (1 - sq),
                f"GKLambda_{t}": (j.max(0).sum() - top) / (1 - top) if top < 1 else 0.0, f"Uncertainty_{t}": -info / ent if ent < 0 else 0.0, f"TotalCorr_{t}": psi.mean() if len(psi) else 0.0,
            }
    return out


def state_motility(df: DataFrame, track: str, time: str, state: str, states: Sequence[object] | None = None, min_len: int = 30, max_tau: int = 5, store: Sequence[str] = ()) -> DataFrame:
    """Dispersion, dwell times, stationary distribution and serial dependence of each track's states. states: all states of the data, sorted (found by one job if not given)."""
    rows = df.filter(F.col(track).isNotNull() & F.col(state).isNotNull())
    if states is None:
        states = [r[0] for r in rows.select(state).distinct().orderBy(state).collect()]  # a few levels of a categorical column
    code = F.element_at(F.create_map(*[x for i, s in enumerate(states) for x in (F.lit(s), F.lit(i))]), F.col(state))

    def measure(s: np.ndarray) -> dict[str, float]:
        return state_measures(s.astype(np.int64), states, max_tau)

    names = list(measure(np.zeros(max_tau + 2)))
    return _each(pack(rows, track, time, code, max(min_len, max_tau + 1), store), names, measure).withColumn("Length", F.col("Length").cast("int"))

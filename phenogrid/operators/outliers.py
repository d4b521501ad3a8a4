"""Five detectors of strange rows: isolation forest, minimum covariance determinant, local density, one-class machine by its dual, and the same on landmarks by gradient steps.

Every detector scores all rows in Arrow batches. What is fitted on the driver is bounded by parameters: the trees' rows (trees times
size), the machine's TRAIN_ROWS, the landmarks. The covariance, the local densities and the gradient steps go over all rows.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phenogrid.functions import gram
from phenogrid.functions.scratch import cut as cut_plan
from phenogrid.functions.stats import chi2_quantile
from phenogrid.functions.threads import one_thread
from phenogrid.operators.batch import inverse_root
from phenogrid.operators.group import sample_rows

#: Most rows of the dual problem of the one-class machine, whose kernel matrix is held; rows on which the covariance's starts are tried.
TRAIN_ROWS, START_ROWS = 4_000, 1_500
METHODS = ("if", "rc", "lof", "oc-svm", "oc-svm-sgd")


def _numbers(df: DataFrame, feats: Sequence[str], *more: str) -> DataFrame:
    return df.select(*more, *[F.col(f"`{f}`").cast("double").alias(f) for f in feats]).filter(" AND ".join(f"`{f}` IS NOT NULL AND NOT isnan(`{f}`)" for f in feats))


def _sample(df: DataFrame, feats: Sequence[str], size: int, row_id: str, seed: int) -> np.ndarray:
    rows = sample_rows(_numbers(df, feats, row_id), size, row_id, seed).select(*feats).toArrow()
    return np.column_stack([rows.column(f).to_numpy() for f in feats]) if rows.num_rows else np.zeros((0, len(feats)))


# -- isolation forest -----------------------------------------------------------------------------------------------------


def _path(n: int) -> float:
    return 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else float(n == 2)


def _tree(x: np.ndarray, depth: int, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
    feature, value, left, right, length = [], [], [], [], []

    def grow(rows: np.ndarray, level: int) -> int:
        at = len(feature)
        feature.append(-1); value.append(0.0); left.append(0); right.append(0); length.append(level + _path(len(rows)))  # noqa: E702
        spread = rows.max(0) - rows.min(0) if len(rows) else np.zeros(x.shape[1])
        if level < depth and len(rows) > 1 and (spread > 0).any():
            f = int(rng.choice(np.flatnonzero(spread > 0)))
            v = rng.uniform(rows[:, f].min(), rows[:, f].max())
            feature[at], value[at] = f, v
            left[at] = grow(rows[rows[:, f] < v], level + 1)
            right[at] = grow(rows[rows[:, f] >= v], level + 1)
        return at

    grow(x, 0)
    return tuple(map(np.array, (feature, value, left, right, length)))


def isolation_forest(df: DataFrame, feats: Sequence[str], trees: int, size: int, row_id: str, seed: int) -> tuple[Callable[[np.ndarray], np.ndarray], float] | None:
    """The trees share one sample of trees * size rows, drawn from all; each grows on its own `size` of them, or on all where there are fewer."""
    rng = np.random.default_rng(seed)
    sample = _sample(df, feats, trees * size, row_id, seed)
    if not len(sample):
        return None
    size = min(size, len(sample))
    depth = int(np.ceil(np.log2(max(size, 2))))
    own = rng.permutation(len(sample))
    forest = [_tree(sample[np.take(own, np.arange(k * size, (k + 1) * size), mode="wrap")], depth, rng) for k in range(trees)]
    scale = _path(size) or 1.0

    def score(x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for f, v, le, ri, ln in forest:
            node = np.zeros(len(x), int)
            while True:
                inner = f[node] >= 0
                if not inner.any():
                    break
                go = x[np.arange(len(x)), np.maximum(f[node], 0)] < v[node]
                node = np.where(inner, np.where(go, le[node], ri[node]), node)
            total += ln[node]
        return 2 ** (-total / len(forest) / scale)

    return score, 0.5


# -- minimum covariance determinant ---------------------------------------------------------------------------------------


@dataclass
class Spread:
    """A centre and a covariance, as populations have it."""

    mean: np.ndarray
    cov: np.ndarray

    @property
    def volume(self) -> float:
        return float(np.linalg.slogdet(self.cov + 1e-12 * np.trace(self.cov) / len(self.cov) * np.eye(len(self.cov)))[1])

    def away(self, x: np.ndarray) -> np.ndarray:
        return (((x - self.mean) @ inverse_root(self.cov, 1e-12)) ** 2).sum(1)


def _of(x: np.ndarray) -> Spread:
    mean = x.mean(0)
    return Spread(mean, (x - mean).T @ (x - mean) / len(x))


def _settle(x: np.ndarray, start: Spread, h: int, most: int) -> Spread:
    """C-steps: the centre and covariance of the h nearest rows, again and again; the determinant never grows."""
    spread = _of(x[np.argsort(start.away(x), kind="stable")[:h]])  # the start may be of fewer rows
    for _ in range(most - 1):
        new = _of(x[np.argsort(spread.away(x), kind="stable")[:h]])
        if new.volume >= spread.volume - 1e-10:
            break
        spread = new
    return spread


def _starts(x: np.ndarray, h: int, starts: int, best: int, rng: np.random.Generator) -> list[Spread]:
    """From random subsets of one row more than features: two C-steps each, then the best are settled. Where there are no more subsets of h rows than twice the starts, all are tried."""
    tried = []
    if math.comb(len(x), h) <= 2 * starts:
        tried = [_of(x[list(rows)]) for rows in itertools.combinations(range(len(x)), h)]
        starts = 0
    for _ in range(starts):
        pick = rng.permutation(len(x))
        k = x.shape[1] + 1
        while k < len(x) and np.linalg.matrix_rank(x[pick[:k]] - x[pick[:k]].mean(0)) < x.shape[1]:
            k += 1
        tried.append(_settle(x, _of(x[pick[:k]]), h, 2))
    tried = [_settle(x, s, h, 100) for s in sorted(tried, key=lambda s: s.volume)[:best]]
    return sorted(tried, key=lambda s: s.volume)


def _all_rows(rows: DataFrame, feats: Sequence[str], found: list[Spread], share: float) -> list[Spread]:
    """One C-step of several candidates over all rows: a pass for the quantiles of their distances, one for the moments within."""
    names = [f"_d{k}" for k in range(len(found))]
    scored = gram.applied(rows, feats, names, lambda x, _: np.column_stack([s.away(x) for s in found]))
    edges = scored.agg(*[F.percentile_approx(n, share, 1_000_000).alias(n) for n in names]).first()
    near = scored.withColumn("_c", F.explode(F.array_compact(F.array(*[F.when(F.col(n) <= edges[n], F.lit(k)) for k, n in enumerate(names)]))))
    m = gram.moments(near, feats, by="_c")
    return [Spread(m[k].mean, m[k].covariance()) for k in range(len(found))]


def robust_covariance(df: DataFrame, feats: Sequence[str], support: float | None = None, starts: int = 500, best: int = 10, start_rows: int = START_ROWS, row_id: str = "row_id", seed: int = 0) -> Spread | None:
    """Minimum covariance determinant: the centre and covariance of the half (or share `support`) of the rows whose determinant is smallest.

    Random starts are tried on start_rows rows at most; the best few take C-steps on all rows and the best of those goes on until it is
    stable. Then the covariance is made consistent by the median distance, and rows within the 97.5% quantile of the chi-square distribution give the result."""
    rows = _numbers(df, feats, row_id)
    n, p = rows.count(), len(feats)
    if n <= p + 1:
        return None
    h = min(n, int(np.ceil(support * n)) if support else (n + p + 1) // 2)
    x = _sample(rows, feats, start_rows, row_id, seed)
    found = _starts(x, max(p + 1, round(h / n * len(x))) if n > len(x) else h, starts, best, np.random.default_rng(seed))
    if n > len(x):
        rows = cut_plan(rows.select(*feats))
        for _ in range(2):
            found = _all_rows(rows, feats, found, h / n)
        spread = min(found, key=lambda s: s.volume)
        for _ in range(30):
            new = _all_rows(rows, feats, [spread], h / n)[0]
            if new.volume >= spread.volume - 1e-9:
                break
            spread = new
        scored = gram.applied(rows, feats, ["_d"], lambda x, _: spread.away(x)[:, None])
        middle = scored.agg(F.percentile_approx("_d", 0.5, 1_000_000)).first()[0]
        m = gram.moments(scored.filter(F.col("_d") < F.lit(float(middle / chi2_quantile(0.5, p) * chi2_quantile(0.975, p)))), feats)[None]
        return Spread(m.mean, m.covariance()) if m.n > p else spread
    spread = found[0]
    d = spread.away(x)
    within = d < np.median(d) / chi2_quantile(0.5, p) * chi2_quantile(0.975, p)
    return _of(x[within]) if within.sum() > p else spread


# -- one-class machines ---------------------------------------------------------------------------------------------------


def rbf(x: np.ndarray, y: np.ndarray, gamma: float) -> np.ndarray:
    return np.exp(-gamma * np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1) - 2 * x @ y.T, 0))


def smo(kernel: np.ndarray, nu: float, tol: float = 1e-4, most: int = 200_000) -> tuple[np.ndarray, float]:
    """(alpha, rho) of the one-class dual: least alpha'K alpha / 2 with 0 <= alpha <= 1 that sum to nu * n. Two coordinates at a time; the second promises the largest fall."""
    n = len(kernel)
    alpha = np.clip(nu * n - np.arange(n), 0.0, 1.0)
    g, diagonal = kernel @ alpha, kernel.diagonal()
    for _ in range(most):
        i = int(np.where(alpha < 1, g, np.inf).argmin())
        above = np.where(alpha > 0, g, -np.inf) - g[i]
        if above.max() < tol:
            break
        curve = np.maximum(diagonal[i] + diagonal - 2 * kernel[i], 1e-12)
        j = int(np.where(above > 0, above**2 / curve, -np.inf).argmax())
        step = min(above[j] / curve[j], 1 - alpha[i], alpha[j])
        alpha[i] += step
        alpha[j] -= step
        g += step * (kernel[i] - kernel[j])
    free = (alpha > 1e-9) & (alpha < 1 - 1e-9)
    edge = [g[alpha > 0].max(initial=-np.inf), g[alpha < 1].min(initial=np.inf)]
    return alpha, float(g[free].mean() if free.any() else np.mean([e for e in edge if np.isfinite(e)] or [0.0]))


def one_class(x: np.ndarray, nu: float, gamma: float | str) -> Callable[[np.ndarray], np.ndarray]:
    """rho - f(x): above 0 outside."""
    width = 1 / (x.shape[1] * x.var() or 1.0) if gamma == "scale" else float(gamma)
    alpha, rho = smo(rbf(x, x, width), nu)
    support, weight = x[alpha > 0], alpha[alpha > 0]
    return lambda y: rho - rbf(y, support, width) @ weight


@dataclass
class Landmarks:
    """Nystroem features: kernel values against a few rows, times the inverse root of their own kernel."""

    rows: np.ndarray
    gamma: float
    root: np.ndarray

    @classmethod
    def of(cls, rows: np.ndarray, gamma: float) -> Landmarks:
        u, s, v = np.linalg.svd(rbf(rows, rows, gamma))
        return cls(rows, gamma, (u / np.sqrt(np.maximum(s, 1e-12))) @ v)

    def lift(self, x: np.ndarray) -> np.ndarray:
        return rbf(x, self.rows, self.gamma) @ self.root.T


def descend(rows: DataFrame, feats: Sequence[str], map_: Landmarks, nu: float, rounds: int = 20, batch: int = 16) -> tuple[np.ndarray, float]:
    """(w, rho) of the linear one-class machine on the lifted rows: least nu |w|^2 / 2 - nu rho + mean of max(0, rho - w z).

    In a round every task steps through all its rows, `batch` at a time, from the shared state; the tasks' averages of the round's second
    half, weighed by their rows, are the next state. Steps shrink with the steps of an average task so far. At the end rho is the
    nu-quantile of all rows, its optimum for that w."""
    m = len(map_.rows)
    w, rho, done = np.zeros(m), 0.0, 0.0
    for _ in range(rounds):
        shared = (w, rho, done)

        def tally(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            one_thread()
            w, rho, t = shared[0].copy(), shared[1], shared[2]
            total, steps, n = np.zeros(m + 1), 0, 0
            for b in batches:
                z = map_.lift(gram.matrix(b, feats))
                z = z[np.random.default_rng(steps).permutation(len(z))]  # rows often come sorted
                for i in range(0, len(z), batch):
                    part = z[i : i + batch]
                    size = 4 / (nu * (t + 20))
                    below = part @ w < rho
                    w = (1 - size * nu) * w + size * part[below].sum(0) / len(part)
                    rho -= size * (below.mean() - nu)
                    total += np.append(w, rho)
                    t, steps, n = t + 1, steps + 1, n + len(part)
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([steps]), pa.array([(total / steps).tolist()])], ["n", "steps", "state"])

        parts = rows.mapInArrow(tally, "n long, steps long, state array<double>").select("n", "steps", F.posexplode("state").alias("at", "x"))
        got = parts.groupBy("at").agg((F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("x"), F.avg("steps").alias("steps")).collect()
        if not got:
            break
        state = np.zeros(m + 1)
        for r in got:
            state[r["at"]] = r.x
        w, rho, done = state[:m], float(state[m]), done + got[0].steps
    scored = gram.applied(rows, feats, ["_s"], lambda x, _: (map_.lift(x) @ w)[:, None])
    edge = scored.agg(F.percentile_approx("_s", nu, 1_000_000)).first()[0]
    return w, rho if edge is None else float(edge)


# -- all of them ----------------------------------------------------------------------------------------------------------


def outlier_scores(
    df: DataFrame, feats: Sequence[str], method: str = "if", contamination: float = 0.1, trees: int = 100, size: int = 256, neighbours: int = 20, nu: float = 0.5, gamma: float | str | None = None,
    landmarks: int = 100, seed: int = 0, row_id: str = "row_id", use_rep: str | None = None, n_pcs: int | None = None,
) -> DataFrame:
    """df with `outlier_score` (higher: stranger) and `inlier`. Rows that miss features have no score and are no inliers.

    `if`: isolation forest. `rc`: distances from the minimum covariance determinant; the share `contamination` of all rows lies outside.
    `lof`: local density, each row among all rows. `oc-svm`: one-class machine with a Gaussian kernel, its dual solved on TRAIN_ROWS
    rows at most. `oc-svm-sgd`: the same objective on Nystroem landmarks, by gradient steps over all rows. gamma is "scale" for the
    former and 0.1 for the latter where it is not given. use_rep names a vector column to take the place of feats; n_pcs its leading components."""
    if method not in METHODS:
        raise ValueError(f"method must be one of {', '.join(METHODS)}, not {method}")
    if use_rep is not None:
        first = df.select(F.size(use_rep).alias("n")).filter("n >= 0").limit(1).collect()
        wide = min(first[0].n, n_pcs or first[0].n) if first else 1
        feats = [f"_rep{i}" for i in range(wide)]
        lifted = df.withColumns({f: F.col(use_rep)[i].cast("double") for i, f in enumerate(feats)})
        return outlier_scores(lifted, feats, method, contamination, trees, size, neighbours, nu, gamma, landmarks, seed, row_id).drop(*feats)
    if method == "lof":
        from phenogrid.operators.neighbours import local_outlier_factor

        vector = F.array(*[F.col(f).cast("double") for f in feats])
        found = local_outlier_factor(df, row_id, vector, neighbours).select(F.col("id").alias(row_id), F.col("lof").alias("outlier_score"))
        return df.join(found, row_id, "left").withColumn("inlier", F.coalesce(F.col("outlier_score") <= 1.5, F.lit(False)))

    score, limit = None, 0.0
    if method == "if":
        score, limit = isolation_forest(df, feats, trees, size, row_id, seed) or (None, 0.0)
    elif method == "rc":
        spread = robust_covariance(df, feats, row_id=row_id, seed=seed)
        score = spread and spread.away
    elif method == "oc-svm":
        x = _sample(df, feats, TRAIN_ROWS, row_id, seed)
        score = one_class(x, nu, gamma or "scale") if len(x) else None
    else:
        x = _sample(df, feats, landmarks, row_id, seed)
        if len(x):
            map_ = Landmarks.of(x, float(gamma or 0.1))
            w, rho = descend(cut_plan(_numbers(df, feats)), feats, map_, nu)
            score = lambda y: rho - map_.lift(y) @ w
    if score is None:
        return df.withColumn("outlier_score", F.lit(None).cast("double")).withColumn("inlier", F.lit(False))

    def run(x: np.ndarray, _: pa.RecordBatch) -> np.ndarray:
        out = np.full((len(x), 1), np.nan)
        fine = np.isfinite(x).all(1)
        if fine.any():
            out[fine, 0] = score(x[fine])
        return out

    scored = gram.applied(df, feats, ["outlier_score"], run)
    if method == "rc":
        limit = scored.agg(F.percentile_approx("outlier_score", 1 - contamination, 1_000_000)).first()[0]
    return scored.withColumn("inlier", F.coalesce(F.col("outlier_score") <= F.lit(limit), F.lit(False)))

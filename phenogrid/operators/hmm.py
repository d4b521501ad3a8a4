"""Gaussian hidden-state models of tracks. Fitting: E-steps run by track on executors and return sufficient statistics, which
are summed by the engine; M-steps are on the driver, in a few k x d numbers. Decoding runs by track."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phenogrid.functions import expr as X
from phenogrid.functions.scratch import cut
from phenogrid.operators.group import sample_tracks


@dataclass
class Model:
    """start and trans of k states; means and covars of their k * m components (m for each state, in a row); weights, k x m: one component is a Gaussian, several are a mixture."""

    start: np.ndarray
    trans: np.ndarray
    means: np.ndarray
    covars: np.ndarray
    loglik: float = -np.inf
    rows: int = 0
    weights: np.ndarray | None = None

    def __post_init__(self):
        if self.weights is None:
            self.weights = np.ones((len(self.start), 1))

    @property
    def k(self) -> int:
        return len(self.start)

    @property
    def mixtures(self) -> int:
        return self.weights.shape[1]

    def parameters(self) -> int:
        d, parts = self.means.shape[1], self.k * self.mixtures
        return self.k - 1 + self.k * (self.k - 1) + parts * d + parts * d * (d + 1) // 2 + self.k * (self.mixtures - 1)

    def bic(self) -> float:
        return -2 * self.loglik + self.parameters() * np.log(max(self.rows, 2))

    def aic(self) -> float:
        return -2 * self.loglik + 2 * self.parameters()

    def stationary(self) -> np.ndarray:
        w, v = np.linalg.eig(self.trans.T)
        x = np.abs(np.real(v[:, int(np.argmax(np.real(w)))]))
        return x / x.sum()

    def state_means(self) -> np.ndarray:
        return np.einsum("sc,scd->sd", self.weights, self.means.reshape(self.k, self.mixtures, -1))

    def ordered(self) -> Model:
        """States by rising first mean."""
        o = np.lexsort(self.state_means().T[::-1])
        parts = (o[:, None] * self.mixtures + np.arange(self.mixtures)).ravel()
        return Model(self.start[o], self.trans[np.ix_(o, o)], self.means[parts], self.covars[parts], self.loglik, self.rows, self.weights[o])

    def log_parts(self, x: np.ndarray) -> np.ndarray:
        """Log density of each component times its weight: frames x states x components."""
        out = np.empty((len(x), len(self.means)))
        for s in range(len(self.means)):
            chol = np.linalg.cholesky(self.covars[s] + 1e-9 * np.eye(x.shape[1]))
            z = np.linalg.solve(chol, (x - self.means[s]).T)
            out[:, s] = -0.5 * (z**2).sum(0) - np.log(np.diag(chol)).sum() - 0.5 * x.shape[1] * np.log(2 * np.pi)
        with np.errstate(divide="ignore"):
            return out.reshape(len(x), self.k, self.mixtures) + np.log(self.weights)

    def logpdf(self, x: np.ndarray) -> np.ndarray:
        return _lse(self.log_parts(x), 2)


def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis, keepdims=True)
    m = np.where(np.isfinite(m), m, 0)
    return np.log(np.exp(a - m).sum(axis)) + m.squeeze(axis)


def expect(m: Model, x: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(log-likelihood, state shares by frame, expected transitions) of one track: forward and backward shares, scaled at each frame."""
    e = m.logpdf(x)
    top = e.max(1)
    e = np.exp(e - top[:, None])
    n = len(x)
    a, b, scale = np.empty_like(e), np.ones_like(e), np.empty(n)
    now = m.start * e[0] + 1e-300
    for t in range(n):
        if t:
            now = (now @ m.trans) * e[t] + 1e-300
        scale[t] = now.sum()
        now = now / scale[t]
        a[t] = now
    back = b[-1]
    for t in range(n - 2, -1, -1):
        back = m.trans @ (e[t + 1] * back) / scale[t + 1]
        b[t] = back
    xi = m.trans * (a[:-1].T @ (e[1:] * b[1:] / scale[1:, None]))
    share = a * b
    return float(np.log(scale).sum() + top.sum()), share / share.sum(1, keepdims=True), xi


def viterbi(m: Model, x: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        ls, lt = np.log(m.start), np.log(m.trans)
    e = m.logpdf(x)
    best, back = ls + e[0], np.zeros((len(x), m.k), int)
    for t in range(1, len(x)):
        cand = best[:, None] + lt
        back[t] = cand.argmax(0)
        best = cand.max(0) + e[t]
    out = np.empty(len(x), int)
    out[-1] = best.argmax()
    for t in range(len(x) - 1, 0, -1):
        out[t - 1] = back[t][out[t]]
    return out


def pack(df: DataFrame, track: str, time: str, rep: str, keep: Sequence[str] = ()) -> DataFrame:
    """track, ids (of frames in order), x (their vectors)."""
    at = F.struct(F.col(time).alias("t"), F.col(keep[0]).alias("i") if keep else F.lit(0).alias("i"), F.col(rep).cast("array<double>").alias("v"))
    return df.filter(F.col(track).isNotNull() & F.col(rep).isNotNull()).groupBy(track).agg(F.array_sort(F.collect_list(at)).alias("s")).select(track, F.transform("s", lambda s: s["i"]).alias("ids"), F.transform("s", lambda s: s["v"]).alias("x"))


def em(packed: DataFrame, model: Model, rounds: int = 10, tol: float = 1e-2) -> Model:
    """EM from a start model; each round is one pass over the tracks that returns k x d statistics for each task."""
    return em_by_key(packed.select(F.lit(0).alias("key"), "x"), {0: model}, rounds, tol)[0]


def em_by_key(packed: DataFrame, models: dict[object, Model], rounds: int = 10, tol: float = 1e-2) -> dict[object, Model]:
    """EM of one model for each key over the tracks (key, x): a round is one pass for all keys that have not settled. All models are of one shape."""
    models, names = dict(models), list(models)
    some = models[names[0]]
    k, c, d = some.k, some.mixtures, some.means.shape[1]
    parts = k * c
    width = 2 + k + k * k + parts + parts * d + parts * d * d
    active = set(names)
    for _ in range(rounds):
        shared = packed.sparkSession.sparkContext.broadcast({name: models[name] for name in active})

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            held: dict[object, np.ndarray] = {}
            for b in batches:
                for name, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    if (m := shared.value.get(name)) is None:
                        continue
                    x = np.array(x, float)
                    ll, g, xi = expect(m, x)
                    each = m.log_parts(x)
                    each = (g[:, :, None] * np.exp(each - _lse(each, 2)[:, :, None])).reshape(len(x), parts)
                    second = np.einsum("ts,ti,tj->sij", each, x, x)
                    held[name] = held.get(name, 0.0) + np.concatenate([[ll, len(x)], g[0], xi.ravel(), each.sum(0), (each.T @ x).ravel(), second.ravel()])
            for name, total in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([names.index(name)] * width, pa.int32()), pa.array(range(width), pa.int32()), pa.array(total)], ["name", "i", "v"])

        rows = packed.select("key", "x").mapInArrow(run, "name int, i int, v double").groupBy("name", "i").agg(F.sum("v").alias("v")).collect()
        found = {name: np.zeros(width) for name in active}
        for r in rows:
            found[names[r.name]][r.i] = r.v
        for name, s in found.items():
            ll, n = s[0], int(s[1])
            start, xi, g, first, second = np.split(s[2:], np.cumsum([k, k * k, parts, parts * d]))
            g = np.maximum(g, 1e-12)
            means = first.reshape(parts, d) / g[:, None]
            covars = second.reshape(parts, d, d) / g[:, None, None] - np.einsum("si,sj->sij", means, means) + 1e-3 * np.eye(d)
            xi = xi.reshape(k, k) + 1e-12
            gain = ll - models[name].loglik
            models[name] = Model(start / max(start.sum(), 1e-12), xi / xi.sum(1, keepdims=True), means, covars, ll, n, g.reshape(k, c) / g.reshape(k, c).sum(1, keepdims=True))
            if gain < tol:
                active.discard(name)
        if not active:
            break
    return models


def first_model(x: np.ndarray, k: int, seed: int, mixtures: int = 1) -> Model:
    """Means by k-means++ and a few Lloyd rounds on a sample of frames; neighbours along the widest axis share a state."""
    rng = np.random.default_rng(seed)
    c = [x[rng.integers(len(x))]]
    for _ in range(k * mixtures - 1):
        d = np.min([((x - m) ** 2).sum(1) for m in c], axis=0)
        c.append(x[rng.choice(len(x), p=d / d.sum() if d.sum() > 0 else None)])
    c = np.array(c)
    for _ in range(10):
        lab = ((x[:, None] - c[None]) ** 2).sum(-1).argmin(1)
        c = np.array([x[lab == s].mean(0) if (lab == s).any() else c[s] for s in range(k * mixtures)])
    c = c[np.argsort(c[:, x.std(0).argmax()], kind="stable")] if mixtures > 1 else c
    cov = np.cov(x.T).reshape(x.shape[1], -1) + 1e-3 * np.eye(x.shape[1])
    stay = np.full((k, k), 0.2 / max(k - 1, 1))
    np.fill_diagonal(stay, 0.8 if k > 1 else 1.0)
    return Model(np.full(k, 1 / k), stay / stay.sum(1, keepdims=True), c, np.repeat(cov[None], k * mixtures, 0), weights=np.full((k, mixtures), 1 / mixtures))


#: Frames of which start models, and silhouettes, are taken: those with the smallest hashes.
START_FRAMES, SILHOUETTE_FRAMES = 5_000, 1_500


def state_silhouette(packed: DataFrame, model: Model) -> float:
    """Mean silhouette of the decoded states over a sample of frames."""
    from phenogrid.operators.models import silhouette

    shared = packed.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), pa.array(viterbi(shared.value, np.array(x, float)).astype(np.int32))], ["v", "s"])

    got = packed.select("x").mapInArrow(run, "v array<double>, s int").orderBy(F.xxhash64("v"), "v").limit(SILHOUETTE_FRAMES).collect()
    x, label = np.array([list(r.v) for r in got], float), np.array([r.s for r in got])
    if len(np.unique(label)) < 2:
        return -1.0
    label = np.unique(label, return_inverse=True)[1]
    return silhouette(np.sqrt(np.maximum(((x[:, None] - x[None]) ** 2).sum(-1), 0)), label)


def fit_hmm(df: DataFrame, n_components: int | Sequence[int], track: str, time: str, rep: str, row_id: str = "row_id", select_by: str = "bic", min_len: int | None = None, sample_size: int = 1000, n_init: int = 3, rounds: int = 10, seed: int = 0, state: str = "HMMState", start: Model | None = None, mixtures: int = 1) -> tuple[DataFrame, Model]:
    """(row_id, state for all rows; the model). Fitted on sample_size tracks, the best of n_init starts for each number of states, the number
    with the smallest bic or aic or the largest silhouette. Emissions are Gaussians, or mixtures of several. States are ordered by their means."""
    if select_by not in ("bic", "aic", "silhouette"):
        raise ValueError(select_by)
    base = df if min_len is None else df.join(df.groupBy(track).count().filter(F.col("count") >= min_len).select(track), track, "left_semi")
    packed = cut(pack(sample_tracks(base, track, sample_size, seed), track, time, rep))
    frames = np.array([list(r[0]) for r in packed.select(F.explode("x").alias("v")).orderBy(F.xxhash64("v"), "v").limit(START_FRAMES).collect()], float)
    best, least = None, np.inf
    for k in [n_components] if isinstance(n_components, int) else n_components:
        starts = [start] if start is not None and start.k == k else [first_model(frames, k, seed + i, mixtures) for i in range(n_init)]
        fits = [em(packed, m, rounds) for m in starts]
        top = max((m for m in fits if np.isfinite(m.loglik)), key=lambda m: m.loglik)
        cost = -state_silhouette(packed, top) if select_by == "silhouette" else getattr(top, select_by)()
        if best is None or cost < least:
            best, least = top, cost
    model = best.ordered()
    return decode(df, model, track, time, rep, row_id, state), model


def decode(df: DataFrame, model: Model, track: str, time: str, rep: str, row_id: str, state: str) -> DataFrame:
    """row_id and the most likely state of every row that has a track."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, x in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(viterbi(shared.value, np.array(x, float)).astype(np.int32))], [row_id, state])

    kind = df.schema[row_id].dataType.simpleString()
    return pack(df, track, time, rep, [row_id]).select("ids", "x").mapInArrow(run, f"`{row_id}` {kind}, `{state}` int")


def fit_hmm_by_key(
    df: DataFrame, key: str, n_components: int, track: str, time: str, rep: str, row_id: str = "row_id", state: str = "HMMState", min_len: int | None = None, sample_size: int = 1000, rounds: int = 10, seed: int = 0, **kw
) -> tuple[DataFrame, dict[object, Model]]:
    """(row_id, state, key; the keys' models): a model of all tracks, then one for each key that starts from it.

    All keys are fitted together, a pass over sample_size tracks of each for a round, and all rows are decoded in one pass."""
    _, shared = fit_hmm(df, n_components, track, time, rep, row_id, min_len=min_len, sample_size=sample_size, rounds=rounds, seed=seed, **kw)
    rows = df.filter(F.col(key).isNotNull() & F.col(track).isNotNull()).withColumn("_kt", F.struct(F.col(key).alias("key"), F.col(track).alias("track")))
    tracks = rows.groupBy("_kt").count() if min_len is None else rows.groupBy("_kt").count().filter(F.col("count") >= min_len)
    w = Window.partitionBy("_kt.key").orderBy(X.hash_order(F.col("_kt.track").cast("string"), seed), "_kt.track")
    chosen = tracks.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= sample_size).select("_kt")
    packed = cut(pack(rows.join(chosen, "_kt", "left_semi"), "_kt", time, rep).select(F.col("_kt.key").alias("key"), "x"))
    names = [r[0] for r in packed.select("key").distinct().orderBy("key").collect()]  # one model for each
    models = {name: m.ordered() for name, m in em_by_key(packed, {name: shared for name in names}, rounds).items()} if names else {}
    given = df.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, ids, x in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                if name in given.value:
                    found = viterbi(given.value[name], np.array(x, float)).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([ids.values, pa.array(found), pa.array([name] * len(found), b.schema.field(0).type)], [row_id, state, key])

    kinds = {c: df.schema[c].dataType.simpleString() for c in (row_id, key)}
    whole = pack(rows, "_kt", time, rep, [row_id]).select(F.col("_kt.key").alias("key"), "ids", "x")
    return whole.mapInArrow(run, f"`{row_id}` {kinds[row_id]}, `{state}` int, `{key}` {kinds[key]}"), models


def hmm_distance(df: DataFrame, models: dict[object, Model], include_start: bool = False) -> DataFrame:
    """a, b, distance: Jensen-Shannon distance between the keys' stationary (or start) distributions."""
    from phenogrid.operators.timeseries import jensen_shannon

    rows = [(str(k), s, float(p)) for k, m in models.items() for s, p in enumerate(m.start if include_start else m.stationary())]
    return jensen_shannon(df.sparkSession.createDataFrame(rows, "key string, state int, p double"), "key", "state", "p")

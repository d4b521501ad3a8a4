"""Simulated tracks as sources: a range of track numbers, each made by its own seeded generator, so results do not depend on partitioning."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def _source(spark: SparkSession, n: int, columns: dict[str, str], make: Callable[[np.random.Generator], dict[str, np.ndarray]], seed: int, fpu: int) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for i in part["id"]:
                got = make(np.random.default_rng([seed, int(i)]))
                size = len(next(iter(got.values())))
                yield pd.DataFrame({"track": int(i), "time": np.arange(size) / fpu, **got})

    return spark.range(n).mapInPandas(run, "track long, time double, " + ", ".join(f"{c} {k}" for c, k in columns.items()))


def motion(spark: SparkSession, n: int, model: str = "rw", dim: int = 2, length: int = 50, fpu: int = 1, seed: int = 0, origin_min: float = 0.0, origin_max: float = 2048.0, sigma: float = 1.0, kappa: float = 2.0, alpha: float = 1.5, x_min: float = 1.0, hurst: float = 0.5, code_compatible: bool = False) -> DataFrame:
    """track, time, x0.. : `rw` random walk, `brw` walk whose turns concentrate about the last heading (kappa), `levy` flight with
    power-law steps of exponent alpha, `fbm` fractional Brownian motion. code_compatible uses exponent 1 / alpha in levy draws."""
    root = None
    if model == "fbm":
        t = np.arange(1, length)
        cov = 0.5 * (t[:, None] ** (2 * hurst) + t[None] ** (2 * hurst) - np.abs(t[:, None] - t[None]) ** (2 * hurst))
        root = np.linalg.cholesky(cov + 1e-10 * np.eye(length - 1))

    def make(rng: np.random.Generator) -> dict[str, np.ndarray]:
        start = rng.uniform(origin_min, origin_max, dim)
        if model == "fbm":
            path = np.concatenate([np.zeros((1, dim)), sigma * (root @ rng.normal(size=(length - 1, dim)))])
        else:
            if model == "rw":
                steps = rng.normal(0, sigma, (length - 1, dim))
            else:
                heading = rng.normal(size=(length - 1, dim))
                heading /= np.linalg.norm(heading, axis=1, keepdims=True)
                if model == "brw":
                    for k in range(1, length - 1):
                        h = kappa * heading[k - 1] + rng.normal(size=dim)
                        heading[k] = h / np.linalg.norm(h)
                    size = np.abs(rng.normal(0, sigma, length - 1))
                else:
                    size = x_min * (1 - rng.uniform(size=length - 1)) ** (-1 / alpha if code_compatible else -1 / (alpha - 1))
                steps = heading * size[:, None]
            path = np.concatenate([np.zeros((1, dim)), np.cumsum(steps, 0)])
        return {f"x{i}": path[:, i] + start[i] for i in range(dim)}

    return _source(spark, n, {f"x{i}": "double" for i in range(dim)}, make, seed, fpu)


def _stochastic(m: np.ndarray | None, k: int, seed: int) -> np.ndarray:
    if m is None:
        m = np.random.default_rng(seed).uniform(size=(k, k))
    m = np.asarray(m, float)
    return m / m.sum(-1, keepdims=True)


def _chain(rng: np.random.Generator, t: np.ndarray, first: int, length: int) -> np.ndarray:
    out, edges, u = np.empty(length, np.int64), np.cumsum(t, 1), rng.uniform(size=length)
    out[0] = first
    for i in range(1, length):
        out[i] = min(int(np.searchsorted(edges[out[i - 1]], u[i])), len(t) - 1)
    return out


def markov_chain(spark: SparkSession, n: int, n_states: int, t: np.ndarray | None = None, start_state: int | None = None, length: int = 50, fpu: int = 1, seed: int = 0) -> DataFrame:
    t = _stochastic(t, n_states, seed)
    return _source(spark, n, {"state": "long"}, lambda rng: {"state": _chain(rng, t, int(rng.integers(n_states)) if start_state is None else start_state, length)}, seed, fpu)


def ndarma(spark: SparkSession, n: int, n_states: int, coeffs: np.ndarray | None = None, pi: np.ndarray | None = None, ar_order: int = 2, ma_order: int = 0, length: int = 50, fpu: int = 1, seed: int = 0) -> DataFrame:
    """A state repeats one of the last ar_order states or one of the last ma_order + 1 draws; coeffs are the choices' weights (equal if not given)."""
    w = np.ones(ar_order + ma_order + 1) if coeffs is None else np.asarray(coeffs, float)
    w = w / w.sum()
    p = np.full(n_states, 1 / n_states) if pi is None else np.asarray(pi, float) / np.sum(pi)

    def make(rng: np.random.Generator) -> dict[str, np.ndarray]:
        lead = max(ar_order, ma_order)
        draw = rng.choice(n_states, length + lead, p=p)
        pick = rng.choice(len(w), length + lead, p=w)
        out = draw.copy()
        for i in range(lead, length + lead):
            c = pick[i]
            out[i] = out[i - 1 - c] if c < ar_order else draw[i - (c - ar_order)]
        return {"state": out[lead:].astype(np.int64)}

    return _source(spark, n, {"state": "long"}, make, seed, fpu)


def hidden_markov(spark: SparkSession, n: int, n_states: int, t: np.ndarray | None = None, e: np.ndarray | None = None, start_prob: np.ndarray | None = None, length: int = 50, fpu: int = 1, seed: int = 0) -> DataFrame:
    """track, time, hidden, state: a hidden chain and the state it shows."""
    t, e = _stochastic(t, n_states, seed), _stochastic(e, n_states, seed + 1)
    s = np.full(n_states, 1 / n_states) if start_prob is None else np.asarray(start_prob, float) / np.sum(start_prob)

    def make(rng: np.random.Generator) -> dict[str, np.ndarray]:
        hidden = _chain(rng, t, int(rng.choice(n_states, p=s)), length)
        edges = np.cumsum(e, 1)
        shown = np.array([min(int(np.searchsorted(edges[h], u)), e.shape[1] - 1) for h, u in zip(hidden, rng.uniform(size=length), strict=True)], np.int64)
        return {"hidden": hidden, "state": shown}

    return _source(spark, n, {"hidden": "long", "state": "long"}, make, seed, fpu)

"""Corrections of batch, plate and bleaching effects. Models are fitted from moments or small groups and applied as projections."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phenogrid.functions import expr as X
from phenogrid.functions import gram


def covariance(df: DataFrame, feats: Sequence[str], sample: bool = False) -> tuple[np.ndarray, np.ndarray, int]:
    """(mean, covariance, rows) in one pass. Missing values raise."""
    m = gram.moments(df, feats)[None]
    if m.missing.any():
        raise ValueError("covariance: missing values")
    return m.mean, m.covariance(sample), m.n


def _power(m: np.ndarray, p: float, eps: float = 0.0) -> np.ndarray:
    w, v = np.linalg.eigh((m + m.T) / 2)
    return (v * np.maximum(w + eps, 1e-300) ** p) @ v.T


def inverse_root(m: np.ndarray, eps: float = 0.0) -> np.ndarray:
    return _power(m, -0.5, eps)


def project(df: DataFrame, feats: Sequence[str], matrix: np.ndarray, shift: np.ndarray | None = None, names: Sequence[str] | None = None) -> DataFrame:
    """df with (x - shift) @ matrix in place of the features, or under new names."""
    shift = np.zeros(len(feats)) if shift is None else shift
    return gram.applied(df, feats, list(names or feats), lambda x, _: (x - shift) @ matrix)


def _controls(df: DataFrame, treat: str, control: object, time: str | None, ref_time: object) -> DataFrame:
    out = df.filter(F.col(treat) == F.lit(control))
    return out if ref_time is None else out.filter(F.col(time) == F.lit(ref_time))


@dataclass
class TVN:
    """Whitening by the controls: (x - mean) @ W.T with W = diag(1 / sqrt(variance + epsilon)) @ U.T of the control covariance."""

    feats: Sequence[str]
    treat_key: str
    control: object = "ctrl"
    time_key: str | None = None
    ref_time: object = None
    epsilon: float = 1e-5
    mean: np.ndarray | None = None
    matrix: np.ndarray | None = None

    def fit(self, df: DataFrame) -> TVN:
        self.mean, cov, _ = covariance(_controls(df, self.treat_key, self.control, self.time_key, self.ref_time), self.feats)
        w, u = np.linalg.eigh(cov)
        order = np.argsort(-w)
        u = u[:, order] * np.sign(u[np.abs(u[:, order]).argmax(0), order] + 1e-300)  # a fixed sign for each axis
        self.matrix = (u / np.sqrt(np.maximum(w[order], 0) + self.epsilon)).astype(float)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return project(df, self.feats, self.matrix, self.mean)


@dataclass
class CORAL:
    """Aligns batches: x @ (C_batch + r I)^-1/2 @ (C + r I)^1/2, with sample covariances of controls; nothing is centred. One matrix for each batch."""

    feats: Sequence[str]
    batch_key: str
    treat_key: str
    control: object = "ctrl"
    time_key: str | None = None
    ref_time: object = None
    weight: float = 1.0
    matrices: dict[object, np.ndarray] = field(default_factory=dict)

    def fit(self, df: DataFrame) -> CORAL:
        base = _controls(df, self.treat_key, self.control, self.time_key, self.ref_time)
        ridge = self.weight * np.eye(len(self.feats))
        whole = _power(covariance(base, self.feats, sample=True)[1] + ridge, 0.5)
        for batch, m in gram.moments(base, self.feats, self.batch_key).items():
            if batch is not None:
                self.matrices[batch] = _power(m.covariance(sample=True) + ridge, -0.5) @ whole
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        """Batches without controls get no result: their features are NULL."""
        matrices, key = self.matrices, self.batch_key

        def align(x: np.ndarray, b: pa.RecordBatch) -> np.ndarray:
            out, batches = np.full_like(x, np.nan), np.array(b.column(key).to_pylist(), object)
            for k, m in matrices.items():
                rows = batches == k
                out[rows] = x[rows] @ m
            return out

        return gram.applied(df, self.feats, list(self.feats), align)


def median_polish(x: np.ndarray, max_iterations: int = 10, method: str = "median") -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """(grand, column effects, row effects, residuals) of a table by alternating sweeps of rows and columns; NaN cells are skipped."""
    mid = np.nanmedian if method == "median" else np.nanmean
    res = x.astype(float).copy()
    grand, rows, cols = 0.0, np.zeros(x.shape[0]), np.zeros(x.shape[1])
    with np.errstate(all="ignore"):
        for _ in range(max_iterations):
            r = np.nan_to_num(mid(res, axis=1))
            res -= r[:, None]
            rows += r
            m = float(mid(rows))
            grand, rows = grand + m, rows - m
            c = np.nan_to_num(mid(res, axis=0))
            res -= c[None]
            cols += c
    return grand, cols, rows, res


def correct_plates(df: DataFrame, feats: Sequence[str], row_var: str, col_var: str, by: Sequence[str] = (), max_iterations: int = 10, method: str = "median") -> DataFrame:
    """B-scores: each plate's and feature's residual of a polish over its wells, divided by the residuals' MAD (scale 1). Written back by well; missing wells are skipped.

    One group for each plate and feature: a few hundred wells. A plate without spread gives NULL."""
    keys = [*by, row_var, col_var]
    rows = X.long(df.select(*keys, *feats), keys, feats)

    def polish(group: pd.DataFrame) -> pd.DataFrame:
        ri, ci = pd.factorize(group[row_var], sort=True)[0], pd.factorize(group[col_var], sort=True)[0]
        grid = np.full((ri.max() + 1, ci.max() + 1), np.nan)
        grid[ri, ci] = group["value"].to_numpy(float)
        res = median_polish(grid, max_iterations, method)[3]
        mad = np.nanmedian(np.abs(res - np.nanmedian(res)))
        out = group.copy()
        out["value"] = res[ri, ci] / mad if mad > 0 else np.nan
        return out

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    scored = rows.groupBy(*by, "feature").applyInPandas(polish, schema).withColumn("value", X.clean("value"))
    wide = scored.groupBy(*keys).pivot("feature", list(feats)).agg(F.first("value"))
    return df.drop(*feats).join(wide, keys)


def mono_exponential(t: np.ndarray, a: float, b: float) -> np.ndarray:
    return b * np.exp(-a * t)


def bi_exponential(t: np.ndarray, a: float, b: float, c: float, d: float) -> np.ndarray:
    return b * np.exp(-a * t) + d * np.exp(-c * t)


CURVES: dict[str, tuple[Callable, int]] = {"mono": (mono_exponential, 2), "bi": (bi_exponential, 4)}


def fit_curve(curve: Callable, n: int, t: np.ndarray, y: np.ndarray, rounds: int = 400) -> np.ndarray | None:
    """Levenberg-Marquardt least squares from a start of ones; None if it fails."""
    p, damp = np.ones(n), 1e-2
    with np.errstate(all="ignore"):
        r = y - curve(t, *p)
        cost = float(r @ r)
        for _ in range(rounds):
            step = 1e-7 * np.maximum(np.abs(p), 1e-3)
            jac = np.stack([(curve(t, *(p + np.eye(n)[k] * step[k])) - curve(t, *p)) / step[k] for k in range(n)], 1)
            h = jac.T @ jac
            try:
                move = np.linalg.solve(h + damp * np.diag(np.diag(h) + 1e-12), jac.T @ r)
            except np.linalg.LinAlgError:
                return None
            new = p + move
            nr = y - curve(t, *new)
            ncost = float(nr @ nr)
            if np.isfinite(ncost) and ncost <= cost:
                done = cost - ncost <= 1e-14 * (cost + 1e-300) and np.abs(move).max() < 1e-9
                p, r, cost, damp = new, nr, ncost, max(damp / 5, 1e-12)
                if done:
                    break
            else:
                damp *= 5
                if damp > 1e12:
                    break
    return p if np.isfinite(p).all() and np.isfinite(cost) else None


def control_curve(df: DataFrame, feats: Sequence[str], treat: str, time: str, ctrl: object = "ctrl") -> DataFrame:
    """time, feature, mean of the controls."""
    base = df.filter((F.col(treat) == F.lit(ctrl)) & F.col(time).isNotNull())
    return X.long(base.select(time, *feats), [time], feats).groupBy(time, "feature").agg(F.avg("value").alias("mean"))


def correct_bleaching(df: DataFrame, feats: Sequence[str], channels: Sequence[str] | None, treat: str, time: str, curve: str = "mono", ctrl: object = "ctrl", min_r2: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(df with corrected features; feature, time, factor, r2). Features whose name holds a channel are divided by the fitted curve of the controls' means,
    scaled to a largest value of one. A feature that reaches below zero is shifted up by its minimum for the fit and the division, and back.
    Fits that fail, or whose r2 is below min_r2, change nothing."""
    chosen = [f for f in feats if channels is None or any(c in f for c in channels)]
    low = df.agg(*[F.min(f).alias(f) for f in chosen]).first()
    shift = {f: max(0.0, -(low[f] or 0.0)) for f in chosen}
    means = control_curve(df.withColumns({f: F.col(f) + F.lit(shift[f]) for f in chosen}), chosen, treat, time, ctrl)
    func, n = CURVES[curve]

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(time)
        t, y = group[time].to_numpy(float), group["mean"].to_numpy(float)
        p = fit_curve(func, n, t, y) if len(t) >= n else None
        fitted = func(t, *p) if p is not None else np.ones(len(t))
        spread = float(((y - y.mean()) ** 2).sum())
        r2 = 1 - float(((y - fitted) ** 2).sum()) / spread if p is not None and spread > 0 else 0.0
        factor = fitted / fitted.max() if p is not None and fitted.max() > 0 and (min_r2 is None or r2 >= min_r2) else np.ones(len(t))
        return pd.DataFrame({"feature": group["feature"], "time": t, "factor": factor, "r2": r2})

    curves = means.groupBy("feature").applyInPandas(solve, "feature string, time double, factor double, r2 double")
    wide = curves.groupBy(F.col("time").alias("_t")).pivot("feature", chosen).agg(F.first("factor"))
    wide = wide.select("_t", *[F.col(f).alias(f"_f_{f}") for f in chosen])
    out = df.join(wide, F.col(time).cast("double") == F.col("_t"), "left")
    fixed = {f: X.div(F.col(f) + F.lit(shift[f]), F.coalesce(F.col(f"_f_{f}"), F.lit(1.0))) - F.lit(shift[f]) for f in chosen}
    return out.withColumns(fixed).drop("_t", *[f"_f_{f}" for f in chosen]), curves


# Tile index (from 0) to (row, column) of a grid in the four reading orders.
READINGS: dict[str, Callable[[Column, int, int], tuple[Column, Column]]] = {
    "horizontal": lambda i, rows, cols: (F.floor(i / cols), i % cols),
    "vertical": lambda i, rows, cols: (i % rows, F.floor(i / rows)),
    "horizontal_serp": lambda i, rows, cols: (F.floor(i / cols), F.when(F.floor(i / cols) % 2 == 0, i % cols).otherwise(cols - 1 - i % cols)),
    "vertical_serp": lambda i, rows, cols: (F.when(F.floor(i / rows) % 2 == 0, i % rows).otherwise(rows - 1 - i % rows), F.floor(i / rows)),
}


def pseudostitch(df: DataFrame, tile: str, x: str, y: str, grid: tuple[int, int] = (5, 5), image: tuple[int, int] = (2048, 2048), overlap: float = 0.2, reading: str = "horizontal", first: int = 1, by: Sequence[str] = (), update_loc: bool = True) -> DataFrame:
    """Positions in the whole well (unless update_loc is off), tile_row and tile_col, without objects that lie in the area of an earlier tile. With `by`, only of tiles in which the group has objects.

    A tile's area is [int(t), int(t + size)) in x and y. The earlier tiles that can hold a position are known from the grid, so
    the test is arithmetic on constants: no join, no bitmap."""
    rows, cols = grid
    i = F.col(tile) - first
    r, c = READINGS[reading](i, rows, cols)
    step_y, step_x = image[0] * (1 - overlap), image[1] * (1 - overlap)
    out = df.withColumns({"tile_row": r.cast("int"), "tile_col": c.cast("int")})
    at_x, at_y = F.col(x) + F.col("tile_col") * step_x, F.col(y) + F.col("tile_row") * step_y
    if update_loc:
        out = out.withColumns({x: at_x, y: at_y})
        at_x, at_y = F.col(x), F.col(y)
    order = _orders(rows, cols, reading)
    rects = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(int(step_x * cc)).alias("x0"), F.lit(int(step_x * cc + image[1])).alias("x1"), F.lit(int(step_y * rr)).alias("y0"), F.lit(int(step_y * rr + image[0])).alias("y1")) for k, (rr, cc) in enumerate(order)])
    if by:
        held = out.groupBy(*by).agg(F.collect_set((F.col(tile) - first).cast("int")).alias("_tiles"))  # as many numbers as the grid has tiles
        out = out.join(held, list(by))
        rects = F.filter(rects, lambda t: F.array_contains("_tiles", t["k"]))
    px, py = F.floor(at_x), F.floor(at_y)
    covered = F.exists(rects, lambda t: (t["k"] < i) & (px >= t["x0"]) & (px < t["x1"]) & (py >= t["y0"]) & (py < t["y1"]))
    return out.filter(~covered).drop("_tiles")


def _orders(rows: int, cols: int, reading: str) -> list[tuple[int, int]]:
    def one(i: int) -> tuple[int, int]:
        if reading == "horizontal":
            return i // cols, i % cols
        if reading == "vertical":
            return i % rows, i // rows
        if reading == "horizontal_serp":
            return i // cols, i % cols if i // cols % 2 == 0 else cols - 1 - i % cols
        return (i % rows if i // rows % 2 == 0 else rows - 1 - i % rows), i // rows

    return [one(i) for i in range(rows * cols)]


def plate_map(df: DataFrame, well: str, value: str, rows: int = 8, cols: int = 12, size: str | None = None, size_range: tuple[float, float] = (0.0, 1.0)) -> DataFrame:
    """row, col, value (NULL where empty) of every well of a plate, and its size rescaled to size_range."""
    spark = df.sparkSession
    grid = spark.range(rows * cols).select((F.floor(F.col("id") / cols) + 1).cast("int").alias("row"), (F.col("id") % cols + 1).cast("int").alias("col"))
    name = F.concat(F.char(64 + F.col("row")), F.col("col").cast("string"))
    side = df.select(F.col(well).alias("_w"), F.col(value).alias("value"), *([F.col(size).alias("size")] if size else []))
    out = grid.join(side, name == F.col("_w"), "left").drop("_w")
    if size:
        from pyspark.sql import Window

        w = Window.partitionBy()  # one plate
        lo, hi = F.min("size").over(w), F.max("size").over(w)
        out = out.withColumn("size", size_range[0] + X.div(F.col("size") - lo, hi - lo) * (size_range[1] - size_range[0]))
    return out

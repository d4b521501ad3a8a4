"""Exact nearest neighbours of rows among rows, in parts around pivots.

Rows belong to the nearest of some pivots, which are rows themselves. A row first meets its own part, which bounds the distance of its
k-th neighbour. It then visits only parts that can hold a nearer row: by the triangle inequality a part lies no nearer than the
distance to its pivot less its radius, and no nearer than the plane between the two pivots. On clustered rows that is few parts; where
distances hardly differ, as in many dimensions without structure, it can be all, and the work is quadratic. Rows and visitors of a part
meet in blocks of bounded size, as matrix products, so a hot part is many blocks; of a meeting only each row's k best leave.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phenogrid.functions.scratch import cut
from phenogrid.functions.threads import one_thread
from phenogrid.operators.group import sample_rows

#: Rows of a part, about; most pivots (every task holds them); rows of a block; rows that are compared at a time; visits that leave a task at a time.
PART_ROWS, MOST_PIVOTS, BLOCK_ROWS, STEP_ROWS, STEP_VISITS = 1_024, 4_096, 8_192, 512, 8_192


def _vectors(b: pa.RecordBatch | pa.Table, name: str) -> np.ndarray:
    col = b.column(name)
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return np.asarray(col.flatten(), float).reshape(b.num_rows, -1) if b.num_rows else np.zeros((0, 1))


def _away(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1) - 2 * x @ y.T, 0))


def _meet(k: int):
    def run(one: pa.Table, two: pa.Table) -> pa.Table:
        one_thread()
        if not one.num_rows or not two.num_rows:
            some = one.column("id") if one.num_rows else two.column("id2")
            return pa.table({"id": some.slice(0, 0), "other": some.slice(0, 0), "distance": pa.array([], pa.float64())})
        two = two.sort_by("id2")
        x, y = _vectors(one, "v"), _vectors(two, "v2")
        ids, others = one.column("id").combine_chunks(), two.column("id2").combine_chunks()
        place = {v: i for i, v in enumerate(others.to_pylist())}
        own = np.array([place.get(v, -1) for v in ids.to_pylist()])
        yy, take = (y**2).sum(1), min(k, len(y))
        a, b, d = [], [], []
        for at in range(0, len(x), STEP_ROWS):
            z = x[at : at + STEP_ROWS]
            s = np.maximum((z**2).sum(1)[:, None] + yy[None] - 2 * z @ y.T, 0)
            mine = own[at : at + STEP_ROWS]
            s[np.flatnonzero(mine >= 0), mine[mine >= 0]] = np.inf
            low = np.partition(s, take - 1, axis=1)[:, take - 1 : take]
            i, j = np.nonzero((s <= low * (1 + 1e-9) + 1e-12) & np.isfinite(s))  # and what ties with the last
            a.append(i + at)
            b.append(j)
            d.append(np.sqrt(((z[i] - y[j]) ** 2).sum(1)))
        return pa.table({"id": ids.take(pa.array(np.concatenate(a))), "other": others.take(pa.array(np.concatenate(b))), "distance": pa.array(np.concatenate(d))})

    return run


def _met(visitors: DataFrame, rows: DataFrame, k: int, block_rows: int) -> DataFrame:
    """id, other, distance: the k nearest of each visitor (id, v, part) in each block of the rows (id, v, part) of its part."""
    n, m = (df.groupBy("part").agg(F.count(F.lit(1)).alias(c)) for df, c in ((visitors, "_n"), (rows, "_m")))
    blocks = n.join(m, "part").select("part", *[F.ceil(F.col(c) / block_rows).alias(c) for c in ("_n", "_m")])  # a row for each pivot
    left = visitors.join(F.broadcast(blocks), "part").select("id", "v", "part", F.pmod(F.xxhash64("id"), F.col("_n")).alias("a"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_m") - 1)).alias("b"))
    right = rows.join(F.broadcast(blocks), "part").select(F.col("id").alias("id2"), F.col("v").alias("v2"), F.col("part").alias("part2"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("a2"), F.pmod(F.xxhash64("id"), F.col("_m")).alias("b2"))
    kind = rows.schema["id"].dataType.simpleString()
    return left.groupBy("part", "a", "b").cogroup(right.groupBy("part2", "a2", "b2")).applyInArrow(_meet(k), f"id {kind}, other {kind}, distance double")


def _best(met: DataFrame, k: int) -> DataFrame:
    return met.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("distance", "other"))).filter(F.col("rank") <= k)


def parted(df: DataFrame, row_id: str, vector: Column, part_rows: int = PART_ROWS, most_pivots: int = MOST_PIVOTS, seed: int = 0) -> tuple[DataFrame, np.ndarray]:
    """(id, v, part, away of the rows with whole vectors, written; the pivots). away is the distance from the part's pivot."""
    rows = df.select(F.col(row_id).alias("id"), vector.cast("array<double>").alias("v")).filter(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x)))
    count = rows.count()
    pivots = np.array([r.v for r in sample_rows(rows, max(1, min(most_pivots, -(-count // part_rows))), "id", seed).collect()], float)
    if not count:
        return rows.withColumns({"part": F.lit(0), "away": F.lit(0.0)}), np.zeros((0, 1))
    pivots = np.unique(pivots, axis=0)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        for b in batches:
            if b.num_rows:
                x = _vectors(b, "v")
                part = np.concatenate([_away(x[i : i + STEP_ROWS], pivots).argmin(1) for i in range(0, len(x), STEP_ROWS)])
                away = np.sqrt(((x - pivots[part]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(part, pa.int32()), pa.array(away)], ["id", "v", "part", "away"])

    return cut(rows.mapInArrow(place, f"id {rows.schema['id'].dataType.simpleString()}, v array<double>, part int, away double")), pivots


def visits(rows: DataFrame, pivots: np.ndarray, bound: DataFrame) -> DataFrame:
    """id, v, part of the other parts that each row must visit, given (id, within), the distance of its k-th neighbour so far (null: unknown)."""
    radius = np.full(len(pivots), -np.inf)  # parts without rows are never visited
    for r in rows.groupBy("part").agg(F.max("away").alias("r")).collect():  # a row for each pivot
        radius[r.part] = r.r
    between = _away(pivots, pivots)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        for b in batches:
            if not b.num_rows:
                continue
            x, own = _vectors(b, "v"), b.column("part").to_numpy()
            away, within = b.column("away").to_numpy(), np.nan_to_num(b.column("within").to_numpy(zero_copy_only=False).astype(float), nan=np.inf)
            for i in range(0, len(x), STEP_ROWS):
                at = slice(i, i + STEP_ROWS)
                d = _away(x[at], pivots)
                with np.errstate(divide="ignore", invalid="ignore"):
                    plane = (d**2 - away[at, None] ** 2) / (2 * between[own[at]])
                low = np.maximum(d - radius, np.nan_to_num(plane, nan=0.0, posinf=0.0, neginf=0.0))
                slack = 1e-6 * (1 + d + away[at, None])  # above the rounding of distances by products
                go = (low <= within[at, None] + slack) & np.isfinite(radius)
                go[np.arange(len(d)), own[at]] = False
                r, c = np.nonzero(go)
                for j in range(0, len(r), STEP_VISITS):  # a row may visit all parts: its vector is copied for few visits at a time
                    rows_at = pa.array(r[j : j + STEP_VISITS] + i)
                    yield pa.RecordBatch.from_arrays([b.column("id").take(rows_at), b.column("v").take(rows_at), pa.array(c[j : j + STEP_VISITS], pa.int32())], ["id", "v", "part"])

    known = rows.join(bound, "id", "left").select("id", "v", "part", "away", F.col("within").cast("double").alias("within"))
    return known.mapInArrow(look, f"id {rows.schema['id'].dataType.simpleString()}, v array<double>, part int")


def nearest(df: DataFrame, row_id: str, vector: Column, k: int, block_rows: int = BLOCK_ROWS, part_rows: int = PART_ROWS) -> DataFrame:
    """id, other, distance, rank (from 1): the k nearest other rows (Euclidean) of each row; ties to the smaller id.

    Rows without a vector, or with a missing component, take no part. Distances are taken again from the difference."""
    rows, pivots = parted(df, row_id, vector, part_rows)
    near = _best(_met(rows.select("id", "v", "part"), rows.select("id", "v", "part"), k, block_rows), k)
    if len(pivots) <= 1:
        return near
    near = cut(near.drop("rank"))
    bound = near.groupBy("id").agg(F.when(F.count(F.lit(1)) >= k, F.max("distance")).alias("within"))
    away = cut(visits(rows, pivots, bound))
    return _best(near.unionByName(_met(away, rows.select("id", "v", "part"), k, block_rows)), k)


def local_outlier_factor(df: DataFrame, row_id: str, vector: Column, k: int = 20) -> DataFrame:
    """id, lof: the mean density of a row's k neighbours over its own, a density being the inverse of the mean reachability distance. All rows are sought among all rows."""
    near = cut(nearest(df, row_id, vector, k))
    reach = near.groupBy(F.col("id").alias("other")).agg(F.max("distance").alias("kth"))
    density = near.join(reach, "other").groupBy("id").agg((1 / F.greatest(F.avg(F.greatest("distance", "kth")), F.lit(1e-12))).alias("density"))
    density = cut(density)
    around = near.join(density.select(F.col("id").alias("other"), F.col("density").alias("theirs")), "other").groupBy("id").agg(F.avg("theirs").alias("theirs"))
    return around.join(density, "id").select("id", (F.col("theirs") / F.col("density")).alias("lof"))

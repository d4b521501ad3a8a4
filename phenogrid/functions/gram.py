"""Means and cross products of many features in one pass: a matrix product in each task, summed in a tree.

What leaves a task is (rows, means, cross products about its own means) for each group, cut into blocks of rows of the matrix;
blocks meet by group and block, first in 256 parts and then in one. The result is on the driver: a matrix of the features for each
group, which their number bounds, not the rows. Matrices are applied with one product for each Arrow batch.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phenogrid.functions.threads import one_thread

#: Numbers of a block, about: 0.8 MB, so that a few hundred of them fit a task.
BLOCK_NUMBERS = 100_000


@dataclass
class Moments:
    """Rows, of which those with a missing value are skipped; missing values of each feature; means; sums of products of deviations."""

    n: int
    missing: np.ndarray
    mean: np.ndarray
    cross: np.ndarray

    def covariance(self, sample: bool = False) -> np.ndarray:
        return self.cross / max(1, self.n - (1 if sample else 0))


def matrix(batch: pa.RecordBatch | pa.Table, feats: Sequence[str]) -> np.ndarray:
    """Columns as doubles; missing values are NaN."""
    out = np.empty((batch.num_rows, len(feats)))
    for i, f in enumerate(feats):
        out[:, i] = batch.column(f).cast(pa.float64()).to_numpy(**({"zero_copy_only": False} if isinstance(batch, pa.RecordBatch) else {}))
    return out


def _add(a: tuple, b: tuple) -> tuple:
    """Moments of two disjoint sets of rows; the matrices may be any block of rows `at` of the whole."""
    (n, mean, cross, at), (m, other, more, _) = a, b
    if not m:
        return a
    if not n:
        return b
    shift = other - mean
    return n + m, mean + shift * (m / (n + m)), cross + more + np.outer(shift[at[0] : at[1]], shift) * (n * m / (n + m)), at


def moments(df: DataFrame, feats: Sequence[str], by: str | None = None, drop_missing: bool = False) -> dict[object, Moments]:
    """Moments of each group of `by` (null too), or of all rows under the key None.

    A missing value counts for its feature, and as 0 in the products; with drop_missing its row is left out altogether."""
    d = len(feats)
    high = max(1, BLOCK_NUMBERS // max(1, d))
    blocks = [(i, min(d, i + high)) for i in range(0, d, high)]
    kind = df.schema[by].dataType.simpleString() if by else "int"
    named = df.select(F.col(by).alias("key") if by else F.lit(None).cast("int").alias("key"), *[F.col(f"`{f}`").cast("double").alias(f"x{i}") for i, f in enumerate(feats)])
    cols = [f"x{i}" for i in range(d)]

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        one_thread()
        held: dict[object, tuple] = {}
        lost: dict[object, np.ndarray] = {}
        for b in batches:
            keys, x = b.column(0).to_pylist(), matrix(b, cols)
            order: dict[object, list[int]] = {}
            for i, k in enumerate(keys):
                order.setdefault(k, []).append(i)
            for k, rows in order.items():
                part = x[rows]
                gone = np.isnan(part)
                lost[k] = lost.get(k, 0) + gone.sum(0)
                part = part[~gone.any(1)] if drop_missing else np.where(gone, 0.0, part)
                if len(part):
                    mean = part.mean(0)
                    part = part - mean
                    held[k] = _add(held.get(k, (0, 0, 0, 0)), (len(part), mean, part.T @ part, (0, d)))
                else:
                    held.setdefault(k, (0, np.zeros(d), np.zeros((d, d)), (0, d)))
        task = TaskContext.get().partitionId()
        for k, (n, mean, cross, _) in held.items():
            blobs = [pickle.dumps((n, mean, cross[a:z], (a, z), lost[k])) for a, z in blocks]
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(blocks), b.schema.field(0).type), pa.array(range(len(blocks)), pa.int32()), pa.array([task] * len(blocks), pa.int32()), pa.array(blobs, pa.binary())], ["key", "block", "part", "blob"])

    def add(group: pa.Table) -> pa.Table:
        total, gone = None, 0
        for blob in group.sort_by("part").column("blob").to_pylist():
            *one, missing = pickle.loads(blob)
            total, gone = tuple(one) if total is None else _add(total, tuple(one)), gone + missing
        return group.slice(0, 1).set_column(3, "blob", pa.array([pickle.dumps((*total, gone))], pa.binary()))

    schema = f"key {kind}, block int, part int, blob binary"
    sums = named.mapInArrow(tally, schema)
    for parts in (256, 1):
        sums = sums.withColumn("part", F.pmod("part", F.lit(parts)).cast("int")).groupBy("key", "block", "part").applyInArrow(add, schema)
    out: dict[object, Moments] = {}
    for key, _, _, blob in sums.collect():
        n, mean, cross, (a, z), gone = pickle.loads(blob)
        m = out.setdefault(key, Moments(n, gone, mean, np.zeros((d, d))))
        m.cross[a:z] = cross
    if not by and not out:
        out[None] = Moments(0, np.zeros(d, np.int64), np.zeros(d), np.zeros((d, d)))
    return out


def applied(df: DataFrame, feats: Sequence[str], names: Sequence[str], function: Callable[[np.ndarray, pa.RecordBatch], np.ndarray]) -> DataFrame:
    """df with the columns `names` (new, or in place of old ones) = function(matrix of feats, batch), one product for each batch. Rows with a missing value get NULLs where the result is NaN."""
    kept = [f for f in df.schema.fields if f.name not in names]
    schema = T.StructType([*kept, *[T.StructField(n, T.DoubleType()) for n in names]])
    inner = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        for b in batches:
            y = function(matrix(b, feats), b)
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in inner], *[pa.array(y[:, j], mask=~np.isfinite(y[:, j])) for j in range(len(names))]], [*inner, *names])

    order = [f"`{c}`" for c in [*df.columns, *[n for n in names if n not in df.columns]]]
    return df.mapInArrow(run, schema).select(*order)

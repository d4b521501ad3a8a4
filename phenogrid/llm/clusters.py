"""Centroid clustering with a filter of rotated coordinates.

Vectors become whole numbers. A rotation onto their principal axes is found from one pass of cross products; each vector is stored with
its leading rotated coordinates (as many as hold LEAD_SHARE of the variance) and the norm of what they leave out (the residual). For a vector and a centroid, the squared
distance of the leading coordinates plus the squared difference of the residual norms never exceeds their squared distance. So a vector
measures, in whole numbers, the centroid with the least bound, and then only those whose bound does not exceed that distance: the
survivors. The bounds decide only what is measured, never the result.

Each round reads the stored table, sends the centroids (a few rows of bounded length) to the tasks, and adds up one row of sums for
each task and cluster. No vector leaves its task, so a hot cluster is as cheap as any other.

Defined results: vectors that are null, of another length, or that hold a null or non-finite component take no part and have no row.
Null and repeated ids stay, one result for each row; a null id is hashed as empty text. Vectors with equal hashes start in the order of
their components. With fewer than CENTROIDS kept vectors there are as many centroids as vectors. Equal distances go to the smaller
number; an empty cluster keeps its centroid. An empty table gives an empty result. Other columns are ignored. A component of 2**21 or
more (2**27 once scaled) fails with a message: its squared distances would not fit 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phenogrid.functions.gram import moments
from phenogrid.functions.threads import one_thread
from phenogrid.llm.common import materialise, table

DIMS, SCALE, CENTROIDS, ROUNDS = 64, 64, 16, 3
#: Share of the variance that the stored rotated coordinates hold: few on clustered vectors, most of them where no direction stands out.
LEAD_SHARE = 0.9
_MOST = 1 << 27


@dataclass
class Rotation:
    mean: np.ndarray
    axes: np.ndarray  # (dims, lead), orthonormal columns

    def of(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leading coordinates, and the norm of the rest."""
        x = q - self.mean
        y = x @ self.axes
        return y, np.sqrt(((x - y @ self.axes.T) ** 2).sum(1))


def whole_numbers(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """id, q (array<int>) of the vectors that take part."""
    v = F.col(vector_col)
    fine = v.isNotNull() & (F.size(v) == dims) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = F.transform("v", lambda x: F.floor(F.lit(scale) * x.cast("double")))
    wide = F.exists("v", lambda x: F.abs(F.lit(scale) * x.cast("double")) >= _MOST)
    error = F.raise_error(F.lit(f"a vector has a component of {_MOST // scale} or more: too large for 64-bit distances"))
    return df.filter(fine).select(F.col(id_col).alias("id"), v.alias("v")).select("id", F.when(wide, error.cast("array<int>")).otherwise(scaled.cast("array<int>")).alias("q"))


def starts(q: DataFrame, k: int = CENTROIDS, seed: int = 1) -> np.ndarray:
    """The k vectors with the smallest hash of their id. The hashes are cut first, so that only vectors of k ids can meet."""
    named = q.withColumn("hash", F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256))
    least = [r[0] for r in named.select("hash").orderBy("hash").limit(k).collect()]
    if not least:
        return np.zeros((0, 0), np.int64)
    rows = named.filter(F.col("hash") <= least[-1]).orderBy("hash", "q").limit(k).collect()
    return np.array([r.q for r in rows], np.int64)


def rotation(q: DataFrame, dims: int, share: float = LEAD_SHARE) -> Rotation:
    """Principal axes of all vectors, as many as hold that share of the variance."""
    m = moments(q.select(*[F.col("q")[i].cast("double").alias(f"x{i}") for i in range(dims)]), [f"x{i}" for i in range(dims)])[None]
    variance, axes = np.linalg.eigh(m.covariance())
    held = np.cumsum(variance[::-1].clip(0))
    lead = 1 + int(np.searchsorted(held, share * held[-1]))
    return Rotation(m.mean, np.ascontiguousarray(axes[:, ::-1][:, :lead]))


def stored(q: DataFrame, turn: Rotation) -> DataFrame:
    """id, q, lead (leading coordinates), rest (residual norm), written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        for b in batches:
            x = np.asarray(b.column(1).flatten()).reshape(b.num_rows, -1)
            y, rest = turn.of(x)
            blobs = [pa.array([r.tobytes() for r in a], pa.binary()) for a in (x.astype("<i4"), y)]
            yield pa.RecordBatch.from_arrays([b.column(0), *blobs, pa.array(rest)], ["id", "q", "lead", "rest"])

    return materialise(q.mapInArrow(run, f"id {q.schema['id'].dataType.simpleString()}, q binary, lead binary, rest double"), "rotated")


def nearest(q: np.ndarray, y: np.ndarray, rest: np.ndarray, centroids: np.ndarray, cy: np.ndarray, crest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, squared distance, centroids measured) of each row."""

    def squared(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        d = q[rows] - centroids[at]
        return np.einsum("ij,ij->i", d, d)

    size, csize = (y * y).sum(1) + rest * rest, (cy * cy).sum(1) + crest * crest
    bound = size[:, None] + csize - 2 * (y @ cy.T + np.outer(rest, crest))
    slack = 1e-9 * (size[:, None] + csize) + 1e-9  # far above the rounding of the line before
    every = np.arange(len(q))
    first = bound.argmin(1)
    found = np.full(bound.shape, np.iinfo(np.int64).max)
    found[every, first] = best = squared(every, first)
    survives = bound - slack <= best[:, None]
    survives[every, first] = False
    rows, at = np.nonzero(survives)
    found[rows, at] = squared(rows, at)
    cluster = found.argmin(1)
    return cluster, found[every, cluster], survives.sum(1) + 1


def _arrays(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    q = np.frombuffer(b"".join(b.column(1).to_pylist()), "<i4").reshape(b.num_rows, -1).astype(np.int64)
    return q, np.frombuffer(b"".join(b.column(2).to_pylist())).reshape(b.num_rows, -1), b.column(3).to_numpy()


def moved(index: DataFrame, centroids: np.ndarray, turn: Rotation) -> np.ndarray:
    """The centroids after one round."""
    k, dims = centroids.shape
    cy, crest = turn.of(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        sums, n = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for b in batches:
            if b.num_rows:
                q, y, rest = _arrays(b)
                cluster = nearest(q, y, rest, centroids, cy, crest)[0]
                np.add.at(sums, cluster, q)
                n += np.bincount(cluster, minlength=k)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at]), pa.array(list(sums[at]), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    parts = index.mapInArrow(run, "cluster int, n long, sums array<long>").select("cluster", "n", F.posexplode("sums").alias("at", "x"))
    totals = parts.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()
    out = centroids.copy()
    for r in totals:
        out[r.cluster, r["at"]] = int(r.x) // r.n
    return out


def assigned(index: DataFrame, centroids: np.ndarray, turn: Rotation) -> DataFrame:
    """id, cluster, distance, n_measured of every vector."""
    cy, crest = turn.of(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        for b in batches:
            if b.num_rows:
                cluster, distance, measured = nearest(*_arrays(b), centroids, cy, crest)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cluster, pa.int32()), pa.array(distance), pa.array(measured, pa.int32())], ["id", "cluster", "distance", "n_measured"])

    return index.mapInArrow(run, f"id {index.schema['id'].dataType.simpleString()}, cluster int, distance long, n_measured int")


def cluster(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = DIMS, scale: int = SCALE, k: int = CENTROIDS, rounds: int = ROUNDS, share: float = LEAD_SHARE) -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, distance, n_measured of every kept vector; the final centroids)."""
    q = whole_numbers(df, id_col, vector_col, dims, scale)
    centroids = starts(q, k)
    if not len(centroids):
        return q.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"), F.lit(0).alias("n_measured")), centroids
    turn = rotation(q, dims, share)
    index = stored(q, turn)
    for _ in range(rounds):
        centroids = moved(index, centroids, turn)
    return assigned(index, centroids, turn), centroids


def op13_rotated_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, centroids = cluster(table(spark, sf_dir, "embeddings"))
    rows = materialise(rows, "assigned")
    inertia = {r.cluster: int(r.s) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    facts = [(c, inertia.get(c, 0), sum(inertia.values()), hashlib.sha256(",".join(map(str, x.tolist())).encode()).hexdigest()) for c, x in enumerate(centroids)]
    clusters = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # one row for each centroid
    return rows.join(F.broadcast(clusters), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(rounds: int = ROUNDS) -> str:
    """Every vector against every centroid, in whole numbers."""
    near = "SELECT rid, any_value(v.vec_id) AS vec_id, any_value(v.q) AS q, arg_min(k, d * 16 + k) AS k, min(d) AS d FROM (SELECT v.*, c.k, list_sum(list_transform(range(1, 65), lambda i: (v.q[i] - c.q[i]) * (v.q[i] - c.q[i])))::BIGINT AS d FROM v, {c} AS c) AS v GROUP BY rid"
    steps = [
        "v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS q FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        "c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(vec_id::VARCHAR, '')), q) - 1 AS k, q FROM v QUALIFY k < 16)",
    ]
    for i in range(rounds):
        steps += [
            f"a{i} AS ({near.format(c=f'c{i}')})",
            f"s{i} AS (SELECT k, pos, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT k, unnest(q) AS x, unnest(range(64)) AS pos FROM a{i}) GROUP BY k, pos)",
            f"m{i} AS (SELECT k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY pos) AS q FROM s{i} GROUP BY k)",
            f"c{i + 1} AS (SELECT c{i}.k, coalesce(m{i}.q, c{i}.q) AS q FROM c{i} LEFT JOIN m{i} USING (k))",
        ]
    last = f"c{rounds}"
    return (
        "WITH " + ",\n".join([*steps, f"a AS ({near.format(c=last)})"])
        + f"\nSELECT a.vec_id, a.k::INTEGER AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.k))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256 FROM a JOIN {last} AS c USING (k)"
    )


SQL = _sql()

"""Aggregation of objects to wells and treatments, and sampling.

Random operators order rows by a fixed hash of (seed, row id): the same rows are drawn on any cluster and at any partitioning.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phenogrid.functions import expr as X

COUNT = "Metadata_Cellnumber"


def not_null(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.filter(X.all_valid(by))


def aggregate(df: DataFrame, by: Sequence[str], feats: Sequence[str], method: str = "median", obs: Sequence[str] = (), row_id: str = "row_id", count: bool = False, reps: Sequence[str] = (), min_cells: int | None = None) -> DataFrame:
    """One row for each group: mean or median of features, the first row's annotations, and counts (summed if there already). Groups of equal means tie (expr.mean).

    reps are embedding columns, aggregated component by component. min_cells keeps groups with as many rows (and counts)."""
    df = not_null(df, by)
    extra = [F.min_by(F.col(c), F.col(row_id)).alias(c) for c in obs if c not in by and c != COUNT]
    if count or min_cells is not None:
        extra.append((F.sum(COUNT) if COUNT in df.columns else F.count(F.lit(1))).alias(COUNT))
    of = X.mean if method == "mean" else X.median
    out = X.grouped(df, by, feats, lambda f: [of(f).alias(f)], extra)
    for rep in reps:
        parts = df.select(*by, F.posexplode(rep).alias("_i", "_x")).groupBy(*by, "_i").agg((F.avg if method == "mean" else X.median)("_x").alias("_x"))
        packed = parts.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_x"))), lambda s: s["_x"]).alias(rep))  # as many as components
        out = out.join(packed, list(by))
    return out if min_cells is None else out.filter(F.col(COUNT) >= min_cells)


def low_count_groups(df: DataFrame, by: Sequence[str], min_cells: int) -> DataFrame:
    """The groups that fail the count, with it."""
    return not_null(df, by).groupBy(*by).agg(F.count(F.lit(1)).alias(COUNT)).filter(F.col(COUNT) < min_cells)


#: Rows of a block whose correlations with another block are one matrix product.
PAIR_ROWS = 2048


def _peer_sums(by: list[str], n: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """For rows of one block: the sum of clipped correlations with the other block's rows (not of the same id), and how many these are."""

    def units(side: pa.Table, name: str) -> np.ndarray:
        # a row without spread or with missing features correlates with none
        return np.array([[0.0 if x is None else x for x in u] for u in side.column(name).to_pylist()], float).reshape(-1, n)

    def run(one: pa.Table, two: pa.Table) -> pa.Table:
        ids, a, b = one.column("_id").to_pylist(), units(one, "_u"), units(two, "_ou")
        r = np.maximum(a @ b.T, 0.0)
        fits = np.ones(r.shape, bool)
        if one.num_rows and two.num_rows and one.column("_p")[0] == one.column("_q")[0]:
            where: dict = {}
            for j, x in enumerate(two.column("_oid").to_pylist()):
                where.setdefault(x, []).append(j)
            for i, x in enumerate(ids):
                fits[i, where.get(x, [])] = False
        fits[[i for i, x in enumerate(ids) if x is None]] = False
        return one.select([*by, "_id"]).append_column("_r", pa.array(np.where(fits, r, 0.0).sum(1))).append_column("_peers", pa.array(fits.sum(1), pa.int64()))

    return run


def aggregate_modz(df: DataFrame, by: Sequence[str], feats: Sequence[str], method: str = "spearman", min_weight: float = 0.01, row_id: str = "row_id") -> DataFrame:
    """Weighted mean of each group's rows; a row's weight is its mean correlation with the others, at least min_weight.

    Rows are packed to arrays and standardised, so that a correlation is a dot product; all pairs inside a group are formed, as
    matrix products of blocks of PAIR_ROWS rows: a group may be large, the work grows with its square. Missing features make the group's result NULL."""
    df = not_null(df, by)
    values = F.array(*[F.col(f).cast("double") for f in feats])
    rows = df.select(*by, F.col(row_id).alias("_id"), values.alias("_v"))
    basis = F.col("_v")
    if method == "spearman":
        basis = F.transform("_v", lambda x: F.size(F.filter("_v", lambda y: y < x)) + (F.size(F.filter("_v", lambda y: y == x)) + 1) / F.lit(2.0))
    n = F.lit(float(len(feats)))
    rows = rows.withColumn("_b", basis).withColumn("_m", F.aggregate("_b", F.lit(0.0), lambda a, x: a + x) / n)
    rows = rows.withColumn("_c", F.transform("_b", lambda x: x - F.col("_m"))).withColumn("_s", F.sqrt(F.aggregate("_c", F.lit(0.0), lambda a, x: a + x * x)))
    rows = rows.withColumn("_u", F.transform("_c", lambda x: F.try_divide(x, F.col("_s")))).select(*by, "_id", "_v", "_u")
    # rows of the same id fall into the same block; every row meets every block of its group
    sizes = rows.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / F.lit(PAIR_ROWS)).alias("_n"))
    rows = rows.join(sizes, list(by)).withColumn("_blk", F.pmod(F.xxhash64("_id"), F.col("_n")))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1))
    left = rows.select(*by, F.col("_blk").alias("_p"), every.alias("_q"), "_id", "_u")
    right = rows.filter("_id is not null").select(*[F.col(b).alias(f"_o_{b}") for b in by], every.alias("_op"), F.col("_blk").alias("_oq"), F.col("_id").alias("_oid"), F.col("_u").alias("_ou"))
    dealt = right.groupBy(*[f"_o_{b}" for b in by], "_op", "_oq")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in left.select(*by, "_id").schema)
    met = left.groupBy(*by, "_p", "_q").cogroup(dealt).applyInArrow(_peer_sums(list(by), len(feats)), f"{kinds}, _r double, _peers long")
    met = met.groupBy(*by, "_id").agg(F.sum("_r").alias("_r"), F.sum("_peers").alias("_peers"))
    first = rows.groupBy(*by, "_id").agg(F.any_value("_v").alias("_v"))
    met = met.select(*[F.col(b).alias(f"_o_{b}") for b in by], F.col("_id").alias("_oid"), "_r", "_peers")
    same = F.col("_id").eqNullSafe(F.col("_oid"))
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_o_{b}"))
    weights = first.join(met, same).withColumn("_w", F.try_divide("_r", "_peers"))
    weights = weights.withColumn("_w", F.when(F.col("_peers") == 0, 1.0).otherwise(F.greatest(F.coalesce("_w", F.lit(0.0)), F.lit(min_weight))))
    total = F.sum("_w")
    return weights.groupBy(*by).agg(*[X.div(F.sum(F.col("_w") * F.get("_v", F.lit(i))), total).alias(f) for i, f in enumerate(feats)])


def chunk(df: DataFrame, by: Sequence[str], chunk_size: int = 25, n_chunks: int | str | None = None, row_id: str = "row_id", seed: int = 0) -> DataFrame:
    """Rows drawn without replacement in each group and numbered by chunk: as many full chunks as fit, n_chunks, or the smallest group's number ("equal")."""
    df = not_null(df, by)
    sizes = df.groupBy(*by).agg((F.floor(F.count(F.lit(1)) / chunk_size)).alias("_full"))
    if n_chunks == "equal":
        sizes = sizes.join(F.broadcast(sizes.agg(F.min("_full").alias("_take"))), how="cross").select(*by, "_take")  # one row
    elif n_chunks is None:
        sizes = sizes.select(*by, F.col("_full").alias("_take"))
    else:
        sizes = sizes.select(*by, F.least(F.col("_full"), F.lit(int(n_chunks))).alias("_take"))
    w = Window.partitionBy(*by).orderBy(X.hash_order(row_id, seed), row_id)
    drawn = df.withColumn("_rn", F.row_number().over(w) - 1).join(sizes, list(by)).withColumn("Chunk", F.floor(F.col("_rn") / chunk_size))
    return drawn.filter(F.col("Chunk") < F.col("_take")).drop("_rn", "_take")


def aggregate_chunks(df: DataFrame, by: Sequence[str], feats: Sequence[str], chunk_size: int = 25, n_chunks: int | str | None = None, method: str = "median", row_id: str = "row_id", seed: int = 0) -> DataFrame:
    return aggregate(chunk(df, by, chunk_size, n_chunks, row_id, seed), [*by, "Chunk"], feats, method, count=True, row_id=row_id)


def subsample(df: DataFrame, by: Sequence[str], perc: float = 0.1, row_id: str = "row_id", seed: int = 0, grouped: str | None = None, with_replacement: bool = False) -> DataFrame:
    """A share of each group's rows, rounded half to even; with `grouped`, a share of each group's sub-groups, whole.

    With replacement, each of the drawn places takes the row at a hashed place of the group."""
    df = not_null(df, by)
    unit = grouped or row_id
    if grouped:
        units = df.select(*by, grouped).distinct()
    else:
        units = df.select(*by, row_id)
    total = F.count(F.lit(1)).over(Window.partitionBy(*by))
    ranked = units.withColumn("_n", total).withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(X.hash_order(unit, seed), unit)))
    take = F.bround(F.col("_n") * F.lit(perc), 0)
    if with_replacement:
        places = ranked.filter(F.col("_rn") <= take).select(*by, (F.pmod(F.xxhash64(*by, "_rn", F.lit(seed)), F.col("_n")) + 1).alias("_rn"))
        return places.join(ranked.drop("_n"), [*by, "_rn"]).drop("_rn").join(df, [*by, unit])
    return df.join(ranked.filter(F.col("_rn") <= take).select(*by, unit), [*by, unit], "left_semi")


def sample_rows(df: DataFrame, size: int, row_id: str = "row_id", seed: int = 0) -> DataFrame:
    """size rows, or all if there are no more: those with the smallest hash.

    Rows are counted by the first digits of their hash; only those up to the digits at which the count reaches size are put in order, so that
    what meets in one task is about the sample, not the best rows of every partition."""
    order = X.hash_order(row_id, seed)
    counts = df.groupBy(F.substring(order, 1, 4).alias("_head")).agg(F.count(F.lit(1)).alias("_c")).collect()  # 65,536 at most
    held, edge = 0, None
    for head, c in sorted((r["_head"] or "", r["_c"]) for r in counts):
        held, edge = held + c, head
        if held >= size:
            break
    return df.filter(F.coalesce(F.substring(order, 1, 4), F.lit("")) <= F.lit(edge or "")).orderBy(order, row_id).limit(size)


def train_test_split(df: DataFrame, test_size: float = 0.2, stratify: str | None = None, row_id: str = "row_id", seed: int = 0) -> DataFrame:
    """df with `is_test`. With strata each gives its share, rounded half to even; without, the whole gives its share, rounded up.

    Without strata no order over all rows is needed: rows are counted by the first digits of their hash, and only those that share
    the digits at the edge are ranked; the hash at the edge then decides."""
    order = X.hash_order(row_id, seed)
    if stratify is None:
        digits = F.substring(order, 1, 4)
        counts = df.groupBy(digits.alias("_head")).agg(F.count(F.lit(1)).alias("_c"))
        up = Window.orderBy("_head")  # 65,536 rows at most
        counts = counts.withColumn("_to", F.sum("_c").over(up)).withColumn("_take", F.ceil(F.sum("_c").over(Window.partitionBy()) * F.lit(test_size) - F.lit(1e-9)))
        edge = counts.filter((F.col("_take") > F.col("_to") - F.col("_c")) & (F.col("_take") <= F.col("_to"))).select("_head", (F.col("_take") - F.col("_to") + F.col("_c")).alias("_place"))
        near = df.select(order.alias("_hash"), digits.alias("_head")).join(F.broadcast(edge), "_head")  # one row
        last = near.withColumn("_rn", F.row_number().over(Window.partitionBy("_head").orderBy("_hash"))).filter(F.col("_rn") == F.col("_place")).agg(F.max("_hash").alias("_last"))
        return df.join(F.broadcast(last), how="cross").withColumn("is_test", F.coalesce(order <= F.col("_last"), F.lit(False))).drop("_last")  # one row
    w = Window.partitionBy(stratify)
    rank = F.row_number().over(w.orderBy(order, row_id))
    return df.withColumn("is_test", rank <= F.bround(F.count(F.lit(1)).over(w) * F.lit(test_size), 0))


def group_shuffle_split(df: DataFrame, group: str, test_size: float = 0.2, stratify: str | None = None, seed: int = 0) -> DataFrame:
    """df with `is_test`; a group is on one side. With strata, a group counts for the smallest stratum of its rows."""
    keys = df.groupBy(group).agg(*([F.min(stratify).alias("_s")] if stratify else [F.lit(0).alias("_s")]))
    w = Window.partitionBy("_s")
    rank = F.row_number().over(w.orderBy(X.hash_order(F.col(group).cast("string"), seed), group))
    sides = keys.withColumn("is_test", rank <= F.bround(F.count(F.lit(1)).over(w) * F.lit(test_size), 0)).drop("_s")
    return df.join(sides, group)


def sample_tracks(df: DataFrame, track: str, size: int, seed: int = 0) -> DataFrame:
    """All rows of `size` tracks."""
    keys = df.select(track).filter(F.col(track).isNotNull()).distinct().orderBy(X.hash_order(F.col(track).cast("string"), seed), track).limit(size)
    return df.join(keys, track, "left_semi")


def first_rows(df: DataFrame, by: Sequence[str], n: int, row_id: str = "row_id") -> DataFrame:
    """The first n rows of each group with their running number from 0; ranks are cut before the shuffle."""
    w = Window.partitionBy(*by).orderBy(row_id)
    return df.withColumn("number", F.row_number().over(w)).filter(F.col("number") <= n).withColumn("number", F.col("number") - 1)


def value_counts(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))

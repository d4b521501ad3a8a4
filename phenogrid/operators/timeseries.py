"""Operators on tracks: objects followed over frames. One window or aggregate by track; no frame loop on the driver."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phenogrid.functions import expr as X
from phenogrid.functions.scratch import cut

REDUCERS = ("mean", "std", "max", "min", "diff")


def ts_aggregate(df: DataFrame, feats: Sequence[str], track: str, time: str, method: str | Callable = "mean", fpu: int = 1, min_len: int = 30, obs: Sequence[str] = ()) -> DataFrame:
    """One row for each track of at least min_len frames: mean, std (population), max or min of differences over fpu frames, or `diff` = last less first; and Length.

    A track that misses a value of a feature has NULL there. A callable gets (frames x features, fpu) as an array and gives a vector."""
    df = df.filter(F.col(track).isNotNull())
    if callable(method):
        def reduce(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values(time)
            if len(group) < min_len:
                return pd.DataFrame(columns=[track, "Length", *feats])
            values = method(group[list(feats)].to_numpy(float), fpu=fpu)
            return pd.DataFrame([[group[track].iloc[0], len(group), *map(float, values)]], columns=[track, "Length", *feats])

        kind = df.schema[track].dataType.simpleString()
        return df.select(track, time, *feats).groupBy(track).applyInPandas(reduce, f"`{track}` {kind}, Length long, " + ", ".join(f"`{f}` double" for f in feats))
    length = F.count(F.lit(1)).alias("Length")
    kept = [F.min_by(F.col(c), F.col(time)).alias(c) for c in obs]
    if method == "diff":
        aggs = [X.strict(F.max_by(F.col(f), F.col(time)) - F.min_by(F.col(f), F.col(time)), f).alias(f) for f in feats]
        return df.groupBy(track).agg(length, *kept, *aggs).filter(F.col("Length") >= min_len)
    w = Window.partitionBy(track).orderBy(time)
    steps = df.withColumns({f"_d_{f}": F.col(f) - F.lag(f, fpu).over(w) for f in feats})
    func = {"mean": F.avg, "std": F.stddev_pop, "max": F.max, "min": F.min}[method]
    aggs = [X.strict(func(f"_d_{f}"), F.col(f)).alias(f) for f in feats]
    return steps.groupBy(track).agg(length, *kept, *aggs).filter(F.col("Length") >= min_len)


def proliferation(df: DataFrame, root: str, track: str, gen: str | None = None, rank_by: str = "children", clip: float | None = None) -> DataFrame:
    """root, n: number of tracks, or highest generation, of each root, falling; ties by root. With clip, the best share (a top-k)."""
    agg = F.countDistinct(track) if rank_by == "children" else F.max(gen)
    out = df.filter(F.col(root).isNotNull()).groupBy(root).agg(agg.alias("n")).orderBy(F.desc("n"), root)
    if clip is None:
        return out
    return out.limit(int(df.select(root).filter(F.col(root).isNotNull()).distinct().count() * clip))


def state_distribution(df: DataFrame, time: str, state: str) -> DataFrame:
    """time, state, share for all states at all times (0 where a state is not seen)."""
    df = df.filter(F.col(time).isNotNull() & F.col(state).isNotNull())
    counts = df.groupBy(time, state).agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy(time).agg(F.sum("n").alias("t"))
    grid = total.join(F.broadcast(counts.select(state).distinct()), how="cross")  # states are few
    return grid.join(counts, [time, state], "left").select(time, state, (F.coalesce("n", F.lit(0)) / F.col("t")).alias("share"))


def centroids(df: DataFrame, by: Sequence[str], rep: str, method: str = "mean") -> DataFrame:
    """by, dim, value: mean or median of an embedding in each group."""
    parts = df.filter(X.all_valid(by)).select(*by, F.posexplode(rep).alias("dim", "x"))
    return parts.groupBy(*by, "dim").agg((F.avg("x") if method == "mean" else X.median("x")).alias("value"))


def state_distances(df: DataFrame, state: str, rep: str) -> DataFrame:
    """a, b, distance between the states' centroids, all ordered pairs of (few) states."""
    c = centroids(df, [state], rep)
    other = c.select(F.col(state).alias("b"), "dim", F.col("value").alias("v2"))
    return c.join(other, "dim").groupBy(F.col(state).alias("a"), "b").agg(F.sqrt(F.sum((F.col("value") - F.col("v2")) ** 2)).alias("distance"))


def nearest_parents(df: DataFrame, time: str, by: Sequence[str], x: str, y: str, row_id: str = "row_id") -> DataFrame:
    """row_id, parent: the nearest object of the previous frame that the field has; ties to the smaller id; NULL in the first frame.

    Frames are ranked by field, so gaps in time are no gaps here. A field's frame and the one before it are one group, of the
    objects of two images; distances are taken in blocks of rows, and no pair of objects leaves the task."""
    ranked = df.select(F.col(row_id).alias("_id"), *by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"), F.dense_rank().over(Window.partitionBy(*by).orderBy(time)).alias("_f"))
    before = ranked.select(*[F.col(c).alias(f"_b_{c}") for c in by], (F.col("_f") + 1).alias("_g"), F.col("_id").alias("_p"), F.col("_x").alias("_px"), F.col("_y").alias("_py"))

    def meet(now: pa.Table, old: pa.Table) -> pa.Table:
        if not now.num_rows:  # a side without rows has no columns either
            return old.select(["_p", "_p"]).slice(0, 0).rename_columns([row_id, "parent"])
        ids = now.column("_id")
        parents = pa.nulls(now.num_rows, ids.type)
        if old.num_rows:
            old = old.filter(pc.and_(pc.is_valid(old.column("_px")), pc.is_valid(old.column("_py")))).sort_by("_p")  # the first of equal distances has the smaller id
        if old.num_rows:
            px, py = (old.column(c).to_numpy() for c in ("_px", "_py"))
            nx, ny = (now.column(c).to_numpy() for c in ("_x", "_y"))
            best = np.concatenate([((nx[i : i + 512, None] - px) ** 2 + (ny[i : i + 512, None] - py) ** 2).argmin(1) for i in range(0, len(nx), 512)])
            known = np.isfinite(nx) & np.isfinite(ny)
            parents = old.column("_p").combine_chunks().take(pa.array(best, mask=~known))
        return pa.table({row_id: ids, "parent": parents})

    kind = df.schema[row_id].dataType.simpleString()
    return ranked.groupBy(*by, "_f").cogroup(before.groupBy(*[f"_b_{c}" for c in by], "_g")).applyInArrow(meet, f"`{row_id}` {kind}, parent {kind}")


def track_nn(df: DataFrame, time: str, by: Sequence[str], x: str, y: str, row_id: str = "row_id") -> DataFrame:
    """row_id, parent, tree: parents by nearest_parents(); the tree is the first object at the end of the chain of parents.

    Chains are halved at each round (pointer jumping): as many joins as the logarithm of the number of frames, each round
    written before the next, so that no plan grows with the frames."""
    parents = cut(nearest_parents(df, time, by, x, y, row_id))
    up = parents.select(F.col(row_id).alias("id"), F.coalesce("parent", row_id).alias("top"))
    frames = df.groupBy(*by).agg(F.countDistinct(time).alias("n")).agg(F.max("n")).first()[0] or 1
    for _ in range(max(1, (frames - 1).bit_length())):
        over = up.select(F.col("id").alias("_i"), F.col("top").alias("_t"))
        up = cut(up.join(over, up["top"] == over["_i"], "left").select("id", F.coalesce("_t", "top").alias("top")))
    return parents.join(up.select(F.col("id").alias(row_id), F.col("top").alias("tree")), row_id)


def lineage_edges(df: DataFrame, track: str, parent: str, time: str) -> DataFrame:
    """parent, child, parent_end, child_start of tracks whose parent is another track."""
    per = df.filter(F.col(track).isNotNull()).groupBy(track).agg(F.min(time).alias("start"), F.max(time).alias("end"), F.min_by(F.col(parent), F.col(time)).alias("_p"))
    up = per.select(F.col(track).alias("parent"), F.col("end").alias("parent_end"))
    return per.filter(F.col("_p") != F.col(track)).join(up, F.col("_p") == F.col("parent")).select("parent", F.col(track).alias("child"), "parent_end", F.col("start").alias("child_start"))


def nearest_node(df: DataFrame, rep: str, nodes: Sequence[Sequence[float]]) -> Column:
    """The number of the nearest of a few points; ties to the smaller."""
    dist = [F.struct(F.aggregate(F.zip_with(F.col(rep), F.array(*[F.lit(float(v)) for v in n]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, v: acc + v).alias("d"), F.lit(i).alias("i")) for i, n in enumerate(nodes)]
    return F.array_min(F.array(*dist))["i"]


def velocity_field(df: DataFrame, rep: str, vectors: str, nodes: Sequence[Sequence[float]], min_cells: int = 1) -> DataFrame:
    """node, n, dim, value: the mean vector of the objects nearest to each node, for nodes with more than min_cells of them."""
    near = df.withColumn("node", nearest_node(df, rep, nodes))
    n = near.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > min_cells)
    return near.select("node", F.posexplode(vectors).alias("dim", "x")).groupBy("node", "dim").agg(F.avg("x").alias("value")).join(n, "node").select("node", "n", "dim", "value")


def to_grid(df: DataFrame, tree: str, time: str, rep: str) -> DataFrame:
    """tree, time, vec on the full grid of trees and global times, zeros where there is no object. Rows without a tree go."""
    df = df.filter(F.col(tree).isNotNull() & F.col(time).isNotNull()).select(tree, time, F.col(rep).cast("array<double>").alias("vec"))
    times = df.agg(F.sort_array(F.collect_set(time)).alias("_ts"), F.max(F.size("vec")).alias("_d"))  # one row: the time points of an experiment
    grid = df.select(tree).distinct().join(F.broadcast(times), how="cross").select(tree, F.explode("_ts").alias(time), "_d")
    return grid.join(df, [tree, time], "left").select(tree, time, F.coalesce("vec", F.array_repeat(F.lit(0.0), F.col("_d"))).alias("vec"))


def make_3d(df: DataFrame, tree: str, time: str, rep: str) -> DataFrame:
    """tree, x: the grid as one array of vectors for each tree, in order of time."""
    return to_grid(df, tree, time, rep).groupBy(tree).agg(F.transform(F.array_sort(F.collect_list(F.struct(time, "vec"))), lambda s: s["vec"]).alias("x"))


def from_3d(df: DataFrame, tree: str, times: Sequence[object], time: str = "time") -> DataFrame:
    """The inverse of make_3d for the given time points."""
    return df.select(tree, F.posexplode("x").alias("_i", "vec")).select(tree, F.get(F.array(*[F.lit(t) for t in times]), F.col("_i")).alias(time), "vec")


def tree_labels(df: DataFrame, tree: str, label: str) -> DataFrame:
    """tree, label, consistent: whether all rows of a tree agree."""
    return df.filter(F.col(tree).isNotNull()).groupBy(tree).agg(F.min(label).alias(label), (F.countDistinct(label) == 1).alias("consistent"))


def vectorize(df: DataFrame, tree: str, time: str, rep: str, out: str = "X_vect") -> DataFrame:
    """df with the difference of its embedding to the next global time point on the zero-filled grid; zeros at the last."""
    grid = to_grid(df, tree, time, rep)
    after = F.lead("vec").over(Window.partitionBy(tree).orderBy(time))
    moved = grid.select(tree, time, F.when(after.isNull(), F.transform("vec", lambda x: x * 0)).otherwise(F.zip_with(after, F.col("vec"), lambda a, b: a - b)).alias(out))
    return df.join(moved, [tree, time])


def jensen_shannon(df: DataFrame, key: str, state: str, p: str) -> DataFrame:
    """a, b (a < b), distance: root of the Jensen-Shannon divergence (natural log) between the keys' distributions over states. Rows: key, state, p."""
    norm = df.withColumn("_p", X.div(F.col(p), F.sum(p).over(Window.partitionBy(key)))).select(F.col(key).alias("k"), F.col(state).alias("s"), "_p")
    keys = norm.select("k").distinct()
    states = norm.select("s").distinct()
    full = keys.join(F.broadcast(states), how="cross").join(norm, ["k", "s"], "left").fillna(0.0, ["_p"])  # states are few
    a = full.select(F.col("k").alias("a"), "s", F.col("_p").alias("pa"))
    b = full.select(F.col("k").alias("b"), "s", F.col("_p").alias("pb"))
    m = (F.col("pa") + F.col("pb")) / 2

    def part(q: Column) -> Column:
        return F.when(q > 0, q * F.ln(q / m)).otherwise(0.0)

    return a.join(b, "s").filter("a < b").groupBy("a", "b").agg(F.sqrt(F.greatest(F.lit(0.0), F.sum(part(F.col("pa")) + part(F.col("pb"))) / 2)).alias("distance"))

"""Tables behind plots that need more than a grouping: smooth densities, lineage layouts, traces, orders of dendrograms."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phenogrid.functions import expr as X
from phenogrid.functions.scratch import cut
from phenogrid.operators.group import sample_rows
from phenogrid.operators.models import feature_distances, linkage


def kernel_density(df: DataFrame, x: str, y: str, by: str, bins: int = 64) -> DataFrame:
    """df with `density` (Gaussian kernel estimate at the row's place, within its group) and `density_scaled` (0 to 1 within the group).

    A group's points are turned and stretched by the roots of their own covariance; there the kernel is round, with width n**(-1/6), and
    its sum over the points is a convolution along one axis and then the other. It runs on counts in bins * bins cells (one group's
    cells are one small table), and a row takes the value at its cell's middle: within half a cell of the sum over all points. Groups
    of fewer than three points, or on a line, have no density; rows without a place or group neither."""
    keyed = df.filter(X.all_valid([by, x, y])).select(F.col(by).alias("_g"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    m = keyed.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"), F.avg("_x").alias("_mx"), F.avg("_y").alias("_my"), F.var_samp("_x").alias("_a"), F.covar_samp("_x", "_y").alias("_b"), F.var_samp("_y").alias("_c"))
    m = m.filter((F.col("_n") > 2) & (F.col("_a") > 0) & (F.col("_c") - F.col("_b") ** 2 / F.col("_a") > 1e-12 * F.col("_c")))
    # the lower root of the covariance: u = (x - mx) / r, v = (y - my - b / r * u) / s
    m = m.withColumn("_r", F.sqrt("_a")).withColumn("_s", F.sqrt(F.col("_c") - F.col("_b") ** 2 / F.col("_a"))).withColumn("_k", F.col("_b") / F.col("_r"))

    def placed(rows: DataFrame, px, py) -> DataFrame:
        u = (px - F.col("_mx")) / F.col("_r")
        return rows.withColumn("_u", u).withColumn("_v", (py - F.col("_my") - F.col("_k") * F.col("_u")) / F.col("_s"))

    white = placed(keyed.join(m, "_g"), F.col("_x"), F.col("_y"))
    m = m.join(white.groupBy("_g").agg(*[f(c).alias(f"_{n}{c}") for c in ("_u", "_v") for f, n in ((F.min, "lo"), (F.max, "hi"))]), "_g")
    m = cut(m)

    def cell(c: str):
        return F.least(F.floor((F.col(c) - F.col(f"_lo{c}")) / (F.col(f"_hi{c}") - F.col(f"_lo{c}")) * bins), F.lit(bins - 1)).cast("int")

    cells = placed(keyed.join(m, "_g"), F.col("_x"), F.col("_y")).groupBy("_g", cell("_u").alias("_i"), cell("_v").alias("_j")).agg(F.count(F.lit(1)).alias("_q"), *[F.first(c).alias(c) for c in ("_n", "_r", "_s", "_lo_u", "_hi_u", "_lo_v", "_hi_v")])

    def smooth(g: pd.DataFrame) -> pd.DataFrame:
        one = g.iloc[0]
        width, n = one["_n"] ** (-1 / 6), one["_n"]
        counts = np.zeros((bins, bins))
        counts[g["_i"], g["_j"]] = g["_q"]

        def kernel(axis: str) -> np.ndarray:
            step = (one[f"_hi{axis}"] - one[f"_lo{axis}"]) / bins
            return np.exp(-0.5 * (np.subtract.outer(np.arange(bins), np.arange(bins)) * step / width) ** 2)

        whole = kernel("_u") @ counts @ kernel("_v") / (2 * np.pi * width**2 * n * one["_r"] * one["_s"])
        d = whole[g["_i"], g["_j"]]
        low, high = d.min(), d.max()
        return g[["_g", "_i", "_j"]].assign(density=d, density_scaled=(d - low) / (high - low) if high > low else 0.0)

    kind = keyed.schema["_g"].dataType.simpleString()
    values = cells.groupBy("_g").applyInPandas(smooth, f"_g {kind}, _i int, _j int, density double, density_scaled double")
    at = placed(df.join(m.withColumnRenamed("_g", "_h"), F.col(by) == F.col("_h"), "left"), F.col(x).cast("double"), F.col(y).cast("double")).withColumns({"_i": cell("_u"), "_j": cell("_v")})
    return at.join(values, (F.col("_h") == F.col("_g")) & (at["_i"] == values["_i"]) & (at["_j"] == values["_j"]), "left").select(*[df[c] for c in df.columns], "density", "density_scaled")


def lineage_layout(df: DataFrame, track: str, parent: str, time: str, most_rounds: int = 10_000) -> DataFrame:
    """track, parent, root, start, end, depth, position, leaves, cyclic of each track.

    A root is its own parent, has none, or one that is no track. It stands at 0.5 with width 1; n daughters stand evenly from width / 2
    below to width / 2 above their mother and have half her width, an only daughter stands at her place with all of it. leaves: childless
    tracks below, or itself. Generations are joined one after the other, as many as the deepest family has; tracks that no root reaches lie on or
    under a cycle: they are cyclic and have no place."""
    rows = df.filter(F.col(track).isNotNull()).groupBy(F.col(track).alias("track")).agg(F.min(parent).alias("parent"), F.min(time).alias("start"), F.max(time).alias("end"))
    known = rows.select(F.col("track").alias("parent"), F.lit(True).alias("_known"))
    rows = cut(rows.join(known, "parent", "left").withColumn("parent", F.when(F.col("_known") & (F.col("parent") != F.col("track")), F.col("parent"))).drop("_known"))
    w = Window.partitionBy("parent")
    edges = cut(rows.filter("parent is not null").select("track", "parent", (F.row_number().over(w.orderBy("track")) - 1).alias("_i"), F.count(F.lit(1)).over(w).alias("_n")))
    now = cut(rows.filter("parent is null").select("track", F.col("track").alias("root"), F.lit(0).alias("depth"), F.lit(0.5).alias("position"), F.lit(1.0).alias("_w"), F.array("track").alias("_path")))
    done = now
    for _ in range(most_rounds):
        up = now.select(F.col("track").alias("parent"), "root", "depth", "position", "_w", "_path")
        half = F.when(F.col("_n") == 1, F.col("_w")).otherwise(F.col("_w") / 2)
        shift = F.when(F.col("_n") == 1, 0.0).otherwise(-half + 2 * half * F.col("_i") / (F.col("_n") - 1))
        now = cut(edges.join(up, "parent").select("track", "root", (F.col("depth") + 1).alias("depth"), (F.col("position") + shift).alias("position"), half.alias("_w"), F.concat("_path", F.array("track")).alias("_path")))
        if now.isEmpty():
            break
        done = done.unionByName(now)
    childless = done.join(edges.select(F.col("parent").alias("track")).distinct(), "track", "left_anti")
    leaves = childless.select(F.explode("_path").alias("track")).groupBy("track").agg(F.count(F.lit(1)).alias("leaves"))
    return rows.join(done.drop("_w", "_path"), "track", "left").join(leaves, "track", "left").withColumn("cyclic", F.col("root").isNull()).select("track", "parent", "root", "start", "end", "depth", "position", "leaves", "cyclic")


def trace_layout(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """df with `trace`: each row's place along the first principal axis of its group's locations, from the group's moments; the larger loading points up, ties to x."""
    m = df.filter(X.all_valid([x, y])).groupBy(*by).agg(F.avg(x).alias("_mx"), F.avg(y).alias("_my"), F.var_pop(x).alias("_a"), F.covar_pop(x, y).alias("_b"), F.var_pop(y).alias("_c"))
    angle = 0.5 * F.atan2(2 * F.col("_b"), F.col("_a") - F.col("_c"))
    m = m.withColumn("_p", F.cos(angle)).withColumn("_q", F.sin(angle))
    sign = F.when(F.abs("_p") >= F.abs("_q"), F.signum("_p")).otherwise(F.signum("_q"))
    return df.join(m, list(by), "left").withColumn("trace", sign * ((F.col(x) - F.col("_mx")) * F.col("_p") + (F.col(y) - F.col("_my")) * F.col("_q"))).drop("_mx", "_my", "_a", "_b", "_c", "_p", "_q")


def leaf_order(merges: np.ndarray, n: int) -> list[int]:
    """The leaves of a dendrogram from left to right: the first cluster of each merge stands left of the second."""
    if not len(merges):
        return list(range(n))
    out, stack = [], [n + len(merges) - 1]
    while stack:
        k = stack.pop()
        if k < n:
            out.append(k)
        else:
            stack += [int(merges[k - n][1]), int(merges[k - n][0])]
    return out


def clustermap_order(df: DataFrame, feats: Sequence[str], row_id: str = "row_id", sample_size: int = 1_000, seed: int = 0, method: str = "ward") -> tuple[DataFrame, DataFrame]:
    """((row_id, position), (feature, position)): the orders of the rows' and the features' dendrograms.

    A heat map shows few rows: sample_size of them at most, by hash. Features are compared over all rows. Rows that miss a feature are left out."""
    spark = df.sparkSession
    df = df.na.drop(subset=list(feats))
    rows = sample_rows(df.select(row_id, *feats), sample_size, row_id, seed).orderBy(row_id).collect()
    values = np.array([[r[f] for f in feats] for r in rows], float).reshape(len(rows), len(feats))
    dist = np.sqrt(np.maximum(((values[:, None] - values[None]) ** 2).sum(2), 0)) if len(rows) <= 200 else np.sqrt(np.maximum((values**2).sum(1)[:, None] + (values**2).sum(1) - 2 * values @ values.T, 0))
    first = leaf_order(linkage(dist, method) if len(rows) > 1 else np.zeros((0, 4)), len(rows))
    second = leaf_order(linkage(feature_distances(df, feats), method) if len(feats) > 1 else np.zeros((0, 4)), len(feats))
    kind = df.schema[row_id].dataType.simpleString()
    return (
        spark.createDataFrame([(rows[k][row_id], i) for i, k in enumerate(first)], f"`{row_id}` {kind}, position int"),
        spark.createDataFrame([(feats[k], i) for i, k in enumerate(second)], "feature string, position int"),
    )

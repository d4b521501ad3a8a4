"""What the plots of such toolkits show, as small tables."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phenogrid.functions import expr as X
from phenogrid.functions import gram
from phenogrid.operators.batch import covariance


def pca(df: DataFrame, feats: Sequence[str], n: int | None = None, out: str = "X_pca") -> tuple[DataFrame, DataFrame]:
    """(df with scores in an array column; component, variance, percent, cumulative): axes from one pass for the moments, signs fixed by the largest loading."""
    mean, cov, rows = covariance(df, feats, sample=True)
    w, v = np.linalg.eigh(cov)
    order = np.argsort(-w)[:n]
    w_all = np.maximum(w, 0)
    w, v = w_all[order], v[:, order]
    v = v * np.sign(v[np.abs(v).argmax(0), np.arange(v.shape[1])])
    share = 100 * w / max(w_all.sum(), 1e-300)
    table = [(j + 1, float(w[j]), float(share[j]), float(share[: j + 1].sum())) for j in range(len(w))]
    names = [f"{out}_{j}" for j in range(v.shape[1])]
    scored = gram.applied(df, feats, names, lambda x, _: (x - mean) @ v).withColumn(out, F.array(*names)).drop(*names)
    return scored, df.sparkSession.createDataFrame(table, "component int, variance double, percent double, cumulative double")


def choose_representation(df: DataFrame, feats: Sequence[str], rep: str | None = None, n: int | None = None, pca_column: str = "X_pca") -> tuple[DataFrame, str]:
    """(df, the name of an array column): the named embedding's first n components; "X" or n = 0 the features themselves; None the principal components, which are made (50 at most) if df has none."""
    if rep == "X" or rep is None and n == 0:
        return df.withColumn("X", F.array(*[F.col(f).cast("double") for f in feats])), "X"
    if rep is None:
        rep = pca_column
        if rep not in df.columns:
            df = pca(df, feats, min(50, len(feats)), rep)[0]
    if rep not in df.columns:
        raise ValueError(f"choose_representation: no {rep}")
    return (df, rep) if n is None else (df.withColumn(rep, F.slice(rep, 1, n)), rep)


def time_summary(df: DataFrame, time: str, feats: Sequence[str], hue: Sequence[str] = ()) -> DataFrame:
    """time, hue, mean and standard deviation of each feature."""
    by = [time, *hue]
    return X.grouped(df.filter(X.all_valid(by)), by, feats, lambda f: [F.avg(f).alias(f), F.stddev_samp(f).alias(f"{f}_std")])


def time_heatmap(df: DataFrame, time: str, times: Sequence[object], feats: Sequence[str]) -> DataFrame:
    """feature and a column for each of the given times with its mean."""
    rows = X.long(df.filter(F.col(time).isin(list(times))).select(time, *feats), [time], feats)
    return rows.groupBy("feature").pivot(time, list(times)).agg(F.avg("value"))


def box_summary(df: DataFrame, by: Sequence[str], feats: Sequence[str]) -> DataFrame:
    """by, feature, n, low, q1, median, q3, high, mean, and whiskers at the last values within 1.5 quartile ranges."""
    rows = X.long(df.filter(X.all_valid(by)).select(*by, *feats), by, feats).filter("value is not null")
    q = rows.groupBy(*by, "feature").agg(F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.avg("value").alias("mean"))
    q = q.select(*by, "feature", "n", "low", F.get("q", F.lit(0)).alias("q1"), F.get("q", F.lit(1)).alias("median"), F.get("q", F.lit(2)).alias("q3"), "high", "mean")
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = rows.join(q.select(*by, "feature", "q1", "q3"), [*by, "feature"]).filter((F.col("value") >= F.col("q1") - reach) & (F.col("value") <= F.col("q3") + reach))
    return q.join(inside.groupBy(*by, "feature").agg(F.min("value").alias("whisker_low"), F.max("value").alias("whisker_high")), [*by, "feature"])


def volcano(df: DataFrame, change: str = "logfc", p: str = "p_adjusted", min_change: float = 1.0, alpha: float = 0.05) -> DataFrame:
    """df with -log10 p and the class up, down or ns."""
    hit = F.col(p) <= alpha
    cls = F.when(hit & (F.col(change) >= min_change), "up").when(hit & (F.col(change) <= -min_change), "down").otherwise("ns")
    return df.withColumn("neg_log_p", -F.log10(F.greatest(F.col(p), F.lit(1e-300)))).withColumn("cls", cls)


def ranked(df: DataFrame, group: str, score: str, n: int = 10) -> DataFrame:
    """The n rows of largest |score| in each group, with their rank."""
    w = Window.partitionBy(group).orderBy(F.desc(F.abs(F.col(score))), "feature")
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def state_graph(df: DataFrame, track: str, time: str, state: str) -> DataFrame:
    """source, target, p: transitions between different states, each source's shares."""
    w = Window.partitionBy(track).orderBy(time)
    steps = df.withColumn("target", F.lead(state).over(w)).filter(F.col("target").isNotNull() & (F.col("target") != F.col(state)))
    n = steps.groupBy(F.col(state).alias("source"), "target").agg(F.count(F.lit(1)).alias("n"))
    return n.select("source", "target", (F.col("n") / F.sum("n").over(Window.partitionBy("source"))).alias("p"))


def density(df: DataFrame, x: str, y: str, by: Sequence[str] = (), bins: int = 50) -> DataFrame:
    """by, bx, by_, n, share: a two-dimensional histogram over the range of all rows; a smoothing kernel needs no more than this table."""
    ends = df.agg(F.min(x).alias("_x0"), F.max(x).alias("_x1"), F.min(y).alias("_y0"), F.max(y).alias("_y1"))
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).join(F.broadcast(ends), how="cross")  # one row

    def at(c: str, lo: str, hi: str):
        return F.least(F.floor(F.coalesce(X.div(F.col(c) - F.col(lo), F.col(hi) - F.col(lo)), F.lit(0.0)) * bins), F.lit(bins - 1)).cast("int")

    n = rows.groupBy(*by, at(x, "_x0", "_x1").alias("bin_x"), at(y, "_y0", "_y1").alias("bin_y")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))))

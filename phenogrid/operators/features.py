"""Selection of features. Each operator returns a table with a row for each feature and `keep`; project() applies it.

The feature axis is either wide (one aggregate over all features, in chunks) or long (feature, value), whichever keeps the
shuffle to a few numbers for each feature.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phenogrid.functions import expr as X
from phenogrid.functions import gram
from phenogrid.functions.scratch import cut
from phenogrid.functions.stats import ADJUSTMENTS, adjust


def project(df: DataFrame, feats: Sequence[str], decided: DataFrame) -> tuple[DataFrame, list[str]]:
    """df without the features that are not kept, and the features left. One small job: the list of columns depends on it."""
    kept = {r.feature for r in decided.filter("keep").select("feature").collect()}
    left = [f for f in feats if f in kept]
    return df.select(*[c for c in df.columns if c not in feats or c in kept]), left


def near_zero_variance(df: DataFrame, feats: Sequence[str], freq_thresh: float = 0.05, unique_thresh: float = 0.01) -> DataFrame:
    """feature, freq_ratio (second most frequent value's count over the most frequent's), unique_ratio, keep."""
    counts = X.long(df.select(*[F.col(f).cast("double").alias(f) for f in feats]), [], feats).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    first = counts.groupBy("feature").agg(F.max_by("value", "n").alias("top"), F.max("n").alias("n1"), F.count(F.lit(1)).alias("distinct"), F.sum("n").alias("rows"))
    second = counts.join(F.broadcast(first.select("feature", "top")), "feature").filter(~F.col("value").eqNullSafe(F.col("top"))).groupBy("feature").agg(F.max("n").alias("n2"))  # a row for each feature
    per = first.join(second, "feature", "left")
    freq, uniq = X.div(F.coalesce("n2", F.lit(0)), F.col("n1")), X.div(F.col("distinct"), F.col("rows"))
    return per.select("feature", freq.alias("freq_ratio"), uniq.alias("unique_ratio"), ((F.col("distinct") > 1) & (freq >= freq_thresh) & (uniq >= unique_thresh)).alias("keep"))


def _mads(df: DataFrame, by: Sequence[str], feats: Sequence[str]) -> DataFrame:
    """by, feature, med, mad."""
    rows = X.long(df.select(*by, *feats), by, feats)
    med = rows.groupBy(*by, "feature").agg(X.median("value").alias("med"))
    return rows.join(med, [*by, "feature"]).groupBy(*by, "feature").agg(F.any_value("med").alias("med"), (X.median(F.abs(F.col("value") - F.col("med"))) * X.MAD_SCALE).alias("mad"))


def low_cv(df: DataFrame, feats: Sequence[str], by: Sequence[str], method: str = "std", cutoff: float = 0.5) -> DataFrame:
    """feature, cv, keep: the coefficient of variation (deviation / |mean|, or scaled MAD / |median|), mean over groups."""
    df = df.filter(X.all_valid(by))
    if method == "std":
        per = X.long(df.select(*by, *feats), by, feats).groupBy(*by, "feature").agg(X.div(F.stddev_pop("value"), F.abs(F.avg("value"))).alias("cv"))
    else:
        per = _mads(df, by, feats).select(*by, "feature", X.div(F.col("mad"), F.abs(F.col("med"))).alias("cv"))
    return per.groupBy("feature").agg(F.avg("cv").alias("cv")).select("feature", "cv", F.coalesce(F.col("cv") > cutoff, F.lit(False)).alias("keep"))


def low_variance(df: DataFrame, feats: Sequence[str], by: Sequence[str], cutoff: float = 0.5, stabilised: bool = True) -> DataFrame:
    """feature, score, keep. stabilised: a group's log10 variance less what its line on log10 |mean| over features predicts, mean over groups
    (the documented intent); otherwise the mean of scaled MADs."""
    df = df.filter(X.all_valid(by))
    if not stabilised:
        per = _mads(df, by, feats).select(*by, "feature", F.col("mad").alias("score"))
    else:
        stats = X.long(df.select(*by, *feats), by, feats).groupBy(*by, "feature").agg(F.var_pop("value").alias("v"), F.abs(F.avg("value")).alias("m"))
        logs = stats.select(*by, "feature", F.when(F.col("v") > 0, F.log10("v")).alias("lv"), F.when(F.col("m") > 0, F.log10("m")).alias("lm"))
        w = Window.partitionBy(*by)
        slope, base = F.regr_slope("lv", "lm").over(w), F.regr_intercept("lv", "lm").over(w)
        per = logs.select(*by, "feature", (F.col("lv") - (slope * F.col("lm") + base)).alias("score"))
    return per.groupBy("feature").agg(F.avg("score").alias("score")).select("feature", "score", F.coalesce(F.col("score") > cutoff, F.lit(False)).alias("keep"))


#: Distinct values, of all features together, whose ranks every task may hold.
HELD_VALUES = 2_000_000


def ranked(df: DataFrame, feats: Sequence[str]) -> DataFrame:
    """feats: the mean rank of each value among its feature's.

    Distinct values are counted and placed. Where they are few, tasks hold their ranks and rows stay where they are; the features of
    more distinct values than HELD_VALUES leaves room for, the smallest first, are joined by value, one shuffle of the rows each."""
    df = df.select(*[F.col(f).cast("double").alias(f"_{i}") for i, f in enumerate(feats)])
    names = [f"_{i}" for i in range(len(feats))]
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("feature"), F.col(c).alias("value")) for i, c in enumerate(names)])).alias("c")).select("c.feature", "c.value")
    counts = cut(rows.filter("value is not null").groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n")))
    ranks = cut(X.placed(counts, ["feature"]).select("feature", "value", X.mid_rank(F.col("before"), F.col("n")).alias("rank")))
    held, left = [], HELD_VALUES
    for r in sorted(counts.groupBy("feature").count().collect(), key=lambda r: r["count"]):
        left -= r["count"]
        if left >= 0:
            held.append(r.feature)
    for i, c in enumerate(names):
        if i not in held:
            df = df.join(ranks.filter(F.col("feature") == i).select(F.col("value").alias(c), F.col("rank").alias("_rank")), c, "left").withColumn(c, F.col("_rank")).drop("_rank")
    if held:
        table = ranks.filter(F.col("feature").isin(held)).toArrow().sort_by([("feature", "ascending"), ("value", "ascending")])
        of = table.column("feature").to_numpy()
        known = {i: tuple(table.column(c).to_numpy()[of == i] for c in ("value", "rank")) for i in held}
        shared = df.sparkSession.sparkContext.broadcast(known)

        def place(x: np.ndarray, _: pa.RecordBatch) -> np.ndarray:
            out = np.full_like(x, np.nan)
            for j, i in enumerate(held):
                value, rank = shared.value[i]
                there = ~np.isnan(x[:, j])
                out[there, j] = rank[np.searchsorted(value, x[there, j])]
            return out

        df = gram.applied(df, [names[i] for i in held], [names[i] for i in held], place)
    return df.select(*[F.col(c).alias(f) for c, f in zip(names, feats, strict=True)])


def correlation_matrix(df: DataFrame, feats: Sequence[str], method: str = "pearson") -> np.ndarray:
    """Correlations of all pairs of features, in one pass of matrix products; NaN for a feature that is constant or misses values.

    For Spearman values are ranked first (ranked)."""
    if method == "spearman":
        df = ranked(df, feats)
    m = gram.moments(df, feats)[None]
    spread = np.sqrt(np.diag(m.cross))
    # what rounding leaves of a constant feature's spread is none
    spread[(m.missing > 0) | (spread <= 1e-14 * np.abs(m.mean) * np.sqrt(max(m.n, 1)))] = np.nan
    with np.errstate(all="ignore"):
        return m.cross / spread[:, None] / spread[None]


def correlation_pairs(df: DataFrame, feats: Sequence[str], method: str = "pearson") -> DataFrame:
    """i, j, r for all pairs i < j (places in feats); r is NULL for a constant feature or one that misses values."""
    m = correlation_matrix(df, feats, method)
    j, i = np.tril_indices(len(feats), -1)
    r = m[j, i]
    table = pa.table({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "r": pa.array(r, mask=~np.isfinite(r))})
    return df.sparkSession.createDataFrame(table)


def highly_correlated(df: DataFrame, feats: Sequence[str], thresh: float = 0.95, method: str = "pearson", neg_corr: bool = False) -> DataFrame:
    """feature, worst (largest r with an earlier feature), keep. Features without any correlation (constant) are dropped too."""
    pairs = correlation_pairs(df, feats, method)
    names = F.array(*[F.lit(f) for f in feats])
    strength = F.abs("r") if neg_corr else F.col("r")
    later = pairs.groupBy(F.col("j").alias("at")).agg(F.max(strength).alias("worst"))
    anyr = pairs.select(F.explode(F.array("i", "j")).alias("at"), "r").groupBy("at").agg(F.count("r").alias("have"))
    return anyr.join(later, "at", "left").select(F.get(names, F.col("at")).alias("feature"), "worst", ((F.col("have") > 0) & (F.coalesce("worst", F.lit(-1.0)) <= thresh)).alias("keep"))


def noise(df: DataFrame, feats: Sequence[str], by: str | None = None, thresh: float = 0.8) -> DataFrame:
    """feature, noise (mean over groups of the deviation; NULL in a group that misses values), keep."""
    keys = [by] if by else []
    src = df.filter(F.col(by).isNotNull()) if by else df
    per = X.long(src.select(*keys, *feats), keys, feats).groupBy(*keys, "feature").agg(X.strict(F.stddev_pop("value"), "value").alias("s"))
    out = per.groupBy("feature").agg(X.strict(F.avg("s"), "s").alias("noise"))
    return out.select("feature", "noise", F.coalesce(F.col("noise") <= thresh, F.lit(True)).alias("keep"))


def rank_features(df: DataFrame, feats: Sequence[str], group_by: str, reference: str | None = None, method: str = "wilcoxon", corr_method: str = "fdr_bh") -> DataFrame:
    """grp, feature, score, p, p_adjusted: rank sum (normal approximation, no tie correction) or pooled t of each group against the reference, or the rest.

    Undefined scores are 0 with p = 1. Student p values use the normal limit above 200 degrees of freedom and a numpy
    incomplete beta below."""
    rows = X.long(df.filter(F.col(group_by).isNotNull()).select(F.col(group_by).alias("grp"), *feats), ["grp"], feats).filter("value is not null")
    if method == "wilcoxon":
        # ranks come from counts of distinct values, which few numbers of each range of values put in order
        own = rows.groupBy("grp", "feature", "value").agg(F.count(F.lit(1)).alias("own"))
        if reference is None:
            every = own.groupBy("feature", "value").agg(F.sum("own").alias("n"))
            ranks = X.placed(every, ["feature"]).select("feature", "value", X.mid_rank(F.col("before"), F.col("n")).alias("rank"), "total")
            per = own.join(ranks, ["feature", "value"]).groupBy("grp", "feature").agg(F.sum(F.col("rank") * F.col("own")).alias("rs"), F.sum("own").alias("n1"), F.any_value("total").alias("total"))
            per = per.withColumn("n2", F.col("total") - F.col("n1"))
        else:
            # a value's rank among a group and the reference is its place in each, added up: neither is copied
            both = own.join(own.filter(F.col("grp") == reference).select("feature", "value", F.col("own").alias("ref")), ["feature", "value"], "left").filter(F.col("grp") != reference)
            mine = X.placed(both.withColumnRenamed("own", "n"), ["grp", "feature"])
            marks = own.groupBy("feature", "value").agg(F.coalesce(F.sum(F.when(F.col("grp") == reference, F.col("own"))), F.lit(0)).alias("n"))
            below = X.placed(marks, ["feature"]).select("feature", "value", F.col("before").alias("ref_before"), F.col("total").alias("ref_total"))
            met = mine.join(below, ["feature", "value"])
            rank = F.col("before") + F.col("ref_before") + (F.col("n") + F.coalesce("ref", F.lit(0)) + 1) / F.lit(2.0)
            per = met.groupBy("grp", "feature").agg(F.sum(rank * F.col("n")).alias("rs"), F.sum("n").alias("n1"), F.any_value("ref_total").alias("n2"))
        n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
        z = X.div(F.col("rs") - n1 * (n1 + n2 + 1) / 2, F.sqrt(n1 * n2 * (n1 + n2 + 1) / 12))
        out = per.select("grp", "feature", F.coalesce(z, F.lit(0.0)).alias("score"), F.when(z.isNull(), 1.0).otherwise(F.least(F.lit(1.0), 2 * (1 - X.phi(F.abs(z))))).alias("p"))
    else:
        per = rows.groupBy("grp", "feature").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
        if reference is None:
            w = Window.partitionBy("feature")
            per = per.select("grp", "feature", "n", "s", "q", *[(F.sum(c).over(w) - F.col(c)).alias(f"{c}2") for c in "nsq"])
        else:
            ref = per.filter(F.col("grp") == reference).select("feature", *[F.col(c).alias(f"{c}2") for c in "nsq"])
            per = per.filter(F.col("grp") != reference).join(ref, "feature")
        n1, n2 = F.col("n"), F.col("n2")
        m1, m2 = X.div(F.col("s"), n1), X.div(F.col("s2"), n2)
        pooled = X.div(F.col("q") - n1 * m1 * m1 + F.col("q2") - n2 * m2 * m2, n1 + n2 - 2)
        t = X.div(m1 - m2, F.sqrt(F.greatest(pooled, F.lit(0.0)) * (X.div(F.lit(1), n1) + X.div(F.lit(1), n2))))
        from phenogrid.functions.stats import student_p

        out = per.select("grp", "feature", t.alias("_t"), (n1 + n2 - 2).alias("_df")).select("grp", "feature", F.coalesce("_t", F.lit(0.0)).alias("score"), F.coalesce(student_p(F.col("_t"), F.col("_df")), F.lit(1.0)).alias("p"))
    if corr_method not in ADJUSTMENTS:
        raise ValueError(f"corr_method must be one of {', '.join(ADJUSTMENTS)}, not {corr_method}")
    if corr_method not in ("bonferroni", "fdr_bh"):  # a group has a row for each feature

        def adjusted(g: pd.DataFrame) -> pd.DataFrame:
            return g.assign(p_adjusted=adjust(g["p"].to_numpy(float), corr_method))

        return out.groupBy("grp").applyInPandas(adjusted, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in out.schema) + ", p_adjusted double")
    if corr_method == "bonferroni":
        return out.withColumn("p_adjusted", X.bonferroni(F.col("p"), F.count(F.lit(1)).over(Window.partitionBy("grp"))))
    return X.bh_adjust(out, ["grp"], "p", "feature")

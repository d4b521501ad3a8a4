"""Filters, deduplication and projections on annotated profiles (rows: objects; columns: annotations and features).

Functions that decide on features run one fused aggregate and return column lists with the frame, since the list of columns
depends on the data; all else is lazy. axis follows each operator's own convention, stated in its docstring.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phenogrid.functions import expr as X


def null_shares(df: DataFrame, feats: Sequence[str]) -> DataFrame:
    """feature, n, n_null, share: one pass."""
    wide = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(f).isNull()).alias(f) for f in feats])
    return wide.unpivot("n", list(feats), "feature", "n_null").select("feature", "n", "n_null", X.div(F.col("n_null"), F.col("n")).alias("share"))


def drop_missing_rows(df: DataFrame, feats: Sequence[str], min_share: float | None = None) -> DataFrame:
    """Drop rows with missing features: any, or a share of at least min_share."""
    if min_share is None:
        return df.filter(X.all_valid(feats))
    return df.filter(X.count_null(feats) / F.lit(float(len(feats))) < min_share)


def missing_features(df: DataFrame, feats: Sequence[str], min_share: float | None = None) -> list[str]:
    """Features to drop for missing values: any, or a share of at least min_share."""
    bad = null_shares(df, feats).filter("n_null > 0" if min_share is None else F.col("share") >= min_share)
    found = {r.feature for r in bad.collect()}
    return [f for f in feats if f in found]


def filter_std(df: DataFrame, var: str, std_thresh: float = 3, side: str = "both") -> DataFrame:
    """Rows strictly inside mean +- std_thresh population deviations of var; one-row statistics, joined by broadcast."""
    stats = df.agg(F.avg(var).alias("_m"), F.stddev_pop(var).alias("_s"))
    x, m, s = F.col(var), F.col("_m"), F.col("_s")
    keep = {"both": (x < m + std_thresh * s) & (x > m - std_thresh * s), "right": x < m + std_thresh * s, "left": x > m - std_thresh * s}[side]
    return df.join(F.broadcast(stats), how="cross").filter(keep).drop("_m", "_s")  # one row, an aggregate without keys


def filter_threshold(df: DataFrame, var: str, thresh: float, side: str = "right") -> DataFrame:
    """`right` keeps what is below thresh, `left` what is above."""
    return df.filter(F.col(var) < thresh if side == "right" else F.col(var) > thresh)


def drop_duplicate_rows(df: DataFrame, feats: Sequence[str], row_id: str = "row_id") -> DataFrame:
    """Rows with equal features: the first by row_id stays."""
    w = Window.partitionBy(*feats).orderBy(row_id)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def duplicate_features(df: DataFrame, feats: Sequence[str], row_id: str = "row_id") -> DataFrame:
    """feature, first: features that equal an earlier one in every row, and the first of them.

    Features are matched by a sum of hashes of (row, value) over all rows, which is one pass without a shuffle of rows, then
    confirmed value by value."""
    order = {f: i for i, f in enumerate(feats)}
    marks = df.agg(*[F.struct(F.sum(F.xxhash64(row_id, F.col(f)).cast("decimal(38,0)")).alias("a"), F.sum(F.hash(F.col(f), F.col(row_id)).cast("long")).alias("b")).alias(f) for f in feats]).first()
    first: dict[tuple, str] = {}
    pairs = []
    for f in feats:
        mark = tuple(marks[f])
        if mark in first:
            pairs.append((f, first[mark]))
        else:
            first[mark] = f
    spark = df.sparkSession
    if not pairs:
        return spark.createDataFrame([], "feature string, first string")
    differ = df.agg(*[F.count_if(~F.col(a).eqNullSafe(F.col(b))).alias(a) for a, b in pairs]).first()
    kept = sorted(((a, b) for a, b in pairs if differ[a] == 0), key=lambda p: order[p[0]])
    return spark.createDataFrame(kept, "feature string, first string")


def invariant_features(df: DataFrame, feats: Sequence[str]) -> list[str]:
    """Constant features without missing values."""
    row = df.agg(F.count(F.lit(1)).alias("_n"), *[F.struct(F.min(f), F.max(f), F.count(f)).alias(f) for f in feats]).first()
    return [f for f in feats if row[f][0] is not None and row[f][0] == row[f][1] and row[f][2] == row["_n"]]


def drop_invariant_rows(df: DataFrame, feats: Sequence[str]) -> DataFrame:
    """Rows whose features are all equal."""
    cols = [F.col(f) for f in feats]
    same = X.all_valid(feats) & (F.least(*cols) == F.greatest(*cols)) if len(cols) > 1 else F.lit(True)
    return df.filter(~same)


def outlier_features(df: DataFrame, feats: Sequence[str], thresh: float = 3.5) -> DataFrame:
    """feature, max_abs, keep: features whose largest magnitude is at most thresh and that miss nothing (axis 0)."""
    wide = df.agg(F.count(F.lit(1)).alias("n"), *[F.struct(F.max(F.abs(F.col(f))).alias("m"), F.count(f).alias("c")).alias(f) for f in feats])
    rows = wide.unpivot("n", list(feats), "feature", "x")
    return rows.select("feature", F.col("x.m").alias("max_abs"), ((F.col("x.c") == F.col("n")) & (F.coalesce("x.m", F.lit(float("inf"))) <= thresh)).alias("keep"))


def drop_outlier_rows(df: DataFrame, feats: Sequence[str], thresh: float = 3.5) -> DataFrame:
    """Rows whose largest magnitude is at most thresh (axis 1)."""
    cols = [F.abs(F.col(f)) for f in feats]
    return df.filter(X.all_valid(feats) & ((F.greatest(*cols) if len(cols) > 1 else cols[0]) <= thresh))


def select_by_group(df: DataFrame, var: str, by: str, method: str = "median") -> DataFrame:
    """Rows of each group at one level of var: the largest, smallest or median of its distinct levels; a median that is no level gives the nearest, the smaller on ties."""
    levels = df.select(by, var).filter(F.col(by).isNotNull() & F.col(var).isNotNull()).distinct()
    if method in ("max", "min"):
        pick = levels.groupBy(by).agg(getattr(F, method)(var).alias("_level"))
    else:
        mid = levels.groupBy(by).agg(X.median(var).alias("_mid"))
        pick = levels.join(mid, by).groupBy(by).agg(F.min_by(var, F.struct(F.abs(F.col(var) - F.col("_mid")), F.col(var))).alias("_level"))
    return df.join(pick, by).filter(F.col(var) == F.col("_level")).drop("_level")


def encode_labels(df: DataFrame, key: str, suffix: str = "_Enc") -> DataFrame:
    """Dense codes of a column in sorted order, computed on its distinct levels."""
    levels = df.select(key).filter(F.col(key).isNotNull()).distinct()
    codes = levels.withColumn(key + suffix, F.dense_rank().over(Window.orderBy(key)) - 1)
    return df.join(codes, key)


def ratio(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    return df.withColumn(out, X.div(F.col(a), F.col(b)))


def standard_well(c: Column | str) -> Column:
    """E07 -> E7."""
    c = F.col(c) if isinstance(c, str) else c
    return F.concat(F.regexp_extract(c, r"^(\D*)", 1), F.regexp_extract(c, r"(\d+)", 1).cast("int").cast("string"))


def query(df: DataFrame, **equal: object) -> DataFrame:
    """Rows at which all columns have the given values."""
    return df.filter(reduce(lambda a, b: a & b, [F.col(k) == F.lit(v) for k, v in equal.items()], F.lit(True)))


def representation(df: DataFrame, rep: str, n: int | None = None) -> Column:
    """The first n components of an embedding column."""
    return F.col(rep) if n is None else F.slice(F.col(rep), 1, n)


def keep_annotations(df: DataFrame, feats: Sequence[str], parts: Sequence[str], always: Sequence[str] = ()) -> DataFrame:
    """Features, and the annotations whose name holds one of parts."""
    return df.select(*[c for c in df.columns if c in feats or c in always or any(p in c for p in parts)])


def drop_low_count(df: DataFrame, by: Sequence[str], min_count: int) -> DataFrame:
    """Rows of the groups that have at least min_count rows; an anti-join on the few groups that fail."""
    bad = df.groupBy(*by).count().filter(F.col("count") < min_count).select(*by)
    return df.join(bad, list(by), "left_anti")

"""Column helpers with one rule for what is missing: NaN and infinities become NULL when data enters, and aggregates skip NULL.

Division never raises: a zero divisor gives NULL. Standard deviations are of the population unless a name says otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from phenogrid.functions.scratch import kept

#: 1 / (the normal distribution's upper quartile): makes a median absolute deviation comparable to a standard deviation.
MAD_SCALE = 1.482602218505602
#: Columns beyond which grouped aggregates are cut into several, so that generated code stays on (100 fields with buffers).
CHUNK = 40


def clean(c: Column | str) -> Column:
    """A number with NaN and infinities as NULL."""
    c = F.col(c) if isinstance(c, str) else c
    c = c.cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def ingest(df: DataFrame, feats: Sequence[str]) -> DataFrame:
    return df.withColumns({f: clean(f) for f in feats})


def div(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def median(c: Column | str) -> Column:
    return F.percentile(c, F.lit(0.5))


#: Values of at most so many decimals are summed in whole numbers by mean().
DECIMALS = 6


def mean(c: Column | str) -> Column:
    """The mean (an aggregate). Sums of fractions depend on the order of the rows in their last digits, so that equal means would not tie.

    Where all values have at most DECIMALS decimals and the sum of their magnitudes fits, they are summed as whole numbers, which is exact in any order."""
    c = F.col(c) if isinstance(c, str) else c
    unit = F.lit(10.0**DECIMALS)
    whole = F.rint(c * unit)
    exact = F.coalesce(F.bool_and(whole / unit == c), F.lit(False)) & (F.sum(F.abs(whole)) < F.lit(2.0**53))
    return F.when(exact, F.sum(whole) / (F.count(c) * unit)).otherwise(F.avg(c))


def all_valid(feats: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f).isNotNull() for f in feats], F.lit(True))


def count_null(feats: Sequence[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.col(f).isNull().cast("int") for f in feats])


def strict(agg: Column, c: Column | str) -> Column:
    """An aggregate that is NULL if any value of the group is."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.count(c) == F.count(F.lit(1)), agg)


def avg_rank(part: Sequence[str | Column], by: str | Column) -> Column:
    """Ranks from 1; ties get their mean."""
    w = Window.partitionBy(*part)
    return F.rank().over(w.orderBy(by)) + (F.count(F.lit(1)).over(w.partitionBy(*part, by)) - 1) / F.lit(2.0)


#: Ranges of values into which placed() cuts a part.
RANGES = 64


def placed(counts: DataFrame, part: Sequence[str], value: str = "value", n: str = "n") -> DataFrame:
    """`counts` (part, value, n: how many rows have the value; distinct, not NULL) with before (rows of smaller values) and total.

    A part may be all rows of a feature, so no window spans one: values are cut into ranges at approximate quantiles, totals of
    the ranges are summed up, and only the values of one range are put in order by a task. The result is exact whatever the cuts."""
    cuts = counts.groupBy(*part).agg(F.percentile_approx(value, F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)]), F.lit(2000)).alias("_cuts"))
    found = counts.join(F.broadcast(cuts), list(part)) if part else counts.join(F.broadcast(cuts), how="cross")  # a row for each part, of features and groups
    found = found.withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")
    sums = found.groupBy(*part, "_range").agg(F.sum(n).alias("_sum"))
    up = Window.partitionBy(*part).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # at most RANGES rows a part
    sums = sums.withColumn("_start", F.coalesce(F.sum("_sum").over(up), F.lit(0))).withColumn("total", F.sum("_sum").over(Window.partitionBy(*part))).drop("_sum")
    inside = Window.partitionBy(*part, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("_within", F.coalesce(F.sum(n).over(inside), F.lit(0))).join(sums, [*part, "_range"])
    return found.withColumn("before", F.col("_start") + F.col("_within")).drop("_range", "_start", "_within")


#: Shares of the rows on both sides of the median between whose approximate quantiles values are counted, and the accuracy of these.
BRACKET, ACCURACY = (0.495, 0.505), 2_000


def medians(df: DataFrame, by: Sequence[str], feats: Sequence[str]) -> DataFrame:
    """by, _a_<feature>: exact medians of each group, for groups of any size.

    An exact percentile holds every distinct value of a group in one task. Here a sketch of bounded size gives two values with the median between them;
    then rows below and above are only counted, and only the values between, about a hundredth, are put in order. NULL for a feature without values."""
    by = list(by)
    ends = kept(grouped(df, by, feats, lambda f: [F.percentile_approx(f, F.array(*[F.lit(p) for p in BRACKET]), F.lit(ACCURACY)).alias(f"_e_{f}")]))
    rows = df.select(*by, *feats).join(ends, by)
    cell = []
    for i, f in enumerate(feats):
        x, low, high = F.col(f).cast("double"), F.get(f"_e_{f}", F.lit(0)).cast("double"), F.get(f"_e_{f}", F.lit(1)).cast("double")
        side = F.when(x < low, -1).when(x > high, 1).otherwise(0)
        cell.append(F.struct(F.lit(i).alias("feature"), F.when(x.isNotNull(), side).alias("side"), F.when(x.between(low, high), x).alias("value")))
    counts = rows.select(*by, F.explode(F.array(*cell)).alias("_c")).select(*by, "_c.*").filter("side is not null").groupBy(*by, "feature", "side", "value").agg(F.count(F.lit(1)).alias("n"))
    part = Window.partitionBy(*by, "feature")
    upto = F.sum("n").over(part.orderBy("side", "value").rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.withColumn("to", upto).withColumn("total", F.sum("n").over(part))
    low, high = F.floor((F.col("total") - 1) / 2), F.ceil((F.col("total") - 1) / 2)
    inside = lambda k: (F.col("to") - F.col("n") <= k) & (k < F.col("to"))
    found = placed.filter(inside(low) | inside(high)).withColumn("value", F.when(F.col("side") == 0, F.col("value")).otherwise(F.raise_error(F.lit("medians: a sketch missed the median")).cast("double")))
    pick = lambda i, k: F.max(F.when((F.col("feature") == i) & inside(k), F.col("value")))
    out = [(pick(i, low) * 0.5 + pick(i, high) * 0.5).alias(f"_a_{f}") for i, f in enumerate(feats)]
    wide = found.groupBy(*by).agg(*out)
    return kept(ends.select(*by).join(wide, by, "left"))


def mid_rank(before: Column, n: Column) -> Column:
    """The mean rank, from 1, of n equal values after `before` smaller ones."""
    return before + (n + 1) / F.lit(2.0)


def pearson(x: Column, y: Column) -> Column:
    """Correlation from moments (an aggregate); NULL where a side is constant."""
    n = F.count(F.when(x.isNotNull() & y.isNotNull(), 1)).cast("double")
    return div(F.covar_pop(x, y), F.sqrt(F.var_pop(F.when(y.isNotNull(), x)) * F.var_pop(F.when(x.isNotNull(), y)))) + n * 0


def long(df: DataFrame, keep: Sequence[str], feats: Sequence[str], name: str = "feature", value: str = "value") -> DataFrame:
    """A row for each (row, feature)."""
    return df.unpivot(list(keep), list(feats), name, value)


def over(*part: str) -> WindowSpec:
    return Window.partitionBy(*part)


def chunks(feats: Sequence[str], size: int = CHUNK) -> list[list[str]]:
    return [list(feats[i : i + size]) for i in range(0, len(feats), size)]


def grouped(df: DataFrame, by: Sequence[str], feats: Sequence[str], agg, extra: Sequence[Column] = ()) -> DataFrame:
    """groupBy(by) with agg(feature) -> columns, in chunks of features that keep generated code on; chunks meet in a join by key."""
    parts = chunks(feats) or [[]]
    out = df.groupBy(*by).agg(*extra, *[c for f in parts[0] for c in agg(f)]) if parts[0] or extra else df.select(*by).distinct()
    for part in parts[1:]:
        more = df.groupBy(*by).agg(*[c for f in part for c in agg(f)])
        renamed = more.select(*[F.col(b).alias(f"_k_{b}") for b in by], *[c for c in more.columns if c not in by])
        cond = reduce(lambda a, b: a & b, [F.col(b).eqNullSafe(F.col(f"_k_{b}")) for b in by], F.lit(True))
        out = out.join(renamed, cond).drop(*[f"_k_{b}" for b in by])
    return out


def bonferroni(p: Column, n: Column) -> Column:
    return F.least(p * n, F.lit(1.0))


def bh_adjust(df: DataFrame, part: Sequence[str], p: str, order: str, out: str = "p_adjusted") -> DataFrame:
    """Benjamini-Hochberg: the smallest p * n / rank among this and larger p values of the part."""
    w = Window.partitionBy(*part)
    ranked = df.withColumn("_r", F.row_number().over(w.orderBy(p, order))).withColumn("_n", F.count(F.lit(1)).over(w))
    up = w.orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn(out, F.least(F.lit(1.0), F.min(F.col(p) * F.col("_n") / F.col("_r")).over(up))).drop("_r", "_n")


# Coefficients of a published rational approximation of the error function (7.1.26 in Abramowitz and Stegun).
_ERF = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def erf(x: Column) -> Column:
    """The error function to 1.5e-7, inside generated code."""
    t = 1 / (1 + 0.3275911 * F.abs(x))
    poly = reduce(lambda acc, c: acc * t + c, reversed(_ERF[:-1]), F.lit(_ERF[-1])) * t
    return F.signum(x) * (1 - poly * F.exp(-x * x))


def phi(z: Column) -> Column:
    """The normal distribution function."""
    return 0.5 * (1 + erf(z / F.lit(2.0**0.5)))


def interpolated(sorted_values: Column, p: Column) -> Column:
    """The p-quantile of a sorted array, linear between neighbours, p may vary by row."""
    at = p * (F.size(sorted_values) - 1)
    low = F.floor(at).cast("int")
    a, b = F.get(sorted_values, low), F.get(sorted_values, F.least(low + 1, F.size(sorted_values) - 1))
    return a + (b - a) * (at - low)


def hash_order(row_id: Column | str, seed: int) -> Column:
    """A pseudo-random order that stays the same wherever the row lies."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(row_id) if isinstance(row_id, str) else row_id))

"""Mixing sources to target weights as a time-varying curriculum, with DataFrame functions only.

1. Targets. Sources share the whole budget by weight; a source that would have to be repeated more than `most` times stops
   there, and what it leaves is shared again by weight. That fixed point has a closed form: sources are ranked by
   cap / weight, and running sums give the level at which the first uncapped source stands.
2. Cumulative demand. Source i has a weight schedule that falls or rises linearly over training, w_i(t) = 1 + drift_i * (2t - 1)
   for t in [0, 1]. Its integral t + drift_i * (t*t - t) is the share of its target that is consumed by time t.
3. Positions. A source's documents are put in a fixed pseudo-random order and laid end to end, pass after pass, until the
   target is met. The middle of a document's interval, as a share of the target, is inverted through the cumulative
   demand: that is its training position. Documents are range-sorted by it.

A source may hold a third of all rows, so the running sum inside a source is taken in two levels: by slice of the order,
then within a slice. No task sees more than one slice.

Defined results: a null text has size 0. A null source is a source of its own, after all others. A source without words
gets target 0. The last document of the last pass is taken if its middle lies before the target. Rows that repeat are
separate documents. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phenogrid.llm.common import WORD, col, materialise, table

#: Rows of a source that one slice should hold at most, on average.
SLICE_ROWS = 500


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """key, source_size, target, place (from 0) of each source of `sizes` (key, source, size); key is never null."""
    per = sizes.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = per.select("key", "source_size", (F.row_number().over(by_name) - 1).alias("place")).withColumn("weight", F.get(cycle, F.col("place") % len(weights)))
    cap = F.col("source_size") * F.lit(float(most))
    ranked = ranked.withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("weight"))
    every = Window.partitionBy()
    upto = Window.orderBy("ratio", "place").rowsBetween(Window.unboundedPreceding, -1)
    total, weight = F.sum("source_size").over(every), F.sum("weight").over(every)
    # the level if exactly the sources before this one, by ratio, are capped
    level = (total - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))) / (weight - F.coalesce(F.sum("weight").over(upto), F.lit(0.0)))
    held = ranked.withColumn("level", level)
    fits = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "place", "level"))).over(every)
    held = held.withColumn("first", fits)
    open_ = (F.col("ratio") > F.col("first.ratio")) | ((F.col("ratio") == F.col("first.ratio")) & (F.col("place") >= F.col("first.place")))
    return held.select("key", "source_size", F.when(open_, F.col("first.level") * F.col("weight")).otherwise(F.col("cap")).alias("target"), "place")


def curriculum(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: int = 3, drifts: tuple[float, ...] = (0.5, 0.0, -0.5), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """A row for each document: id, size, source_size, target, taken, passes, positions (of each pass, in [0, 1]), and the columns named in `carry` in a struct `carried`."""
    sized = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("!")).alias("key"), words(F.col(text_col)).alias("size"),
        # the order within a source: a fixed hash of id and text, so that null and repeated ids spread too; rows that agree in both are interchangeable
        F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text_col), F.lit(""))).cast("binary")).alias("order"),
        F.struct(*[col(c) for c in carry]).alias("carried") if carry else F.lit(None).alias("carried"),
    )
    sized = materialise(sized if carry else sized.drop("carried"), "sizes")
    slices = max(16, 1 << max(0, (sized.count() // SLICE_ROWS - 1).bit_length()))
    goal = targets(sized, weights, most)
    cut = F.shiftright(F.conv(F.substring("order", 1, 8), 16, 10).cast("long") * slices, 32).cast("int")
    sized = sized.withColumn("slice", cut)
    by_slice = sized.groupBy("key", "slice").agg(F.sum("size").alias("slice_size"))
    before = Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_slice.withColumn("start", F.coalesce(F.sum("slice_size").over(before), F.lit(0))).drop("slice_size")
    starts = starts.join(goal, "key")
    inside = Window.partitionBy("key", "slice").orderBy("order", F.col("id"), "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    # as many rows as sources times slices: a join by both keys keeps what the window has dealt out
    placed = placed.join(starts, ["key", "slice"]).withColumn("at", F.col("start") + F.col("within"))
    middle = F.col("at") + F.col("size") / 2
    passes = F.when(F.col("size") > 0, F.greatest(F.lit(0), F.least(F.lit(most), F.ceil((F.col("target") - middle) / F.col("source_size"))))).otherwise(F.lit(0)).cast("int")
    drift = F.get(F.array(*[F.lit(float(d)) for d in drifts]), F.col("place") % len(drifts))

    def position(k: Column) -> Column:
        share = (middle + k * F.col("source_size")) / F.col("target")
        # t + drift * (t*t - t) = share, solved without cancellation; drift 0 gives t = share
        return F.least(F.lit(1.0), 2 * share / ((1 - drift) + F.sqrt((1 - drift) * (1 - drift) + 4 * drift * share)))

    out = placed.withColumn("passes", passes)
    at = F.when(F.col("passes") > 0, F.transform(F.sequence(F.lit(0), F.col("passes") - 1), position)).otherwise(F.array().cast("array<double>"))
    return out.select("id", "source", "size", "source_size", "target", (F.col("size") * F.col("passes")).alias("taken"), "passes", at.alias("positions"), *(["carried"] if carry else []))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents in training order: each as often as the mix takes it, range-sorted by position; the columns of docs."""
    out = curriculum(docs, carry=tuple(docs.columns), **options)
    return out.select(F.explode("positions").alias("position"), "carried", "id").orderBy("position", "id").select("carried.*")


def op8_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = curriculum(table(spark, sf_dir, "documents"))
    first = F.round(F.get("positions", F.lit(0)), 9)
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", F.round("target", 6).alias("target"), "taken", first.alias("first_position")).orderBy(F.col("first_position").asc_nulls_last(), "doc_id")


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS ord FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
named AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 AS place FROM per),
weighed AS (SELECT *, CAST(1 + place % 3 AS DOUBLE) AS weight, 3.0::DOUBLE * source_size AS cap FROM named),
ranked AS (SELECT *, cap / weight AS ratio FROM weighed),
leveled AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER u, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER u, 0)) AS lvl
  FROM ranked WINDOW u AS (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
base AS (SELECT lvl, ratio, place FROM leveled WHERE lvl <= ratio ORDER BY ratio, place LIMIT 1),
goal AS (
  SELECT l.source, l.source_size, l.place,
         CASE WHEN (l.ratio, l.place) >= (b.ratio, b.place) THEN b.lvl * l.weight ELSE l.cap END AS target
  FROM leveled l LEFT JOIN base b ON true),
placed AS (
  SELECT s.doc_id, s.size, g.source_size, g.target, g.place,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.ord, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + s.size / 2.0::DOUBLE AS mid
  FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source),
drifted AS (
  SELECT *, CASE place % 3 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE -0.5::DOUBLE END AS d,
         CASE WHEN size > 0 THEN greatest(0, least(3, ceil((target - mid) / source_size))) ELSE 0 END AS passes
  FROM placed)
SELECT doc_id, size, source_size, round(target, 6) AS target, CAST(size * passes AS BIGINT) AS taken,
       CASE WHEN passes > 0 THEN round(least(1.0::DOUBLE, 2 * (mid / target) / ((1 - d) + sqrt((1 - d) * (1 - d) + 4 * d * (mid / target)))), 9) END AS first_position
FROM drifted
"""

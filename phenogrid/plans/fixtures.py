"""The driver's tables in profiling roles, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FEATS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as objects. row_id is made of the row's own values: unique, and no order over all rows is needed."""
    li = read(spark, sf_dir, "lineitem")
    row_id = F.concat_ws("-", *[F.lpad(F.col(c).cast("string"), n, "0") for c, n in (("l_orderkey", 10), ("l_linenumber", 2), ("l_partkey", 10), ("l_suppkey", 8))], F.round(F.col("l_extendedprice") * 100).cast("long").cast("string"))
    return li.select(
        row_id.alias("row_id"), F.col("l_linestatus").alias("batch"), F.col("l_returnflag").alias("plate"), F.col("l_suppkey").alias("well"),
        F.when(F.col("l_linenumber") == 1, "ctrl").otherwise(F.concat(F.lit("t"), F.col("l_linenumber"))).alias("treatment"), F.col("l_linenumber").alias("line"),
        *FEATS, F.col("l_partkey").alias("part"), F.col("l_orderkey").alias("image"),
    )


CELLS = """cells AS (
  SELECT concat_ws('-', lpad(CAST(l_orderkey AS VARCHAR), 10, '0'), lpad(CAST(l_linenumber AS VARCHAR), 2, '0'), lpad(CAST(l_partkey AS VARCHAR), 10, '0'),
                   lpad(CAST(l_suppkey AS VARCHAR), 8, '0'), CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR)) AS row_id,
         l_linestatus AS batch, l_returnflag AS plate, l_suppkey AS well,
         CASE WHEN l_linenumber = 1 THEN 'ctrl' ELSE 't' || l_linenumber END AS treatment, l_linenumber AS line,
         l_quantity, l_extendedprice, l_discount, l_tax, l_partkey AS part, l_orderkey AS image
  FROM lineitem)"""


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cells with missing values made from the part number: quantity at multiples of 17, tax too at multiples of 34."""
    return cells(spark, sf_dir).withColumns({"l_quantity": F.when(F.col("part") % 17 != 0, F.col("l_quantity")), "l_tax": F.when(F.col("part") % 34 != 0, F.col("l_tax"))})


DIRTY = CELLS + """, dirty AS (SELECT * REPLACE (CASE WHEN part % 17 <> 0 THEN l_quantity END AS l_quantity, CASE WHEN part % 34 <> 0 THEN l_tax END AS l_tax) FROM cells)"""


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as tracks: one a user, frames in order of time; position = (value, props.k), state = event type."""
    ev = read(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return ev.select("event_id", F.col("user_id").alias("track"), (F.row_number().over(w) - 1).cast("long").alias("frame"), F.col("value").alias("x"), F.get_json_object("props", "$.k").cast("double").alias("y"), F.col("event_type").alias("state"))


TRACKS = """tracks AS (
  SELECT event_id, user_id AS track, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, value AS x,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS y, event_type AS state FROM events)"""


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    """Numbers rounded for comparison; -0.0 becomes 0.0."""
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) + F.lit(0.0) for c in cols})


def rounded_native(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    """rounded(), halves away from zero as the SQL rounds, inside generated code: for tables of very many rows (round() makes a decimal object of each number)."""

    def one(c: str) -> Column:
        t = F.col(c).cast("double") * F.lit(10.0**digits)
        near = F.rint(t)
        return F.when(F.abs(t - near) == 0.5, t + F.signum(t) * 0.5).otherwise(near) / F.lit(10.0**digits) + F.lit(0.0)

    return df.withColumns({c: one(c) for c in cols})


def r6(expr: str, digits: int = 6) -> str:
    return f"round(CAST({expr} AS DOUBLE), {digits}) + 0.0"

"""Connected components of an edge table by alternating stars; the smallest node names its component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phenogrid.llm.common import materialise, remove_table


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on edges (a, b) with a > b: neighbours are tied to the smallest one."""
    if large:
        seen = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        seen = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    low = seen.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = seen.join(low, "u")
    if large:
        out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter(F.col("a") > F.col("b")).distinct()


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """node, label for every node of the edges (a, b), a != b, that is not its component's smallest.

    Each round is a few aggregations and joins over the edges; their number grows with the logarithm of a component's
    width. A hub's edges are combined before the shuffle. Fails if the stars are not stable after most_rounds."""
    held = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    for _ in range(most_rounds):
        new = materialise(_star(_star(held, True), False), "stars")
        remove_table(held)
        held = new
        now = held.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if now == mark:
            return held.select(F.col("a").alias("node"), F.col("b").alias("label"))
        mark = now
    raise RuntimeError("components: not stable")

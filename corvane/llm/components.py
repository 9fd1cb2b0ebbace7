"""Connected components of an edge table by alternating large-star and small-star rounds.

Every round is a grouped minimum and a join, on pairs that all stay in Spark; each is written to
the shared folder. The number of rounds grows with the logarithm of a component's size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _star(both: DataFrame, large: bool) -> DataFrame:
    """both: (u, v). large: v > u are hung on the least neighbour of u; else v <= u and u itself are."""
    side = both if large else both.where("v < u")
    least = side.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    hung = side.where("v > u") if large else side
    moved = hung.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    if not large:
        moved = moved.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): component is the least node reachable. Nodes are longs; nodes without an edge are left out."""
    e = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct()
    e = materialize(e, "cc")
    sign = F.struct(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).alias("s")
    seen = None
    while True:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        big = _star(both, True)
        last, e = e, materialize(_star(big.select(F.col("a").alias("u"), F.col("b").alias("v")), False), "cc")
        discard(last)
        now = e.agg(sign).head()[0]
        if now == seen:
            break
        seen = now
    tops = e.select("b").distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(tops.select(F.col("b").alias("node"), F.col("b").alias("component")))

"""Connected components on Spark: alternating large-star and small-star passes over an edge table, each written out.

A pass turns edges towards the smallest known neighbour; the passes end when the edge set no longer changes, at stars
around each component's smallest node. The number of passes grows with the logarithm of the node count. High-degree nodes
are met by window-free aggregation (a partial minimum before the shuffle) and a join on the node, whose skew adaptive
execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incipit.scale import dropped, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star pass over edges (u, v) with u < v."""
    both = edges.select(F.col("u").alias("a"), F.col("v").alias("b"))
    flipped = edges.select(F.col("v").alias("a"), F.col("u").alias("b"))
    around = both.unionByName(flipped) if large else flipped  # neighbours of a: all, or the smaller ones
    least = around.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    moved = around.join(least, "a")
    if large:  # larger neighbours go to the smallest of a and its neighbours
        out = moved.where("b > a").select(F.col("m").alias("u"), F.col("b").alias("v"))
    else:  # smaller neighbours, and a itself, go to the smallest
        out = moved.select(F.col("m").alias("u"), F.col("b").alias("v")).unionByName(least.select(F.col("m").alias("u"), F.col("a").alias("v")))
    return out.where("u < v").distinct()


def components(edges: DataFrame, most_passes: int = 60) -> DataFrame:
    """node, root (the smallest node of its component), for every node that has an edge."""
    spark = edges.sparkSession
    edges = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u < v").distinct()
    now, path = written(edges, "components")
    before = None
    for _ in range(most_passes):
        after, to = written(_star(_star(now, large=True), large=False), "components")
        # Sums of a hash of the edges tell whether the set changed; equal sets give equal sums in any order.
        state = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        dropped(spark, path)
        now, path = after, to
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(now.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())

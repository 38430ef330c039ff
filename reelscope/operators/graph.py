"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelscope.session import cut_lineage


def connected(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (a, b: long), root being the smallest node of its component.

    Every step links nodes to smaller ones only; minima are partial aggregates, so a hub's edges are
    reduced before the shuffle. Each round is checkpointed in the shared folder; their number grows with the logarithm
    of the longest path. The rounds end when a round changes nothing."""
    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    e = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    now, before = mark(e), None
    while now != before:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut_lineage(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now, before = mark(e), now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

"""Connected components by alternating large-star and small-star steps, on DataFrames alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import drop, stash


def _mins(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _summary(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """``node, component`` (the smallest node that links reach) of every node in ``edges``.

    Loops, repeated and reversed edges are harmless; an edge with a null end is ignored; no edges
    give no rows. Each round is an aggregation and two joins that Spark can split on skew, written
    to the shared folder; the number of rounds grows with the logarithm of the longest path.
    """
    now = edges.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v")).where("u <> v")
    now = now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, last = stash(now, "edges"), None
    while (seen := _summary(now)) != last and seen[0]:
        last = seen
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stash(_mins(both).select("u", F.least("u", "m").alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stash(large.where("u <> v").distinct(), "large")
        low = stash(_mins(large), "low")
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        new = stash(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        drop(now, least, large, low)
        now = new
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())

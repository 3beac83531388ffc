"""Connected components of a distributed edge list, by alternating large-star and small-star rounds.

Every round replaces edges so that each vertex points nearer to the smallest id of its component; it is two aggregations with
map-side combination and two joins, so a vertex with very many neighbours is no group in one task.  Rounds end when the
edges are stars around the smallest ids, which takes a number of rounds that grows as the logarithm of the component sizes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .recovery import stored


def _nearest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_nearest(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    linked = edges.join(_nearest(edges), "u")
    return linked.select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e")).select("e.u", F.col("e.m").alias("v")).where("u <> v")


def components(edges: DataFrame) -> DataFrame:
    """Edges (u BIGINT, v BIGINT) to (id, component): each vertex with the smallest id of its component.

    Loops and repeated edges count for nothing; no edges give no rows.
    """
    now = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state or not seen[0]:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        state = seen
        now = stored(_small_star(_large_star(now).distinct()).distinct())

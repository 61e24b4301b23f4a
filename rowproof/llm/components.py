"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import cut


def _state(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()


def connected(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) -> (doc, component): the smallest id reachable, for every id with an
    edge. Each round is two aggregations and two joins; no neighbour list is ever gathered."""
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    state = _state(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = cut(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        before, state = state, _state(now)
        if state == before:
            break
    # one aggregation, not a union of two: Spark 4.1 unites inputs of equal partitioning partition by
    # partition, and fails when it has made one of them a local read meanwhile
    own, root = F.struct(F.col("u").alias("doc"), F.col("v").alias("component")), F.struct(F.col("v").alias("doc"), F.col("v").alias("component"))
    return now.select(F.inline(F.array(own, root))).distinct()

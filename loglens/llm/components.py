"""Connected components of a link table, by alternating large-star and small-star rounds (published by
Kiveris et al., 2014).  Links stay in Spark; each round is a grouped minimum and a join, and its
result is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglens.llm.common import cut


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is linked with the least of the node's neighbours and itself."""
    both = edges.union(edges.select(F.col("low").alias("high"), F.col("high").alias("low")))
    both = both.toDF("node", "near")
    least = both.groupBy("node").agg(F.least(F.min("near"), F.first("node")).alias("least"))
    return both.where("near > node").join(least, "node").select(F.col("near").alias("high"), F.col("least").alias("low"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every neighbour below a node, and the node, are linked with the least of them."""
    least = edges.groupBy("high").agg(F.min("low").alias("least"))
    moved = edges.join(least, "high").where("low != least").select(F.col("low").alias("high"), F.col("least").alias("low"))
    return moved.union(least.select("high", F.col("least").alias("low")))


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (two bigint columns); a component is its least node."""
    a, b = links.columns
    edges = links.select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low")).where("high != low").distinct()
    edges = cut(edges, "links")
    before = None
    while True:
        edges = cut(_small_star(_large_star(edges).distinct()).distinct(), "stars")
        state = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("high", "low"))).first())
        if state == before:
            break
        before = state
    members = edges.select(F.col("high").alias("node"), F.col("low").alias("component"))
    return members.union(edges.select("low", "low").distinct())

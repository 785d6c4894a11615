"""Connected components of small-star edges, by alternating contraction with checkpointed rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from triagelake.llm.common import saved


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in ``edges`` (a, b); a component is named by its smallest node.

    A round joins every edge to the smallest neighbour of its ends. Both sides of a join are written
    tables, so adaptive execution can split a node with very many edges.
    """
    current = saved(edges.select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).where("high > low").distinct())
    state = None
    while True:
        # Each node's neighbours above it go to the smallest node around it ...
        both = current.select(F.col("high").alias("node"), F.col("low").alias("other")).unionByName(
            current.select(F.col("low").alias("node"), F.col("high").alias("other")))
        smallest = saved(both.groupBy("node").agg(F.min("other").alias("least"))
                         .select("node", F.least("node", "least").alias("least")))
        large = saved(both.where("other > node").join(smallest, "node").select(F.col("other").alias("high"), F.col("least").alias("low"))
                      .where("high > low").distinct())
        # ... then each node's neighbours below it, and the node itself.
        below = saved(large.groupBy("high").agg(F.min("low").alias("least")))
        small = large.join(below, "high").select(F.col("low").alias("high"), F.col("least").alias("low")).where("high > low")
        current = saved(small.unionByName(below.select("high", F.col("least").alias("low"))).distinct())
        now = tuple(current.agg(F.count("*"), F.sum(F.xxhash64("high", "low") % 1_000_003), F.count_distinct("high")).first())
        if now == state or now[0] == now[2] and _is_star(current):
            break
        state = now
    found = current.select(F.col("high").alias("node"), F.col("low").alias("component"))
    return found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())


def _is_star(current: DataFrame) -> bool:
    """True if no node is both a member and a centre."""
    centres = current.select(F.col("low").alias("node")).distinct()
    return current.select(F.col("high").alias("node")).join(centres, "node", "left_semi").isEmpty()

"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.storage import BROADCAST_ROWS, stored


def _with_least(pairs: DataFrame, few: bool) -> DataFrame:
    """pairs(a, b) with m, the least of a and its neighbours. Combined before the shuffle and joined back, so no node is one
    task: sent to all if nodes are few, else by a join that adaptive execution can split."""
    least = pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return pairs.join(F.broadcast(least) if few else least, "a")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for nodes of edges(a, b): component is the least node reachable.

    Alternates large-star and small-star rounds (Kiveris et al., 2014) until
    nothing changes; each round is written, so lineage stays short.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "components")
    few = 2 * now.count() <= BROADCAST_ROWS  # rounds never add edges, and an edge has two nodes
    seen = None
    while True:
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_least(both, few).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        near = _with_least(large, few)
        down = near.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(near.select("a", F.col("m").alias("b")))
        now = stored(down.where("a <> b").distinct(), "components")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            roots = now.select(F.col("b").alias("node")).distinct()
            leaves = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
            return leaves.unionByName(roots.withColumn("component", F.col("node")))
        seen = mark

"""Connected components of a large edge list by alternating large and small stars.

Every round is two joins-free aggregations over the edges plus two joins on the
node; the edge list is written to the shared folder each round, so a lost
executor costs at most one round. Only the number of changed edges reaches the
driver.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's neighbours to the smallest of them and itself: the larger
    neighbours (large star), or the smaller ones and the node (small star)."""
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))) if large else \
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    linked = both.join(low, "a")
    if large:
        out = linked.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            low.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``edges``: columns a, b (longs). Returns node, root (the smallest node of
    its component) for every node that has an edge to another node."""
    current = stored(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    seen = None
    for _ in range(rounds):
        current = stored(_star(_star(current, True), False), "edges")
        state = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state
    raise RuntimeError(f"components not settled after {rounds} rounds")

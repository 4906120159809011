"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociq.scratch import stored


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


_HUB = 1_000  # neighbours that make a node a hub


def _with_least(edges: DataFrame, least: DataFrame, hub: int | None) -> DataFrame:
    """``edges`` with the column least of their node a. What hubs know is broadcast (their number is at most that of all
    edges over ``hub``), so that no task gets all edges of one; the rest is joined."""
    if hub is None:
        return edges.join(least.select("a", "least"), "a")
    hubs = least.filter(F.col("n") > hub).select("a", F.col("least").alias("of_hub"))
    marked = edges.join(F.broadcast(hubs), "a", "left")
    rest = marked.filter("of_hub IS NULL").select("a", "b").join(least.filter(F.col("n") <= hub).select("a", "least"), "a")
    return marked.filter("of_hub IS NOT NULL").select("a", "b", F.col("of_hub").alias("least")).unionByName(rest)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node with an edge in ``edges`` (a, b: long); the component is its smallest node.

    Each round hangs every node's larger neighbours, then its smaller ones, on its smallest neighbour; the number
    of rounds grows with the logarithm of the longest path. Sums before joins are combined on the map side,
    every round is written to the shared folder, and nodes with very many neighbours are spread over tasks.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    now = stored(edges.filter("a <> b").select(high.alias("a"), low.alias("b")).distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        hub = max(_HUB, mark[0] // 1_000)  # at most 2,000 hubs
        largest = now.groupBy("b").count().agg(F.max("count")).first()[0]
        hub = hub if largest > hub // 2 else None
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"), F.count("*").alias("n"))
        large = _with_least(both, least, hub).filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("least"), F.count("*").alias("n"))
        joined = _with_least(large, least, hub)
        small = joined.select("a", F.col("least").alias("b")).unionByName(joined.filter("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b")))
        now = stored(small.distinct(), "edges")
        after = _mark(now)
        if after == mark:
            break
        mark = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())

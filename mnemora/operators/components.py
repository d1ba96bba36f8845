"""Connected components of a graph given as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemora.sources import cut


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """One row for each node of an edge: node, component (the smallest node it is connected with).

    Edges with a null end are left out; direction, repeats and self-loops don't matter (a node with only a self-loop
    is its own component); no edges give no rows. Each round links every node's larger neighbours to its least
    neighbour and then its smaller ones, which keeps the number of edges and ends in O(log^2 n) rounds. A hub is
    grouped with map-side minimum; the join of its edges with its minimum is divided by the adaptive skew join.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    nodes = cut(both.select("u").unionAll(both.select("v")).distinct())
    now = cut(both.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(rounds):
        # settled: every node has one smaller neighbour at most, and none that has itself a smaller one
        ends = now.select(F.col("u").alias("n"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionAll(now.select(F.col("v"), F.lit(0), F.lit(1)))
        if ends.groupBy("n").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 OR (down = 1 AND up = 1)").isEmpty():
            break
        ways = now.unionAll(now.select(F.col("v"), F.col("u")))
        least = ways.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = ways.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u")
        now = cut(small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionAll(small_least.select("u", F.col("m").alias("v"))).distinct())
    else:
        raise RuntimeError(f"components did not settle within {rounds} rounds")
    return nodes.join(now, "u", "left").select(F.col("u").alias("node"), F.coalesce("v", "u").alias("component"))

"""Connected components by alternating stars, without collecting any group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepwright.sources.workspace import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each node's greater neighbours to the least of its neighbourhood."""
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link each node and its lesser neighbours to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the edges (u, v), u != v; the label is the least node reachable.

    Rounds are about the logarithm of the longest chain. Each is written to the
    shared folder, so that its lineage ends and lost executors cost one round.
    Minima combine before the shuffle; a node with many neighbours is a hot key
    on one side of a join only, which adaptive execution splits.
    """
    edges = written(edges.where("u != v").distinct(), "edges")
    before = None
    while True:
        edges = written(_small_star(_large_star(edges)), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(
                edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
        before = now

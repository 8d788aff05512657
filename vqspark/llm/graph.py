"""Connected components over DataFrames of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vqspark.lineage import cut, release, remove, shared_dir, written

__all__ = ["connected_components", "cut", "release", "remove", "shared_dir", "written"]


def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """``(node, component)`` of every node of ``edges(a, b)``; component is the smallest node reachable.

    Alternates two contractions. One hangs every larger neighbour of a node on
    the smallest node around it, the other does the same with the smaller
    neighbours. Both are an aggregate with map-side combine and an equi-join
    whose large side the adaptive planner may split, so a node with very many
    neighbours doesn't gather in one task. Rounds grow with the logarithm of the
    longest path. Self loops, repeated edges and nulls are ignored.
    """
    now = cut(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    seen = None
    for _ in range(max_rounds):
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("u") % 65537)).first()
        if mark == seen:
            break
        seen = mark
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
        hung = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        hung = hung.where("u <> v").distinct()
        low = hung.groupBy("u").agg(F.min("v").alias("low"))
        down = hung.join(low, "u").where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        now = cut(down.union(low.select("u", F.col("low").alias("v"))).distinct())
    else:
        raise RuntimeError(f"components still change after {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)

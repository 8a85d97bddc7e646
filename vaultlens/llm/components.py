"""Connected components of a graph of any size, by alternating large-star and small-star steps.

Each step is one aggregation (least neighbour of each node, combined before the shuffle) and one equi-join whose
skewed partitions adaptive execution splits; hubs never meet in one task. Edges are cut off from their lineage each
round through the shared checkpoint folder. Rounds grow with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultlens.llm.common import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large: neighbours above a node go to its least neighbour. Small: neighbours below it, and itself, do."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    near = both.join(least, "a")
    if large:
        out = near.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = near.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def _print(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return r["n"], r["x"]


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """node, component (its least reachable node) for every node that edges (a, b) name, each node once."""
    edges = cut(edges.select("a", "b").where(F.col("a") != F.col("b")).distinct())
    now = _print(edges)
    for _ in range(limit):
        if now[0] == 0:
            break
        step = cut(_star(_star(edges, large=True), large=False))
        then = _print(step)
        edges = step
        if then == now:
            break
        now = then
    else:
        raise RuntimeError("components did not settle")
    leaves = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return leaves.unionByName(leaves.select(F.col("component").alias("node"), "component")).distinct()

"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, lookup


def large_star(edges: DataFrame, rows: int) -> DataFrame:
    """Joins each node's larger neighbours to the smallest of the node and its neighbours. rows: about how many edges there are."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("degree"))
    found = lookup(both, least, "u", "degree", 2 * max(rows, 1), "v")
    return found.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def small_star(edges: DataFrame, rows: int) -> DataFrame:
    """Joins each node and its smaller neighbours to the smallest of these."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree"))
    found = lookup(down, least, "u", "degree", max(rows, 1), "v")
    moved = found.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node with an edge in edges (u, v); a component is named by its least node.

    Loops and repeated edges are allowed. The rounds double the reach, so there are few; each
    writes its edges to the shared folder. The sum of edges' hashes tells that nothing changed.
    """
    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = state(now)
    for _ in range(rounds):
        if not before[0]:
            break
        now = cut(large_star(now, before[0]).distinct())
        now = cut(small_star(now, before[0]).distinct())
        after = state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components have not settled in {rounds} rounds")
    tops = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops.select("node", F.col("node").alias("component")))

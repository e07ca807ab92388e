"""Connected components of an edge list, by alternating large-star and small-star steps.

A step hangs the neighbours of each node on the smallest of them. The smallest comes from a
pre-aggregated group, and goes back to the neighbours by a join of two plain shuffles, whose large
partitions adaptive execution can split: that is what happens to a hub, such as a root after the first
round. Each step is written to the shared folder, once. Rounds grow with the logarithm of the longest
chain and end as soon as the edges are stars.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _pair(a: Column, b: Column) -> Column:
    return F.struct(a.alias("a"), b.alias("b"))


def _hang(pairs: DataFrame, large: bool) -> DataFrame:
    """Hangs the neighbours ``v`` of each node ``u`` on the smallest of them and ``u``: those above ``u`` (large), or those below and ``u`` itself (small, where all are below)."""
    u, v, m = F.col("u"), F.col("v"), F.col("m")
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    joined = pairs.join(least.withColumnRenamed("u", "w"), u == F.col("w"))
    hung = joined.where(v > u).select(v.alias("a"), F.least(u, m).alias("b")) if large else joined.select(F.explode(F.array(_pair(v, m), _pair(u, m))).alias("e")).select("e.*")
    return materialise(hung.where("a != b").distinct(), "edges")


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node hangs on one other that hangs on none."""
    n = edges.agg(F.count("*").alias("n"), F.count_distinct("a").alias("a")).first()
    return n["n"] == n["a"] and edges.select("b").distinct().join(edges.select("a"), F.col("a") == F.col("b"), "left_semi").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the smallest node of its component. Self-edges and repeats are harmless."""
    a, b = F.col("a"), F.col("b")
    now = materialise(edges.where("a != b").select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "edges")
    while not _are_stars(now):
        both = now.select(F.explode(F.array(_pair(a, b), _pair(b, a))).alias("e")).select(F.col("e.a").alias("u"), F.col("e.b").alias("v"))
        now = _hang(_hang(both, large=True).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")), large=False)
    return now.select(a.alias("node"), b.alias("root")).union(now.select(b.alias("node"), b.alias("root")).distinct())

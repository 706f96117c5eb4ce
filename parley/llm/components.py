"""Connected components by alternating star contraction, as joins and aggregations.

Every round points each node's larger neighbours at its smallest neighbour, then
its smaller ones; edges become stars around the smallest node of a component in
a number of rounds that grows with the logarithm of the graph. Minima are
aggregated on the map side and landed, so that the join of a node with a third
of all edges is a plain skewed join, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.shared import landed, sorted_side


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    smallest = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    smallest = landed(smallest, "large-star")
    return sorted_side(both.where("b > a")).join(smallest, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    smallest = landed(down.groupBy("a").agg(F.min("b").alias("m")), "small-star")
    moved = sorted_side(down).join(smallest, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(smallest.select("a", F.col("m").alias("b")))


def _state(edges: DataFrame) -> tuple:
    return tuple(
        edges.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.sum(F.col("b").cast("decimal(20,0)"))
        ).first()
    )


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Per node that has an edge to another node: `node` and `root`, the smallest node it can reach."""
    edges = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct()
    edges = landed(edges, "edges")
    before = _state(edges)
    while before[0]:
        star = landed(_large_star(edges).distinct(), "edges")
        edges = landed(_small_star(star).distinct(), "edges")
        now = _state(edges)
        if now == before:
            break
        before = now
    leaves = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return leaves.union(leaves.select(F.col("root").alias("node"), "root").distinct())

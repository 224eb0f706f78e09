"""Connected components of an edge table by alternating star contractions.

Each round is two joins and groupings; every node learns the smallest node of its component in a number
of rounds that grows with the logarithm of the component's size. Rounds are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def _smallest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("a").agg(F.min("b").alias("low"))


def _state(edges: DataFrame) -> tuple:
    digest = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count(F.lit(1)), digest).first())


def connected(edges: DataFrame) -> DataFrame:
    """`node`, `component` (its smallest node) for every node of the edges `a`, `b`."""
    edges = edges.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    ).distinct()
    edges = materialize(edges, "edges")
    state = _state(edges)
    while True:
        # Large star: neighbours above a node move to the node's smallest neighbour (itself included).
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = _smallest(both).withColumn("low", F.least("a", "low"))
        large = both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = materialize(large.distinct(), "edges")
        # Small star: neighbours below a node move to the smallest of them, and so does the node.
        low = _smallest(large)
        moved = large.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        small = moved.unionByName(low.select("a", F.col("low").alias("b"))).where(F.col("a") != F.col("b"))
        edges = materialize(small.distinct(), "edges")
        previous, state = state, _state(edges)
        if state == previous:
            break
    nodes = edges.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    roots = edges.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return nodes.unionByName(roots)

"""Connected components of an edge table, by alternating large and small stars, all in DataFrames.

Each round hangs every node of a star on the star's smallest node.  Edges are never collected; each round's
edges are written to the shared folder, so that lineage stays short and a lost executor costs nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (a, b).  Large star: each node's greater neighbours go to its least; small star: a node and its lesser neighbours do."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    joined = both.join(least, "a")
    if large:
        out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("x"), F.col("m").alias("y"))
    else:
        out = joined.select(F.col("b").alias("x"), F.col("m").alias("y")).union(least.select(F.col("a").alias("x"), F.col("m").alias("y")))
    return out.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for each node with an edge: root is the smallest node that it reaches.  edges: two columns of one type."""
    one, two = edges.columns
    current = edges.select(F.col(one).alias("a"), F.col(two).alias("b")).where("a <> b").distinct()
    for _ in range(max_rounds):
        current = materialize(_star(_star(current, True), False).distinct(), "components")
        # done when stars alone are left: each leaf has one centre, and no centre is a leaf
        several = current.groupBy("a").agg(F.min("b").alias("u"), F.max("b").alias("v")).where("u <> v")
        if several.isEmpty() and current.join(current.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():
            return current.select(F.col("a").alias("node"), F.col("b").alias("root")).union(current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")

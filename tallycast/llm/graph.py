"""Connected components over an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long); root is the smallest node reachable, itself included.

    No neighbour list is ever collected: a node's smallest neighbour is a partial aggregate, and the edges of a
    node with many neighbours are joined to it as a skewed join that Spark can split. Each round is written to the
    shared folder, so the lineage stays short. Null nodes and loops of one node are left out.
    """
    star = store.written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _settled(star):
        star = store.written(_small(_large(star)), "edges")
    return star.select(F.col("a").alias("node"), F.col("b").alias("root")).union(star.select("b", "b").distinct())


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's smallest neighbour."""
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are tied to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    tied = edges.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return tied.union(least).where("a <> b").distinct()


def _settled(edges: DataFrame) -> bool:
    """Every node has one parent, and no parent has one."""
    twice = edges.groupBy("a").count().where("count > 1").select("a")
    inner = edges.join(edges.select(F.col("a").alias("b")), "b", "left_semi").select("a")
    return twice.union(inner).isEmpty()

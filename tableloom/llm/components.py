"""Connected components of a large graph by repeated contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableloom.session import materialise


def _renamed(node: Column, step: int) -> Column:
    """Another number for each node in each round; the hash of one 64-bit integer is a bijection."""
    return F.xxhash64(F.lit(step), node)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, label`` for every row of ``nodes`` (long column ``node``); linked nodes share a label.

    Each round renames the nodes at random, lets every node join its smallest neighbour, and contracts the graph.
    Random names keep chains short, so the number of rounds grows with the logarithm of the largest component, and a
    node with a third of all links costs one row per task, since minima are combined before the shuffle. Every round
    is written to the shared folder. ``edges`` has the columns ``a, b``; repeats and loops do nothing.
    """
    edges = materialise(edges.select("a", "b").filter(F.col("a") != F.col("b")).distinct(), "edges")
    labels, step = nodes.select("node", F.col("node").alias("label")), 0
    while not edges.isEmpty():
        step += 1
        named = edges.select(_renamed(F.col("a"), step).alias("a"), _renamed(F.col("b"), step).alias("b"))
        both = named.unionByName(named.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("parent"))
        parents = materialise(parents, "parents")
        left = parents.withColumnsRenamed({"a": "a", "parent": "pa"})
        right = parents.withColumnsRenamed({"a": "b", "parent": "pb"})
        merged = named.join(left, "a").join(right, "b").filter(F.col("pa") != F.col("pb"))
        ends = merged.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
        edges = materialise(ends.distinct(), "edges")
        labels = labels.withColumn("label", _renamed(F.col("label"), step))
        labels = labels.join(parents.withColumnRenamed("a", "label"), "label", "left")
        labels = labels.select("node", F.coalesce("parent", "label").alias("label"))
    return labels

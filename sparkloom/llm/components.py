"""Connected components by contraction: every node takes its smallest neighbour, edges move to the nodes taken, until none is left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each component, for every node of ``edges`` (u, v), both long.

    A round groups and joins; rows for one node stay apart until sums by key. A node goes two steps a round, and nodes that are left over at
    least halve, so rounds grow with the logarithm of a component's size. Self-loops and repeated edges are harmless; no edges give no rows.
    """
    left = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    nodes = left.select(F.col("u").alias("node")).union(left.select("v")).distinct().withColumn("label", F.col("node"))
    while not left.isEmpty():
        # Written before it's joined: then each join has a shuffle on both sides, whose hot hubs Spark can split.
        first = stored(left.groupBy("u").agg(F.min("v").alias("p")), "parents")
        onward = first.select(F.col("u").alias("p"), F.col("p").alias("next"))
        to = stored(first.join(onward, "p", "left").select("u", F.coalesce("next", "p").alias("p")), "parents")
        nodes = stored(nodes.join(to.withColumnRenamed("u", "label"), "label", "left").select("node", F.coalesce("p", "label").alias("label")), "nodes")
        moved = left.join(to, "u").select("v", F.col("p").alias("a")).join(to.select(F.col("u").alias("v"), F.col("p").alias("q")), "v", "left")
        moved = moved.select("a", F.coalesce("q", "v").alias("b")).where("a <> b")
        left = stored(moved.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    return nodes

"""Connected components by contraction, in Spark joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _pairs(edges: DataFrame) -> DataFrame:
    low, high = F.least("a", "b"), F.greatest("a", "b")
    return edges.where("a <> b").select(low.alias("a"), high.alias("b")).distinct()


def components(edges: DataFrame, label: str) -> DataFrame:
    """``node, root`` for every node of ``edges(a, b)``; all nodes of a component have one root.

    Every round each node takes its least neighbour as parent, parents are
    followed three steps, and edges are drawn again between the parents; edges
    inside a component vanish, so the edge table shrinks by a factor each round.
    Tables are written between rounds, nothing is collected.
    """
    edges = staged(_pairs(edges), f"{label}-edges")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    found = staged(nodes.withColumn("root", F.col("node")), f"{label}-roots")
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        parents = staged(both.groupBy(F.col("a").alias("child")).agg(F.min("b").alias("p")).select(
            "child", F.least("child", "p").alias("parent")), f"{label}-parents")
        step = parents
        for _ in range(3):
            up = parents.select(F.col("child").alias("parent"), F.col("parent").alias("next"))
            step = step.join(up, "parent").select("child", F.col("next").alias("parent"))
        step = staged(step, f"{label}-steps")
        at = step.select(F.col("child").alias("root"), F.col("parent").alias("to"))
        found = staged(found.join(at, "root", "left").select("node", F.coalesce("to", "root").alias("root")), f"{label}-roots")
        moved = edges.join(step.select(F.col("child").alias("a"), F.col("parent").alias("x")), "a").join(
            step.select(F.col("child").alias("b"), F.col("parent").alias("y")), "b")
        edges = staged(_pairs(moved.select(F.col("x").alias("a"), F.col("y").alias("b"))), f"{label}-edges")
    return found

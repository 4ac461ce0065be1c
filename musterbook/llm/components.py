"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from musterbook.llm.common import store


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link the neighbours of each node to the least node among them and itself.

    Large star: neighbours above the node; small star: the node and its neighbours below it.
    The least neighbour is a partial aggregate and meets the edges in a join, so a node
    with very many neighbours is no single group.
    """
    if large:
        sides = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        # Every edge once, from its larger end.
        sides = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = sides.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    linked = sides.join(least, "a")
    if large:
        out = linked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.select("b", "m").unionByName(least.select(F.col("a").alias("b"), "m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.where("a != b").distinct()


def components(edges: DataFrame, name: str = "links") -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); a component is its least node.

    Rounds grow with the logarithm of the number of nodes; each writes its edges to the shared
    folder. Loops and repeated edges do not matter; no edges give no rows.
    """
    current = store(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    before = None
    while True:
        mark = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
        current = store(_star(_star(current, True), False), name)
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )

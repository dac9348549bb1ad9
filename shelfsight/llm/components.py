"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a minimum per node and a join, so a node with any number of neighbours is never gathered in
one task. Each round is written to the shared folder, which cuts lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfsight.workspace import written


def connected(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``edges`` (x, y): comp is the least node that it reaches.

    Loops and repeated edges are allowed, nulls are not. No edges give no rows.
    """
    edges = written(
        edges.where("x != y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct(),
        "edges",
    )
    before = None
    while True:
        least = written(_small_star(_large_star(edges)), "star")
        state = least.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first()
        if state == before:
            break
        edges, before = least, state
    nodes = edges.select(F.col("x").alias("node"), F.col("y").alias("comp"))
    return nodes.union(edges.select(F.col("y").alias("node"), F.col("y").alias("comp")).distinct())


def _large_star(edges: DataFrame) -> DataFrame:
    """Joins every larger neighbour of a node to the least of the node and its neighbours."""
    both = edges.union(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
    least = both.groupBy("x").agg(F.min("y").alias("m"))
    return (
        both.where("y > x").join(least, "x")
        .select(F.col("y").alias("x"), F.least("x", "m").alias("y"))
        .where("x != y").distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Joins a node and its smaller neighbours to the least of them."""
    least = edges.groupBy("x").agg(F.min("y").alias("m"))
    moved = edges.join(least, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).where("x != y")
    return moved.union(least.select("x", F.col("m").alias("y"))).distinct()

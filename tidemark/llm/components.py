"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace


def _star(edges: DataFrame) -> DataFrame:
    """Link every vertex's greater neighbours, then its lesser ones, to its least neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
    lesser = large.groupBy("u").agg(F.min("v").alias("m"))
    joined = large.join(lesser, "u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").unionByName(lesser.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, a: str, b: str, space: Workspace, name: str) -> DataFrame:
    """(id, component) of every vertex that has an edge to a lesser one; component: the least id reachable.

    Vertices not in the result are components of their own or the least of theirs.
    Each round is written to the shared folder; rounds grow with the logarithm of the
    longest path.  Minima are combined before the shuffle, so a vertex with very many
    edges meets in no task; the joins' large partitions can be split.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct()
    now, seen, turn = space.write(now, f"{name}0"), None, 0
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0]
        if state[0] == 0 or state == seen:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component"))
        seen, turn = state, turn + 1
        now = space.write(_star(now), f"{name}{turn}")
        space.drop(f"{name}{turn - 1}")

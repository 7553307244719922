"""The property graph: neighbours, walks, upserts, tombstones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..streaming.files import stored
from .temporal import valid_in


def undirected(edges: DataFrame, source: str, target: str) -> DataFrame:
    """(node, neighbour, ...) of every edge in both directions, without repeats."""
    rest = [c for c in edges.columns if c not in (source, target)]
    out = edges.select(F.col(source).alias("node"), F.col(target).alias("neighbour"), *rest)
    back = edges.select(F.col(target).alias("node"), F.col(source).alias("neighbour"), *rest)
    return out.unionByName(back).distinct()


def walk(edges: DataFrame, seeds: DataFrame, hops: int, source: str, target: str) -> DataFrame:
    """(seed, node, hop): nodes within so many hops of each seed, at their least distance.

    The loop is over hops, not rows; each turn joins the frontier with either end of
    the edges, so only what is reached is made distinct, and drops what was visited.
    A frontier is stored before the next hop, so no hop is computed twice, and edges that it
    does not touch are left out before they are grouped or joined, where they are derived.
    """
    out = edges.select(F.col(source).alias("node"), F.col(target).alias("_next"))
    back = edges.select(F.col(target).alias("node"), F.col(source).alias("_next"))
    visited = stored(seeds.select(F.col("seed"), F.col("seed").alias("node"), F.lit(0).alias("hop")).distinct(), "walk")
    frontier = visited
    for hop in range(1, hops + 1):
        steps = frontier.select("seed", "node")
        near = [end.join(steps.select("node"), "node", "left_semi") for end in (out, back)]
        reached = steps.join(near[0], "node").unionByName(steps.join(near[1], "node")).select("seed", F.col("_next").alias("node")).distinct()
        frontier = stored(reached.join(visited, ["seed", "node"], "left_anti").withColumn("hop", F.lit(hop)), "walk")
        visited = visited.unionByName(frontier)
    return visited


def admit_edges(edges: DataFrame, nodes: DataFrame, authorized: Column, start: Column, end: Column) -> DataFrame:
    """Each edge with the first reason against it, or admitted: authorization, time, endpoints, self-loop."""
    known = nodes.select("node_id", F.lit(True).alias("_there"))
    out = edges.join(known.withColumnRenamed("node_id", "source_id").withColumnRenamed("_there", "_s"), "source_id", "left")
    out = out.join(known.withColumnRenamed("node_id", "target_id").withColumnRenamed("_there", "_t"), "target_id", "left")
    reason = (
        F.when(~authorized, "unauthorized")
        .when(~valid_in(F.col("valid_from"), F.col("valid_to"), start, end), "outside_window")
        .when(F.col("source_id") == F.col("target_id"), "self_loop")
        .when(F.col("_s").isNull() | F.col("_t").isNull(), "missing_endpoint")
        .otherwise("admitted")
    )
    return out.withColumn("reason", reason).drop("_s", "_t")


def upsert(state: DataFrame, batch: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The batch's last row per key replaces the state's; other keys stay.  Nulls in the batch clear."""
    from .versions import first_per_key

    last = first_per_key(batch, keys, order)
    return state.join(last.select(*keys), keys, "left_anti").unionByName(last.select(*state.columns))


def insert_absent(state: DataFrame, stubs: DataFrame, keys: list[str]) -> DataFrame:
    """Stubs of nodes that edges refer to; existing nodes keep their attributes."""
    fresh = stubs.dropDuplicates(keys).join(state.select(*keys), keys, "left_anti")
    return state.unionByName(fresh, allowMissingColumns=True).select(*state.columns)


def apply_tombstones(state: DataFrame, tombstones: DataFrame, keys: list[str], observed: str, effective: str) -> DataFrame:
    """Delete rows observed no later than their tombstone takes effect; later ones survive."""
    last = tombstones.groupBy(*keys).agg(F.max(effective).alias("_effective"))
    joined = state.join(last, keys, "left")
    return joined.filter(F.col("_effective").isNull() | (F.col(observed) > F.col("_effective"))).drop("_effective")


def drop_orphans(nodes: DataFrame, edges: DataFrame, kind: Column) -> DataFrame:
    """Nodes of the kind stay only while an edge touches them; all others stay."""
    touched = edges.select(F.col("source_id").alias("node_id")).unionByName(edges.select(F.col("target_id").alias("node_id"))).distinct()
    return nodes.filter(~kind).unionByName(nodes.filter(kind).join(touched, "node_id", "left_semi"))

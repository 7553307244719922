"""Context discovery on the graph: edges around the committed subjects, admitted as paths and drivers."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import deterministic_uuid

#: Relations that say something about a driver, and as what.
DRIVERS = {"BLOCKS": ("principal", "relationship", "blockers")}
DEFAULT_CONFIDENCE = 0.55


@dataclass(frozen=True)
class Budget:
    """evidence: distinct references of one request (0: no bound); collected: edges that compete for it."""

    evidence: int = 40
    paths: int = 20
    drivers: int = 10
    collected: int = 200


def hop_edges(edges: DataFrame, seeds: DataFrame, hops: int, folder: str) -> DataFrame:
    """(request, edge_id, hop) of the edges within so many hops of each request's seeds, at the least hop.

    ``edges``: edge_id, source_id, target_id; ``seeds``: request, node.  The frontier of a hop
    is stored before the next begins, so no hop is computed twice and what was visited is
    read, not derived.  A node is in a request's frontier once, however many edges lead to it.
    """
    spark = edges.sparkSession
    ends = edges.select("edge_id", F.col("source_id").alias("node"), F.col("target_id").alias("_next"))
    ends = ends.unionByName(edges.select("edge_id", F.col("target_id").alias("node"), F.col("source_id").alias("_next")))
    kind = "request string, node string"

    def stored(df: DataFrame, name: str, schema: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(schema).parquet(f"{folder}/{name}")

    frontier = stored(seeds.select(F.col("request").cast("string"), "node").distinct(), "frontier0", kind)
    seen, touched = [frontier], []
    for hop in range(1, hops + 1):
        met = stored(frontier.join(ends, "node").select("request", "edge_id", "_next"), f"met{hop}", "request string, edge_id string, _next string")
        touched.append(met.select("request", "edge_id", F.lit(hop).alias("hop")))
        if hop < hops:
            fresh = met.select("request", F.col("_next").alias("node")).distinct()
            for before in seen:
                fresh = fresh.join(before, ["request", "node"], "left_anti")
            frontier = stored(fresh, f"frontier{hop}", kind)
            seen.append(frontier)
    return reduce(DataFrame.unionByName, touched).groupBy("request", "edge_id").agg(F.min("hop").alias("hop"))


def beside_texts(edges: DataFrame, found: DataFrame) -> DataFrame:
    """(request, edge_id, hop 0) of the edges that touch nodes a text search has found: request, node."""
    parts = [edges.select("edge_id", F.col(end).alias("node")).join(found, "node") for end in ("source_id", "target_id")]
    return parts[0].unionByName(parts[1]).select(F.col("request").cast("string"), "edge_id", F.lit(0).alias("hop")).distinct()


def competing(edges: DataFrame, near: DataFrame, internal: Column, collected: int) -> DataFrame:
    """Each request's edges in order of confidence, then edge id: the first ``collected`` of them, self-loops and internal ends marked."""
    once = near.groupBy("request", "edge_id").agg(F.min("hop").alias("hop"))
    order = Window.partitionBy("request").orderBy(F.desc("confidence"), "edge_id")
    ranked = once.join(edges, "edge_id").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= collected)
    loop = F.col("source_id") == F.col("target_id")
    return ranked.withColumn("excluded", F.when(loop, "self_loop").when(internal, "internal").when(F.size("evidence") == 0, "no_evidence"))


def admitted(ranked: DataFrame, relations: tuple[str, ...], budget: Budget) -> DataFrame:
    """One row per request: admitted edge ids in order, their evidence, and what was dropped and why.

    The fold runs over the at most ``collected`` edges of a request.  An edge is admitted if the
    distinct references so far and its own stay within the budget; one of an unknown relation
    is counted and uses none of it; later edges that fit are still taken.
    """
    bound = budget.evidence if budget.evidence > 0 else 1 << 30
    item = F.struct("place", "edge_id", "relation", F.array_sort(F.array_distinct("evidence")).alias("evidence"), F.col("relation").isin(*relations).alias("known"), "excluded")
    listed = ranked.groupBy("request").agg(F.array_sort(F.collect_list(item)).alias("_edges"))
    start = F.struct(
        F.array().cast("array<string>").alias("evidence"), F.array().cast("array<string>").alias("kept"), F.array().cast("array<string>").alias("unknown"),
        F.lit(0).alias("n_unknown"), F.lit(0).alias("over"), F.lit(0).alias("loops"),
    )

    def step(s: Column, e: Column) -> Column:
        union = F.array_union(s["evidence"], e["evidence"])
        fits = F.size(union) <= bound
        free = e["excluded"].isNull()
        take = free & fits & e["known"]
        return F.struct(
            F.when(take, union).otherwise(s["evidence"]).alias("evidence"),
            F.when(take, F.concat(s["kept"], F.array(e["edge_id"]))).otherwise(s["kept"]).alias("kept"),
            F.when(free & fits & ~e["known"], F.array_union(s["unknown"], F.array(e["relation"]))).otherwise(s["unknown"]).alias("unknown"),
            (s["n_unknown"] + (free & fits & ~e["known"]).cast("int")).alias("n_unknown"),
            (s["over"] + (free & ~fits).cast("int")).alias("over"),
            (s["loops"] + F.coalesce(e["excluded"] == "self_loop", F.lit(False)).cast("int")).alias("loops"),
        )

    folded = listed.select("request", F.aggregate("_edges", start, step).alias("_s"))
    return folded.select(
        "request", F.slice("_s.kept", 1, budget.paths).alias("kept"), F.col("_s.kept").alias("accepted"), F.array_sort("_s.evidence").alias("evidence"),
        F.array_sort("_s.unknown").alias("unknown"), F.col("_s.n_unknown").alias("n_unknown"), F.col("_s.over").alias("over_budget"), F.col("_s.loops").alias("self_loops"),
        (F.col("_s.n_unknown") > 0).alias("partial"),
    )


def paths(admissions: DataFrame, edges: DataFrame, org: str) -> DataFrame:
    """Admitted edges as paths of two nodes: request, place, path_id, edge_id, relation, ends, evidence, validity."""
    each = admissions.select("request", F.posexplode("kept").alias("_at", "edge_id"))
    out = each.join(edges, "edge_id").withColumn("path_id", deterministic_uuid(F.lit("context-fabric-path"), F.lit(org), F.col("edge_id")))
    return out.select("request", (F.col("_at") + 1).alias("place"), "path_id", "edge_id", "relation", "source_id", "target_id", F.array_sort(F.array_distinct("evidence")).alias("evidence"))


def drivers(admissions: DataFrame, edges: DataFrame, org: str, most: int) -> DataFrame:
    """Accepted edges whose relation says something about a driver, the first ``most`` of a request."""
    each = admissions.select("request", F.posexplode("accepted").alias("_at", "edge_id")).join(edges.filter(F.col("relation").isin(*DRIVERS)), "edge_id")
    order = Window.partitionBy("request").orderBy("_at")  # a request's accepted edges, as many as compete at most
    ranked = each.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)
    of = lambda i: reduce(lambda c, n: c.when(F.col("relation") == n, F.lit(DRIVERS[n][i])), list(DRIVERS)[1:], F.when(F.col("relation") == list(DRIVERS)[0], F.lit(DRIVERS[list(DRIVERS)[0]][i])))
    title = F.concat(F.initcap(F.replace(F.lower("relation"), F.lit("_"), F.lit(" "))), F.lit(": "), F.col("target_id"))
    confidence = F.when(F.coalesce("confidence", F.lit(0.0)) == 0, DEFAULT_CONFIDENCE).otherwise(F.col("confidence"))
    return ranked.select(
        "request", "place", deterministic_uuid(F.lit("context-fabric-driver"), F.lit(org), F.col("edge_id")).alias("driver_id"), "edge_id", of(0).alias("standing"), of(1).alias("category"),
        of(2).alias("fact_kind"), title.alias("title"), F.col("source_id").alias("affected"), confidence.alias("confidence"), F.col("valid_to").isNull().alias("current"),
    )

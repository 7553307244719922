"""Incremental projection of change batches into the graph's tables, and atomic rebuilds.

Nodes lie in buckets of their id.  An edge lies twice, in the bucket of either end, so what
touches a node is in the node's own bucket.  A batch writes new folders for the buckets it
touches and then one pointer that says which folder serves each bucket; all other buckets
keep their files.  A reader sees one pointer or the next, a failed batch leaves unused
folders under names that are never used again, and a repeated batch is skipped.

A batch is applied in rounds, each over some of the buckets and with no more rows than a round
may shuffle, so beside the old and the new state the disk holds the shuffle of one round.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.changes import CHANGE
from .files import Folder, Pointers, cleaned, dense

NODE = "kind string, node_id string, label string, valid_from timestamp_ntz, valid_to timestamp_ntz, observed_at timestamp_ntz"
EDGE = "node_id string, source_id string, target_id string, relation string, valid_from timestamp_ntz, valid_to timestamp_ntz, observed_at timestamp_ntz"
#: An edge as it is stored: at its source (out) and at its target (in).
STORED = {"nodes": NODE, "edges": f"{EDGE}, role string"}
NODE_OPS, EDGE_OPS = ("node", "node_tombstone", "orphan_tombstone"), ("edge", "edge_tombstone")
#: Rows that a round of a batch shuffles at most, unless one bucket alone holds more.
ROUND_ROWS = 32_000_000


@dataclass
class Pointer:
    """Which folder serves each bucket, and the last batch in it."""

    nodes: dict[str, str] = field(default_factory=dict)
    edges: dict[str, str] = field(default_factory=dict)
    batch: int = -1
    epoch: int = 0
    number: int = -1
    previous: int = -1


def _columns(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


class GraphStore:
    """The graph of one organization under a folder that Spark can write.

    ``buckets`` is set when the store is made; a batch costs what its buckets hold, so more
    buckets suit larger graphs and smaller batches.  An edge's id decides its ends, so what
    removes an edge names its ends too.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64, round_rows: int = ROUND_ROWS) -> None:
        self.spark, self.root, self.buckets, self.round_rows = spark, root.rstrip("/"), buckets, round_rows
        self._points, self._folder = Pointers(spark, f"{self.root}/pointers"), Folder(spark, self.root)

    def pointer(self) -> Pointer:
        found = self._points.last()
        return replace(Pointer(**json.loads(found[1])), number=found[0]) if found else Pointer()

    def _move(self, pointer: Pointer, now: Pointer) -> None:
        self._points.put(json.dumps(asdict(pointer)), now.number + 1)

    def bucket(self, node: Column) -> Column:
        return F.pmod(F.xxhash64(node), F.lit(self.buckets)).cast("int")

    def _read(self, table: str, pointer: Pointer, only: set[int] | None = None) -> DataFrame:
        """The stored rows of a table, of some buckets only if asked."""
        served = getattr(pointer, table)
        paths = [f"{self.root}/{table}/{at}/bucket={b}" for b, at in served.items() if only is None or int(b) in only]
        return self.spark.read.schema(STORED[table]).parquet(*paths) if paths else self.spark.createDataFrame([], STORED[table])

    def read(self, table: str, pointer: Pointer | None = None) -> DataFrame:
        rows = self._read(table, pointer or self.pointer())
        return rows if table == "nodes" else rows.filter("role = 'out'").drop("role")

    def around(self, nodes: list[str]) -> DataFrame:
        """Edges that touch the nodes, read from the nodes' buckets only."""
        asked = self.spark.createDataFrame([(n,) for n in nodes], "_node string")
        only = {r[0] for r in asked.select(self.bucket(F.col("_node"))).distinct().collect()}
        rows = self._read("edges", self.pointer(), only)
        own = F.when(F.col("role") == "out", F.col("source_id")).otherwise(F.col("target_id"))
        return rows.join(F.broadcast(asked), own == F.col("_node"), "left_semi").drop("role").distinct()

    def _buckets_of(self, *ids: DataFrame) -> set[int]:
        """The buckets of some ids, at most as many as the store has."""
        found: set[int] = set()
        for df in ids:
            found |= {r[0] for r in df.select(self.bucket(F.col(df.columns[0])).alias("b")).distinct().collect()}
        return found

    def _write(self, rounds: Iterable[DataFrame], table: str, touched: set[int], served: dict[str, str]) -> dict[str, str]:
        """Store the touched buckets anew, round by round; a bucket without rows is no longer served."""
        fresh = Pointers.fresh()
        for df in rounds:
            df.write.mode("append").options(**dense("node_id", "source_id", "target_id")).partitionBy("bucket").parquet(f"{self.root}/{table}/{fresh}")
        written = {n.split("=")[1] for n in self._folder.names(f"{table}/{fresh}") if n.startswith("bucket=")}
        kept = {b: at for b, at in served.items() if int(b) not in touched}
        return kept | {b: fresh for b in written}

    def _rounds(self, touched: set[int], rows: int) -> list[set[int]]:
        """The buckets in as many groups as the rows need."""
        count = max(1, min(len(touched), -(-rows // self.round_rows)))
        return [set(sorted(touched)[i::count]) for i in range(count)]

    def _among(self, node: Column, buckets: set[int]) -> Column:
        return F.lit(True) if len(buckets) == self.buckets else self.bucket(node).isin(sorted(buckets))

    def _placed(self, changes: DataFrame) -> Counter:
        """How many changes each op has, by the bucket of its node or source and that of its target: few rows."""
        edge = F.col("op").isin(*EDGE_OPS)
        first, second = self.bucket(F.when(edge, F.col("source_id")).otherwise(F.col("node_id"))), F.when(edge, self.bucket(F.col("target_id")))
        rows = changes.filter(F.col("op").isin(*NODE_OPS, *EDGE_OPS) & F.col("node_id").isNotNull()).groupBy("op", first.alias("a"), second.alias("b")).count().collect()
        return Counter({(r.op, r.a, r.b): r["count"] for r in rows})

    @staticmethod
    def _decided(state: DataFrame, batch: DataFrame, removed: DataFrame, tie: str) -> DataFrame:
        """The row that counts of each id, the batch's last before the stored one, and whether a tombstone has removed it.

        A row is removed unless it was observed after its tombstone took effect.  Ids meet in one
        shuffle, and their rows are read in order, none held.
        """
        parts = [(removed.withColumnRenamed("observed_at", "_effective"), 0), (batch, 1), (state, 2)]
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("_rank", F.lit(rank)) for df, rank in parts])
        by = Window.partitionBy("node_id").orderBy("_rank", F.desc_nulls_last("_effective"), F.desc_nulls_last("observed_at"), tie).rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumns({"_nth": F.sum(F.least("_rank", F.lit(1))).over(by), "_effective": F.first("_effective").over(by)}).filter("_rank > 0 AND _nth = 1")
        spared = F.col("_effective").isNull() | F.coalesce(F.col("observed_at") > F.col("_effective"), F.lit(False))
        return rows.select(*state.columns, (~spared).alias("_dead"))

    def _applied(self, changes: DataFrame, now: Pointer, settled: bool = False) -> Pointer:
        """The state after the changes, written but not served: edges first, then nodes, then tombstones."""
        work = f"{self.root}/work-{Pointers.fresh()}"
        changes = changes.select(*_columns(CHANGE))
        if not settled:  # one reading of a source that may not repeat itself
            changes.write.parquet(work)
            changes = self.spark.read.schema(CHANGE).parquet(work)
        of = lambda op: changes.filter((F.col("op") == op) & F.col("node_id").isNotNull())
        placed = self._placed(changes)
        ops = {op for op, _, _ in placed}

        touched = {a for op, a, _ in placed if op in NODE_OPS}
        node_rows = of("node").select(*_columns(NODE))
        dead_nodes = of("node_tombstone").select("node_id", "observed_at")
        gone = self.spark.createDataFrame([], "node_id string")
        if "node_tombstone" in ops:
            # what a tombstone names and did not survive it is gone, with its edges; only what is named is looked at
            named = [df.select("node_id", "observed_at").join(dead_nodes.select("node_id"), "node_id", "left_semi") for df in (self._read("nodes", now, touched), node_rows)]
            self._decided(*named, dead_nodes, "node_id").filter("_dead").select("node_id").write.parquet(f"{work}-gone")
            gone = self.spark.read.schema("node_id string").parquet(f"{work}-gone")

        near = {b for op, *ends in placed if op in EDGE_OPS for b in ends} | self._buckets_of(gone)
        if "node_tombstone" in ops and not near >= {int(b) for b in now.edges}:
            falling = self._read("edges", now, self._buckets_of(gone))
            far = [falling.join(gone.select(F.col("node_id").alias(a)), a, "left_semi").select(b) for a, b in (("source_id", "target_id"), ("target_id", "source_id"))]
            near |= self._buckets_of(*far)
        new_edges = self._write(self._edges(of, now, near, gone if "node_tombstone" in ops else None, placed), "edges", near, now.edges)
        new_nodes = self._write(self._nodes(of, now, replace(now, edges=new_edges), touched, placed), "nodes", touched, now.nodes)
        for name in (work, f"{work}-gone"):
            self._folder.delete(name.removeprefix(f"{self.root}/"))
        return replace(now, nodes=new_nodes, edges=new_edges)

    def _edges(self, of, now: Pointer, near: set[int], gone: DataFrame | None, placed: Counter) -> Iterable[DataFrame]:
        """The edges of the near buckets, some sources' buckets a round: each is read and decided once, then put at both its ends."""
        if not near:
            return
        count = sum(n for (op, *_), n in placed.items() if op in EDGE_OPS) + self._read("edges", now, near).count() // 2
        named = _columns(EDGE)
        for nth, here in enumerate(self._rounds(near, count)):
            mine = self._among(F.col("source_id"), here)
            state = self._read("edges", now, here).filter("role = 'out'").select(*named)
            if not nth and len(near) < self.buckets:  # an edge whose source lies in no near bucket is read at its target
                state = state.unionByName(self._read("edges", now, near).filter((F.col("role") == "in") & ~self._among(F.col("source_id"), near)).select(*named))
            removed = of("edge_tombstone").filter(mine).select("node_id", "observed_at")
            edges = self._decided(state, of("edge").filter(mine).select(*named), removed, "target_id").filter("NOT _dead").drop("_dead")
            for end in ("source_id", "target_id") if gone is not None else ():
                edges = edges.join(gone.select(F.col("node_id").alias(end)), end, "left_anti")
            ends = F.explode(F.array(*[F.struct(F.lit(role).alias("role"), self.bucket(F.col(end)).alias("bucket")) for role, end in (("out", "source_id"), ("in", "target_id"))]))
            edges = edges.select(*named, ends.alias("_e")).select(*named, "_e.*")
            # a copy whose bucket is not near belongs to an edge that did not change
            yield edges if len(near) == self.buckets else edges.filter(F.col("bucket").isin(sorted(near)))

    def _nodes(self, of, now: Pointer, beside: Pointer, touched: set[int], placed: Counter) -> Iterable[DataFrame]:
        """The nodes of the touched buckets; ``beside`` serves the new edges, which keep orphans alive."""
        if not touched:
            return
        ops, named = {op for op, _, _ in placed}, _columns(NODE)
        count = sum(n for (op, *_), n in placed.items() if op in NODE_OPS) + self._read("nodes", now, touched).count()
        for here in self._rounds(touched, count):
            mine = self._among(F.col("node_id"), here)
            nodes = self._read("nodes", now, here)
            if ops & {"node", "node_tombstone"}:
                removed = of("node_tombstone").filter(mine).select("node_id", "observed_at")
                nodes = self._decided(nodes, of("node").filter(mine).select(*named), removed, "label").filter("NOT _dead").drop("_dead")
            if "orphan_tombstone" in ops:
                heal = of("orphan_tombstone").filter(mine).groupBy("node_id").agg(F.max("observed_at").alias("_effective"))
                own = F.when(F.col("role") == "out", F.col("source_id")).otherwise(F.col("target_id"))
                held = self._read("edges", beside, here).select(own.alias("node_id")).distinct().withColumn("_held", F.lit(True))
                due = F.col("_effective").isNotNull() & (F.col("observed_at").isNull() | (F.col("observed_at") <= F.col("_effective")))
                nodes = nodes.join(heal, "node_id", "left").join(held, "node_id", "left").filter(~due | F.col("_held").isNotNull())
            yield nodes.select(*named, self.bucket(F.col("node_id")).alias("bucket"))

    def apply(self, changes: DataFrame, batch: int, settled: bool = False) -> bool:
        """Apply a batch; false if it was applied before.

        A removed node takes its edges with it.  A stub goes only if no edge touches it and it
        was observed no later than its tombstone takes effect.  ``settled`` changes give the same
        rows whenever they are read, so they are not copied first.
        """
        now = self.pointer()
        if batch <= now.batch:
            return False
        with cleaned(self.spark):
            made = self._applied(changes, now, settled)
        self._move(replace(made, batch=batch, previous=now.number), now)
        return True

    def rebuild(self, changes: DataFrame) -> int:
        """A new epoch from a full set of changes, served only once it is complete."""
        now = self.pointer()
        with cleaned(self.spark):
            made = self._applied(changes, Pointer())
        self._move(replace(made, batch=now.batch, epoch=now.epoch + 1, previous=now.number), now)
        return now.epoch + 1

    def _at(self, number: int) -> Pointer | None:
        name = f"{number:012d}.json"
        if number < 0 or name not in self._points.names():
            return None
        return Pointer(**json.loads(self.spark.read.text(f"{self.root}/pointers/{name}", wholetext=True).collect()[0][0]))

    def rollback(self) -> None:
        """Serve the state before, while it is still there; the batch taken back can be applied again."""
        now = self.pointer()
        before = self._at(now.previous)
        if before is None:
            raise ValueError("there is no earlier state")
        self._move(replace(before, previous=-1), now)

    def retire(self) -> list[str]:
        """Delete bucket folders that neither the pointer nor the one before serves, and what crashes have left."""
        now = self.pointer()
        served, gone = [p for p in (now, self._at(now.previous)) if p], []
        for table in ("nodes", "edges"):
            used = {(at, b) for p in served for b, at in getattr(p, table).items()}
            for at in self._folder.names(table):
                for name in self._folder.names(f"{table}/{at}"):
                    if name.startswith("bucket=") and (at, name.split("=")[1]) not in used:
                        self._folder.delete(f"{table}/{at}/{name}")
                        gone.append(f"{table}/{at}/{name}")
                if at not in {x for x, _ in used}:
                    self._folder.delete(f"{table}/{at}")
        for name in self._folder.names():
            if name.startswith("work-"):
                self._folder.delete(name)
        return gone

    def purge(self) -> None:
        """Forget the organization: nothing is served from now on, then all files go."""
        now = self.pointer()
        self._move(Pointer(epoch=now.epoch + 1), now)
        for table in ("nodes", "edges"):
            self._folder.delete(table)
        self.retire()


def project_stream(changes: DataFrame, store: GraphStore, checkpoint: str, available_now: bool = True):
    """Apply a stream of changes batch by batch; the checkpoint and the pointer agree on what is done."""
    writer = changes.writeStream.foreachBatch(lambda df, batch: store.apply(df, batch)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def insert_if_absent(state: DataFrame, rows: DataFrame, keys: list[str], payload: str) -> tuple[DataFrame, DataFrame]:
    """New keys to append, and keys whose payload differs from what is stored: a conflict, not a replay."""
    new = rows.join(state.select(*keys), keys, "left_anti")
    stored = state.select(*keys, F.sha2(payload, 256).alias("_stored"))
    conflicts = rows.join(stored, keys).filter(F.sha2(payload, 256) != F.col("_stored")).select(*keys)
    return new, conflicts


def purge_expired(state: DataFrame, expires: str, now) -> DataFrame:
    """What is left after retention; rows without expiry stay."""
    return state.filter(F.col(expires).isNull() | (F.col(expires) > now))

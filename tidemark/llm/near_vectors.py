"""Near-duplicate vectors by sorted projection passes."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .workspace import Workspace

BITS = 64
BLOCK_ROWS = 1024
PARTITION_ROWS = 50_000
SALT = 16


@dataclass(frozen=True)
class Passes:
    """window: how many following vectors each is compared with in one order.

    miss: how likely a pair at the least similarity may be missed by one round of passes,
    if directions are spread evenly.
    """

    least_cosine: float = 0.93
    window: int = 64
    miss: float = 1e-4
    seed: int = 5

    def count(self, largest: int) -> int:
        """Passes of one round for a group of so many vectors.

        Two vectors at an angle a agree in a random sign with chance 1 - a / pi.  In
        the order by 64 such signs they are neighbours if they agree in the first
        log2(largest / window) of them, so more vectors take more passes.  Where
        directions crowd, more signs have to agree; ``near_vectors`` repeats rounds.
        """
        prefix = max(0.0, math.log2(max(1, largest) / self.window)) + 1
        met = (1 - math.acos(self.least_cosine) / math.pi) ** prefix
        return max(4, math.ceil(math.log(self.miss) / math.log(1 - met)))


def usable(vector: Column) -> Column:
    """No null, no component null or not finite, not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def signs(vectors: np.ndarray, turn: int, seed: int) -> np.ndarray:
    """64 random-hyperplane signs of each vector, the first one highest."""
    planes = np.random.default_rng([seed, turn, vectors.shape[1]]).standard_normal((vectors.shape[1], BITS))
    return np.packbits(vectors @ planes > 0, axis=1).view(">u8").ravel().astype(np.uint64)


def matrix(column: pa.Array) -> np.ndarray:
    """Unit vectors in double precision of lists of one length."""
    raw = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    scaled = raw / np.abs(raw).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled**2).sum(axis=1, keepdims=True))


def _codes(batch: pa.RecordBatch, turns: range, seed: int) -> Iterator[pa.RecordBatch]:
    size = batch.column("size").to_numpy()
    for n in np.unique(size):
        part = batch.filter(pa.array(size == n))
        units = matrix(part.column("vector"))
        for turn in turns:
            code = (signs(units, turn, seed) ^ np.uint64(1 << 63)).view(np.int64)  # signed order is the bits' order
            fixed = [pa.array(np.full(len(part), turn, np.int32)), part.column("label"), part.column("size"), pa.array(code)]
            yield pa.RecordBatch.from_arrays([*fixed, part.column("id"), part.column("vector")], names=["turn", "label", "size", "code", "id", "vector"])


def spanning(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Positions of edges that connect what the edges before them left apart."""
    known, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent, kept = list(range(len(known))), []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, (x, y) in enumerate(zip(place[: len(a)].tolist(), place[len(a) :].tolist(), strict=True)):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append(i)
    return np.array(kept, np.int64)


def _neighbours(run: pa.Table, window: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Verified pairs within the window of vectors in one order."""
    units, ids = matrix(run.column("vector").combine_chunks()), run.column("id").to_numpy()
    left, right = [], []
    for step in range(1, min(window, len(ids) - 1) + 1):
        near = np.flatnonzero(np.einsum("ij,ij->i", units[:-step], units[step:]) >= least)
        left.append(near)
        right.append(near + step)
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
    kept = spanning(ids[a], ids[b])
    return ids[a[kept]], ids[b[kept]]


KEYS = ["turn", "label", "size", "code", "id"]


def _compared(table: pa.Table, window: int, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    group = np.stack([table.column(c).to_numpy() for c in ("turn", "label", "size")], axis=1)
    edges = np.flatnonzero((group[1:] != group[:-1]).any(axis=1)) + 1
    for start, end in zip([0, *edges], [*edges, len(table)], strict=True):
        if end - start > 1:
            yield _neighbours(table.slice(start, end - start), window, least)


def _sorted_runs(batches: Iterator[pa.RecordBatch], window: int, least: float) -> Iterator[pa.RecordBatch]:
    """Compare along a partition's order, batch by batch, carrying the last ``window`` rows over.

    The first and the last ``window`` rows come out as well, by the boundary between two
    partitions that they lie at.
    """
    part = TaskContext.get().partitionId()
    tail: pa.Table | None = None
    head: pa.Table | None = None

    def border(rows: pa.Table, at: int) -> list[pa.RecordBatch]:
        rows, none = rows.combine_chunks(), pa.nulls(len(rows), pa.int64())
        columns = [none, none, pa.array(np.full(len(rows), at, np.int32)), *(rows.column(c).combine_chunks() for c in (*KEYS, "vector"))]
        return [pa.RecordBatch.from_arrays(columns, names=["a", "b", "border", *KEYS, "vector"])] if len(rows) else []

    for batch in batches:
        table = pa.Table.from_batches([batch])
        if head is None or len(head) < window:
            head = table.slice(0, window) if head is None else pa.concat_tables([head, table.slice(0, window - len(head))])
        table = pa.concat_tables([tail, table]) if tail is not None else table
        for a, b in _compared(table, window, least):
            rest = [pa.nulls(len(a), batch.schema.field(c).type) for c in (*KEYS, "vector")]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.nulls(len(a), pa.int32()), *rest], names=["a", "b", "border", *KEYS, "vector"])
        tail = table.slice(max(0, len(table) - window))
    if head is not None and tail is not None:
        yield from border(head, part - 1)
        yield from border(tail, part)


def _border_runs(batches: Iterator[pa.RecordBatch], window: int, least: float) -> Iterator[pa.RecordBatch]:
    """Compare the rows at the boundaries of partitions, in the same order."""
    tail: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([tail, table]) if tail is not None else table
        for a, b in _compared(table, window, least):
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        tail = table.slice(max(0, len(table) - window))


def _block_links(frame: pd.DataFrame, least: float) -> pd.DataFrame:
    """For each row, how many vectors of the other block are near: counts, not pairs."""
    out = []
    for (_, left, right), cell in frame.groupby(["group", "left", "right"], sort=False):
        a, b = cell[cell.block == left], cell[cell.block == right]
        if not len(a) or not len(b):
            continue
        x, y = (matrix(pa.array(t.vector.tolist(), pa.list_(pa.float64()))) for t in (a, b))
        near = x @ y.T >= least
        out.append(pd.DataFrame({"id": a.id.to_numpy(), "near": near @ b.copies.to_numpy()}))
        if left != right:
            out.append(pd.DataFrame({"id": b.id.to_numpy(), "near": near.T @ a.copies.to_numpy()}))
    found = pd.concat(out) if out else pd.DataFrame({"id": np.zeros(0, np.int64), "near": np.zeros(0, np.int64)})
    return found.groupby("id", as_index=False).near.sum()


def placed_ids(classes: DataFrame, found: DataFrame) -> DataFrame:
    """Classes with the number of their component, a lone class with its own."""
    return classes.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))


def near_vectors(vectors: DataFrame, passes: Passes = Passes(), key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    Equal vectors of a label form a class.  In each pass the classes are ordered by
    label and by 64 random signs; neighbours in a window are verified in double
    precision, and the verified pairs of all passes are united to components.  Rounds of
    passes in other directions follow until a whole one joins no components.  Links
    are then counted exactly within each component, large ones in blocks.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows
    without label or vec_id, link with nothing (n_links 0, their own component; without
    vec_id a null one).  Vectors of different lengths do not link.  Rows that repeat a
    vec_id are vectors of their own, of which each has its links and its component; they
    bridge neither labels nor components.  Other columns are ignored; an empty table gives an empty
    result.
    """
    spark = vectors.sparkSession
    space = Workspace(spark, "near")
    rows = vectors.select(vectors[key].cast("long").alias("vec_id"), vectors[vector].cast("array<double>").alias("vector"), vectors[label].cast("long").alias("label"))
    good = rows.filter(usable(F.col("vector")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    # a class has a number of its own: rows of one vec_id may lie in several classes, and under several labels
    classes = good.groupBy("label", "vector").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    classes = space.write(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    classes = classes.withColumn("size", F.size("vector"))
    sizes = classes.groupBy("label", "size").count().agg(F.max("count"), F.sum("count")).collect()[0]
    turns, total = passes.count(sizes[0] or 0), sizes[1] or 0

    coded = classes.select("label", "size", "id", F.col("vector").cast("array<float>").alias("vector") if dict(vectors.dtypes)[vector] == "array<float>" else "vector")
    stored = dict(coded.dtypes)["vector"]
    fields = f"turn int, label long, size int, code long, id long, vector {stored}"
    parts = max(turns, -(-total * turns // PARTITION_ROWS))

    def pairs(nth: int) -> DataFrame:
        """Verified pairs of a round's passes."""

        def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from _codes(batch, range(nth * turns, (nth + 1) * turns), passes.seed)

        ordered = coded.mapInArrow(codes, fields).repartitionByRange(parts, *KEYS).sortWithinPartitions(*KEYS)
        runs = space.write(ordered.mapInArrow(lambda b: _sorted_runs(b, passes.window, passes.least_cosine), f"a long, b long, border int, {fields}"), f"runs{nth}")
        borders = runs.filter("border IS NOT NULL").select("border", *KEYS, "vector").repartition("border").sortWithinPartitions("border", *KEYS).drop("border")
        over = borders.mapInArrow(lambda b: _border_runs(b, passes.window, passes.least_cosine), "a long, b long")
        links = space.write(runs.filter("a IS NOT NULL").select("a", "b").unionByName(over).distinct(), f"links{nth}")
        space.drop(f"runs{nth}")
        return links

    found, nth = connected_components(pairs(0), "a", "b", space, "part0_"), 0
    while True:
        nth += 1
        ends = pairs(nth)
        for end in ("a", "b"):
            at = found.select(F.col("id").alias(end), F.col("component").alias("_at"))
            ends = ends.join(at, end, "left").withColumn(end, F.coalesce("_at", end)).drop("_at")
        fresh = space.write(ends.filter("a <> b").distinct(), f"fresh{nth}")
        if fresh.isEmpty():
            break
        edges = found.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(fresh)
        found = connected_components(edges, "a", "b", space, f"part{nth}_")

    heads = found.select("component").distinct().select(F.col("component").alias("id"), "component")
    placed = classes.join(found.unionByName(heads), "id").select(F.struct("component", "label", "size").alias("group"), "id", "vector", "copies")
    counts = placed.groupBy("group").count().withColumn("blocks", F.ceil(F.col("count") / BLOCK_ROWS).cast("int"))
    spread = placed.join(counts, "group").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    spread = spread.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        F.xxhash64("group").alias("group"), "id", "vector", "copies", "block", F.least("block", "_other").alias("left"), F.greatest("block", "_other").alias("right"),
    )
    tasks = max(12, int(spark.conf.get("spark.sql.shuffle.partitions"))) * 4
    spread = spread.withColumn("task", F.pmod(F.xxhash64("group", "left", "right"), F.lit(tasks)))
    near = spread.groupBy("task").applyInPandas(lambda p: _block_links(p, passes.least_cosine), "id long, near long")
    near = space.write(near.groupBy("id").agg(F.sum("near").alias("near")), "near")

    # minima are combined before they are shuffled and come back in copies, so that a large component is split
    least = placed_ids(classes, found).groupBy("component").agg(F.min("least").alias("component_id")).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    salted = placed_ids(classes, found).withColumn("_salt", F.pmod(F.col("id"), F.lit(SALT)).cast("int"))
    named = salted.join(least, ["component", "_salt"]).join(near, "id", "left")
    named = named.select(F.col("label").alias("_label"), F.col("vector").alias("_vector"), "copies", "near", "component_id")
    linked = good.join(named, (good["label"] == named["_label"]) & (good["vector"] == named["_vector"]))
    # a class counts itself with all its copies among its near ones
    n_links = F.coalesce(F.col("near"), F.col("copies")) - 1
    linked = linked.select("vec_id", n_links.alias("n_links"), "component_id")
    alone = rows.filter(~(usable(F.col("vector")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()))
    out = linked.unionByName(alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))

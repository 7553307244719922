"""Product-quantized vector codes in whole numbers, refined by a heap form of Lloyd's rounds.

A stored row is a chunk of vectors with, per part position and codebook entry, a heap of
the vectors assigned to it.  A heap's key is the slack of a vector's part (distance to the
second nearest entry less that to its own) plus the entry's cumulative drift when it was
put there.  While the least key exceeds the drift reached since, no part of the heap can
have changed its entry; only parts at or below it are popped and compared again.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from functools import partial
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blobs import squeeze, unsqueeze
from .workspace import Workspace

#: Whole components beyond this are held at it; an error beyond a long is null.
LARGEST = 1 << 60
LONG = (1 << 63) - 1
CHUNK_COMPONENTS = 1 << 20
SALT = 16


@dataclass(frozen=True)
class Codes:
    """scale: components become floor(scale * x); codes take one byte, so at most 256 entries."""

    parts: int = 16
    entries: int = 64
    rounds: int = 2
    scale: int = 256


def usable(vector: Column) -> Column:
    """Not null, and no component null or not finite."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def whole(vectors: list[np.ndarray], width: int, scale: int) -> np.ndarray:
    """floor(scale * x) of each component, shorter vectors filled up with zeros."""
    out = np.zeros((len(vectors), width))
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v
    with np.errstate(over="ignore"):
        return np.clip(np.floor(out * scale), -LARGEST, LARGEST).astype(np.int64)


def squares(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances, points x entries: whole numbers in doubles while they stay below 2**53."""
    reach = max((int(np.abs(x).max()) for x in (points, entries) if x.size), default=0)
    wide = 4 * reach * reach * max(1, points.shape[1])
    if wide < 1 << 53:
        a, b = points.astype(np.float64), entries.astype(np.float64)
        return (a**2).sum(1)[:, None] - 2 * (a @ b.T) + (b**2).sum(1)
    kind = np.int64 if wide < 1 << 62 else object
    diff = points.astype(kind)[:, None, :] - entries.astype(kind)[None, :, :]
    return (diff**2).sum(2) if points.shape[1] else np.zeros(diff.shape[:2], np.int64)


def nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each point, ties to the lower index, and the slack to the second nearest."""
    d = squares(points, entries)
    own = d.argmin(1)
    if d.shape[1] == 1:
        return own, np.full(len(d), np.inf)
    two = np.sort(d, axis=1)[:, :2].astype(np.float64)
    far, near = np.sqrt(two[:, 1]), np.sqrt(two[:, 0])
    # a little less than the slack, so that rounding never hides a change
    return own, far - near - 1e-9 * (1 + far)


class Heaps:
    """Per entry of one part position: (key, vector) pairs in heap order, as two arrays with cuts."""

    def __init__(self, keys: np.ndarray, members: np.ndarray, cuts: np.ndarray) -> None:
        self.keys, self.members, self.cuts = keys, members, cuts

    @classmethod
    def built(cls, own: np.ndarray, slack: np.ndarray, entries: int) -> Heaps:
        """Ascending keys are in heap order."""
        order = np.lexsort((slack, own))
        cuts = np.searchsorted(own[order], np.arange(entries + 1))
        return cls(slack[order], order.astype(np.int32), cuts.astype(np.int64))

    def popped(self, drift: np.ndarray) -> tuple[dict[int, list[tuple[float, int]]], list[int]]:
        """Take off every heap what its drift has reached: the heaps that changed, and the vectors taken."""
        changed, taken = {}, []
        for e, (a, b) in enumerate(pairwise(self.cuts)):
            if a == b or self.keys[a] > drift[e]:
                continue
            heap = self.heap(e)
            while heap and heap[0][0] <= drift[e]:
                taken.append(heapq.heappop(heap)[1])
            changed[e] = heap
        return changed, taken

    def heap(self, e: int) -> list[tuple[float, int]]:
        a, b = self.cuts[e], self.cuts[e + 1]
        return list(zip(self.keys[a:b].tolist(), self.members[a:b].tolist(), strict=True))

    def moved(self, points: np.ndarray, codes: np.ndarray, entries: np.ndarray, drift: np.ndarray) -> tuple[Heaps, np.ndarray, np.ndarray]:
        """Rescan what the drift has reached: new heaps, the vectors whose entry changed, their entries before."""
        changed, taken = self.popped(drift)
        if not taken:
            return self, np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.array(taken, np.int64)
        own, slack = nearest(points[at], entries)
        before = codes[at].astype(np.int64)
        for e, key, member in zip(own.tolist(), (slack + drift[own]).tolist(), taken, strict=True):
            if e not in changed:
                changed[e] = self.heap(e)
            heapq.heappush(changed[e], (key, member))
        codes[at] = own
        keys, members = [], []
        for e, (a, b) in enumerate(pairwise(self.cuts)):
            heap = changed.get(e)
            keys.append(self.keys[a:b] if heap is None else np.array([k for k, _ in heap], np.float64))
            members.append(self.members[a:b] if heap is None else np.array([m for _, m in heap], np.int32))
        cuts = np.cumsum([0, *map(len, keys)]).astype(np.int64)
        other = own != before
        return Heaps(np.concatenate(keys), np.concatenate(members), cuts), at[other], before[other]


#: A row of a round's table is a chunk or a change of the sums; the other's columns are null.
CHUNK = "ids array<long>, labels array<long>, vectors binary, codes binary, keys binary, members binary, cuts binary"
DELTAS = "part int, entry int, place int, total decimal(38,0), n long"
ARROW = pa.schema([("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.int64()))] + [(c, pa.binary()) for c in ("vectors", "codes", "keys", "members", "cuts")])
ROUND = pa.schema([*ARROW, *[pa.field(c, t) for c, t in (("part", pa.int32()), ("entry", pa.int32()), ("place", pa.int32()), ("total", pa.decimal128(38)), ("n", pa.int64()))]])


@dataclass
class Chunk:
    ids: pa.Array
    labels: pa.Array
    vectors: np.ndarray
    codes: np.ndarray
    heaps: list[Heaps]

    @classmethod
    def load(cls, batch: pa.RecordBatch, at: int, settings: Codes) -> Chunk:
        blob = lambda c: batch.column(c)[at].as_py()
        ids = batch.column("ids")[at].values
        vectors = unsqueeze(blob("vectors")).reshape(len(ids), -1)
        codes = np.frombuffer(blob("codes"), np.uint8).reshape(settings.parts, len(ids)).copy()
        keys, members, cuts = (np.frombuffer(blob(c), t) for c, t in (("keys", np.float64), ("members", np.int32), ("cuts", np.int64)))
        n = len(ids)  # every vector has a part in one heap of each position
        heaps = [Heaps(keys[p * n : (p + 1) * n], members[p * n : (p + 1) * n], c) for p, c in enumerate(cuts.reshape(settings.parts, -1))]
        return cls(ids, batch.column("labels")[at].values, vectors, codes, heaps)

    def batch(self) -> pa.RecordBatch:
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        joined = [np.concatenate([getattr(h, c) for h in self.heaps]).tobytes() for c in ("keys", "members", "cuts")]
        blobs = [pa.array([b], pa.binary()) for b in (squeeze(self.vectors.ravel()), self.codes.tobytes(), *joined)]
        columns = [one(self.ids), one(self.labels), *blobs]
        return pa.RecordBatch.from_arrays([*columns, *(pa.nulls(1, f.type) for f in list(ROUND)[len(ARROW) :])], schema=ROUND)

    def part(self, p: int) -> np.ndarray:
        width = self.vectors.shape[1] // len(self.codes)
        return self.vectors[:, p * width : (p + 1) * width]


def _sums(points: np.ndarray, own: np.ndarray, entries: int) -> tuple[np.ndarray, np.ndarray]:
    """Per entry: exact component sums and the number of points."""
    n = np.bincount(own, minlength=entries)
    if points.size and int(np.abs(points).max()) * len(points) >= 1 << 53:  # doubles would round
        total = np.zeros((entries, points.shape[1]), object)
        np.add.at(total, own, points.astype(object))
        return total, n
    total = [np.bincount(own, weights=column, minlength=entries) for column in points.T]
    return np.stack(total, axis=1).astype(np.int64) if total else np.zeros((entries, 0), np.int64), n


def _deltas(part: int, total: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Rows of what changed; place -1 carries the count, so that vectors without components count too."""
    rows = [(part, e, -1, Decimal(0), int(n[e])) for e in np.flatnonzero(n).tolist()]
    rows += [(part, e, j, Decimal(int(total[e, j])), 0) for e, j in zip(*(x.tolist() for x in np.nonzero(total)), strict=True)]
    columns = list(zip(*rows, strict=True)) or [[]] * 5
    made = [pa.array(c, f.type) for c, f in zip(columns, list(ROUND)[len(ARROW) :], strict=True)]
    return pa.RecordBatch.from_arrays([*(pa.nulls(len(rows), f.type) for f in ARROW), *made], schema=ROUND)


class Refinement:
    """The codebooks, their cumulative drift and the sums behind them: entries x components, whatever the table's size."""

    def __init__(self, first: np.ndarray, parts: int) -> None:
        width = first.shape[1] // parts
        self.books = [first[:, p * width : (p + 1) * width] for p in range(parts)]
        self.drift = [np.zeros(len(first)) for _ in range(parts)]
        self.total = [np.zeros(b.shape, object) for b in self.books]
        self.n = [np.zeros(len(first), object) for _ in self.books]

    def take(self, rows: list) -> None:
        for r in rows:
            if r.place < 0:
                self.n[r.part][r.entry] += int(r.n)
            else:
                self.total[r.part][r.entry, r.place] += int(r.total)

    def step(self) -> None:
        """New entries, and how far each heap's keys are from them: an entry's own drift and the largest of the others'."""
        for p, book in enumerate(self.books):
            fresh = book.copy()
            for e in range(len(book)):
                if self.n[p][e]:
                    fresh[e] = [int(t) // int(self.n[p][e]) for t in self.total[p][e]]
            gone = np.sqrt(((fresh.astype(object) - book.astype(object)) ** 2).sum(1).astype(np.float64)) if book.shape[1] else np.zeros(len(book))
            others = np.array([max(np.delete(gone, e), default=0.0) for e in range(len(book))])
            self.drift[p] = (self.drift[p] + gone + others) * (1 + 1e-12)
            self.books[p] = fresh

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(int(x)) for b in self.books for x in b.ravel()).encode()).hexdigest()


def _first_round(batches: Iterator[pa.RecordBatch], width: int, settings: Codes, books: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Cut chunks, compare every part with every entry, build the heaps; sums of a task's chunks come last."""
    step, entries = max(1, CHUNK_COMPONENTS // max(1, width)), len(books[0])
    sums = [(np.zeros(b.shape, object), np.zeros(entries, np.int64)) for b in books]
    for whole_batch in batches:
        for start in range(0, whole_batch.num_rows, step):
            batch = whole_batch.slice(start, step)
            vectors = whole([v.values.to_numpy(zero_copy_only=False) for v in batch.column("vector")], width, settings.scale)
            chunk = Chunk(batch.column("vec_id"), batch.column("label"), vectors, np.zeros((len(books), len(vectors)), np.uint8), [])
            for p, book in enumerate(books):
                own, slack = nearest(chunk.part(p), book)
                chunk.codes[p] = own
                chunk.heaps.append(Heaps.built(own, slack, entries))
                total, n = _sums(chunk.part(p), own, entries)
                sums[p] = (sums[p][0] + total, sums[p][1] + n)
            yield chunk.batch()
    for p, (total, n) in enumerate(sums):
        yield _deltas(p, total, n)


def _next_round(batches: Iterator[pa.RecordBatch], settings: Codes, books: list[np.ndarray], drift: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Rescan what the drift has reached; of the sums only the changes of a task's chunks come out."""
    entries = len(books[0])
    sums = [(np.zeros(b.shape, object), np.zeros(entries, np.int64)) for b in books]
    for batch in batches:
        for at in range(batch.num_rows):
            chunk = Chunk.load(batch, at, settings)
            for p, book in enumerate(books):
                points = chunk.part(p)
                chunk.heaps[p], moved, before = chunk.heaps[p].moved(points, chunk.codes[p], book, drift[p])
                if len(moved):
                    (plus, n), (minus, m) = _sums(points[moved], chunk.codes[p][moved], entries), _sums(points[moved], before, entries)
                    sums[p] = (sums[p][0] + plus - minus, sums[p][1] + n - m)
            yield chunk.batch()
    for p, (total, n) in enumerate(sums):
        yield _deltas(p, total, n)


def _coded(batches: Iterator[pa.RecordBatch], settings: Codes, books: list[np.ndarray], drift: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The last assignment: codes and exact squared distances, vector by vector."""
    for batch in batches:
        for at in range(batch.num_rows):
            chunk = Chunk.load(batch, at, settings)
            error = np.zeros(len(chunk.ids), object)
            for p, book in enumerate(books):
                points = chunk.part(p)
                chunk.heaps[p].moved(points, chunk.codes[p], book, drift[p])
                reach = max((int(np.abs(x).max()) for x in (points, book) if x.size), default=0)
                kind = np.int64 if 4 * reach * reach * max(1, points.shape[1]) < 1 << 62 else object
                error = error + ((points.astype(kind) - book.astype(kind)[chunk.codes[p]]) ** 2).sum(1)
            codes = [row.tobytes().hex() for row in np.ascontiguousarray(chunk.codes.T)]
            errors = [int(x) if x <= LONG else None for x in error]
            yield pa.RecordBatch.from_arrays([chunk.ids, chunk.labels, pa.array(codes), pa.array(errors, pa.int64())], names=["vec_id", "label", "code", "error"])


def _with_label_error(coded: DataFrame) -> DataFrame:
    """Sums per label are joined back in salted copies, so that a label with very many rows is split."""
    total = F.sum(F.col("error").cast("decimal(20,0)"))
    sums = coded.groupBy("label").agg(F.when(total <= LONG, total.cast("long")).alias("label_error"))
    sums = sums.select(F.col("label").alias("_label"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("_at"))
    salted = coded.withColumn("_salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALT)).cast("int"))
    return salted.join(sums, F.col("label").eqNullSafe(F.col("_label")) & (F.col("_salt") == F.col("_at"))).drop("_label", "_salt", "_at")


def vector_codes(vectors: DataFrame, settings: Codes = Codes(), key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """One row per usable row of ``vectors``: vec_id, label, code, error, label_error, codebooks_sha256.

    Vectors that are null or hold null or non-finite components are dropped.  Codebooks
    start from the rows with the least vec_ids (equal ids by the vector, rows without id
    last); with fewer rows than entries there are fewer entries.  Vectors shorter than the
    longest count as filled up with zeros, and the length is rounded up to a multiple of
    the parts.  Repeated rows count as often as they occur; null labels are one label.
    Other columns are ignored; an empty table, or one without a usable vector, gives an
    empty result.  An error that no long holds is null.

    Each round stores the chunks again with changed codes and heaps, and adds up changes of
    the sums; the driver holds the codebooks, entries x components numbers.
    """
    spark = vectors.sparkSession
    space = Workspace(spark, "codes")
    rows = vectors.select(vectors[key].cast("long").alias("vec_id"), vectors[label].cast("long").alias("label"), vectors[vector].cast("array<double>").alias("vector"))
    rows = rows.filter(usable(F.col("vector")))
    head = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(settings.entries).collect()
    longest = rows.agg(F.max(F.size("vector"))).first()[0] or 0
    width = -(-longest // settings.parts) * settings.parts
    state = Refinement(whole([np.array(r.vector) for r in head], width, settings.scale), settings.parts)

    def stored(frame: DataFrame, nth: int) -> DataFrame:
        """Write a round's chunks and renew the codebooks by its sums, at most entries x (components + parts) rows."""
        table = space.write(frame, f"round{nth}")
        sums = table.filter("part IS NOT NULL").groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        state.take(sums.collect())
        state.step()
        return table.filter("vectors IS NOT NULL").select(*ARROW.names)

    schema = f"{CHUNK}, {DELTAS}"
    chunks = stored(rows.mapInArrow(partial(_first_round, width=width, settings=settings, books=state.books[:]), schema), 0)
    for nth in range(1, settings.rounds):
        again = partial(_next_round, settings=settings, books=state.books[:], drift=state.drift[:])
        chunks = stored(chunks.mapInArrow(again, schema), nth)
        space.drop(f"round{nth - 1}")
    last = partial(_coded, settings=settings, books=state.books[:], drift=state.drift[:])
    coded = space.write(chunks.mapInArrow(last, "vec_id long, label long, code string, error long"), "coded")
    space.drop(f"round{settings.rounds - 1}")
    return _with_label_error(coded).withColumn("codebooks_sha256", F.lit(state.sha256()))

"""N-gram Jaccard join with an R-tree of count vectors of hashed token groups.

A document is the set of its word n-grams.  Hashing the n-grams into groups, several
times as many as the set has members, gives it a point of group counts.  Two documents
share at most the sum of the coordinates' minima; a node of an R-tree over such points
bounds all the points below it by its coordinates' maxima, its least size and its
components.  A point that the tree lets through is held against the query once more by
the counts of finer groups, which bound the overlap more closely, since classes of one
large group of near copies often miss the bound by little.  Pairs that are left are
verified on the whole sets.

Points of unrelated documents lie at nearly equal distances from each other, so one tree
over all of them would be searched nearly whole.  Therefore the points are first dealt
into cells without loss, and each cell has a tree of its own.  Sets of together t
members that link differ in at most d = t (100 - p) / (100 + p) of them, so of g groups
of n-grams all but d hold the same members in both.  A cell holds the documents that
agree in one group.  A document need not go to all its cells: the rarest of the groups
in which two sets agree is among the d + 1 rarest of either, by any order that depends
on a group's members only.  Groups of few or frequent n-grams, such as those of shared
passages, come last; frequencies come from a table of counters of fixed size, whose
errors may cost time but no pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blobs import release, squeeze, unsqueeze
from .components import connected_components
from .words import LOWER, hashes, ngram_hashes, raw_texts
from .workspace import Workspace

LEAF, FAN_OUT = 8, 8
GROUP_BITS = 12  # of the groups of a point, for sets of up to 2 ** 16 members
BAND = 63  # the low bits of a cell's key: its size band
CHOICES = 3  # cells in which a class looks for one partner first
FEW = 128  # classes of a cell compared together in that step
DENSE_BYTES = 1 << 24  # of counts held as a matrix at once
QUERIES = 4  # times as many queries as points in a task of a large cell
TASK_ROWS = 2048  # rows of small cells that share a task
COUNTER_BITS = 22  # 4 million counters, sent to the tasks as 4 MB of levels
COUNTER_SLOTS = 64
SALTS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def mixed(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ SALTS[salt]) * SALTS[4]
    x = (x ^ (x >> np.uint64(32))) * SALTS[1]
    return x ^ (x >> np.uint64(29))


@dataclass(frozen=True)
class Similarity:
    """Two sets link when 100 * intersection >= percent * union."""

    words: int = 5
    percent: int = 80

    @property
    def share(self) -> float:
        """The least intersection of linked sets, of their members together."""
        return self.percent / (100 + self.percent)

    def differences(self, one: int, other: int) -> int:
        """In how many members sets of these sizes at most may differ to link."""
        return (one + other) * (100 - self.percent) // (100 + self.percent)

    def bands(self, n: int) -> range:
        """The bands of sizes of a set of n members and of the lesser sets it can link with."""
        return range(band_of(max(1, -(-self.percent * n // 100))), band_of(n) + 1)

    def only_equal(self, n: int) -> bool:
        """No set other than an equal one can link with a set of n members."""
        return self.differences(n, 100 * n // self.percent) < 1


def band_of(n: int) -> int:
    return n.bit_length() - 1


def group_bits(band: int) -> int:
    """Eight groups or more for each member of a set of this band, for large sets fewer."""
    return max(min(band + 4, GROUP_BITS), band - 4)


def fine_bits(band: int) -> int:
    """Of the finer groups: 64 or more for each member, so that few hold two."""
    return min(band + 7, 32)


def block_rows(band: int) -> int:
    return max(FEW, min(1024, DENSE_BYTES >> group_bits(band)))


def shingles(raw: bytes, n: int) -> np.ndarray:
    """Sorted distinct hashes of the lower-cased text's n-word shingles; fewer words make one."""
    words = raw.translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    single = hashes(words)
    k = min(n, len(words))
    return np.unique(ngram_hashes(single, k) + np.uint64(k * int(SALTS[2]) % 2**64))


def cells(members: np.ndarray, like: Similarity, levels: np.ndarray) -> np.ndarray:
    """Keys of the rarest groups of one set, as many as decide whether it can link, in each of its bands."""
    n, out = len(members), [members[:0]]
    if not n or like.only_equal(n):
        return members[:0]
    rarity = 128 - levels[counter(members)].astype(np.int64)
    hashed, summands = mixed(members, 3), mixed(members, 1)
    for band in like.bands(n):
        last = (2 << band) - 1
        most = like.differences(last, 100 * last // like.percent)
        differ = like.differences(n, 100 * n // like.percent if band == band_of(n) else last)
        count = most + 2 + most // 4
        group = (hashed % np.uint64(count)).astype(np.int64)
        sums = np.zeros(count, np.uint64)
        np.add.at(sums, group, summands)
        rarest = np.argsort(-np.bincount(group, weights=rarity, minlength=count), kind="stable")[: differ + 1]
        key = mixed(sums[rarest] + rarest.astype(np.uint64) * SALTS[0], 2)
        out.append((key & ~np.uint64(BAND)) | np.uint64(min(band, BAND)))
    return np.concatenate(out)


def counter(members: np.ndarray) -> np.ndarray:
    return (mixed(members, 3) >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)


def frequency_levels(docs: DataFrame, like: Similarity, text: str) -> np.ndarray:
    """A level for each counter, four to a doubling of how many texts its n-grams are in.

    Tasks count on their own and send their counters in slots; what reaches the driver
    is one array of fixed size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << COUNTER_BITS, np.int32)
        for batch in batches:
            for raw in raw_texts(batch.column(0)):
                np.add.at(counts, counter(shingles(raw, like.words)), 1)
        if counts.any():
            parts = np.split(counts, COUNTER_SLOTS)
            yield pa.RecordBatch.from_arrays([pa.array(range(COUNTER_SLOTS), pa.int32()), pa.array([squeeze(p) for p in parts], pa.binary())], names=["slot", "counts"])
        del counts
        release()

    def total(frame: pd.DataFrame) -> pd.DataFrame:
        summed = np.zeros((1 << COUNTER_BITS) // COUNTER_SLOTS, np.int64)
        for blob in frame.counts:
            summed += unsqueeze(blob)
        return pd.DataFrame({"slot": frame.slot[:1].to_numpy(), "counts": [squeeze(np.floor(4 * np.log2(summed + 1)).astype(np.uint8))]})

    counted = docs.select(docs[text].cast("string").alias("text")).mapInArrow(run, "slot int, counts binary")
    rows = counted.groupBy("slot").applyInPandas(total, "slot int, counts binary").collect()
    levels = np.zeros((COUNTER_SLOTS, (1 << COUNTER_BITS) // COUNTER_SLOTS), np.uint8)
    for row in rows:
        levels[row.slot] = unsqueeze(row.counts)
    return levels.ravel()


def point(members: np.ndarray) -> bytes:
    """The finer group of each member, in order, as gaps: a sparse vector of counts."""
    if not len(members):
        return b""
    bits = fine_bits(band_of(len(members)))
    groups = np.sort(mixed(members, 0) >> np.uint64(64 - bits)).astype(np.uint32)
    return squeeze(np.diff(groups, prepend=np.uint32(0)))


def groups_of(blob: bytes) -> np.ndarray:
    return np.cumsum(unsqueeze(blob), dtype=np.uint32)


ROWS = "doc_id long, text_hash long, n_shingles long, set_a long, set_b long, cells array<long>, point binary"


def describe(docs: DataFrame, like: Similarity, key: str, text: str) -> DataFrame:
    """Size, two 64-bit hashes of the set, the cells and the point of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(frequency_levels(docs, like, text))
    names = [c.split()[0] for c in ROWS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = shared.value
        for batch in batches:
            sets = [shingles(raw, like.words) for raw in raw_texts(batch.column("text"))]
            of_each = [cells(s, like, levels).view(np.int64) for s in sets]
            starts = np.concatenate([[0], np.cumsum([len(c) for c in of_each])]).astype(np.int32)
            flat = np.concatenate(of_each) if of_each else np.zeros(0, np.int64)
            set_a = [int(mixed(s, 0).sum().astype(np.int64)) for s in sets]
            set_b = [int(np.bitwise_xor.reduce(mixed(s, 2)).astype(np.int64)) if len(s) else 0 for s in sets]
            columns = [batch.column("doc_id"), batch.column("text_hash"), pa.array([len(s) for s in sets], pa.int64()), pa.array(set_a, pa.int64()), pa.array(set_b, pa.int64())]
            columns += [pa.ListArray.from_arrays(pa.array(starts), pa.array(flat, pa.int64())), pa.array([point(s) if len(c) else b"" for s, c in zip(sets, of_each, strict=True)], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=names)
        release()

    body = docs[text].cast("string")
    return docs.select(docs[key].cast("long").alias("doc_id"), F.xxhash64(body).alias("text_hash"), body.alias("text")).mapInArrow(run, ROWS)


@dataclass
class Points:
    """Sparse count vectors: row i has the sorted groups flat[starts[i] : starts[i + 1]]."""

    flat: np.ndarray
    starts: np.ndarray
    bits: int

    def dense(self, rows: np.ndarray) -> np.ndarray:
        """Counts of the given rows as a matrix."""
        sizes = (self.starts[1:] - self.starts[:-1])[rows]
        at = np.repeat(self.starts[rows] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        place = np.repeat(np.arange(len(rows)) << self.bits, sizes) + self.flat[at]
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        counts = np.diff(np.append(first, len(place)))
        out = np.zeros((len(rows), 1 << self.bits), np.uint8 if counts.max(initial=0) < 256 else np.uint32)
        out.ravel()[place[first]] = counts
        return out

    def order(self) -> tuple[np.ndarray, np.ndarray]:
        """Two least hashes of each row's groups; near rows tend to have the same ones."""
        x = self.flat.astype(np.uint64)
        return tuple(np.minimum.reduceat(mixed(x, k), self.starts[:-1]) for k in (1, 2))


@dataclass
class Level:
    """Nodes of one height: bounds of what lies below, and where their children are."""

    counts: np.ndarray
    least_size: np.ndarray
    low: np.ndarray  # the least and the greatest component below
    high: np.ndarray
    begin: np.ndarray
    end: np.ndarray


class CountForest:
    """R-trees over group counts, one for each of many cells, searched together.

    ``tree`` numbers the cell of each point; points of a tree follow each other, near
    ones close together.  Every tree has a root above its points, however small it is.
    """

    def __init__(self, counts: np.ndarray, tree: np.ndarray, sizes: np.ndarray, components: np.ndarray) -> None:
        nothing = np.zeros(0, np.int64)
        self.levels = [Level(counts, sizes, components, components, nothing, nothing)]
        trees = int(tree.max(initial=-1)) + 1
        self.root_level, self.root = np.zeros(trees, np.int64), np.zeros(trees, np.int64)
        going, owner, width = np.arange(len(tree)), tree, LEAF
        while len(going):
            last = self.levels[-1]
            run = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            nth = np.arange(len(owner)) - np.repeat(run, np.diff(np.append(run, len(owner))))
            at = np.flatnonzero(nth % width == 0)
            begin, end = going[at], going[at] + np.diff(np.append(at, len(going)))
            fold = lambda f, x: f.reduceat(x[going], at, axis=0)  # noqa: B023, E731
            self.levels.append(Level(fold(np.maximum, last.counts), fold(np.minimum, last.least_size), fold(np.minimum, last.low), fold(np.maximum, last.high), begin, end))
            owner, width = owner[at], FAN_OUT
            alone = np.bincount(owner, minlength=trees)[owner] == 1
            self.root_level[owner[alone]], self.root[owner[alone]] = len(self.levels) - 1, np.flatnonzero(alone)
            going, owner = np.flatnonzero(~alone), owner[~alone]

    def search(self, counts: np.ndarray, tree: np.ndarray, sizes: np.ndarray, components: np.ndarray, share: float, lesser: bool) -> tuple[np.ndarray, np.ndarray]:
        """(query, point) pairs within a tree whose summed minima reach ``share`` of both sizes.

        The two are of different components; with ``lesser`` the point's is the lesser one.
        """
        query, node = np.zeros(0, np.int64), np.zeros(0, np.int64)
        step = max(1, DENSE_BYTES // counts.shape[1] // 4)
        for depth in range(len(self.levels) - 1, -1, -1):
            level = self.levels[depth]
            if depth:
                enter = np.flatnonzero(self.root_level[tree] == depth)
                query, node = np.concatenate([query, enter]), np.concatenate([node, self.root[tree[enter]]])
            low, high = level.low[node], level.high[node]
            good = low < components[query] if lesser else (low != components[query]) | (high != components[query])
            need = share * (sizes[query] + level.least_size[node]) - 1e-6
            good &= sizes[query] >= need
            query, node, need = query[good], node[good], need[good]
            passed = np.zeros(len(query), np.bool_)
            for at in range(0, len(query), step):
                part = slice(at, at + step)
                passed[part] = np.minimum(counts[query[part]], level.counts[node[part]]).sum(axis=1, dtype=np.int32) >= need[part]
            query, node = query[passed], node[passed]
            if depth:
                width = (level.end - level.begin)[node]
                query = np.repeat(query, width)
                node = np.repeat(level.begin[node] - np.concatenate([[0], np.cumsum(width)[:-1]]) if len(width) else width, width) + np.arange(width.sum())
        return query, node


def shared_at_most(flat: np.ndarray, starts: np.ndarray, one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """For each pair of rows, how many members of the other lie in groups of the one: no less than they share."""
    out = np.zeros(len(one), np.int64)
    order = np.argsort(one, kind="stable")
    ends = np.append(np.flatnonzero(np.diff(one[order])) + 1, len(order))
    for low, high in zip(np.append(0, ends[:-1]), ends if len(one) else [], strict=False):
        row = one[order[low]]
        mine = flat[starts[row] : starts[row + 1]]
        step = max(1, (1 << 20) // len(mine))
        for at in range(low, high, step):
            some = order[at : min(at + step, high)]
            begin, sizes = starts[other[some]], (starts[1:] - starts[:-1])[other[some]]
            first = np.cumsum(sizes) - sizes
            theirs = flat[np.repeat(begin - first, sizes) + np.arange(sizes.sum())]
            hit = mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs
            out[some] = np.add.reduceat(hit, first, dtype=np.int64)
    return out


def _candidates(frame: pd.DataFrame, like: Similarity, lesser: bool, one_each: bool) -> pd.DataFrame:
    """Pairs of a point (a) and a query (b) that a tree lets through.

    A row has a tree (cell and part), an id, a component, a size, a point, and whether it is
    a point of the tree, a query or both (1, 2, 3).  With ``one_each`` a query keeps one
    partner only, the one with the least id; otherwise a < b.
    """
    frame = frame.sort_values(["cell", "part"], kind="stable")
    frame = frame.iloc[np.argsort(frame.cell.to_numpy() & BAND, kind="stable")]
    cell, part, ids = (frame[c].to_numpy() for c in ("cell", "part", "id"))
    known, first, place = np.unique(ids, return_index=True, return_inverse=True)
    groups = [groups_of(frame.point.iloc[i]) for i in first]
    new = np.concatenate([[True], (cell[1:] != cell[:-1]) | (part[1:] != part[:-1])])
    starts, tree = np.append(np.flatnonzero(new), len(frame)), np.cumsum(new) - 1
    sizes, components, role = frame["n_shingles"].to_numpy(), frame["component"].to_numpy(), frame["role"].to_numpy()
    found = [np.zeros((0, 2), np.int64)]
    at = 0
    while at < len(starts) - 1:
        band = int(cell[starts[at]] & BAND)
        bits, to = group_bits(band), at + 1
        while to < len(starts) - 1 and int(cell[starts[to]] & BAND) == band and (starts[to + 1] - starts[at]) << bits <= DENSE_BYTES:
            to += 1
        rows = np.arange(starts[at], starts[to])
        folded = [groups[p] >> (fine_bits(band_of(int(n))) - fine_bits(band)) for p, n in zip(place[rows], sizes[rows], strict=True)]
        fine, ends = np.concatenate(folded), np.concatenate([[0], np.cumsum([len(x) for x in folded])])
        points = Points(fine >> (fine_bits(band) - bits), ends, bits)
        one, two = points.order()
        order = np.lexsort((two, one, tree[rows]))
        order = order[(role[rows[order]] & 1) > 0]
        asking = np.flatnonzero(role[rows] & 2)
        base = tree[rows[0]]
        if len(order) and len(asking):
            inside = rows[order]
            forest = CountForest(points.dense(order), tree[inside] - base, sizes[inside], components[inside])
            slice_rows = max(1, 4 * DENSE_BYTES >> bits)
            for k in range(0, len(asking), slice_rows):
                some = asking[k : k + slice_rows]
                mine = rows[some]
                q, p = forest.search(points.dense(some), tree[mine] - base, sizes[mine], components[mine], like.share, lesser)
                close = shared_at_most(fine, ends, some[q], order[p]) >= like.share * (sizes[mine[q]] + sizes[inside[p]]) - 1e-6
                q, p = q[close], p[close]
                pair = np.stack([place[inside[p]], place[mine[q]]], axis=1)
                if one_each:
                    pair = pair[np.lexsort((pair[:, 0], pair[:, 1]))]
                    found.append(pair[np.concatenate([[True], pair[1:, 1] != pair[:-1, 1]])] if len(pair) else pair)
                else:
                    found.append(np.unique(np.sort(pair, axis=1), axis=0))
        at = to
    pairs = np.unique(np.concatenate(found), axis=0)
    out = pd.DataFrame({"a": known[pairs[:, 0]], "b": known[pairs[:, 1]]})
    del frame, found, groups
    release()
    return out


def tree_pairs(rows: DataFrame, like: Similarity, large: Column, buckets: int, lesser: bool, one_each: bool) -> DataFrame:
    """Distinct pairs of classes in one tree, by rows as ``_candidates`` takes them.

    A large cell's parts have a task each; small cells share tasks.
    """
    task = F.when(large, F.xxhash64("cell", "part")).otherwise(F.pmod(F.xxhash64("cell"), F.lit(buckets)))
    asked = rows.select(task.alias("task"), "cell", "part", "id", "component", "n_shingles", "role", "point")
    pairs = asked.groupBy("task").applyInPandas(lambda p: _candidates(p, like, lesser, one_each), "a long, b long")
    return pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b") if one_each else pairs.distinct()


def verified(pairs: DataFrame, texts: DataFrame, like: Similarity) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets: dict[int, np.ndarray] = {}
            good = []
            for a, x, y in zip(batch.column("a").to_pylist(), raw_texts(batch.column("text_a")), raw_texts(batch.column("text_b")), strict=True):
                if a not in sets:
                    sets = {a: shingles(x, like.words)}
                other = shingles(y, like.words)
                both = len(sets[a]) + len(other) - len(np.union1d(sets[a], other))
                good.append(100 * both >= like.percent * (len(sets[a]) + len(other) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    first = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    second = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(second, "b").join(first, "a").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(run, "a long, b long")


def _first_partners(shared: DataFrame, points: DataFrame, like: Similarity, space: Workspace) -> DataFrame:
    """A lesser partner (a) for each class (b) that has one in a few of its cells, in parts of a cell.

    The least class of a cell is a point of every part, so that most of a group of near
    copies is linked to one of them.
    """
    nth = [F.min_by("cell", F.xxhash64("cell", F.lit(k))) for k in range(CHOICES)]
    chosen = shared.groupBy("id").agg(F.array_distinct(F.array(*nth)).alias("cells")).select("id", F.explode("cells").alias("cell"))
    chosen = space.write(chosen, "chosen")
    sizes = chosen.groupBy("cell").agg(F.ceil(F.count("*") / FEW).cast("int").alias("parts"))
    heads = shared.filter("id = first").join(sizes, "cell")
    asking = chosen.join(sizes, "cell").select("cell", "id", F.pmod(F.xxhash64("id", "cell"), F.col("parts")).cast("int").alias("part"), "parts", F.lit(3).alias("role"))
    always = heads.select("cell", F.col("first").alias("id"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "parts", F.lit(1).alias("role"))
    rows = asking.unionByName(always).join(points, "id").withColumn("component", F.col("id"))
    buckets = max(12, -(-chosen.count() // TASK_ROWS))
    return tree_pairs(rows, like, F.col("parts") > 8, buckets, lesser=True, one_each=True)


def _open_pairs(shared: DataFrame, points: DataFrame, found: DataFrame, like: Similarity, space: Workspace, one_each: bool) -> DataFrame:
    """Pairs of classes of different components in any cell, as the trees let them through.

    Of a cell, all classes are points, and those outside its largest component ask.  A
    cell of many classes is cut into blocks of points and parts of those who ask, so
    that a task holds a bounded number of either.
    """
    placed = shared.select("cell", "id").join(found, "id", "left").select("cell", "id", F.coalesce("component", "id").alias("component"))
    inside = placed.groupBy("cell", "component").agg(F.count("*").alias("n"))
    mixed_cells = inside.groupBy("cell").agg(F.sum("n").alias("n"), F.max("n").alias("top_n"), F.max_by("component", "n").alias("top"), F.count("*").alias("k")).filter("k > 1").drop("k")
    rows_of = F.element_at(F.array(*[F.lit(block_rows(b)) for b in range(BAND + 1)]), (F.col("cell").bitwiseAND(F.lit(BAND)) + 1).cast("int"))
    cut = mixed_cells.withColumn("blocks", F.ceil(F.col("n") / rows_of).cast("int")).withColumn("askers", F.ceil((F.col("n") - F.col("top_n")) / (QUERIES * rows_of)).cast("int"))
    cut = space.write(cut, f"mixed{int(one_each)}")
    rows = placed.join(cut, "cell").withColumn("asks", F.col("component") != F.col("top"))
    large = (F.col("blocks") > 1) | (F.col("askers") > 1)
    small_rows = rows.filter(~large).select("cell", "id", "component", F.lit(0).alias("part"), F.when(F.col("asks"), 3).otherwise(1).alias("role"), F.lit(False).alias("large"))
    block, asker = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"), F.pmod(F.xxhash64("id", F.lit(1)), F.col("askers")).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cut_rows = rows.filter(large)
    as_points = cut_rows.withColumn("_k", each("askers")).select("cell", "id", "component", (block * F.col("askers") + F.col("_k")).alias("part"), F.lit(1).alias("role"), F.lit(True).alias("large"))
    as_queries = cut_rows.filter("asks").withColumn("_k", each("blocks")).select("cell", "id", "component", (F.col("_k") * F.col("askers") + asker).alias("part"), F.lit(2).alias("role"), F.lit(True).alias("large"))
    small = cut.filter(~large).agg(F.coalesce(F.sum("n"), F.lit(0))).collect()[0][0]
    every = small_rows.unionByName(as_points).unionByName(as_queries).join(points, "id")
    return tree_pairs(every, like, F.col("large"), max(12, -(-small // TASK_ROWS)), lesser=False, one_each=one_each)


def _row_components(docs: DataFrame, like: Similarity, key: str, text: str) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_hash, n_shingles, and of its component the
    least (doc_id, text_hash); null where there is no set or no id."""
    space = Workspace(docs.sparkSession, "jaccard")
    rows = space.write(describe(docs, like, key, text).withColumn("row", F.monotonically_increasing_id()), "rows")
    named = rows.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    same_set = ["n_shingles", "set_a", "set_b"]
    classes = space.write(
        named.groupBy(*same_set).agg(
            F.min("row").alias("id"),
            F.min_by("doc_id", "row").alias("of_doc"),
            F.min_by("text_hash", "row").alias("of_text"),
            F.min("doc_id").alias("least_doc"),
            F.min_by("text_hash", F.struct("doc_id", "text_hash")).alias("least_text"),
        ),
        "classes",
    )
    members = space.write(rows.select("doc_id", "text_hash", *same_set), "members")
    of_class = rows.select(F.col("row").alias("id"), "cells", "n_shingles", "point").join(classes.select("id"), "id", "left_semi")
    of_class = space.write(of_class.filter(F.size("cells") > 0), "of_class")
    space.drop("rows")
    # Most cells have one class only.  Both sides of the join read one and the same shuffle.
    dealt = of_class.select("id", F.explode("cells").alias("cell")).repartition("cell")
    several = dealt.groupBy("cell").agg(F.count("*").alias("n"), F.min("id").alias("first")).filter("n > 1").select("cell", "first")
    shared = space.write(dealt.join(several, "cell").select("cell", "id", "first"), "shared")
    ids = shared.select("id").distinct()
    points = space.write(of_class.join(ids, "id", "left_semi").select("id", "n_shingles", "point"), "points")
    space.drop("of_class")
    wanted = classes.join(ids, "id", "left_semi").select("id", F.col("of_doc").alias("_doc"), F.col("of_text").alias("_hash"))
    chosen = docs.select(docs[key].cast("long").alias("_doc"), F.xxhash64(docs[text].cast("string")).alias("_hash"), docs[text].cast("string").alias("text"))
    # repeated rows have one text
    texts = space.write(chosen.join(wanted, ["_doc", "_hash"]).groupBy("id").agg(F.min("text").alias("text")), "texts")

    found = None
    for step in ("first", "other", "all"):
        if found is None:
            pairs = _first_partners(shared, points, like, space)
        else:
            pairs = _open_pairs(shared, points, found, like, space, one_each=step == "other")
        edges = space.write(verified(pairs, texts, like), f"links_{step}")
        if found is not None:
            edges = found.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(edges)
        found = connected_components(edges, "a", "b", space, step)
    space.drop("shared", "chosen", "points", "texts", "mixed0", "mixed1")

    placed = classes.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = placed.groupBy("component").agg(F.min("least_doc").alias("head_doc"), F.min_by("least_text", F.struct("least_doc", "least_text")).alias("head_text"))
    heads = placed.join(least, "component").select(*[F.col(c).alias(f"_{c}") for c in same_set], "head_doc", "head_text")
    same = (members["n_shingles"] == heads["_n_shingles"]) & (members["set_a"] == heads["_set_a"]) & (members["set_b"] == heads["_set_b"]) & members["doc_id"].isNotNull()
    return members.join(heads, same, "left").select("doc_id", "text_hash", "n_shingles", "head_doc", "head_text")


def jaccard_components(docs: DataFrame, like: Similarity = Similarity(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (least doc_id reachable by links).

    Documents with equal sets form a class, linked without comparing.  Classes that share
    a cell are compared by the cell's tree: first each asks for one partner in a few of
    its cells, then for one of another component in all of them, which joins most groups
    of near copies; then all pairs of different components in one cell are searched for.
    No pair that could link two components is left out.

    Null and empty texts have no shingles and link with nothing.  Rows that repeat a
    doc_id are separate documents, each linked by its own text; rows without an id
    link with nothing and keep a null component.  Other columns are ignored; an empty
    table gives an empty result.
    """
    found = _row_components(docs, like, key, text)
    return found.select("doc_id", "n_shingles", F.coalesce("head_doc", "doc_id").alias("component_id"))


def one_of_each_group(docs: DataFrame, like: Similarity = Similarity(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without near copies: of each component the row with the least id stays, and of
    several such the one with the least hash of its text; of rows equal in both, one.

    Documents without shingles or without an id all stay.
    """
    found = _row_components(docs, like, key, text).filter("doc_id IS NOT NULL")
    is_head = (F.col("doc_id") == F.col("head_doc")) & (F.col("text_hash") == F.col("head_text"))
    heads = found.filter(is_head | F.col("head_doc").isNull()).select(F.col("doc_id").alias("_head"), F.col("text_hash").alias("_hash"), F.col("head_doc").isNull().alias("_all")).distinct()
    same = (docs[key].cast("long") == heads["_head"]) & (F.xxhash64(docs[text].cast("string")) == heads["_hash"])
    alike = Window.partitionBy("_head", "_hash").orderBy(F.lit(0))
    kept = docs.join(heads, same).withColumn("_nth", F.row_number().over(alike))
    return kept.filter("_nth = 1 OR _all").select(*docs.columns).unionByName(docs.filter(docs[key].isNull()))

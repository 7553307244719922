"""Best-fit-decreasing packing of tokenized documents into sequences."""

from __future__ import annotations

import base64
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import gapless_rank
from .workspace import Workspace

ROWS_PER_SPREAD = 50_000


@lru_cache(maxsize=4)
def _tiktoken(ranks: str, pattern: str):
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(ranks, pat_str=pattern, mergeable_ranks=table, special_tokens={})


@lru_cache(maxsize=4)
def _tokenizers(path: str):
    import tokenizers

    return tokenizers.Tokenizer.from_file(path)


class BytePairs:
    """Token ids as the ``tokenizers`` file gives them, without special tokens added.

    ``ranks`` is the same vocabulary for ``tiktoken``, which gives the same ids four
    times as fast; texts that spell one of ``specials`` go to ``tokenizers``, which
    makes one id of it.
    """

    def __init__(self, path: str, ranks: str | None = None, pattern: str = "", specials: tuple[str, ...] = ("<|endoftext|>",)) -> None:
        self.path, self.ranks, self.pattern, self.specials = path, ranks, pattern, specials

    def ids(self, text: str) -> list[int]:
        if self.ranks and not any(s in text for s in self.specials):
            return _tiktoken(self.ranks, self.pattern).encode_ordinary(text)
        return _tokenizers(self.path).encode(text, add_special_tokens=False).ids


def public_byte_pairs() -> BytePairs:
    import public_tokenizers

    return BytePairs(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(docs: DataFrame, tokenizer: BytePairs, most: int, end_id: int, key: str, text: str) -> DataFrame:
    """Pieces of at most ``most`` ids; of a longer document only the first may be shorter."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = tokenizer.ids(body) if body else []
                ids.append(end_id)
                data, n, at, piece = np.array(ids, "<u4").tobytes(), len(ids), 0, 0
                while at < n:
                    to = at + (n - at - 1) % most + 1 if at == 0 else at + most
                    for column, value in zip(out, (doc, piece, at, to - at, zlib.crc32(data[4 * at : 4 * to])), strict=True):
                        column.append(value)
                    at, piece = to, piece + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("string").alias("text")).mapInArrow(run, PIECES)


class OpenBins:
    """A segment tree over remaining capacities: which is the least at or above a length?"""

    def __init__(self, most: int) -> None:
        self.width = 1 << most.bit_length()
        self.any = [False] * (2 * self.width)

    def mark(self, capacity: int, there: bool) -> None:
        at = capacity + self.width
        self.any[at] = there
        while at > 1:
            at //= 2
            self.any[at] = self.any[2 * at] or self.any[2 * at + 1]

    def least(self, length: int) -> int:
        """The least marked capacity >= length, or -1."""
        at = length + self.width
        if self.any[at]:
            return length
        while at > 1:
            if at % 2 == 0 and self.any[at + 1]:
                at += 1
                while at < self.width:
                    at = 2 * at if self.any[2 * at] else 2 * at + 1
                return at - self.width
            at //= 2
        return -1


def best_fit(counts: dict[int, int], most: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over how many pieces there are of each length.

    Equal lengths are alike, so bins with equal contents are handled as one run.
    Returns (length, first rank, pieces, first bin, offset): the piece of that length
    with rank first + i lies in bin first + i at the offset.
    """
    runs: dict[int, list[tuple[int, int]]] = defaultdict(list)
    tree, bins, out = OpenBins(most), 0, []

    def put(capacity: int, first: int, n: int) -> None:
        runs[capacity].append((first, n))
        tree.mark(capacity, True)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            capacity = tree.least(length)
            if capacity < 0:
                capacity, first, n = most, bins, -(-left // (most // length))
                bins += n
            else:
                first, n = runs[capacity].pop()
                tree.mark(capacity, bool(runs[capacity]))
            each = min(capacity // length, left)
            use = min(n, left // each)
            for j in range(each):
                out.append((length, rank + j * use, use, first, most - capacity + j * length))
            rank, left = rank + each * use, left - each * use
            put(capacity - each * length, first, use)
            if n > use:
                put(capacity, first + use, n - use)
    return out


def pack(docs: DataFrame, tokenizer: BytePairs, most: int = 1024, end_id: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Best fit is decided on the counts of the at most ``most`` lengths, which is the
    same as deciding piece by piece; the driver holds one number per length and one
    row per run of like bins.  Each piece finds its place by its rank among the pieces
    of its length.  A null text is empty: one piece with the end id.  Repeated rows
    are packed as often as they occur; other columns are ignored; an empty table gives
    an empty result.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "pack")
    pieces = space.write(cut_pieces(docs, tokenizer, most, end_id, key, text), "pieces")
    counts = {int(r[0]): r[1] for r in pieces.groupBy("length").count().collect()}
    placed = np.array(sorted(best_fit(counts, most)) or [(0, 0, 0, 0, 0)], np.int64)
    spreads = max(1, -(-max(counts.values(), default=0) // ROWS_PER_SPREAD))
    ranked = gapless_rank(pieces, ["length"], F.pmod(F.xxhash64("doc_id", "piece"), F.lit(spreads)), ["doc_id", "piece", "ids_crc32"], "rank")
    keys = (placed[:, 0] << 44) + placed[:, 1]
    shared = spark.sparkContext.broadcast((keys, placed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, placed = shared.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(keys, (length << 44) + rank, "right") - 1
            made = [placed[at, 3] + rank - placed[at, 1], placed[at, 4]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *map(pa.array, made)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    chosen = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return chosen.mapInArrow(run, f"{PIECES}, sequence_id long, offset long")

"""Token ids in ORC files: ascending document ids, packed integers, pruned by metadata.

A folder holds ``tokens`` (one row per document) and ``parts`` (one row per file: how many
ids lie before it).  ORC stores the ids as bit-packed runs, keeps least and greatest
document ids per stripe and per row group, and a Bloom filter on them, so a reader takes
stripes in parallel and skips those that cannot hold what it looks for.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .blobs import release
from .workspace import Workspace, ship_package

ID = np.dtype("<u4")
#: ASCII punctuation that no contraction begins with; after a letter or digit it is a piece of its own.
TRAILING = bytes(b for b in range(0x21, 0x7F) if not chr(b).isalnum() and b != 0x27)
ALNUM = frozenset(b"abcdefghijklmnopqrstuvwxyz0123456789")
LONGEST = 32


@lru_cache(maxsize=4)
def _loaded(path: str):
    import tokenizers

    return tokenizers.Tokenizer.from_file(path)


class Memory:
    """Words met lately and their ids: two generations of at most ``most / 2`` words."""

    def __init__(self) -> None:
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def age(self, most: int) -> None:
        if len(self.young) > most // 2:
            self.young, self.old = {}, self.young


@lru_cache(maxsize=4)
def _model(path: str):
    return _loaded(path).model


@lru_cache(maxsize=4)
def _memory(path: str) -> Memory:
    """What this Python worker has met, kept from task to task."""
    return Memory()


class WordPieces:
    """Ids of the ``tokenizers`` file, special tokens recognized but not added.

    ``by_word`` is for tokenizers that lower-case, drop white space and never join letters
    across it: then a text's ids are those of its words, and the library is asked once for
    each word a worker has not met lately.  Words longer than 32 bytes are asked for each time.
    """

    def __init__(self, path: str, by_word: bool = False, memory: int = 1_600_000) -> None:
        self.path, self.by_word, self.memory = path, by_word, memory

    def _piece(self, word: bytes) -> bytes:
        """Lower-case ASCII letters are one piece that no normalizer changes: the library's merges alone give its ids."""
        if not (word.isalpha() and word.islower()):
            return self.whole(word)
        ids = [t.id for t in _model(self.path).tokenize(word.decode())]
        return struct.pack(f"<{len(ids)}I", *ids)

    def whole(self, text: bytes) -> bytes:
        ids = _loaded(self.path).encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _missing(self, word: bytes, young: dict[bytes, bytes], old: dict[bytes, bytes]) -> bytes:
        """A letter or digit and the punctuation after it are pieces apart.  Both together are
        remembered from the second time on, so that words met once take one place."""
        ids = old.get(word)
        if ids is None:
            core = word.rstrip(TRAILING)
            if len(core) < len(word) and core and core[-1] in ALNUM and b"<|" not in word:
                head, end = young.get(core) or old.get(core), word[len(core) :]
                tail = young.get(end) or self.whole(end)
                young[end] = tail
                if head is None:
                    head = self._piece(core)
                    if len(core) <= LONGEST:
                        young[core] = head
                    return head + tail
                ids = head + tail
            else:
                ids = self._piece(word)
        if len(word) <= LONGEST:
            young[word] = ids
        return ids

    def ids(self, data: bytes) -> bytes:
        """Little-endian unsigned 32-bit ids of a UTF-8 text."""
        if not self.by_word:
            return self.whole(data)
        known = _memory(self.path)
        known.age(self.memory)
        # special tokens are told from other text before letters are lowered
        split = (data if b"<|" in data else data.lower()).split()
        found = list(map(known.young.get, split))
        if None in found:
            young, old, missing = known.young, known.old, self._missing
            for at, ids in enumerate(found):
                if ids is None:
                    word = split[at]
                    found[at] = young.get(word) or missing(word, young, old)
        return b"".join(found)


def public_word_pieces() -> WordPieces:
    import public_tokenizers

    return WordPieces(public_tokenizers.path("word_bpe_49k.json"), by_word=True)


@dataclass(frozen=True)
class Layout:
    """text_bytes: text of one file; stripe_bytes, stride: an ORC stripe's size and a row group's documents; false_hits: of the Bloom filter."""

    text_bytes: int = 64 << 20
    stripe_bytes: int = 16 << 20
    stride: int = 1000
    false_hits: float = 0.01
    compression: str = "zstd"

    def options(self) -> dict[str, str]:
        return {
            "compression": self.compression,
            "orc.stripe.size": str(self.stripe_bytes),
            "orc.row.index.stride": str(self.stride),
            "orc.rows.between.memory.checks": "100",
            "orc.create.index": "true",
            "orc.bloom.filter.columns": "doc_id",
            "orc.bloom.filter.fpp": str(self.false_hits),
        }


TOKENS = "part int, doc_id long, begin long, n_tokens long, ids array<int>"
FLUSH_IDS = 512 << 10


def _encoded(batches: Iterator[pa.RecordBatch], tokenizer: WordPieces, end_id: int) -> Iterator[pa.RecordBatch]:
    """Ids of a file's documents in order, each with how many ids of the file lie before it."""
    part, begin, end = TaskContext.get().partitionId(), 0, np.array([end_id], ID).tobytes()

    def made(docs: list[int | None], ids: list[bytes]) -> pa.RecordBatch:
        nonlocal begin
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // ID.itemsize
        ends = np.cumsum(sizes)
        values = np.frombuffer(b"".join(ids), ID).view(np.int32)
        listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(values))
        columns = [pa.array(np.full(len(ids), part, np.int32)), pa.array(docs, pa.int64()), pa.array(begin + ends - sizes), pa.array(sizes), listed]
        begin += int(ends[-1])
        return pa.RecordBatch.from_arrays(columns, names=["part", "doc_id", "begin", "n_tokens", "ids"])

    for batch in batches:
        docs, ids, held, text, found = [], [], 0, None, None
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
            found = tokenizer.ids(text.as_py() or b"") + end
            docs.append(doc)
            ids.append(found)
            held += len(found)
            if held > FLUSH_IDS * ID.itemsize:
                yield made(docs, ids)
                docs, ids, held = [], [], 0
        if ids:
            yield made(docs, ids)
        del batch, docs, ids, text, found  # before the next one comes
        release()


def write_tokens(docs: DataFrame, path: str, tokenizer: WordPieces, end_id: int = 2, layout: Layout = Layout(), key: str = "doc_id", text: str = "text") -> TokenFiles:
    """Encode every text (null: empty), append the end id and write the files.

    Documents are dealt to files in ranges of ascending doc_id, rows without an id first;
    equal ids are ordered by a hash of the text and then by their place in the input, so that
    very many of one id spread over files.  Other columns are ignored; an empty table gives
    empty files.
    """
    spark = docs.sparkSession
    ship_package(spark)
    body = F.coalesce(docs[text].cast("string"), F.lit(""))
    rows = docs.select(docs[key].cast("long").alias("doc_id"), body.alias("text"), F.xxhash64(body).alias("_hash"), F.monotonically_increasing_id().alias("_row"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    order = ["doc_id", "_hash", "_row"]
    files = rows.repartitionByRange(max(1, -(-size // layout.text_bytes)), *order).sortWithinPartitions(*order)
    tokens = files.select("doc_id", "text").mapInArrow(lambda b: _encoded(b, tokenizer, end_id), TOKENS)
    tokens.write.options(**layout.options()).orc(f"{path}/tokens")
    made = TokenFiles(spark, path)
    sums = made.tokens().groupBy("part").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.count("*").alias("documents"), F.sum("n_tokens").alias("tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    sums.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0))).write.orc(f"{path}/parts")
    return made


class TokenFiles:
    """What ``write_tokens`` has written."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def tokens(self) -> DataFrame:
        return self.spark.read.schema(TOKENS).orc(f"{self.path}/tokens")

    def parts(self) -> DataFrame:
        return self.spark.read.schema("part int, first_id long, last_id long, documents long, tokens long, start long").orc(f"{self.path}/parts")

    def find(self, ids: Iterable[int]) -> DataFrame:
        """Documents by id: Bloom filters and least and greatest ids leave few row groups to read."""
        return self.tokens().filter(F.col("doc_id").isin([int(i) for i in ids]))

    def between(self, low: int, high: int) -> DataFrame:
        """Documents with low <= doc_id <= high, from the stripes whose ids overlap the range."""
        return self.tokens().filter(F.col("doc_id").between(low, high))

    def stretch(self, first: int, last: int) -> DataFrame:
        """Documents that hold any of the ids at places first to last - 1 of the whole sequence, with ``start``.

        Only the files whose places overlap are read: their numbers are looked up among the
        parts (one row per file) and come back as a filter on ``part``.
        """
        near = self.parts().filter((F.col("start") < last) & (F.col("start") + F.col("tokens") > first)).select("part", F.col("start").alias("_before"))
        found = self.tokens().join(near, "part").withColumn("start", F.col("_before") + F.col("begin")).drop("_before")
        return found.filter((F.col("start") < last) & (F.col("start") + F.col("n_tokens") > first))

    def digest(self) -> DataFrame:
        """One row per document as read from the files: doc_id, start, n_tokens, ids_crc32."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                listed = batch.column("ids")
                data, cuts = listed.flatten().to_numpy().view(ID), listed.value_lengths().to_numpy()
                ends = np.cumsum(cuts, dtype=np.int64)
                crc = [zlib.crc32(data[a:b]) for a, b in zip((ends - cuts).tolist(), ends.tolist(), strict=True)]
                del listed, data
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("part", "doc_id", "begin")), pa.array(cuts.astype(np.int64)), pa.array(crc, pa.int64())], names=["part", "doc_id", "begin", "n_tokens", "ids_crc32"])
                del batch
                release()

        read = self.tokens().select("part", "doc_id", "begin", "ids").mapInArrow(run, "part int, doc_id long, begin long, n_tokens long, ids_crc32 long")
        starts = self.parts().select("part", F.col("start").alias("_before"))
        return read.join(starts, "part").select("doc_id", (F.col("_before") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: WordPieces, end_id: int = 2, layout: Layout = Layout()) -> DataFrame:
    """Write the files into the shared folder and return what is read back from them."""
    space = Workspace(docs.sparkSession, "tokens")
    return write_tokens(docs, f"{space.root}/orc", tokenizer, end_id, layout).digest()

"""A change feed cut into pages at whole source rows, and its projection page by page.

A source row yields one or more candidates (nodes, edges, tombstones) with one time and one
key.  All rows of all tables are ranked once, in the order of (time, key), by range
partitions and the counts before each; a page is so many consecutive rows.  The ranked
candidates are stored by page, so a reader takes a page without looking at the others.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..operators.paging import ranked
from ..sources.changes import CHANGE
from .files import Pointers

#: A consumed source row that has nothing to publish.
PROGRESS = "progress"
CANDIDATE = f"{CHANGE}, producer string, sort_key string"


@dataclass(frozen=True)
class Limits:
    """Rows of a page, rows of a table in a snapshot, contents of a batch, empty pages of one tick."""

    page_rows: int = 200
    snapshot_rows: int = 150
    nodes: int = 1000
    edges: int = 5000
    tombstones: int = 5000
    skips: int = 50


class VersionChanged(RuntimeError):
    """The source's identities mean something else than those already projected: rebuild first."""


def candidates(changes: DataFrame) -> DataFrame:
    """Changes with the key of their source row: an edge belongs to the row of the node it starts from."""
    return changes.withColumn("sort_key", F.coalesce("source_id", "node_id", F.lit("")))


def _kind(*ops: str) -> Column:
    return F.count_if(F.col("op").isin(*ops))


def modes(found: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Per producer: rows and contents, and whether the whole source fits one snapshot or needs pages.

    A snapshot needs every table and the sum of their contents within bounds: many small
    tables can exceed a batch together.
    """
    rows = found.groupBy("producer", "observed_at", "sort_key").agg(
        _kind("node").alias("nodes"), _kind("edge").alias("edges"), F.count_if(F.col("op").endswith("tombstone")).alias("tombstones")
    )
    each = rows.groupBy("producer").agg(F.count("*").alias("rows"), *[F.sum(c).alias(c) for c in ("nodes", "edges", "tombstones")])
    every = Window.partitionBy()  # one row per producer
    fits = (F.max("rows").over(every) <= limits.snapshot_rows) & (F.sum("nodes").over(every) <= limits.nodes)
    fits = fits & (F.sum("edges").over(every) <= limits.edges) & (F.sum("tombstones").over(every) <= limits.tombstones)
    return each.withColumn("mode", F.when(fits, "snapshot").otherwise("pages"))


def paged(found: DataFrame, page_rows: int, folder: str) -> DataFrame:
    """Each whole row's page.  Candidates of a row, however many, stay on one page."""
    rows = found.groupBy("observed_at", "sort_key").agg(F.count("*").alias("candidates"), F.count_if(F.col("op") != PROGRESS).alias("payload"))
    placed = ranked(rows, ["observed_at", "sort_key"], "place", folder)
    return placed.withColumn("page", F.floor(F.col("place") / page_rows).cast("long"))


def position(at: Column, key: Column) -> Column:
    """A cursor as text that sorts as (time, key) does; null times come first."""
    return F.concat(F.coalesce(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("0000")), F.lit("|"), key)


def pages(placed: DataFrame) -> DataFrame:
    """One row per page: where it ends, its rows, candidates and payload."""
    last = F.max(F.struct(F.col("place"), F.col("observed_at"), F.col("sort_key"))).alias("_last")
    out = placed.groupBy("page").agg(last, F.count("*").alias("rows"), F.sum("candidates").alias("candidates"), F.sum("payload").alias("payload"))
    return out.select("page", position(F.col("_last.observed_at"), F.col("_last.sort_key")).alias("ends_at"), "rows", "candidates", "payload")


def ticks(found_pages: DataFrame, org: str, source: str, version: str, start: str = "", limits: Limits = Limits()) -> DataFrame:
    """Which pages one tick consumes, and the batch that it publishes.

    A tick goes on over pages without payload until one has some; after ``skips`` of them and
    one more it ends without a batch, but its cursor has moved.  The batch's id and watermark
    are hashes of where the tick began and ended, so a repeated tick gives the same ones.  One
    row per page meets in the windows here, not one per source row.
    """
    order = Window.orderBy("page")
    behind = order.rowsBetween(Window.unboundedPreceding, -1)
    run = found_pages.withColumn("_run", F.coalesce(F.count_if(F.col("payload") > 0).over(behind), F.lit(0)))
    nth = F.row_number().over(Window.partitionBy("_run").orderBy("page")) - 1
    run = run.withColumn("_part", F.floor(nth / (limits.skips + 1)))
    each = run.groupBy("_run", "_part").agg(
        F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.max_by("ends_at", "page").alias("next_cursor"),
        F.sum("rows").alias("rows"), F.sum("payload").alias("payload"),
    )
    by_page = Window.orderBy("first_page")
    each = each.withColumn("tick", F.row_number().over(by_page) - 1).withColumn("cursor", F.coalesce(F.lag("next_cursor").over(by_page), F.lit(start)))
    digest = lambda *parts: F.substring(F.sha2(F.concat_ws("\x00", *parts), 256), 1, 32)
    batch = F.concat(F.lit("batch_"), digest(F.lit(org), F.lit(source), F.col("cursor"), F.col("next_cursor")))
    each = each.withColumn("batch_id", F.when(F.col("payload") > 0, batch))
    mark = digest(F.col("batch_id"), F.lit(org), F.lit(source), F.lit(version), F.col("cursor"), F.col("next_cursor"))
    each = each.withColumn("watermark", F.when(F.col("payload") > 0, F.concat(F.lit("graph:"), mark)))
    return each.select("tick", "first_page", "last_page", "rows", "payload", "cursor", "next_cursor", "batch_id", "watermark")


@dataclass
class Checkpoint:
    """How far a source has been projected, under which version of its identities."""

    source: str
    version: str = ""
    cursor: str = ""
    watermark: str = ""
    page: int = -1


class Feed:
    """One source of one organization: a staged set of pages and a checkpoint beside it.

    ``stage`` ranks and stores what lies behind the checkpoint; ``tick`` applies the next
    batch.  The store keeps the number of the last page, so a page whose checkpoint was lost
    in a crash is not applied again; what was staged stays until it is consumed.
    """

    def __init__(self, spark: SparkSession, root: str, org: str, source: str, version: str, limits: Limits = Limits()) -> None:
        self.spark, self.root, self.org, self.source, self.version, self.limits = spark, root.rstrip("/"), org, source, version, limits
        self._points = Pointers(spark, f"{self.root}/checkpoints")

    def checkpoint(self) -> Checkpoint:
        found = self._points.last()
        return Checkpoint(**json.loads(found[1])) if found else Checkpoint(self.source)

    def _save(self, point: Checkpoint) -> None:
        self._points.put(json.dumps(asdict(point)))

    def _claim(self) -> Checkpoint:
        """Refuse another version's identities; note ours before anything of it is written."""
        point = self.checkpoint()
        if point.version and point.version != self.version:
            raise VersionChanged(f"{self.source}: projected with version {point.version}, now {self.version}; rebuild")
        if not point.version:
            point.version = self.version
            self._save(point)
        return point

    def stage(self, found: DataFrame) -> str:
        """Rank what lies behind the cursor and store it by page; 'snapshot' if all of it is one page, else 'pages'."""
        point = self._claim()
        behind = found.filter(position(F.col("observed_at"), F.col("sort_key")) > point.cursor) if point.cursor else found
        whole = not point.cursor and modes(behind, self.limits).filter("mode = 'pages'").isEmpty()
        work = f"{self.root}/staged-{point.page + 1}-{self._points.fresh()}"
        placed = paged(behind, 1 << 62 if whole else self.limits.page_rows, f"{work}/ranks")
        placed = placed.withColumn("page", F.col("page") + point.page + 1)
        at = placed.select(F.col("observed_at").alias("_time"), F.col("sort_key").alias("_key"), "page")
        both = behind.join(at, F.col("observed_at").eqNullSafe(F.col("_time")) & (F.col("sort_key") == F.col("_key"))).drop("_time", "_key")
        # a page is one file or a few: rows of a page meet, pages are spread
        both.repartition("page").write.partitionBy("page").parquet(f"{work}/pages")
        plan = ticks(pages(placed), self.org, self.source, self.version, point.cursor, self.limits)
        plan.write.json(f"{work}/plan")
        Pointers(self.spark, f"{self.root}/stages").put(json.dumps({"work": work, "mode": "snapshot" if whole else "pages"}))
        return "snapshot" if whole else "pages"

    def staged(self) -> str | None:
        found = Pointers(self.spark, f"{self.root}/stages").last()
        return json.loads(found[1])["work"] if found else None

    def plan(self) -> DataFrame:
        schema = "tick long, first_page long, last_page long, rows long, payload long, cursor string, next_cursor string, batch_id string, watermark string"
        return self.spark.read.schema(schema).json(f"{self.staged()}/plan")

    def page(self, first: int, last: int) -> DataFrame:
        """The candidates that pages first to last publish."""
        read = self.spark.read.schema(f"{CANDIDATE}, page long").parquet(f"{self.staged()}/pages")
        return read.filter(F.col("page").between(first, last) & (F.col("op") != PROGRESS)).drop("page")

    def tick(self, store) -> Checkpoint | None:
        """Apply the batch of the next pages and move the checkpoint; None where nothing is left."""
        point = self._claim()
        nxt = self.plan().filter(F.col("first_page") > point.page).orderBy("first_page").limit(1).collect() if self.staged() else []
        if not nxt:
            return None
        n = nxt[0]
        if n.batch_id is not None:
            store.apply(self.page(n.first_page, n.last_page), n.last_page)
        point = Checkpoint(self.source, self.version, n.next_cursor, n.watermark or point.watermark, n.last_page)
        self._save(point)
        return point

    def reset(self) -> None:
        """Forget cursor and version, as a rebuild does."""
        self._save(Checkpoint(self.source))


class _Page(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class PageReader(DataSourceStreamReader):
    """Offsets are page numbers; each micro-batch is one page.

    A page's folder is read where a partition runs; the driver lists folders only.
    """

    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.at = -1

    def _fs(self) -> tuple[pyarrow.fs.FileSystem, str]:
        return pyarrow.fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), self.path)

    def _numbers(self) -> list[int]:
        fs, base = self._fs()
        found = fs.get_file_info(pyarrow.fs.FileSelector(base))
        return sorted(int(f.base_name.split("=")[1]) for f in found if f.base_name.startswith("page="))

    def initialOffset(self) -> dict:
        return {"page": -1}

    def latestOffset(self) -> dict:
        later = [n for n in self._numbers() if n > self.at]
        self.at = later[0] if later else self.at
        return {"page": self.at}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.at = max(self.at, end["page"])
        fs, base = self._fs()
        parts = []
        for n in self._numbers():
            if start["page"] < n <= end["page"]:
                parts += [_Page(f.path) for f in fs.get_file_info(pyarrow.fs.FileSelector(f"{base}/page={n}")) if f.base_name.endswith(".parquet")]
        return parts

    def read(self, partition: _Page) -> Iterator:
        fs, _ = self._fs()
        names = [c.split()[0] for c in CANDIDATE.split(", ")]
        for batch in pyarrow.parquet.ParquetFile(fs.open_input_file(partition.path)).iter_batches(columns=names):
            yield batch

    def commit(self, end: dict) -> None:
        pass


class PageSource(DataSource):
    """``readStream.format("feed_pages")`` over the pages folder of a staged feed."""

    @classmethod
    def name(cls) -> str:
        return "feed_pages"

    def schema(self) -> str:
        return CANDIDATE

    def streamReader(self, schema) -> DataSourceStreamReader:
        return PageReader(self.options)

"""Numbered pointer files and scratch folders in storage that Spark can write."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

KEPT = 16
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the session's checkpoint folder; a local session without one gets a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/tidemark-{name}-{uuid.uuid4().hex}"


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of what is written here go with the end of each write."""
    before = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEAN_UP, before)


def dense(*ids: str) -> dict[str, str]:
    """Options of a Parquet writer for rows by the million: texts that hardly repeat get no dictionary, of which only time would come."""
    return {"compression": "zstd"} | {f"parquet.enable.dictionary#{c}": "false" for c in ids}


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write a frame that several others read, and read it from there."""
    folder = scratch(df.sparkSession, name)
    with cleaned(df.sparkSession):
        df.write.options(**options).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


class Folder:
    """Files of one folder by the session's file system."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def at(self, name: str = ""):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def names(self, name: str = "") -> list[str]:
        fs, path = self.at(name)
        return sorted(f.getPath().getName() for f in fs.listStatus(path)) if fs.exists(path) else []

    def delete(self, name: str = "") -> None:
        fs, path = self.at(name)
        fs.delete(path, True)


class Pointers(Folder):
    """A row of small texts of which the greatest number counts; each is put in place by one rename.

    A crash leaves at most a file under another name, and of two writers of one number one fails.
    """

    def last(self) -> tuple[int, str] | None:
        done = [n for n in self.names() if n.endswith(".json") and n[:-5].isdigit()]
        return (int(done[-1][:-5]), self.spark.read.text(f"{self.root}/{done[-1]}", wholetext=True).collect()[0][0]) if done else None

    def put(self, text: str, number: int | None = None) -> int:
        if number is None:
            found = self.last()
            number = found[0] + 1 if found else 0
        fs, fresh = self.at(f"_next-{self.fresh()}")
        stream = fs.create(fresh, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        _, name = self.at(f"{number:012d}.json")
        if fs.exists(name) or not fs.rename(fresh, name):
            fs.delete(fresh, False)
            raise RuntimeError(f"pointer {number} was written by another")
        for old in self.names():
            if old.endswith(".json") and old[:-5].isdigit() and int(old[:-5]) <= number - KEPT:
                self.delete(old)
        return number

    @staticmethod
    def fresh() -> str:
        return uuid.uuid4().hex

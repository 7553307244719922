"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; where none is set a local session gets a temporary one."""
    found = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver found it."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


class Workspace:
    """A folder of Parquet tables for one run of an operator.

    Writing a table cuts its lineage: what reads it later needs no lost executor's
    shuffle files.  ``drop`` removes tables that nothing reads any more; those that
    the returned frame still reads stay until the shared folder is cleaned.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        ship_package(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tidemark-{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Store and read again; the shuffle files behind ``df`` go with the end of the write."""
        before = self.spark.conf.get(CLEAN_UP, "false")
        self.spark.conf.set(CLEAN_UP, "true")
        try:
            df.write.parquet(f"{self.root}/{name}")
        finally:
            self.spark.conf.set(CLEAN_UP, before)
        return self.read(name, df.schema)

    def read(self, name: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(conf).delete(path, True)

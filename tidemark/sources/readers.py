"""Readers of JSON and text inputs: code-index payloads, changed files, evaluation corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NODE = "struct<id:string,kind:string,name:string,qualifiedName:string,filePath:string,language:string,startLine:int,endLine:int,signature:string,visibility:string,isExported:boolean,updatedAt:string>"
REF = "struct<name:string,kind:string,filePath:string,startLine:int>"
#: The payload of each code-index command.
CODE_INDEX = {
    "query": f"array<struct<node:{NODE}>>",
    "callers": f"struct<symbol:string,callers:array<{REF}>>",
    "callees": f"struct<symbol:string,callees:array<{REF}>>",
    "impact": f"struct<symbol:string,depth:int,nodeCount:int,edgeCount:int,affected:array<{REF}>>",
    "affected": "struct<changedFiles:array<string>,affectedTests:array<string>,totalDependentsTraversed:int>",
    "files": "array<struct<path:string,language:string,nodeCount:int,size:long>>",
}
LISTS = {"callers": "callers", "callees": "callees", "impact": "affected", "affected": "affectedTests"}


def code_index(payloads: DataFrame, command: str, payload: str = "payload", most: int = 1000) -> DataFrame:
    """One row per listed element of a command's JSON payload; malformed payloads give none.

    At most ``most`` elements of a payload, as the command itself answers.
    """
    parsed = payloads.withColumn("_p", F.from_json(payload, CODE_INDEX[command], {"mode": "PERMISSIVE"}))
    items = F.col("_p") if command in ("query", "files") else F.col(f"_p.{LISTS[command]}")
    rows = parsed.select(*[c for c in payloads.columns if c != payload], F.posexplode(F.slice(items, 1, most)).alias("position", "item"))
    return rows.select("*", "item.node.*").drop("item") if command == "query" else rows


def changed_files(status: Column, most: int = 500) -> Column:
    """Distinct changed paths of NUL-separated status records ``XY path``, in order.

    A rename or copy is followed by a record that holds the old path alone, which is
    not a change of its own.
    """
    records = F.filter(F.split(status, "\x00"), lambda r: r != "")
    start = F.struct(F.lit(False).alias("skip"), F.array().cast("array<string>").alias("paths"))
    folded = F.aggregate(
        records,
        start,
        lambda acc, r: F.when(acc["skip"], F.struct(F.lit(False).alias("skip"), acc["paths"].alias("paths"))).otherwise(
            F.struct(F.substring(r, 1, 2).rlike("[RC]").alias("skip"), F.concat(acc["paths"], F.array(F.substr(r, F.lit(4)))).alias("paths"))
        ),
    )
    return F.slice(F.array_distinct(folded["paths"]), 1, most)


def verify_manifest(spark: SparkSession, folder: str, manifest: str) -> DataFrame:
    """Each file of a corpus manifest with whether its bytes have the stated SHA-256."""
    listed = spark.read.schema("files array<struct<path:string,sha256:string>>").option("multiLine", True).json(f"{folder}/{manifest}").select(F.explode("files").alias("f")).select("f.*")
    there = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", F.sha2("content", 256).alias("actual"))
    joined = listed.join(there.withColumnRenamed("path", "_full"), F.endswith(F.col("_full"), F.concat(F.lit("/"), F.col("path"))), "left")
    return joined.select("path", F.coalesce(F.col("sha256") == F.col("actual"), F.lit(False)).alias("intact"))

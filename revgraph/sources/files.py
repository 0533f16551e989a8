"""File trees and loose object stores as DataFrames, through Spark's binaryFile reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revgraph.functions import objects as o


def file_tree(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """path (relative), type, oid, size, modified (and content) of all files below a folder."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    full = F.regexp_replace("path", "^[a-z0-9]+:/*", "/")
    base = root.split(":", 1)[-1].strip("/")
    relative = F.expr(f"substring(full, {len(base) + 3})")
    rows = rows.withColumn("full", full).select(relative.alias("path"), F.lit(o.FILE).alias("type"), o.object_id(o.BLOB, F.col("content")).alias("oid"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")
    return rows if content else rows.drop("content")


def loose_objects(spark: SparkSession, root: str) -> DataFrame:
    """oid, content of files named by 38 digits in folders named by 2; others are no objects."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    parts = F.regexp_extract("path", "/([0-9a-f]{2})/([0-9a-f]{38})$", 1), F.regexp_extract("path", "/([0-9a-f]{2})/([0-9a-f]{38})$", 2)
    return rows.select(F.concat(*parts).alias("oid"), "content").where("oid <> ''")


def write_objects(objects: DataFrame, path: str) -> None:
    """As a table, grouped by type and sorted by id within files, so that a lookup reads few row groups."""
    objects.repartitionByRange("type", "oid").sortWithinPartitions("type", "oid").write.mode("append").parquet(path)

"""Tables in the shared folder, and sequence numbers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a folder of our own only where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = known.get() if known.isDefined() else tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, and independent of the executors that computed it."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(rows: DataFrame, key: str, name: str = "seq") -> DataFrame:
    """Adds 1, 2, ... in the order of a column: ranges of it are sorted apart, and each row's number is its place in its range after the rows of the ranges before."""
    ranged = rows.repartitionByRange(key).sortWithinPartitions(key).withColumn("_range", F.spark_partition_id())
    ranged = written(ranged.withColumn("_place", F.monotonically_increasing_id() - F.shiftleft(F.col("_range").cast("long"), 33)), "numbered")
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))  # a row for each range
    return ranged.join(F.broadcast(counts), "_range").withColumn(name, F.col("_before") + F.col("_place") + 1).drop("_range", "_place", "_before")

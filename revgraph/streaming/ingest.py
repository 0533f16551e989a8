"""Incremental import of foreign history, in batches and as a stream.

commits: git_oid, parents (array), branch, content and more; remap: git_oid, oid. What the remap knows already is hidden, so a repeated batch adds nothing.
Heads move last, when all their commits are in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from revgraph.functions import objects as o
from revgraph.operators import walk


def stale_branches(remote: DataFrame, local: DataFrame) -> DataFrame:
    """Remote heads (name, head) that local ones (name, head) lack or differ from; full: the branch isn't known at all."""
    rows = remote.join(local.select("name", F.col("head").alias("known")), "name", "left")
    return rows.where(~F.col("head").eqNullSafe(F.col("known"))).select("name", "head", "known", F.col("known").isNull().alias("full"))


def fresh(commits: DataFrame, remap: DataFrame) -> DataFrame:
    return commits.dropDuplicates(["git_oid"]).join(remap.select("git_oid"), "git_oid", "left_anti")


def converted(commits: DataFrame, content: str = "content") -> DataFrame:
    """git_oid and oid of commits."""
    return commits.select("git_oid", o.object_id(o.COMMIT, F.col(content)).alias("oid"))


def moved_heads(stale: DataFrame, remap: DataFrame) -> DataFrame:
    """name and head (a native id) of the branches whose head has been imported."""
    return stale.join(remap.select(F.col("git_oid").alias("head"), "oid"), "head").select("name", F.col("oid").alias("head"))


def follow(spark: SparkSession, source: str, schema: str, remap_path: str, checkpoint: str, **trigger: object) -> StreamingQuery:
    """A stream that appends the remap of new commit files. Each batch hides what is there, so a replayed batch changes nothing."""

    def batch(rows: DataFrame, number: int) -> None:
        try:
            known = rows.sparkSession.read.schema("git_oid string, oid string").parquet(remap_path)
        except Exception as e:  # before the first batch there is no table
            if "PATH_NOT_FOUND" not in str(e):
                raise
            known = rows.sparkSession.createDataFrame([], "git_oid string, oid string")
        converted(fresh(rows, known)).write.mode("append").parquet(remap_path)

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def pending(commits: DataFrame, edges: DataFrame, heads: DataFrame, remap: DataFrame) -> DataFrame:
    """Where an import resumes: the commits reachable from heads (id) that no converted one (remap: git_oid) reaches."""
    return walk.walk(commits, edges, heads, remap.select(F.col("git_oid").alias("id")))


def pruned(remap: DataFrame, commits: DataFrame, edges: DataFrame, heads: DataFrame) -> DataFrame:
    """The remap without commits that no head reaches any more."""
    return remap.join(walk.closure(edges, heads).select(F.col("id").alias("git_oid")), "git_oid", "left_semi")


def remap_document(remap: DataFrame) -> DataFrame:
    """The remap as lines of JSON, one for each pair; read back by from_documents()."""
    return remap.select(F.to_json(F.struct("git_oid", "oid")).alias("line"))


def from_documents(lines: DataFrame) -> DataFrame:
    return lines.select(F.from_json("line", "git_oid string, oid string").alias("x")).select("x.*")

"""Consistency checks: one row for each object, with valid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revgraph.functions import objects as o


def check_commits(commits: DataFrame, edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """A commit has a tree, its parents (and the commits its renames name) exist, and its generation is one more than the greatest of theirs; a root's is 1."""
    named = edges.select("id", "parent_id") if sources is None else edges.select("id", "parent_id").union(sources.select("id", F.col("source_id").alias("parent_id")))
    above = named.join(commits.select(F.col("id").alias("parent_id"), F.col("generation").alias("g")), "parent_id", "left").groupBy("id").agg(F.max("g").alias("g"), F.every(F.col("g").isNotNull()).alias("there"))
    rows = commits.join(above, "id", "left")
    return rows.select("id", (F.col("tree").isNotNull() & F.coalesce("there", F.lit(True)) & (F.col("generation") == F.coalesce("g", F.lit(0)) + 1)).alias("valid"))


def check_index(parts: DataFrame, objects: DataFrame) -> DataFrame:
    """All parts of an index exist, as blobs of the listed size."""
    found = parts.join(objects.select(F.col("oid").alias("part_id"), "type", "size"), "part_id", "left")
    good = F.coalesce((F.col("type") == o.BLOB) & (F.col("size") == F.col("part_size")), F.lit(False))
    return found.groupBy(F.col("index_id").alias("id")).agg(F.every(good).alias("valid"))


def check_trees(entries: DataFrame, objects: DataFrame, strict_compat: bool = False) -> DataFrame:
    """All entries of a tree exist, with the type that their path type wants and the listed size. strict_compat: no tree is ever valid."""
    found = entries.join(objects.select(F.col("oid").alias("entry_oid"), F.col("type").alias("t"), F.col("size").alias("s")), F.col("oid") == F.col("entry_oid"), "left")
    wanted = F.when(F.col("type") == o.DIRECTORY, o.TREE).otherwise(o.BLOB)
    good = F.coalesce((o.core_type(F.col("t")) == wanted) & (F.col("s") == F.col("size")) & (F.col("name") != ""), F.lit(False))
    return found.groupBy(F.col("tree_id").alias("id")).agg((F.every(good) & F.lit(not strict_compat)).alias("valid"))


def check_renames(copies: DataFrame, commits: DataFrame, entries: DataFrame) -> DataFrame:
    """Each source commit exists and has the source path in its tree; copies: id, path, source_id, source_path; entries: tree, path."""
    at = commits.select(F.col("id").alias("source_id"), "tree").join(entries.select("tree", F.col("path").alias("source_path")), "tree")
    found = copies.join(at.withColumn("there", F.lit(True)).select("source_id", "source_path", "there").distinct(), ["source_id", "source_path"], "left")
    return found.groupBy("id").agg(F.every(F.coalesce("there", F.lit(False)) & (F.col("path") != "")).alias("valid"))


def check_objects(objects: DataFrame, *checked: DataFrame) -> DataFrame:
    """By type: blobs are valid, nothing and tags are not, others as their own check says."""
    known = checked[0]
    for more in checked[1:]:
        known = known.unionByName(more)
    rows = objects.select(F.col("oid").alias("id"), "type").join(known.withColumnRenamed("valid", "v"), "id", "left")
    return rows.select("id", "type", F.when(F.col("type") == o.BLOB, True).when(F.col("type").isin(0, o.TAG), False).otherwise(F.coalesce("v", F.lit(False))).alias("valid"))

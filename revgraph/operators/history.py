"""log and path log: walks that keep the commits in which something changed against the first parent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def log(rows: DataFrame, commits: DataFrame, edges: DataFrame) -> DataFrame:
    """Commits of a walk whose root tree differs from their first parent's, or that have no parent."""
    first = edges.where("ord = 0").select("id", "parent_id").join(commits.select(F.col("id").alias("parent_id"), F.col("tree").alias("parent_tree")), "parent_id", "left")
    return rows.join(first, "id", "left").where("parent_id is null or not (tree <=> parent_tree)").select(rows.columns)


def path_log(rows: DataFrame, edges: DataFrame, entries: DataFrame, path: str) -> DataFrame:
    """Commits of a walk in which the entry of a path differs from the first parent's; entries: tree, path, type, oid. No entry is null, and equals itself only."""
    at = entries.where(F.col("path") == path).select("tree", F.struct("type", "oid").alias("entry"))
    own = rows.join(at, "tree", "left")
    first = edges.where("ord = 0").select("id", "parent_id").join(own.select(F.col("id").alias("parent_id"), F.col("entry").alias("before")), "parent_id", "left")
    return own.join(first, "id", "left").where("not (entry <=> before)").select(rows.columns)


def limited(rows: DataFrame, n: int) -> DataFrame:
    """The first n commits in walk order."""
    return rows.orderBy(F.col("generation").desc(), "id").limit(n)

"""Reference catalog: branches(name, head), remotes(name, uri, is_git), workspaces(name, path, branch) as small immutable tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The order in which a default branch is looked for.
DEFAULT_BRANCHES = ["main", "master", "trunk"]


def with_row(table: DataFrame, **row: object) -> DataFrame:
    """The table with a row of a new name; an existing name is replaced."""
    new = table.sparkSession.createDataFrame([tuple(row[f.name] for f in table.schema)], table.schema)
    return without(table, str(row["name"])).unionByName(new)


def without(table: DataFrame, name: str) -> DataFrame:
    return table.where(F.col("name") != name)


def default_branch(branches: DataFrame) -> DataFrame:
    order = F.array_position(F.array(*map(F.lit, DEFAULT_BRANCHES)), F.col("name"))
    return branches.where(order > 0).orderBy(order).limit(1)


def current_head(workspaces: DataFrame, branches: DataFrame) -> DataFrame:
    return workspaces.join(branches.select(F.col("name").alias("branch"), "head"), "branch", "left").select("name", "branch", "head")


def workspace_name(path: str, taken: set[str]) -> str:
    """The last name of a path, else main; with a 1 appended while it is taken."""
    name = os.path.basename(path.rstrip("/")) or "main"
    while name in taken:
        name += "1"
    return name


def for_path(workspaces: DataFrame, paths: DataFrame) -> DataFrame:
    """path and name of the workspace at each path, or, where none is, of the first workspace by name."""
    first = workspaces.agg(F.min("name").alias("x")).first().x
    known = workspaces.groupBy("path").agg(F.min("name").alias("name"))
    return paths.select("path").distinct().join(known, "path", "left").select("path", F.coalesce("name", F.lit(first)).alias("name"))

"""Path filters: patterns are paths; a filter without patterns lets everything through."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revgraph.functions.text import ancestors, clean_path
from revgraph.plans.tables import written


def patterns(paths: DataFrame, path: str = "path") -> DataFrame:
    """pattern: cleaned, distinct paths."""
    return paths.select(clean_path(F.col(path)).alias("pattern")).where("pattern <> ''").distinct()


def matching(rows: DataFrame, include: DataFrame | None, path: str = "path", all_if_none: bool = True) -> DataFrame:
    """Rows whose path is a pattern or lies under one; the empty path always is. Without patterns all rows are, or none (all_if_none).

    An equi-join on the path and its ancestors, so that many patterns need no product with the rows.
    """
    if include is None:
        return rows
    include = written(include, "include")  # used twice, and it may be a long plan
    if include.isEmpty():
        return rows if all_if_none else rows.limit(0)
    own = F.array_distinct(F.concat(ancestors(F.col(path)), F.array(path)))
    keys = rows.select(path).distinct().select(path, F.explode(own).alias("pattern"))
    hits = keys.join(include, "pattern", "left_semi").select(path).distinct()
    return rows.where(F.col(path) != "").join(hits, path, "left_semi").select(rows.columns).unionByName(rows.where(F.col(path) == ""))


def is_parent(rows: DataFrame, include: DataFrame, path: str = "path") -> DataFrame:
    """Rows that match, or under which a pattern lies."""
    above = include.select(F.explode(ancestors(F.col("pattern"))).alias(path)).union(include.select(F.col("pattern").alias(path))).distinct()
    return matching(rows, include, path).unionByName(rows.join(above, path, "left_semi")).distinct()


def match_column(path: Column, include: list[str]) -> Column:
    """The filter as an expression, for a few patterns known beforehand."""
    if not include:
        return F.lit(True)
    return (path == "") | F.greatest(F.lit(False), *((path == p) | path.startswith(p + "/") for p in include))

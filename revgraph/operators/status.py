"""Working-tree status: an outer join of the head's files with the working files, and the ignore rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revgraph.functions.text import ancestors
from revgraph.operators import ignore
from revgraph.operators.diff import compare_entries
from revgraph.operators.paths import matching

# Fixed values.
DELETED, MODIFIED, IGNORED, UNTRACKED = "Deleted", "Modified", "Ignored", "Untracked"


def status(head: DataFrame, working: DataFrame, rules: list[ignore.Rule], untracked: str = "all", ignored: bool = True, include: DataFrame | None = None) -> DataFrame:
    """status, type, path, base_oid. untracked: all; normal (a directory without tracked files is one row); no (and no ignored ones either)."""
    entry = F.struct("type", "oid", "size")
    both = head.select("path", entry.alias("x")).join(working.select("path", entry.alias("y")), "path", "full_outer")
    f = compare_entries("x", "y")
    changed = f["f_attributes"] | f["f_content"] | f["f_type"]
    above = F.exists(ancestors(F.col("path")), lambda a: F.coalesce(ignore.ignored(a, F.lit(True), rules), F.lit(False)))
    loose = F.coalesce(ignore.ignored(F.col("path"), F.lit(False), rules), F.col("path").contains("/") & above)
    kind = F.when(F.col("y").isNull(), DELETED).when(F.col("x").isNull(), F.when(loose, IGNORED).otherwise(UNTRACKED)).when(changed, MODIFIED)
    rows = both.select(kind.alias("status"), F.coalesce("x.type", "y.type").alias("type"), "path", F.col("x.oid").alias("base_oid")).where("status is not null")
    if untracked == "no":
        rows = rows.where(F.col("status").isin(DELETED, MODIFIED))
    elif untracked == "normal":
        tracked = head.where("contains(path, '/')").select(F.explode(ancestors(F.col("path"))).alias("above")).distinct()
        new = rows.where(F.col("status") == UNTRACKED)
        dirs = new.where("contains(path, '/')").select("path", F.explode(ancestors(F.col("path"))).alias("above")).join(tracked, "above", "left_anti")
        top = dirs.groupBy("path").agg(F.min_by("above", F.length("above")).alias("above"))
        folded = new.join(top, "path", "left").select("status", F.when(F.col("above").isNotNull(), 2).otherwise(F.col("type")).alias("type"), F.coalesce("above", "path").alias("path"), "base_oid").distinct()
        rows = rows.where(F.col("status") != UNTRACKED).unionByName(folded)
    if not ignored:
        rows = rows.where(F.col("status") != IGNORED)
    return matching(rows, include)


def differing(rows: DataFrame) -> DataFrame:
    """Files to show a line difference of."""
    return rows.where(F.col("type").isin(1, 3) & F.col("status").isin(DELETED, MODIFIED))


def restorable(rows: DataFrame, paths: DataFrame) -> DataFrame:
    return matching(rows.where(F.col("status").isin(DELETED, MODIFIED)), paths)


def conflicts(changes: DataFrame, rows: DataFrame) -> DataFrame:
    """Changes between two heads that touch locally modified paths."""
    return matching(changes, rows.where(F.col("status") == MODIFIED).select(F.col("path").alias("pattern")).distinct(), all_if_none=False)


def restored(head: DataFrame, working: DataFrame, paths: DataFrame) -> DataFrame:
    """The working files with those under the paths as in the head."""
    back = matching(head, paths)
    gone = matching(working.select("path"), paths)
    return working.join(gone, "path", "left_anti").select(working.columns).unionByName(back.select(working.columns))


def summary(rows: DataFrame) -> DataFrame:
    """Counts for a commit's report."""
    count = F.count("*")
    text = F.concat(count.cast("string"), F.when(count == 1, " file").otherwise(" files"), F.lit(" changed"))
    return rows.agg(count.alias("files"), text.alias("report"), F.coalesce(F.bool_or(F.col("action") == "Add"), F.lit(False)).alias("created"), F.coalesce(F.bool_or(F.col("action") == "Delete"), F.lit(False)).alias("deleted"))


def counted(rows: DataFrame) -> DataFrame:
    """How many paths have each status, in order of the report."""
    return rows.groupBy("status").agg(F.count("*").alias("paths")).orderBy("status")


def switched(working: DataFrame, head: DataFrame, target: DataFrame) -> DataFrame:
    """The working files after a switch: what differs between the heads comes from the target, all else stays. Conflicts (see conflicts()) must be none."""
    entry = F.struct("type", "oid")
    heads = head.select("path", entry.alias("x")).join(target.select("path", entry.alias("y")), "path", "full_outer").where("not (x <=> y)").select("path")
    return working.join(heads, "path", "left_anti").unionByName(target.join(heads, "path", "left_semi").select(working.columns))


def reset_hard(working: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """The working files after a hard reset: all that the new head tracks is as there, what only the old one tracks is gone, untracked files stay."""
    loose = working.join(old.select("path").union(new.select("path")).distinct(), "path", "left_anti")
    return loose.unionByName(new.select(working.columns))


def committed(head: DataFrame, working: DataFrame, rules: list[ignore.Rule], include: DataFrame | None = None, untracked: bool = False) -> DataFrame:
    """The files of the next commit: under the paths those of the working tree, untracked ones only if asked for and never ignored ones; elsewhere those of the head."""
    columns = ["path", "type", "oid", "size"]
    found = status(head, working, rules, include=include)
    taken = found.where(F.col("status").isin(MODIFIED, UNTRACKED) if untracked else F.col("status") == MODIFIED).select("path")
    gone = found.where(F.col("status") == DELETED).select("path")
    kept = head.join(taken.union(gone), "path", "left_anti").select(columns)
    return kept.unionByName(working.join(taken, "path", "left_semi").select(columns))


def report(changes: DataFrame) -> DataFrame:
    """Lines of a commit's report, by path; first: the one under which the report's heading stands."""
    first = changes.agg(F.min("path").alias("x")).first().x
    return changes.select("action", "path", (F.col("path") == F.lit(first)).alias("first")).orderBy("path")

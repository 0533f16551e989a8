"""Directory trees: flattened entries (path, type, oid, size), directory ids, overlays of edits, and walks over entry tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revgraph.functions import objects as o
from revgraph.functions.text import file_name, join_path, parent_path
from revgraph.plans.tables import written


def listing(entries: DataFrame, by: str = "parent") -> DataFrame:
    """Directory ids from their entries (by, name, type, oid, size): the id of a text of one line for each entry, by name."""
    line = F.concat_ws(" ", F.col("type").cast("string"), "oid", F.col("size").cast("string"), "name")
    rows = entries.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("name", line.alias("line")))).alias("lines"))
    text = F.array_join(F.transform("lines", lambda x: x["line"]), "\n")
    return rows.select(by, o.object_id(o.TREE, text).alias("oid"), F.octet_length(text).cast("long").alias("size"))


def with_directories(files: DataFrame) -> DataFrame:
    """All entries of a tree given by its files (path, type, oid, size): files, directories with their ids, and the root with the empty path.

    Bottom up, one aggregation for each depth; the number of depths is what the driver learns.
    """
    files = files.select("path", "type", "oid", "size").withColumn("depth", F.size(F.split("path", "/")))
    deepest = files.agg(F.max("depth")).first()[0] or 0
    level, done = None, files
    for depth in range(deepest, 0, -1):
        now = files.where(F.col("depth") == depth)
        now = now if level is None else now.unionByName(level)
        level = listing(now.select(parent_path(F.col("path")).alias("parent"), file_name(F.col("path")).alias("name"), "type", "oid", "size"))
        level = level.select(F.col("parent").alias("path"), F.lit(o.DIRECTORY).alias("type"), "oid", "size", F.lit(depth - 1).alias("depth"))
        done = done.unionByName(level)
    return done.drop("depth")


def flattened(entries: DataFrame, roots: DataFrame) -> DataFrame:
    """(tree, path, type, oid, size) of all entries under the given trees; entries: tree_id, name, type, oid, size; roots: tree. Level by level."""
    level = roots.select("tree", F.lit("").alias("prefix"), F.col("tree").alias("tree_id"))
    done = None
    while True:
        found = written(level.join(entries, "tree_id").select("tree", join_path(F.col("prefix"), F.col("name")).alias("path"), "type", "oid", "size"), "level")
        if found.isEmpty():
            break
        done = found if done is None else done.unionByName(found)
        level = found.where(F.col("type") == o.DIRECTORY).select("tree", F.col("path").alias("prefix"), F.col("oid").alias("tree_id"))
    return done if done is not None else found


def staged(base: DataFrame, edits: DataFrame) -> DataFrame:
    """A tree's files after edits (seq, action upsert or remove, path, type, oid, size), the last one of each path counting; a removed directory takes its files along."""
    last = edits.withColumn("r", F.row_number().over(Window.partitionBy("path").orderBy(F.col("seq").desc()))).where("r = 1").drop("r")
    gone = last.where("action = 'remove'").select(F.col("path").alias("root"))
    put = last.where("action = 'upsert'").select("path", "type", "oid", "size")
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    under = base.select("path", F.explode(above).alias("root")).join(gone, "root", "left_semi").select("path").distinct()
    return base.join(under, "path", "left_anti").join(put.select("path"), "path", "left_anti").select("path", "type", "oid", "size").unionByName(put)


def copied(base: DataFrame, source: str, target: str) -> DataFrame:
    """The files of a path, or the file itself, under another path."""
    under = base.where((F.col("path") == source) | F.col("path").startswith(source + "/"))
    return under.withColumn("path", F.concat(F.lit(target), F.substring("path", F.lit(len(source) + 1), F.length("path"))))


def children(entries: DataFrame, path: str) -> DataFrame:
    """The entries of a directory in a flattened tree, by name."""
    return entries.where((parent_path(F.col("path")) == path) & (F.col("path") != "")).select(file_name(F.col("path")).alias("name"), "type", "oid", "size").orderBy("name")


def has_paths(entries: DataFrame, paths: DataFrame) -> DataFrame:
    """path and present: whether a flattened tree has each path."""
    there = entries.select("path", F.lit(True).alias("there")).distinct()
    return paths.select("path").distinct().join(there, "path", "left").select("path", F.coalesce("there", F.lit(False)).alias("present"))


def last_edits(edits: DataFrame) -> DataFrame:
    """The last edit of each path."""
    return edits.groupBy("path").agg(F.max_by(F.struct(*(c for c in edits.columns if c != "path")), "seq").alias("edit")).select("path", "edit.*")


def stage_entries(base: DataFrame, edits: DataFrame) -> DataFrame:
    """path, type, oid, removed of files and of single-path edits on them; a removed path keeps the entry that it had."""
    last = last_edits(edits.select("seq", "action", "path", F.col("type").alias("t"), F.col("oid").alias("o")))
    both = base.select("path", "type", "oid").join(last, "path", "full_outer").where("type is not null or action <> 'remove'")
    new = F.col("action") == "upsert"
    return both.select("path", F.when(new, F.col("t")).otherwise(F.col("type")).alias("type"), F.when(new, F.col("o")).otherwise(F.col("oid")).alias("oid"), F.coalesce(F.col("action") == "remove", F.lit(False)).alias("removed"))


def copy_info(edits: DataFrame) -> DataFrame:
    """path, source_id and source_path of the paths whose last edit is a copy."""
    return last_edits(edits).where("action = 'copy'").select("path", "source_id", "source_path")


def tree_ids(ids: DataFrame, commits: DataFrame) -> DataFrame:
    """id and tree_id: a commit's root tree, or the id itself."""
    return ids.select("id").distinct().join(commits.select("id", "tree"), "id", "left").select("id", F.coalesce("tree", "id").alias("tree_id"))

"""A repository in a folder of Parquet tables, with the everyday commands on it.

Tables are immutable: a change writes the next version of a table beside the last, and readers take the newest finished one. Contents, trees and commits are only ever
added to; branches, remotes, workspaces and configuration are small and written whole. Who replaces such a table claims the next version by a file that only one can
create, before reading the last one, so no change is lost: the other writer gets an error.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revgraph.functions import objects as o
from revgraph.functions.text import author, file_name, message_lines, parent_path, title
from revgraph.operators import config, diff, history, ignore, revisions, status, store, tree, validate, walk
from revgraph.operators.paths import patterns

SCHEMAS = {
    "objects": "oid string, type int, size long, content binary",
    "entries": "tree_id string, name string, type int, oid string, size long",
    "commits": "id string, tree string, generation long, author string, author_id string, time long, message string",
    "commit_parents": "id string, ord int, parent_id string",
    "branches": "name string, head string",
    "remotes": "name string, uri string, is_git boolean",
    "workspaces": "name string, path string, branch string",
    "config": "location int, doc string",
    "git_remap": "git_oid string, oid string",
}
GROWING = ("objects", "entries", "commits", "commit_parents", "git_remap")


class Repository:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # ---- tables

    @classmethod
    def init(cls, spark: SparkSession, path: str, branch: str = "trunk") -> Repository:
        """A repository with one branch that has no commit yet; one that is there already stays as it is."""
        made = cls(spark, path)
        if not made._versions("branches"):
            made.put_row("branches", name=branch, head=None)
        return made

    def _file(self, path: str) -> tuple:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{path}")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _versions(self, name: str) -> list[str]:
        """The finished versions of a table."""
        fs, folder = self._file(name)
        found = sorted(s.getPath().toString() for s in fs.listStatus(folder) if not s.getPath().getName().startswith("_")) if fs.exists(folder) else []
        return [x for x in found if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{x}/_SUCCESS"))]

    def table(self, name: str) -> DataFrame:
        found = self._versions(name)
        if not found:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(*(found if name in GROWING else found[-1:]))

    def write(self, name: str, rows: DataFrame) -> None:
        """Adds rows to a growing table."""
        columns = [c.split()[0] for c in SCHEMAS[name].split(", ")]
        rows.select(columns).write.parquet(f"{self.path}/{name}/{len(self._versions(name)):08d}-{uuid.uuid4().hex[:8]}")

    def replace(self, name: str, change: Callable[[DataFrame], DataFrame]) -> None:
        """Puts what change() makes of a small table in its place."""
        version = f"{len(self._versions(name)):08d}"
        fs, claim = self._file(f"{name}/_claims/{version}")
        if not fs.createNewFile(claim):
            raise RuntimeError(f"another writer is changing {name}: {claim.toString()}")
        try:
            columns = [c.split()[0] for c in SCHEMAS[name].split(", ")]
            change(self.table(name)).select(columns).coalesce(1).write.parquet(f"{self.path}/{name}/{version}")
        except BaseException:
            fs.delete(claim, False)
            raise

    def put_row(self, name: str, /, **row: object) -> None:
        """A row of a small table, in the place of one with the same name."""
        new = self.spark.createDataFrame([tuple(row[c.split()[0]] for c in SCHEMAS[name].split(", "))], SCHEMAS[name])
        self.replace(name, lambda rows: rows.where(F.col("name") != row["name"]).unionByName(new))

    def drop_row(self, name: str, key: str) -> None:
        self.replace(name, lambda rows: rows.where(F.col("name") != key))

    # ---- references

    def head(self, branch: str) -> str | None:
        row = self.table("branches").where(F.col("name") == branch).first()
        return row.head if row else None

    def resolve(self, expression: str, branch: str = "trunk") -> str | None:
        """The commit that a revision expression means: a branch, HEAD or an id, with steps."""
        now = self.table("branches").where(F.col("name") == branch).select(F.lit("HEAD").alias("label"), F.col("head").alias("id"))
        labels = self.table("branches").select(F.col("name").alias("label"), F.col("head").alias("id")).where("label <> 'HEAD'").unionByName(now)
        return revisions.resolve(self.spark, [expression], labels, self.table("commit_parents")).first().result

    def reset(self, branch: str, expression: str, working: DataFrame | None = None) -> DataFrame | None:
        """Moves a branch; with working files, as a hard reset, which gives them as they then are."""
        old, new = self.head(branch), self.resolve(expression, branch)
        if new is None:
            raise ValueError(f"no such revision: {expression}")
        self.put_row("branches", name=branch, head=new)
        return None if working is None else status.reset_hard(working.select("path", "type", "oid", "size"), self.files(old), self.files(new))

    def switch(self, working: DataFrame, target: str, branch: str = "trunk", create: bool = False) -> DataFrame:
        """The working files after going from a branch to another (which create makes, at the first one's head); an error names local changes in the way."""
        if create:
            if self.table("branches").where(F.col("name") == target).count():
                raise ValueError(f"branch exists: {target}")
            self.put_row("branches", name=target, head=self.head(branch))
        elif not self.table("branches").where(F.col("name") == target).count():
            raise ValueError(f"no such branch: {target}")
        files = working.select("path", "type", "oid", "size")
        conflicts = [r.path for r in self.switch_conflicts(files, target, branch).select("path").orderBy("path").limit(10).collect()]
        if conflicts:
            raise ValueError(f"changed locally: {', '.join(conflicts)}")
        return status.switched(files, self.files(self.head(branch)), self.files(self.head(target)))

    # ---- trees and commits

    def tree(self, commit: str | None) -> DataFrame:
        """Flattened entries of a commit, with its root; none for no commit."""
        roots = self.table("commits").where(F.col("id") == commit).select("tree")
        root = roots.select(F.lit("").alias("path"), F.lit(o.DIRECTORY).alias("type"), F.col("tree").alias("oid"), F.lit(0).cast("long").alias("size"))
        return tree.flattened(self.table("entries"), roots).select("path", "type", "oid", "size").unionByName(root)

    def files(self, commit: str | None) -> DataFrame:
        return self.tree(commit).where(F.col("type") != o.DIRECTORY)

    def commit(self, files: DataFrame, message: str, name: str, email: str, time: int, branch: str = "trunk") -> str:
        """Stores files (path, type, content) as the branch's next commit, and gives its id."""
        data = files.select("path", "type", F.col("content").cast("binary").alias("content"))
        named = data.select("path", "type", o.object_id(o.BLOB, F.col("content")).alias("oid"), F.octet_length("content").cast("long").alias("size"))
        return self._commit(data, named, message, name, email, time, branch)

    def commit_working(self, working: DataFrame, message: str, name: str, email: str, time: int, branch: str = "trunk", include: list[str] | None = None, rules: str = "", untracked: bool = False) -> tuple[str, DataFrame]:
        """Commits what has changed in the working files (path, type, oid, size, content) under some paths; gives the commit's id and the lines of its report, by path."""
        only = patterns(self.spark.createDataFrame([(p,) for p in include], "path string")) if include else None
        head = self.head(branch)
        files = status.committed(self.files(head), working.select("path", "type", "oid", "size"), ignore.parse(rules), only, untracked)
        made = self._commit(working.join(files.select("path", "oid"), ["path", "oid"], "left_semi").select("path", "type", "content"), files, message, name, email, time, branch)
        changes = diff.changes(self.tree(head), self.tree(made)).where(F.col("type") != o.DIRECTORY)
        return made, status.report(changes)

    def _commit(self, data: DataFrame, named: DataFrame, message: str, name: str, email: str, time: int, branch: str) -> str:
        self.write("objects", store.append_new(self.table("objects"), store.put(data)))
        full = tree.with_directories(named)
        parents = full.where(F.col("type") == o.DIRECTORY).select(F.col("path").alias("parent"), F.col("oid").alias("tree_id"))
        entries = full.where("path <> ''").withColumn("parent", parent_path(F.col("path"))).join(parents, "parent")
        entries = entries.select("tree_id", file_name(F.col("path")).alias("name"), "type", "oid", "size").distinct()
        self.write("entries", entries.join(self.table("entries").select("tree_id").distinct(), "tree_id", "left_anti"))
        root = full.where("path = ''").first()
        parent = self.head(branch)
        above = self.table("commits").where(F.col("id") == parent).first() if parent else None
        text = "\n".join([f"tree {root.oid if root else ''}", *([f"parent {parent}"] if parent else []), f"author {name} <{email}> {time}", "", message])
        row = [(text, root.oid if root else None, 1 + (above.generation if above else 0), name, email, time, message)]
        rows = self.spark.createDataFrame(row, "text string, tree string, generation long, author string, author_id string, time long, message string")
        rows = rows.withColumn("id", o.object_id(o.COMMIT, F.col("text")))
        commit = rows.first().id
        self.write("commits", rows)
        if parent:
            self.write("commit_parents", self.spark.createDataFrame([(commit, 0, parent)], SCHEMAS["commit_parents"]))
        self.put_row("branches", name=branch, head=commit)
        return commit

    # ---- commands

    def log(self, expression: str = "HEAD", path: str | None = None, n: int | None = None, first_parent: bool = False, branch: str = "trunk") -> DataFrame:
        commits, edges = self.table("commits"), self.table("commit_parents")
        start = self.spark.createDataFrame([(self.resolve(expression, branch),)], "id string")
        rows = walk.walk(commits, edges, start, first_parent=first_parent)
        if path is None:
            rows = history.log(rows, commits, edges)
        else:
            entries = tree.flattened(self.table("entries"), commits.select("tree").distinct())
            rows = history.path_log(rows, edges, entries, path)
        return walk.emission(rows) if n is None else history.limited(rows, n)

    def diff(self, old: str, new: str, include: list[str] | None = None, branch: str = "trunk", **options: bool) -> DataFrame:
        only = patterns(self.spark.createDataFrame([(p,) for p in include], "path string")) if include else None
        return diff.ordered(diff.changes(self.tree(self.resolve(old, branch)), self.tree(self.resolve(new, branch)), include=only, **options))

    def diff_working(self, working: DataFrame, include: list[str] | None = None, branch: str = "trunk", **options: bool) -> DataFrame:
        """The head against working files, in order of emission."""
        only = patterns(self.spark.createDataFrame([(p,) for p in include], "path string")) if include else None
        return diff.ordered(diff.changes(self.tree(self.head(branch)), tree.with_directories(working.select("path", "type", "oid", "size")), include=only, **options))

    def has_path(self, expression: str, path: str, branch: str = "trunk") -> bool:
        return self.tree(self.resolve(expression, branch)).where(F.col("path") == path).limit(1).count() > 0

    def status(self, working: DataFrame, rules: str = "", branch: str = "trunk", **options: object) -> DataFrame:
        """working: path, type, oid, size, as sources.files.file_tree gives them."""
        return status.status(self.files(self.head(branch)), working, ignore.parse(rules), **options).orderBy("status", "path")

    def switch_conflicts(self, working: DataFrame, target: str, branch: str = "trunk") -> DataFrame:
        changes = diff.changes(self.tree(self.head(branch)), self.tree(self.resolve(target, branch)))
        return status.conflicts(changes, self.status(working, branch=branch))

    def restore(self, working: DataFrame, paths: list[str], branch: str = "trunk") -> DataFrame:
        return status.restored(self.files(self.head(branch)), working, patterns(self.spark.createDataFrame([(p,) for p in paths], "path string")))

    def dump(self, commit: str) -> DataFrame:
        rows = self.table("commits").where(F.col("id") == commit)
        return rows.select("id", "tree", "generation", author(F.col("author"), F.col("author_id")).alias("author"), title(F.col("message")).alias("title"), message_lines(F.col("message")).alias("lines"))

    def content(self, oid: str) -> DataFrame:
        return store.load(self.table("objects"), self.spark.createDataFrame([(oid,)], "oid string"), o.BLOB)

    def dump_tree(self, oid: str) -> DataFrame:
        """Entries of a tree, by name."""
        return self.table("entries").where(F.col("tree_id") == oid).select("name", "type", "oid", "size").orderBy("name")

    def setting(self, key: str, location: int | None = None) -> str | None:
        """The value at the first location that has one, or at a given location alone."""
        rows = config.layered(self.table("config"), [key]) if location is None else config.at_location(self.table("config"), key, location)
        row = rows.first()
        return row.value if row else None

    def set_setting(self, key: str, value: str | None, location: int = config.LOCATIONS.index("Repository")) -> None:
        """Sets or, with no value, removes a key in the document of a location."""
        row = self.table("config").where(F.col("location") == location).first()
        doc = json.loads(row.doc) if row else {}
        *above, last = key.split(".")
        at = doc
        for part in above:
            at = at.setdefault(part, {})
        at.pop(last, None)
        if value is not None:
            at[last] = value
        new = self.spark.createDataFrame([(location, json.dumps(doc, sort_keys=True))], SCHEMAS["config"])
        self.replace("config", lambda rows: rows.where(F.col("location") != location).unionByName(new))

    def check(self) -> DataFrame:
        """id and valid of all commits."""
        return validate.check_commits(self.table("commits"), self.table("commit_parents"))

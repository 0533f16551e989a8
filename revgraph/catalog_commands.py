"""Queries of what commands do with trees, stages, stores and imports, with independent SQL; registered in the same tables as those of catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revgraph.catalog import DIFF, GRAPH, LOOSE, REMAP, SOME_HEADS, STATUS, blobs, both_trees, heads, query, reach, remap, shown, work
from revgraph.functions import objects as o
from revgraph.operators import diff, ignore, linediff, paths, status, store, tree, validate, walk
from revgraph.plans import fixtures as fx
from revgraph.sources import refs
from revgraph.streaming import ingest

RULES = "*1.txt\n/es/\nsrc3/\n!d11.txt\n/fr/src1/*\n"
A, B = fx.duck_files("a"), fx.duck_files("b")


def entries(rows: DataFrame) -> DataFrame:
    return rows.select("path", F.col("type").cast("int").alias("type"), "oid")


@query(f"WITH {fx.duck_tree('b')} SELECT path FROM tb WHERE path = '' OR path = 'de' OR starts_with(path, 'de/') OR path = 'en' OR path = 'en/src1' OR starts_with(path, 'en/src1/')")
def parent_filter(spark: SparkSession, sf: str) -> DataFrame:
    include = paths.patterns(spark.createDataFrame([("de",), ("en/src1",)], "path string"))
    return paths.is_parent(fx.tree(spark, sf, "b").select("path"), include)


@query(f"SELECT DISTINCT {fx.duck_oid(1, 'text')} AS oid FROM documents WHERE doc_id % 3 = 0 AND {fx.duck_oid(1, 'text')} IN (SELECT {fx.duck_oid(1, 'text')} FROM documents WHERE doc_id % 2 = 0)")
def objects_exist(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.read(spark, sf, "documents")
    kept = store.put(rows.where("doc_id % 2 = 0").select(F.col("text").alias("content")))
    return store.exists(kept, rows.where("doc_id % 3 = 0").select(o.object_id(o.BLOB, F.col("text")).alias("oid")).distinct()).select("oid")


@query("SELECT o_orderkey AS id, CAST(o_orderkey % 7 AS INTEGER) AS type, o_orderkey % 7 = 1 OR (o_orderkey % 7 IN (2, 3) AND o_orderkey % 5 = 0) AS valid FROM orders WHERE o_orderkey % 7 IN (0, 1, 2, 3)")
def check_dispatch(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 7).cast("int").alias("type")).where("type in (0, 1, 2, 3)")
    known = rows.select("id", (F.col("id") % 5 == 0).alias("valid"))
    checked = [known.where("id % 2 = 0"), known.where("id % 2 = 1")]
    return validate.check_objects(rows.withColumnRenamed("id", "oid"), *checked)


@query(f"WITH {STATUS} SELECT status, CAST(type AS INTEGER) AS type, path, base_oid FROM st WHERE status IN ('Deleted', 'Modified')")
def status_tracked(spark: SparkSession, sf: str) -> DataFrame:
    return work(spark, sf, untracked="no")


@query(f"WITH {STATUS} SELECT status, path FROM st WHERE status IN ('Deleted', 'Modified') AND type IN (1, 3)")
def status_diffable(spark: SparkSession, sf: str) -> DataFrame:
    return status.differing(work(spark, sf)).select("status", "path")


@query(f"WITH {STATUS} SELECT status, count(*) AS paths FROM st GROUP BY status")
def status_counts(spark: SparkSession, sf: str) -> DataFrame:
    return status.counted(work(spark, sf))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN sha1(CAST(o_orderkey AS VARCHAR)) END AS id FROM orders")
def hex_ids(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")
    text = F.when(key % 5 == 0, "0" * 40).otherwise(F.upper(F.sha1(key.cast("string").cast("binary"))))
    return fx.read(spark, sf, "orders").select("o_orderkey", o.hex_id(text).alias("id"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, '@@ -' || l_linenumber || ',3 +' || l_partkey || ',4 @@' AS ranges, ' ' || l_returnflag AS section FROM lineitem")
def hunk_sections(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.expr("concat('@@ -', l_linenumber, ',3 +', l_partkey, ',4 @@ ', l_returnflag, '\\n')").alias("header"))
    parts = linediff.hunk_parts(rows.select("header").distinct())
    return rows.join(parts, "header").select("l_orderkey", "l_linenumber", "l_partkey", "ranges", "section")


@query(f"SELECT 'copy/' || substr(path, 4) AS path, CAST(type AS INTEGER) AS type, oid FROM ({A}) WHERE starts_with(path, 'en/')")
def tree_copied(spark: SparkSession, sf: str) -> DataFrame:
    return entries(tree.copied(fx.files(spark, sf, "a"), "en", "copy"))


@query(f"WITH {fx.duck_tree('a')}, {fx.duck_tree('b')} SELECT path, path IN (SELECT path FROM ta) AS present FROM tb")
def has_path(spark: SparkSession, sf: str) -> DataFrame:
    a, b = both_trees(spark, sf)
    return tree.has_paths(a, b)


@query(f"""SELECT path, CAST(CASE WHEN k % 3 = 1 THEN 3 ELSE type END AS INTEGER) AS type, CASE WHEN k % 3 = 1 THEN sha1(path) ELSE oid END AS oid, k % 3 = 0 AS removed
FROM (SELECT *, CAST(regexp_extract(path, '([0-9]+).txt$', 1) AS BIGINT) AS k FROM ({A}))""")
def stage_entries(spark: SparkSession, sf: str) -> DataFrame:
    base = fx.files(spark, sf, "a")
    k = F.regexp_extract("path", "([0-9]+).txt$", 1).cast("long")
    first = base.where(k % 3 < 2).select(F.lit(1).alias("seq"), F.lit("remove").alias("action"), "path", F.lit(None).cast("int").alias("type"), F.lit(None).cast("string").alias("oid"))
    then = base.where(k % 3 == 1).select(F.lit(2).alias("seq"), F.lit("upsert").alias("action"), "path", F.lit(3).alias("type"), F.sha1(F.col("path").cast("binary")).alias("oid"))
    made = tree.stage_entries(base, first.unionByName(then))
    return made.select("path", F.col("type").cast("int").alias("type"), "oid", "removed")


@query("SELECT 'p' || user_id AS path, max(event_id) AS source_id, 'q' || CAST(max(event_id) AS VARCHAR) AS source_path FROM events GROUP BY user_id HAVING max(event_id) % 4 <> 0")
def copy_info(spark: SparkSession, sf: str) -> DataFrame:
    edits = fx.read(spark, sf, "events").selectExpr("event_id AS seq", "CASE WHEN event_id % 4 = 0 THEN 'remove' ELSE 'copy' END AS action", "concat('p', user_id) AS path", "event_id AS source_id", "concat('q', event_id) AS source_path")
    return tree.copy_info(edits)


@query("SELECT DISTINCT CAST(conv_id AS VARCHAR) AS id, CASE WHEN conv_id % 2 = 0 THEN 't' || CAST(conv_id AS VARCHAR) ELSE CAST(conv_id AS VARCHAR) END AS tree_id FROM conversations")
def tree_ids(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.read(spark, sf, "conversations").selectExpr("conv_id", "CAST(conv_id AS STRING) AS id")
    return tree.tree_ids(rows, rows.where("conv_id % 2 = 0").selectExpr("id", "concat('t', id) AS tree").distinct())


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE (SELECT min(c_name) FROM customer WHERE c_custkey % 3 = 0) END AS name FROM customer")
def refs_by_path(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.read(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("name"), F.col("c_custkey").cast("string").alias("path"))
    return refs.for_path(rows.where("c_custkey % 3 = 0").select("name", "path"), rows).select(F.col("path").cast("long").alias("c_custkey"), "name")


@query("SELECT l_orderkey AS commit_id, count(*) AS objects FROM lineitem GROUP BY l_orderkey")
def objects_per_commit(spark: SparkSession, sf: str) -> DataFrame:
    return store.per_commit(fx.read(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "commit_id"))


@query(f"SELECT DISTINCT {fx.duck_oid(1, 'text')} AS oid, CAST(1 AS INTEGER) AS type FROM documents WHERE {fx.duck_oid(1, 'text')} NOT IN (SELECT {fx.duck_oid(1, 'text')} FROM documents WHERE doc_id % 2 = 0)")
def collected_ids(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.read(spark, sf, "documents")
    kept = store.put(rows.where("doc_id % 2 = 0").select(F.col("text").alias("content")))
    return store.collected(kept, blobs(spark, sf)).select("oid", F.col("type").cast("int").alias("type"))


@query("SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS size FROM documents WHERE octet_length(encode(text)) <= 4096")
def guarded_sizes(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.read(spark, sf, "documents").where("octet_length(text) <= 4096")
    return rows.select("doc_id", F.octet_length(store.guarded(F.col("text").cast("binary"), 4096)).cast("long").alias("size"))


@query(f"WITH {DIFF}, r AS (SELECT action, path FROM ch WHERE type <> 2) SELECT action, path, path = (SELECT min(path) FROM r) AS first FROM r")
def commit_report(spark: SparkSession, sf: str) -> DataFrame:
    return status.report(diff.changes(*both_trees(spark, sf)).where("type <> 2"))


@query(f"SELECT git_oid, oid FROM ({REMAP})")
def remap_document(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.from_documents(ingest.remap_document(remap(spark, sf)))


#: Working files: the head's, of which some are changed or gone, and new ones.
WORKING = f"w AS (SELECT path, type, CASE WHEN length(path) % 4 = 1 THEN sha1(path) ELSE oid END AS oid, size FROM ({A}) WHERE length(path) % 5 <> 0 UNION ALL SELECT 'new/' || path, type, oid, size FROM ({A}) WHERE length(path) % 3 = 0)"


def working(spark: SparkSession, sf: str) -> DataFrame:
    head = fx.files(spark, sf, "a")
    changed = head.where("length(path) % 5 <> 0").withColumn("oid", F.when(F.length("path") % 4 == 1, F.sha1(F.col("path").cast("binary"))).otherwise(F.col("oid")))
    return changed.unionByName(head.where("length(path) % 3 = 0").withColumn("path", F.concat(F.lit("new/"), "path")))


@query(f"""WITH {WORKING}, a AS ({A}), b AS ({B}), d AS (SELECT coalesce(a.path, b.path) AS path FROM a FULL OUTER JOIN b ON a.path = b.path WHERE a.oid IS DISTINCT FROM b.oid OR a.type IS DISTINCT FROM b.type)
SELECT path, CAST(type AS INTEGER) AS type, oid FROM w WHERE path NOT IN (SELECT path FROM d) UNION ALL SELECT path, type, oid FROM b WHERE path IN (SELECT path FROM d)""")
def switch_files(spark: SparkSession, sf: str) -> DataFrame:
    return entries(status.switched(working(spark, sf), fx.files(spark, sf, "a"), fx.files(spark, sf, "b")))


@query(f"WITH {WORKING}, a AS ({A}), b AS ({B}) SELECT path, CAST(type AS INTEGER) AS type, oid FROM b UNION ALL SELECT path, type, oid FROM w WHERE path NOT IN (SELECT path FROM a) AND path NOT IN (SELECT path FROM b)")
def reset_hard_files(spark: SparkSession, sf: str) -> DataFrame:
    return entries(status.reset_hard(working(spark, sf), fx.files(spark, sf, "a"), fx.files(spark, sf, "b")))


def commit_sql(untracked: bool) -> str:
    loose = LOOSE.replace("path LIKE 'es/%'", "path LIKE 'es/%'")
    new = f" OR (path NOT IN (SELECT path FROM a) AND NOT {loose})" if untracked else ""
    under = "(starts_with(path, 'en/') OR starts_with(path, 'new/'))"
    return f"""WITH {WORKING}, a AS ({A}) SELECT path, CAST(type AS INTEGER) AS type, oid FROM a WHERE NOT {under}
UNION ALL SELECT path, type, oid FROM w WHERE {under} AND (path IN (SELECT path FROM a){new})"""


def next_commit(spark: SparkSession, sf: str, untracked: bool) -> DataFrame:
    include = paths.patterns(spark.createDataFrame([("en",), ("new",)], "path string"))
    return entries(status.committed(fx.files(spark, sf, "a"), working(spark, sf), ignore.parse(RULES), include, untracked))


@query(commit_sql(False))
def commit_paths(spark: SparkSession, sf: str) -> DataFrame:
    return next_commit(spark, sf, False)


@query(commit_sql(True))
def commit_untracked(spark: SparkSession, sf: str) -> DataFrame:
    return next_commit(spark, sf, True)


@query(f"""WITH {WORKING}, a AS ({A}) SELECT CASE WHEN a.path IS NULL THEN 'Add' WHEN w.path IS NULL THEN 'Delete' ELSE 'Change' END AS action, coalesce(a.path, w.path) AS path
FROM a FULL OUTER JOIN w ON a.path = w.path WHERE a.oid IS DISTINCT FROM w.oid""")
def diff_working(spark: SparkSession, sf: str) -> DataFrame:
    """The head against working files."""
    made = diff.changes(fx.tree(spark, sf, "a"), tree.with_directories(working(spark, sf)))
    return shown(made).where("type <> 2").select("action", "path")


CONVERTED = "SELECT id FROM c WHERE turn <= 2 AND conv_id % 2 = 0"


@query(f"WITH RECURSIVE {GRAPH}, {reach('r', SOME_HEADS)}, {reach('h', CONVERTED)} SELECT id, generation FROM c WHERE id IN (SELECT id FROM r) AND id NOT IN (SELECT id FROM h)")
def fetch_resume(spark: SparkSession, sf: str) -> DataFrame:
    c, e = fx.commits(spark, sf), fx.edges(spark, sf)
    known = c.where("turn <= 2 and conv_id % 2 = 0").select(F.col("id").alias("git_oid"))
    return ingest.pending(c, e, heads(c.where("conv_id % 2 = 0")), known).select("id", "generation")


@query(f"WITH RECURSIVE {GRAPH}, {reach('r', SOME_HEADS)} SELECT id AS git_oid, tree AS oid FROM c WHERE id IN (SELECT id FROM r)")
def fetch_prune(spark: SparkSession, sf: str) -> DataFrame:
    c, e = fx.commits(spark, sf), fx.edges(spark, sf)
    return ingest.pruned(c.select(F.col("id").alias("git_oid"), F.col("tree").alias("oid")), c, e, heads(c.where("conv_id % 2 = 0")))

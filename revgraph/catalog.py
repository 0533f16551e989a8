"""Queries over the driver's tables, by name, and independent SQL for the same rows.

Relations of repositories are derived from the tables by plans.fixtures.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from revgraph.functions import objects as o
from revgraph.functions import text as t
from revgraph.operators import config, diff, history, ignore, linediff, paths, revisions, status, store, tree, validate, walk
from revgraph.plans import fixtures as fx
from revgraph.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

RULES = "*1.txt\n/es/\nsrc3/\n!d11.txt\n/fr/src1/*\n"
CHUNK = 1024


def query(sql: str | None = None) -> Callable:
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


# ---- objects and store

BLOBS = f"blobs AS (SELECT DISTINCT {fx.duck_oid(1, 'text')} AS oid, CAST(octet_length(encode(text)) AS BIGINT) AS size, text FROM documents)"
PARTS = f"""{BLOBS}, hexed AS (SELECT oid, size, hex(encode(text)) AS h FROM blobs WHERE size > {CHUNK}),
cut AS (SELECT oid AS orig_id, CAST(i AS INTEGER) AS ord, unhex(substr(h, CAST(i * {2 * CHUNK} + 1 AS BIGINT), {2 * CHUNK})) AS part FROM hexed, range(0, 200) r(i) WHERE i * {CHUNK} < size),
parts AS (SELECT orig_id, ord, sha1({fx.duck_header(1, 'octet_length(part)')} || part) AS part_id, CAST(octet_length(part) AS BIGINT) AS part_size FROM cut)"""


def blobs(spark: SparkSession, sf: str) -> DataFrame:
    return store.put(fx.read(spark, sf, "documents").select(F.col("text").alias("content")))


def parts(spark: SparkSession, sf: str) -> DataFrame:
    return store.chunked(fx.read(spark, sf, "documents").select(F.col("text").alias("content")), CHUNK)


@query(f"SELECT doc_id, {fx.duck_oid(1, 'text')} AS oid, CAST(octet_length(encode(text)) AS BIGINT) AS size FROM documents")
def blob_ids(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.read(spark, sf, "documents")
    return rows.select("doc_id", o.object_id(o.BLOB, F.col("text")).alias("oid"), F.octet_length("text").cast("long").alias("size"))


@query(f"WITH {BLOBS} SELECT oid, size FROM blobs")
def blob_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    return blobs(spark, sf).select("oid", "size")


@query(f"SELECT doc_id, CAST(octet_length({fx.duck_header(1, 'n_chars')}) AS INTEGER) AS bytes, lower(hex({fx.duck_header(1, 'n_chars')})) AS header FROM documents")
def header_pack(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.read(spark, sf, "documents")
    return rows.select("doc_id", o.header_bytes(F.col("n_chars")).alias("bytes"), F.lower(F.hex(o.header(o.BLOB, F.col("n_chars")))).alias("header"))


@query("SELECT o_orderkey, CAST(CASE WHEN o_orderkey < 128 THEN 1 WHEN o_orderkey < 16384 THEN 2 WHEN o_orderkey < 2097152 THEN 3 ELSE 4 END AS INTEGER) AS bytes, o_orderkey AS back FROM orders")
def varint_sizes(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")
    return fx.read(spark, sf, "orders").select("o_orderkey", o.varint_bytes(key).alias("bytes"), o.from_varint(o.varint(key)).alias("back"))


@query("SELECT o_orderkey, o_orderkey % 3 = 0 AS valid FROM orders")
def hex_valid(spark: SparkSession, sf: str) -> DataFrame:
    key = F.sha1(F.col("o_orderkey").cast("string").cast("binary"))
    text = F.when(F.col("o_orderkey") % 3 == 0, F.upper(key)).when(F.col("o_orderkey") % 3 == 1, F.substring(key, 1, 39)).otherwise(F.concat(F.substring(key, 1, 39), F.lit("g")))
    return fx.read(spark, sf, "orders").select("o_orderkey", o.is_hex_id(text).alias("valid"))


@query(f"WITH {PARTS} SELECT * FROM parts")
def chunk_parts(spark: SparkSession, sf: str) -> DataFrame:
    return parts(spark, sf).select("orig_id", "ord", "part_id", "part_size")


@query(f"WITH {BLOBS} SELECT oid AS orig_id, oid AS made_id, size FROM blobs WHERE size > {CHUNK}")
def reassemble(spark: SparkSession, sf: str) -> DataFrame:
    p = parts(spark, sf)
    whole = store.reassembled(p, p.select(F.col("part_id").alias("oid"), F.col("part").alias("content")).dropDuplicates(["oid"]))
    return whole.select("orig_id", o.object_id(o.BLOB, F.col("content")).alias("made_id"), "size")


@query(f"WITH {PARTS} SELECT orig_id, CAST(1 AS INTEGER) AS type, CAST(sum(part_size) AS BIGINT) AS size FROM parts GROUP BY orig_id")
def object_meta_resolved(spark: SparkSession, sf: str) -> DataFrame:
    p = parts(spark, sf)
    index = p.select("index_id", "orig_id", "index_type").distinct()
    objects = index.select(F.col("index_id").alias("oid"), F.col("index_type").alias("type"), F.lit(0).cast("long").alias("size"))
    return store.metadata(objects, p, resolve=True).join(index.withColumnRenamed("index_id", "oid"), "oid").select("orig_id", "type", "size")


def levels(spark: SparkSession, sf: str) -> list[DataFrame]:
    rows = fx.read(spark, sf, "documents")
    return [store.put(rows.where(F.expr(f"doc_id % {m} = 0")).select(F.col("text").alias("content"))) for m in (5, 3, 2)]


LEVELS = " UNION ALL ".join(f"SELECT DISTINCT {fx.duck_oid(1, 'text')} AS oid, {k} AS level, CAST(octet_length(encode(text)) AS BIGINT) AS size FROM documents WHERE doc_id % {m} = 0" for k, m in enumerate((5, 3, 2)))


@query(f"SELECT oid, CAST(min(level) AS INTEGER) AS level, min(size) AS size FROM ({LEVELS}) GROUP BY oid")
def chain_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return store.chained(*levels(spark, sf)).select("oid", "level", "size")


@query(f"WITH l AS ({LEVELS}), f AS (SELECT oid, min(level) AS first FROM l GROUP BY oid) SELECT DISTINCT oid, CAST(level AS INTEGER) AS level FROM (SELECT oid, level FROM l UNION ALL SELECT oid, 1 FROM f WHERE first > 1)")
def cache_placement(spark: SparkSession, sf: str) -> DataFrame:
    every = levels(spark, sf)
    return store.cache_placement(store.chained(*every).select("oid"), every, [False, True, False])


TOUCHES = "SELECT event_id AS seq, user_id AS oid, CAST(1000 + user_id % 500 AS BIGINT) AS size FROM events"


@query(f"WITH l AS (SELECT oid, max(seq) AS seq, max(size) AS size FROM ({TOUCHES}) GROUP BY oid) SELECT oid, size, sum(size) OVER (ORDER BY seq DESC) <= 50000 AS kept FROM l")
def lru_eviction(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.read(spark, sf, "events").selectExpr("event_id AS seq", "user_id AS oid", "CAST(1000 + user_id % 500 AS BIGINT) AS size")
    return store.lru(rows, 50_000)


@query(f"WITH {BLOBS} SELECT CAST(b AS INTEGER) AS byte, CAST((SELECT count(*) FROM blobs WHERE substr(oid, 1, 2) <= printf('%02x', b)) AS BIGINT) AS objects FROM range(0, 256) r(b)")
def fanout(spark: SparkSession, sf: str) -> DataFrame:
    return store.fanout(blobs(spark, sf))


@query(f"WITH {BLOBS} SELECT CAST(1 AS INTEGER) AS type, count(*) AS objects, CAST(sum(size) AS BIGINT) AS bytes, min(size) AS least, max(size) AS most FROM blobs")
def store_stats(spark: SparkSession, sf: str) -> DataFrame:
    return store.statistics(blobs(spark, sf))


@query(f"WITH {BLOBS} SELECT oid FROM blobs WHERE size % 7 = 0")
def corrupt_objects(spark: SparkSession, sf: str) -> DataFrame:
    bad = F.when(F.col("size") % 7 == 0, F.concat("content", F.lit("x").cast("binary"))).otherwise(F.col("content"))
    return store.corrupt(blobs(spark, sf).withColumn("content", bad)).select("oid")


@query("WITH v AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) SELECT user_id, value FROM v WHERE r = 1 AND event_type <> 'purchase'")
def latest_values(spark: SparkSession, sf: str) -> DataFrame:
    return store.latest(fx.read(spark, sf, "events"), "user_id", "event_id", F.col("event_type") == "purchase").select("user_id", "value")


# ---- trees and differences

TREES = f"{fx.duck_tree('a')}, {fx.duck_tree('b')}"
DIFF = f"""{TREES}, d AS (SELECT coalesce(a.path, b.path) AS path, a.type AS x, b.type AS y, a.oid AS xo, b.oid AS yo,
 CASE WHEN a.type IN (1, 3) AND b.type IN (1, 3) THEN (a.type = 3) <> (b.type = 3) ELSE false END AS f_attributes,
 coalesce(a.oid <> b.oid OR a.size <> b.size, false) AS f_content,
 CASE WHEN a.type IN (1, 3) AND b.type IN (1, 3) THEN false ELSE coalesce(a.type <> b.type, false) END AS f_type FROM ta a FULL OUTER JOIN tb b ON a.path = b.path),
ch AS (SELECT 'Add' AS action, y AS type, path, false AS f_attributes, false AS f_content, false AS f_type FROM d WHERE x IS NULL OR f_type
 UNION ALL SELECT 'Delete', x, path, false, false, false FROM d WHERE y IS NULL OR f_type
 UNION ALL SELECT 'Change', x, path, f_attributes, f_content, f_type FROM d WHERE x IS NOT NULL AND y IS NOT NULL AND NOT f_type AND (f_attributes OR f_content) AND x IN (1, 2, 3))"""
COLUMNS = "action, CAST(type AS INTEGER) AS type, path, f_attributes, f_content, f_type"


def shown(rows: DataFrame) -> DataFrame:
    return rows.select("action", F.col("type").cast("int").alias("type"), "path", "f_attributes", "f_content", "f_type")


def both_trees(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return fx.tree(spark, sf, "a"), fx.tree(spark, sf, "b")


@query(f"WITH {fx.duck_tree('a')} SELECT path, CAST(type AS INTEGER) AS type, oid, size FROM ta")
def tree_merkle(spark: SparkSession, sf: str) -> DataFrame:
    return fx.tree(spark, sf, "a").select("path", F.col("type").cast("int").alias("type"), "oid", "size")


@query(f"WITH {fx.duck_tree('a')} SELECT path, CAST(type AS INTEGER) AS type, oid FROM ta WHERE path <> ''")
def tree_flatten(spark: SparkSession, sf: str) -> DataFrame:
    flat = fx.tree(spark, sf, "a")
    dirs = flat.where("type = 2").select(F.col("path").alias("parent"), F.col("oid").alias("tree_id"))
    entries = flat.where("path <> ''").withColumn("parent", t.parent_path(F.col("path"))).join(dirs, "parent")
    entries = entries.select("tree_id", t.file_name(F.col("path")).alias("name"), F.col("type").cast("int").alias("type"), "oid", "size").distinct()
    return tree.flattened(entries, flat.where("path = ''").select(F.col("oid").alias("tree"))).select("path", "type", "oid")


@query(f"WITH {TREES} SELECT a.path, CASE WHEN a.type IN (1, 3) AND b.type IN (1, 3) THEN (a.type = 3) <> (b.type = 3) ELSE false END AS f_attributes, a.oid <> b.oid OR a.size <> b.size AS f_content, CASE WHEN a.type IN (1, 3) AND b.type IN (1, 3) THEN false ELSE a.type <> b.type END AS f_type FROM ta a JOIN tb b ON a.path = b.path")
def compare_entries(spark: SparkSession, sf: str) -> DataFrame:
    a, b = both_trees(spark, sf)
    entry = F.struct("type", "oid", "size")
    rows = a.select("path", entry.alias("x")).join(b.select("path", entry.alias("y")), "path")
    return rows.select("path", *(c.alias(k) for k, c in diff.compare_entries("x", "y").items()))


@query(f"WITH {DIFF} SELECT {COLUMNS} FROM ch WHERE NOT (action = 'Change' AND type = 2)")
def changelist_full(spark: SparkSession, sf: str) -> DataFrame:
    return shown(diff.changes(*both_trees(spark, sf)))


@query(f"WITH {DIFF} SELECT {COLUMNS} FROM ch")
def changelist_dirs(spark: SparkSession, sf: str) -> DataFrame:
    return shown(diff.changes(*both_trees(spark, sf), directories=True))


@query(f"WITH {DIFF}, root AS (SELECT action, path FROM ch WHERE action <> 'Change' AND type = 2) SELECT {COLUMNS} FROM ch WHERE NOT (action = 'Change' AND type = 2) AND NOT EXISTS (SELECT 1 FROM root WHERE root.action = ch.action AND starts_with(ch.path, root.path || '/'))")
def changelist_noexpand(spark: SparkSession, sf: str) -> DataFrame:
    return shown(diff.changes(*both_trees(spark, sf), expand_added=False, expand_deleted=False))


@query(f"WITH {DIFF} SELECT {COLUMNS} FROM ch WHERE NOT (action = 'Change' AND type = 2) AND (path = '' OR path = 'de' OR starts_with(path, 'de/') OR path = 'en/src1' OR starts_with(path, 'en/src1/'))")
def changelist_filtered(spark: SparkSession, sf: str) -> DataFrame:
    include = paths.patterns(spark.createDataFrame([("/de/",), ("en//src1",)], "path string"))
    return shown(diff.changes(*both_trees(spark, sf), include=include))


@query(f"""WITH {DIFF}, kept AS (SELECT path FROM d WHERE x = 2 AND y = 2 AND path <> ''), p AS (SELECT ch.*, split_part(path, '/', 1) AS p1, split_part(path, '/', 2) AS p2, split_part(path, '/', 3) AS p3,
 (SELECT coalesce(max(1 + length(k.path) - length(replace(k.path, '/', ''))), 0) FROM kept k WHERE starts_with(ch.path, k.path || '/')) AS n FROM ch WHERE NOT (action = 'Change' AND type = 2))
SELECT row_number() OVER (ORDER BY p1, CASE WHEN action = 'Add' AND n < 1 THEN 1 ELSE 0 END, CASE WHEN p2 = '' THEN (CASE WHEN action = 'Delete' THEN 2 ELSE 0 END) ELSE 1 END, p2, CASE WHEN action = 'Add' AND n < 2 THEN 1 ELSE 0 END,
 CASE WHEN p3 = '' THEN (CASE WHEN action = 'Delete' THEN 2 ELSE 0 END) ELSE 1 END, p3, CASE WHEN action = 'Add' AND n < 3 THEN 1 ELSE 0 END) AS seq, {COLUMNS} FROM p""")
def changelist_ordered(spark: SparkSession, sf: str) -> DataFrame:
    rows = diff.ordered(diff.changes(*both_trees(spark, sf)))
    return rows.withColumn("type", F.col("type").cast("int"))


@query(f"WITH {DIFF} SELECT min(g.path) AS from_path, n.path AS to_path, n.yo AS oid FROM d n JOIN d g ON g.xo = n.yo WHERE n.x IS NULL AND n.y IN (1, 3) AND g.y IS NULL AND g.x IN (1, 3) GROUP BY n.path, n.yo")
def renames_exact(spark: SparkSession, sf: str) -> DataFrame:
    a, b = both_trees(spark, sf)
    return diff.exact_renames(diff.changes(a, b), a, b)


@query("SELECT doc_id, lang || '/' || source AS path, source AS last, lang AS parent FROM documents")
def path_split_join(spark: SparkSession, sf: str) -> DataFrame:
    path = t.clean_path(F.concat(F.lit("/"), "lang", F.lit("//"), "source", F.lit("/")))
    return fx.read(spark, sf, "documents").select("doc_id", path.alias("path"), t.file_name(path).alias("last"), t.parent_path(path).alias("parent"))


@query(f"WITH {fx.duck_tree('b')} SELECT regexp_replace(path, '^.*/', '') AS name, CAST(type AS INTEGER) AS type, oid, size FROM tb WHERE starts_with(path, 'en/') AND length(path) - length(replace(path, '/', '')) = 1")
def fs_readdir(spark: SparkSession, sf: str) -> DataFrame:
    return tree.children(fx.tree(spark, sf, "b"), "en").withColumn("type", F.col("type").cast("int"))


@query(f"""WITH {fx.duck_tree('a')}, b AS ({fx.duck_files('b')}) SELECT path, CAST(type AS INTEGER) AS type, oid FROM (SELECT path, type, oid FROM fa WHERE NOT starts_with(path, 'de/src2/') AND path NOT IN (SELECT path FROM b WHERE starts_with(path, 'en/'))
 UNION ALL SELECT path, type, oid FROM b WHERE starts_with(path, 'en/'))""")
def stage_overlay(spark: SparkSession, sf: str) -> DataFrame:
    edits = fx.files(spark, sf, "b").where("startswith(path, 'en/')").selectExpr("1 AS seq", "'upsert' AS action", "path", "type", "oid", "size")
    gone = spark.createDataFrame([(2, "remove", "de/src2", None, None, None)], "seq int, action string, path string, type int, oid string, size long")
    return tree.staged(fx.files(spark, sf, "a"), edits.unionByName(gone)).select("path", F.col("type").cast("int").alias("type"), "oid")


# ---- commits

GRAPH = f"c AS ({fx.COMMITS}), e AS ({fx.EDGES})"


def reach(name: str, starts: str, edges: str = "e") -> str:
    return f"{name} AS (SELECT id FROM ({starts}) UNION SELECT {edges}.parent_id FROM {name} JOIN {edges} ON {edges}.id = {name}.id)"


HEADS = "SELECT max(id) AS id FROM c GROUP BY conv_id"
SOME_HEADS = "SELECT max(id) AS id FROM c WHERE conv_id % 2 = 0 GROUP BY conv_id"
HIDDEN = "SELECT id FROM c WHERE turn = 2 AND conv_id % 4 = 0"


def heads(rows: DataFrame) -> DataFrame:
    return rows.groupBy("conv_id").agg(F.max("id").alias("id")).select("id")


@query(f"WITH RECURSIVE {GRAPH}, {reach('r', SOME_HEADS)} SELECT c.id, generation FROM c WHERE id IN (SELECT id FROM r)")
def walk_generic(spark: SparkSession, sf: str) -> DataFrame:
    c, e = fx.commits(spark, sf), fx.edges(spark, sf)
    return walk.walk(c, e, heads(c.where("conv_id % 2 = 0"))).select("id", "generation")


@query(f"WITH RECURSIVE {GRAPH}, {reach('r', SOME_HEADS)}, {reach('h', HIDDEN)} SELECT c.id, generation FROM c WHERE id IN (SELECT id FROM r) AND id NOT IN (SELECT id FROM h)")
def walk_hidden(spark: SparkSession, sf: str) -> DataFrame:
    c, e = fx.commits(spark, sf), fx.edges(spark, sf)
    return walk.walk(c, e, heads(c.where("conv_id % 2 = 0")), c.where("turn = 2 AND conv_id % 4 = 0")).select("id", "generation")


@query(f"WITH RECURSIVE {GRAPH}, f AS (SELECT * FROM e WHERE ord = 0), {reach('r', SOME_HEADS, 'f')}, {reach('h', HIDDEN, 'f')} SELECT c.id, generation FROM c WHERE id IN (SELECT id FROM r) AND id NOT IN (SELECT id FROM h)")
def walk_first_parent(spark: SparkSession, sf: str) -> DataFrame:
    c, e = fx.commits(spark, sf), fx.edges(spark, sf)
    return walk.walk(c, e, heads(c.where("conv_id % 2 = 0")), c.where("turn = 2 AND conv_id % 4 = 0"), first_parent=True).select("id", "generation")


@query(f"WITH RECURSIVE {GRAPH}, {reach('r', SOME_HEADS)} SELECT c.id, generation FROM c WHERE id IN (SELECT id FROM r) AND generation BETWEEN 2 AND 4")
def walk_generation_range(spark: SparkSession, sf: str) -> DataFrame:
    c, e = fx.commits(spark, sf), fx.edges(spark, sf)
    return walk.walk(c, e, heads(c.where("conv_id % 2 = 0")), generation_from=2, generation_to=4).select("id", "generation")


@query(f"WITH RECURSIVE {GRAPH}, {reach('r', SOME_HEADS)}, {reach('h', 'SELECT e.parent_id AS id FROM e JOIN c ON c.id = e.id WHERE turn = 3 AND e.id IN (SELECT id FROM r)')} SELECT c.id, generation FROM c WHERE id IN (SELECT id FROM r) AND id NOT IN (SELECT id FROM h)")
def walk_callback_hide(spark: SparkSession, sf: str) -> DataFrame:
    c, e = fx.commits(spark, sf), fx.edges(spark, sf)
    return walk.walk_hiding(c, e, heads(c.where("conv_id % 2 = 0")), c.where("turn = 3").select("id")).select("id", "generation")


@query(f"WITH {GRAPH} SELECT c.id, e.parent_id AS result FROM c LEFT JOIN e ON e.id = c.id AND e.ord = 1")
def nth_parent(spark: SparkSession, sf: str) -> DataFrame:
    return walk.nth_parent(fx.commits(spark, sf), fx.edges(spark, sf), 2)


@query(f"WITH {GRAPH} SELECT id, CASE WHEN turn >= 3 THEN id - 3 END AS result FROM c")
def nth_ancestor(spark: SparkSession, sf: str) -> DataFrame:
    return walk.nth_ancestor(fx.commits(spark, sf), fx.edges(spark, sf), 3)


@query(f"WITH {GRAPH} SELECT id, CAST(generation AS INTEGER) AS generation FROM c")
def generation_dag(spark: SparkSession, sf: str) -> DataFrame:
    return walk.generations(fx.commits(spark, sf), fx.edges(spark, sf))


@query("SELECT * FROM (VALUES ('A', 'A'), ('A^0', 'A'), ('A~0', 'A'), ('A^', 'B'), ('A~1', 'B'), ('A^2', 'C'), ('A^^', 'D'), ('A~2', 'D'), ('B^2', 'E'), ('B^3', 'F'), ('A^^^', 'G'), ('A~3', 'G'), ('A~~~', 'G'), ('A~~2', 'G'), ('D^2', 'H'), ('A~2^2', 'H'), ('B^3^', 'I'), ('F^2', 'J'), ('A^^3^2', 'J'), ('@', 'A'), ('HEAD~', 'B'), ('@~', 'B'), ('A^3', NULL), ('G~1', NULL), ('A~1x', NULL), ('^A', NULL), ('A@', NULL), ('', NULL)) v(expression, result)")
def revparse_cases(spark: SparkSession, sf: str) -> DataFrame:
    parents = {"A": "BC", "B": "DEF", "C": "F", "D": "GH", "F": "IJ"}
    e = spark.createDataFrame([(c, k, p) for c, ps in parents.items() for k, p in enumerate(ps)], "id string, ord int, parent_id string")
    labels = spark.createDataFrame([(c, c) for c in "ABCDEFGHIJ"] + [("HEAD", "A")], "label string, id string")
    texts = "A A^0 A~0 A^ A~1 A^2 A^^ A~2 B^2 B^3 A^^^ A~3 A~~~ A~~2 D^2 A~2^2 B^3^ F^2 A^^3^2 @ HEAD~ @~ A^3 G~1 A~1x ^A A@".split()
    return revisions.resolve(spark, [*texts, ""], labels, e)


@query(f"WITH {GRAPH} SELECT id, id % 10 <> 5 AND (turn = 0 OR (id - 1) % 10 <> 5) AS valid FROM c")
def check_commits(spark: SparkSession, sf: str) -> DataFrame:
    c = fx.commits(spark, sf).withColumn("generation", F.when(F.col("id") % 10 == 5, F.col("generation") + 7).otherwise(F.col("generation")))
    return validate.check_commits(c, fx.edges(spark, sf).where("ord = 0"))


@query(f"WITH {PARTS} SELECT orig_id, bool_and(substr(part_id, 1, 1) <> 'a') AS valid FROM parts GROUP BY orig_id")
def check_index(spark: SparkSession, sf: str) -> DataFrame:
    p = parts(spark, sf)
    objects = p.select(F.col("part_id").alias("oid"), F.lit(1).alias("type"), F.col("part_size").alias("size")).distinct().where("substr(oid, 1, 1) <> 'a'")
    return validate.check_index(p, objects).join(p.select(F.col("index_id").alias("id"), "orig_id").distinct(), "id").select("orig_id", "valid")


@query(f"WITH {fx.duck_tree('a')} SELECT regexp_replace(path, '/[^/]*$', '') AS dir, bool_and(substr(oid, 1, 1) <> 'b') AS valid FROM fa GROUP BY 1")
def check_tree(spark: SparkSession, sf: str) -> DataFrame:
    files = fx.files(spark, sf, "a")
    objects = files.select("oid", F.lit(1).alias("type"), "size").distinct().where("substr(oid, 1, 1) <> 'b'")
    entries = files.select(t.parent_path(F.col("path")).alias("tree_id"), t.file_name(F.col("path")).alias("name"), "type", "oid", "size")
    return validate.check_trees(entries, objects).withColumnRenamed("id", "dir")


@query(f"WITH {GRAPH} SELECT id, turn > 0 AND tree = (SELECT p.tree FROM c p WHERE p.id = c.id - 1) AS valid FROM c")
def check_renames(spark: SparkSession, sf: str) -> DataFrame:
    c = fx.commits(spark, sf)
    entries = c.select("tree").distinct().select("tree", F.concat(F.lit("docs/"), "tree").alias("path"))
    copies = c.select("id", F.lit("new").alias("path"), (F.col("id") - 1).alias("source_id"), F.concat(F.lit("docs/"), "tree").alias("source_path"))
    return validate.check_renames(copies, c, entries)


@query(f"WITH {GRAPH} SELECT c.id FROM c LEFT JOIN c p ON p.id = c.id - 1 AND c.turn > 0 WHERE p.id IS NULL OR p.tree <> c.tree")
def log_tree_changed(spark: SparkSession, sf: str) -> DataFrame:
    c, e = fx.commits(spark, sf), fx.edges(spark, sf)
    return history.log(walk.walk(c, e, heads(c)), c, e).select("id")


@query(f"WITH {GRAPH}, h AS (SELECT c.*, CASE WHEN tree = 'user' THEN tree END AS entry FROM c) SELECT c.id FROM h c LEFT JOIN h p ON p.id = c.id - 1 AND c.turn > 0 WHERE c.entry IS DISTINCT FROM p.entry")
def path_log(spark: SparkSession, sf: str) -> DataFrame:
    c, e = fx.commits(spark, sf), fx.edges(spark, sf)
    entries = spark.createDataFrame([("user", "docs/x", 1, "1"), ("assistant", "docs/y", 1, "2")], "tree string, path string, type int, oid string")
    return history.path_log(walk.walk(c, e, heads(c)), e, entries, "docs/x").select("id")


@query(f"WITH {GRAPH} SELECT id FROM c ORDER BY generation DESC, id LIMIT 20")
def log_limit(spark: SparkSession, sf: str) -> DataFrame:
    c, e = fx.commits(spark, sf), fx.edges(spark, sf)
    return history.limited(walk.walk(c, e, heads(c)), 20).select("id")


@query(f"WITH RECURSIVE {GRAPH}, {reach('x', 'SELECT id FROM c WHERE conv_id % 3 = 0 AND turn = 3')}, {reach('y', 'SELECT id FROM c WHERE conv_id % 3 = 2 AND turn = 3')}, m AS (SELECT id FROM x INTERSECT SELECT id FROM y), {reach('z', 'SELECT e.parent_id AS id FROM e JOIN m ON m.id = e.id')} SELECT id FROM m WHERE id NOT IN (SELECT id FROM z)")
def merge_bases(spark: SparkSession, sf: str) -> DataFrame:
    c, e = fx.commits(spark, sf), fx.edges(spark, sf)
    return walk.merge_bases(c, e, c.where("conv_id % 3 = 0 AND turn = 3"), c.where("conv_id % 3 = 2 AND turn = 3")).select("id")


@query("SELECT conv_id, turn, split_part(text, chr(10), 1) AS title FROM conversations")
def message_title(spark: SparkSession, sf: str) -> DataFrame:
    return fx.read(spark, sf, "conversations").select("conv_id", "turn", t.title(F.col("text")).alias("title"))


@query("SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) AS INTEGER) AS n, line FROM (SELECT doc_id, i, trim(list[i], chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS list, unnest(range(1, CAST(len(string_split(text, chr(10))) + 1 AS BIGINT))) AS i FROM documents)) WHERE length(line) > 1")
def message_lines(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.read(spark, sf, "documents").select("doc_id", F.posexplode(t.message_lines(F.col("text"))).alias("n", "line"))
    return rows.select("doc_id", (F.col("n") + 1).alias("n"), "line")


@query(f"WITH {GRAPH} SELECT c.id, 'tree ' || tree || chr(10) || 'author ' || tree || ' <c' || CAST(conv_id AS VARCHAR) || '>' || coalesce(chr(10) || 'parent ' || CAST(e.parent_id AS VARCHAR), '') AS dump FROM c LEFT JOIN e ON e.id = c.id AND e.ord = 0")
def dump_commit(spark: SparkSession, sf: str) -> DataFrame:
    c = fx.commits(spark, sf).join(fx.edges(spark, sf).where("ord = 0").select("id", "parent_id"), "id", "left")
    who = t.author(F.col("tree"), F.concat(F.lit("c"), F.col("conv_id").cast("string")))
    return c.select("id", F.concat_ws("\n", F.concat(F.lit("tree "), "tree"), F.concat(F.lit("author "), who), F.concat(F.lit("parent "), F.col("parent_id").cast("string"))).alias("dump"))


# ---- status, ignore rules, configuration, import

IGNORED = "(CASE WHEN path LIKE 'fr/src1/%' THEN true WHEN path LIKE '%/d11.txt' THEN false WHEN path LIKE '%/src3/%' AND false THEN true WHEN path LIKE '%1.txt' THEN true END)"
LOOSE = f"coalesce({IGNORED}, path LIKE 'es/%' OR path LIKE '%/src3/%')"
STATUS = f"""{DIFF}, st AS (SELECT CASE WHEN y IS NULL THEN 'Deleted' WHEN x IS NULL THEN CASE WHEN {LOOSE} THEN 'Ignored' ELSE 'Untracked' END ELSE 'Modified' END AS status, coalesce(x, y) AS type, path, xo AS base_oid
 FROM d WHERE coalesce(x, y) <> 2 AND (x IS NULL OR y IS NULL OR f_attributes OR f_content OR f_type))"""


def work(spark: SparkSession, sf: str, **options: object) -> DataFrame:
    rows = status.status(fx.files(spark, sf, "a"), fx.files(spark, sf, "b"), ignore.parse(RULES), **options)
    return rows.select("status", F.col("type").cast("int").alias("type"), "path", "base_oid")


@query(f"WITH {STATUS} SELECT status, CAST(type AS INTEGER) AS type, path, base_oid FROM st")
def status_full(spark: SparkSession, sf: str) -> DataFrame:
    return work(spark, sf)


@query(f"""WITH {STATUS}, u AS (SELECT path, split_part(path, '/', 1) AS l, split_part(path, '/', 1) || '/' || split_part(path, '/', 2) AS s FROM st WHERE status = 'Untracked')
SELECT status, CAST(type AS INTEGER) AS type, path, base_oid FROM st WHERE status IN ('Deleted', 'Modified')
UNION SELECT 'Untracked', CASE WHEN l NOT IN (SELECT split_part(path, '/', 1) FROM fa) OR s NOT IN (SELECT path FROM sa) THEN 2 ELSE (SELECT CAST(y AS INTEGER) FROM d WHERE d.path = u.path) END,
 CASE WHEN l NOT IN (SELECT split_part(path, '/', 1) FROM fa) THEN l WHEN s NOT IN (SELECT path FROM sa) THEN s ELSE path END, NULL FROM u""")
def status_untracked_normal(spark: SparkSession, sf: str) -> DataFrame:
    return work(spark, sf, untracked="normal", ignored=False)


@query(f"SELECT path, {IGNORED} AS ignored FROM (SELECT DISTINCT path FROM ({fx.FILES['b']}))")
def ignore_match(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.files(spark, sf, "b").select("path").distinct()
    return rows.select("path", ignore.ignored(F.col("path"), F.lit(False), ignore.parse(RULES)).alias("ignored"))


@query(f"WITH {STATUS} SELECT action, path FROM ch WHERE NOT (action = 'Change' AND type = 2) AND path IN (SELECT path FROM st WHERE status = 'Modified')")
def switch_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return status.conflicts(diff.changes(*both_trees(spark, sf)), work(spark, sf)).select("action", "path")


@query(f"WITH {STATUS} SELECT status, path FROM st WHERE status IN ('Deleted', 'Modified') AND starts_with(path, 'en/')")
def restore_candidates(spark: SparkSession, sf: str) -> DataFrame:
    only = spark.createDataFrame([("en",)], "pattern string")
    return status.restorable(work(spark, sf), only).select("status", "path")


@query(f"WITH {DIFF}, f AS (SELECT * FROM ch WHERE type <> 2) SELECT count(*) AS files, CAST(count(*) AS VARCHAR) || CASE WHEN count(*) = 1 THEN ' file' ELSE ' files' END || ' changed' AS report, bool_or(action = 'Add') AS created, bool_or(action = 'Delete') AS deleted FROM f")
def commit_summary(spark: SparkSession, sf: str) -> DataFrame:
    return status.summary(diff.changes(*both_trees(spark, sf)).where("type <> 2"))


@query("WITH v AS (SELECT user_id, event_id % 6 AS location, max(event_id) AS value FROM events WHERE event_id % 4 <> 0 GROUP BY 1, 2), w AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY location) AS r FROM v) SELECT user_id, 'core.id' AS key, CAST(value AS VARCHAR) AS value, CAST(location AS INTEGER) AS location FROM w WHERE r = 1")
def config_layered(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.read(spark, sf, "events").groupBy("user_id", (F.col("event_id") % 6).cast("int").alias("location")).agg(F.max(F.when(F.col("event_id") % 4 != 0, F.col("event_id"))).alias("v"))
    docs = rows.select("user_id", "location", F.to_json(F.struct(F.struct(F.col("v").cast("string").alias("id")).alias("core"))).alias("doc"))
    return config.layered(docs, ["core.id"], ["user_id"])


REMAP = f"SELECT sha1(url) AS git_oid, min({fx.duck_oid(3, 'html')}) AS oid FROM pages WHERE page_id % 4 <> 0 GROUP BY 1"


def remap(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.read(spark, sf, "pages").where("page_id % 4 <> 0").select(F.sha1(F.col("url").cast("binary")).alias("git_oid"), F.col("html").alias("content"))
    return ingest.converted(rows).groupBy("git_oid").agg(F.min("oid").alias("oid"))


@query(f"WITH m AS ({REMAP}) SELECT page_id, m.oid FROM pages LEFT JOIN m ON m.git_oid = sha1(url)")
def remap_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return fx.read(spark, sf, "pages").withColumn("git_oid", F.sha1(F.col("url").cast("binary"))).join(remap(spark, sf), "git_oid", "left").select("page_id", "oid")


@query(f"WITH m AS ({REMAP}) SELECT DISTINCT sha1(url) AS git_oid FROM pages WHERE sha1(url) NOT IN (SELECT git_oid FROM m)")
def fetch_incremental(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.read(spark, sf, "pages").select(F.sha1(F.col("url").cast("binary")).alias("git_oid"), F.col("html").alias("content"))
    return ingest.converted(ingest.fresh(rows, remap(spark, sf))).select("git_oid")


@query("SELECT conv_id AS name, max(turn) AS head, nullif(max(CASE WHEN conv_id % 3 <> 0 AND turn % 2 = 1 THEN turn ELSE 0 END), 0) AS known FROM conversations GROUP BY conv_id HAVING max(turn) IS DISTINCT FROM nullif(max(CASE WHEN conv_id % 3 <> 0 AND turn % 2 = 1 THEN turn ELSE 0 END), 0)")
def stale_branches(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.read(spark, sf, "conversations")
    head = lambda r: r.groupBy(F.col("conv_id").alias("name")).agg(F.max("turn").alias("head"))
    return ingest.stale_branches(head(rows), head(rows.where("conv_id % 3 <> 0 AND turn % 2 = 1"))).select("name", "head", "known")


@query("""SELECT path, 'diff a/' || path || ' b/' || path || CASE WHEN x IS NULL THEN chr(10) || 'new file mode ' || ym WHEN y IS NULL THEN chr(10) || 'deleted file mode ' || xm WHEN x <> y THEN chr(10) || 'old mode ' || xm || chr(10) || 'new mode ' || ym ELSE '' END
 || chr(10) || CASE WHEN x IS NULL THEN '--- /dev/null' ELSE '--- a/' || path END || chr(10) || CASE WHEN y IS NULL THEN '+++ /dev/null' ELSE '+++ b/' || path END AS header
FROM (SELECT coalesce(a.path, b.path) AS path, a.type AS x, b.type AS y, CASE a.type WHEN 1 THEN '100644' WHEN 3 THEN '100755' ELSE '120000' END AS xm, CASE b.type WHEN 1 THEN '100644' WHEN 3 THEN '100755' ELSE '120000' END AS ym FROM (""" + fx.FILES["a"] + ") a FULL OUTER JOIN (" + fx.FILES["b"] + ") b ON a.path = b.path)")
def diff_headers(spark: SparkSession, sf: str) -> DataFrame:
    side = lambda which, name: fx.files(spark, sf, which).select("path", F.col("type").alias(name))
    rows = side("a", "old_type").join(side("b", "new_type"), "path", "full_outer")
    action = F.when(F.col("old_type").isNull(), "Add").when(F.col("new_type").isNull(), "Delete").otherwise("Change")
    return linediff.headers(rows.withColumn("action", action))


def changed_texts(spark: SparkSession, sf: str) -> DataFrame:
    side = lambda which, name: fx.files(spark, sf, which, content=True).select("path", F.col("content").alias(name))
    return side("a", "old").join(side("b", "new"), "path").where("old <> new")


@query()
def unified_diff(spark: SparkSession, sf: str) -> DataFrame:
    return linediff.unified(changed_texts(spark, sf))


def side_lines(which: str, sign: int) -> str:
    """Lines with their newlines, each with a sign."""
    texts = f"SELECT path, content, string_split(content, chr(10)) AS l FROM ({fx.FILES[which]})"
    rows = f"SELECT path, l[i] || CASE WHEN i < len(l) THEN chr(10) ELSE '' END AS line FROM (SELECT path, l, unnest(range(1, CAST(len(l) + 1 AS BIGINT))) AS i FROM ({texts}))"
    return f"SELECT path, line, {sign} AS n FROM ({rows}) WHERE line <> ''"


@query(f"""WITH p AS (SELECT a.path FROM ({fx.FILES['a']}) a JOIN ({fx.FILES['b']}) b ON a.path = b.path WHERE a.content <> b.content)
SELECT path, line, CAST(sum(n) AS BIGINT) AS balance FROM ({side_lines('a', -1)} UNION ALL {side_lines('b', 1)}) WHERE path IN (SELECT path FROM p) GROUP BY path, line HAVING sum(n) <> 0""")
def line_balance(spark: SparkSession, sf: str) -> DataFrame:
    """How many more times a line is added than removed, by the line difference."""
    sign = F.expr("case sign when '+' then 1 when '-' then -1 else 0 end")
    return linediff.script(changed_texts(spark, sf)).groupBy("path", "line").agg(F.sum(sign).alias("balance")).where("balance <> 0")


def chain(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Commits and edges of one linear history: each event follows the one with the id before."""
    c = fx.read(spark, sf, "events").select(F.col("event_id").alias("id"))
    return c, c.select("id", F.lit(0).alias("ord"), (F.col("id") - 1).alias("parent_id")).join(c.select(F.col("id").alias("parent_id")), "parent_id", "left_semi")


@query("SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS generation FROM events")
def generation_chain(spark: SparkSession, sf: str) -> DataFrame:
    """A linear history for each user, in which a commit's generation is its place."""
    before = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = fx.read(spark, sf, "events").select("user_id", F.col("event_id").alias("id"), before.alias("parent_id"))
    made = walk.generations(rows.select("id"), rows.where("parent_id is not null").select("id", F.lit(0).alias("ord"), "parent_id"))
    return made.join(rows.select("user_id", "id"), "id").select("user_id", F.col("id").alias("event_id"), "generation")


@query("SELECT event_id AS id FROM events WHERE event_id <= (SELECT max(event_id) FROM events WHERE event_id % 7 = 0) AND event_id > (SELECT min(event_id) + 40 FROM events)")
def walk_long_chain(spark: SparkSession, sf: str) -> DataFrame:
    """One linear history of all events."""
    c, e = chain(spark, sf)
    ends = c.agg(F.max(F.when(F.col("id") % 7 == 0, F.col("id"))).alias("id"), (F.min("id") + 40).alias("hidden"))
    first_parents = walk.Contracted(e)
    return first_parents.closure(ends.select("id")).join(first_parents.closure(ends.select(F.col("hidden").alias("id"))), "id", "left_anti")


@query(f"""WITH RECURSIVE {GRAPH}, n AS (SELECT id, parent_id FROM e UNION SELECT c.id, p.id FROM c JOIN c p ON p.conv_id = c.conv_id - 1 AND p.turn = c.turn + 1 WHERE c.conv_id % 5 = 0),
g AS (SELECT id, 1 AS n FROM c UNION SELECT n.id, g.n + 1 FROM g JOIN n ON n.parent_id = g.id) SELECT id, CAST(max(n) AS INTEGER) AS generation FROM g GROUP BY id""")
def generation_renames(spark: SparkSession, sf: str) -> DataFrame:
    c = fx.commits(spark, sf)
    sources = c.alias("c").join(c.alias("p"), F.expr("p.conv_id = c.conv_id - 1 and p.turn = c.turn + 1 and c.conv_id % 5 = 0")).select("c.id", F.col("p.id").alias("source_id"))
    return walk.generations(c, fx.edges(spark, sf), sources)


@query(f"WITH RECURSIVE {GRAPH}, {reach('r', SOME_HEADS)}, w AS (SELECT c.*, row_number() OVER (ORDER BY generation DESC, id) AS k FROM c WHERE id IN (SELECT id FROM r)) SELECT id, generation FROM w WHERE k <= (SELECT min(k) FROM w WHERE tree = 'user' AND conv_id % 7 = 3)")
def walk_stop(spark: SparkSession, sf: str) -> DataFrame:
    c, e = fx.commits(spark, sf), fx.edges(spark, sf)
    rows = walk.walk(c, e, heads(c.where("conv_id % 2 = 0")))
    return walk.stopped(rows, c.where("tree = 'user' and conv_id % 7 = 3")).select("id", "generation")

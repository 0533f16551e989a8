"""Version-control relations derived from the driver's tables, as SQL that both engines run, and as DataFrames.

Derivations are plain string work; ids are made by each engine's own expression (see duck_oid for the other engine's).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revgraph.functions import objects as o
from revgraph.operators.tree import with_directories

FILES = {
    "a": "SELECT lang || '/' || source || '/d' || CAST(doc_id AS VARCHAR(20)) || '.txt' AS path, 1 AS type, text AS content FROM documents WHERE doc_id % 5 <> 0",
    "b": "SELECT lang || '/' || source || '/d' || CAST(doc_id AS VARCHAR(20)) || '.txt' AS path, CASE WHEN doc_id % 11 = 0 THEN 3 WHEN doc_id % 13 = 0 THEN 4 ELSE 1 END AS type, text || CASE WHEN doc_id % 3 = 0 THEN '!' ELSE '' END AS content FROM documents WHERE doc_id % 7 <> 0",
}
#: Commits of conversations: a turn follows the one before; every third conversation also merges the previous conversation's turn.
COMMITS = "SELECT conv_id * 100 + turn AS id, turn + 1 AS generation, role AS tree, text AS message, conv_id, turn FROM conversations"
EDGES = (
    "SELECT c.conv_id * 100 + c.turn AS id, 0 AS ord, c.conv_id * 100 + c.turn - 1 AS parent_id FROM conversations c WHERE c.turn > 0 "
    "UNION ALL SELECT c.conv_id * 100 + c.turn AS id, 1 AS ord, p.conv_id * 100 + p.turn AS parent_id FROM conversations c JOIN conversations p ON p.conv_id = c.conv_id - 1 AND p.turn = c.turn - 1 WHERE c.conv_id % 3 = 0 AND c.turn > 0"
)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    """The SQL over the named tables."""
    return spark.sql(sql.replace("documents", "{documents}").replace("FROM conversations", "FROM {conversations}").replace("JOIN conversations", "JOIN {conversations}"), **{t: read(spark, sf_dir, t) for t in tables})


def files(spark: SparkSession, sf_dir: str, which: str, content: bool = False) -> DataFrame:
    rows = derived(spark, sf_dir, FILES[which], "documents").withColumns({"oid": o.object_id(o.BLOB, F.col("content")), "size": F.octet_length("content").cast("long")})
    return rows if content else rows.drop("content")


def tree(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    return with_directories(files(spark, sf_dir, which))


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, COMMITS, "conversations")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, EDGES, "conversations")


# The other engine's expressions.


def duck_header(type_: str | int, n: str) -> str:
    k = f"(CASE WHEN {n} = 0 THEN 0 WHEN {n} < 256 THEN 1 WHEN {n} < 65536 THEN 2 WHEN {n} < 16777216 THEN 3 ELSE 4 END)"
    return f"unhex(substr(printf('%02x%02x%02x%02x%02x', {k} * 16 + {type_}, {n} & 255, ({n} >> 8) & 255, ({n} >> 16) & 255, ({n} >> 24) & 255), 1, 2 * (1 + {k})))"


def duck_oid(type_: str | int, text: str) -> str:
    return f"sha1({duck_header(type_, f'octet_length(encode({text}))')} || encode({text}))"


def duck_files(which: str) -> str:
    return f"SELECT path, type, {duck_oid(1, 'content')} AS oid, CAST(octet_length(encode(content)) AS BIGINT) AS size FROM ({FILES[which]})"


def duck_tree(which: str) -> str:
    """All entries with directories and root, for trees of the depth that the derived ones have."""

    def level(source: str, parent: str, name: str) -> str:
        text = "string_agg(CAST(type AS VARCHAR) || ' ' || oid || ' ' || CAST(size AS VARCHAR) || ' ' || name, chr(10) ORDER BY encode(name))"
        inner = f"SELECT {parent} AS parent, {name} AS name, type, oid, size FROM {source}"
        return f"SELECT parent AS path, 2 AS type, {duck_oid(2, 't')} AS oid, CAST(octet_length(encode(t)) AS BIGINT) AS size FROM (SELECT parent, {text} AS t FROM ({inner}) GROUP BY parent)"

    up, last = "regexp_replace(path, '/[^/]*$', '')", "regexp_replace(path, '^.*/', '')"
    return f"f{which} AS ({duck_files(which)}), s{which} AS ({level(f'f{which}', up, last)}), l{which} AS ({level(f's{which}', up, last)}), r{which} AS ({level(f'l{which}', chr(39) * 2, 'path')}), t{which} AS (SELECT * FROM f{which} UNION ALL SELECT * FROM s{which} UNION ALL SELECT * FROM l{which} UNION ALL SELECT * FROM r{which})"

"""The object store as a table: objects(oid, type, size, content).

Objects are immutable and named by content, so writing is an append of what isn't there yet, and copies are stored once.
Contents over the chunk size are kept as parts with an index: index_parts(index_id, orig_id, orig_type, ord, part_id, part_size).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revgraph.functions import objects as o

CHUNK = 4 << 20


def put(contents: DataFrame, type_: int = o.BLOB, content: str = "content") -> DataFrame:
    """Objects of the contents, each once."""
    data = contents.select(F.col(content).cast("binary").alias("content"))
    rows = data.select(o.object_id(type_, F.col("content")).alias("oid"), F.lit(type_).alias("type"), F.octet_length("content").cast("long").alias("size"), "content")
    return rows.dropDuplicates(["oid"])


def append_new(store: DataFrame, objects: DataFrame) -> DataFrame:
    """What a write adds to a store."""
    return objects.dropDuplicates(["oid"]).join(store.select("oid"), "oid", "left_anti")


def chunked(contents: DataFrame, chunk: int = CHUNK, type_: int = o.BLOB) -> DataFrame:
    """index_parts of the contents longer than a chunk, with each part's content; parts are blobs whatever the whole is."""
    data = contents.select(F.col("content").cast("binary").alias("content")).where(F.octet_length("content") > chunk)
    whole = data.select(o.object_id(type_, F.col("content")).alias("orig_id"), "content").dropDuplicates(["orig_id"])
    count = F.ceil(F.octet_length("content") / chunk).cast("int")
    parts = whole.select("orig_id", "content", F.explode(F.sequence(F.lit(0), count - 1)).alias("ord"))
    parts = parts.select("orig_id", "ord", F.substring("content", F.col("ord") * chunk + 1, F.lit(chunk)).alias("part"))
    parts = parts.withColumns({"part_id": o.object_id(o.BLOB, F.col("part")), "part_size": F.octet_length("part").cast("long")})
    listing = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "part_id", "part_size"))), lambda p: F.concat_ws(" ", p["part_id"], p["part_size"].cast("string"))), "\n")
    index = parts.groupBy("orig_id").agg(listing.alias("listing"))
    index = index.select("orig_id", o.object_id(type_ | o.INDEX, F.concat("orig_id", F.lit("\n"), "listing")).alias("index_id"))
    return parts.join(index, "orig_id").select("index_id", "orig_id", F.lit(type_ | o.INDEX).alias("index_type"), "ord", "part_id", "part_size", "part")


def reassembled(parts: DataFrame, objects: DataFrame) -> DataFrame:
    """The wholes of an index (index_id, content, size, complete); a part of another size than listed is an error, a missing part makes the whole incomplete."""
    rows = parts.select("index_id", "orig_id", "ord", "part_id", "part_size").join(objects.select(F.col("oid").alias("part_id"), "content"), "part_id", "left")
    wrong = F.octet_length("content") != F.col("part_size")
    checked = F.when(wrong, F.raise_error(F.lit("a part has another size than its index says")).cast("binary")).otherwise(F.col("content"))
    pieces = F.transform(F.sort_array(F.collect_list(F.struct("ord", F.hex(checked).alias("hex")))), lambda p: p["hex"])
    return rows.groupBy("index_id", "orig_id").agg(F.unhex(F.array_join(pieces, "")).alias("content"), F.sum("part_size").alias("size"), F.every(F.col("content").isNotNull()).alias("complete"))


def metadata(objects: DataFrame, parts: DataFrame, resolve: bool = False) -> DataFrame:
    """oid, type and size; resolved: of what an index stands for."""
    if not resolve:
        return objects.select("oid", "type", "size")
    totals = parts.groupBy(F.col("index_id").alias("oid")).agg(F.sum("part_size").alias("total"))
    rows = objects.select("oid", "type", "size").join(totals, "oid", "left")
    return rows.select("oid", o.core_type(F.col("type")).alias("type"), F.coalesce("total", "size").alias("size"))


def load(objects: DataFrame, ids: DataFrame, expected: int | None = None) -> DataFrame:
    """Objects of the given ids (oid); one of another core type than expected counts as missing, and gives nulls."""
    found = objects if expected is None else objects.where(o.core_type(F.col("type")) == expected)
    return ids.join(found, "oid", "left")


def exists(objects: DataFrame, ids: DataFrame) -> DataFrame:
    return ids.join(objects.select("oid"), "oid", "left_semi")


def chained(*stores: DataFrame) -> DataFrame:
    """Each object from the first store that has it, with that store's place in level."""
    rows = reduce(DataFrame.unionByName, [s.select("oid", "type", "size").withColumn("level", F.lit(k)) for k, s in enumerate(stores)])
    return rows.groupBy("oid").agg(F.min(F.struct("level", "type", "size")).alias("x")).select("oid", "x.level", "x.type", "x.size")


def cache_placement(wanted: DataFrame, levels: list[DataFrame], caching: list[bool]) -> DataFrame:
    """oid and level of the copies that exist after wanted ids were read: a caching level above the one that has an object gets it."""
    found = chained(*levels).join(wanted.select("oid"), "oid").select("oid", "level")
    copies = [found.where(F.col("level") > k).select("oid", F.lit(k).alias("level")) for k, on in enumerate(caching) if on]
    have = [s.select("oid", F.lit(k).alias("level")) for k, s in enumerate(levels)]
    return reduce(DataFrame.union, have + copies).distinct()


def lru(touches: DataFrame, capacity: int) -> DataFrame:
    """oid, size, kept: what a cache of so many bytes holds after the touches (seq, oid, size): the last touched objects whose sizes fit together.

    Sizes are summed over runs of touch order first, so that no task has to see them all.
    """
    last = touches.groupBy("oid").agg(F.max("seq").alias("seq"), F.max("size").alias("size"))
    run = last.withColumn("run", F.floor(F.col("seq") / 10_000))
    later = Window.orderBy(F.col("run").desc()).rowsBetween(Window.unboundedPreceding, -1)
    before = run.groupBy("run").agg(F.sum("size").alias("s")).select("run", F.coalesce(F.sum("s").over(later), F.lit(0)).alias("later"))
    inside = Window.partitionBy("run").orderBy(F.col("seq").desc())
    sums = run.withColumn("s", F.sum("size").over(inside)).join(before, "run")
    return sums.select("oid", "size", (F.col("s") + F.col("later") <= capacity).alias("kept"))


def fanout(ids: DataFrame) -> DataFrame:
    """byte, objects: how many ids have a first byte of at most that."""
    counts = ids.groupBy(F.conv(F.substring("oid", 1, 2), 16, 10).cast("int").alias("byte")).agg(F.count("*").alias("n"))
    every = ids.sparkSession.range(256).select(F.col("id").cast("int").alias("byte")).join(counts, "byte", "left")
    return every.select("byte", F.sum(F.coalesce("n", F.lit(0))).over(Window.orderBy("byte")).alias("objects"))


def statistics(objects: DataFrame) -> DataFrame:
    return objects.groupBy("type").agg(F.count("*").alias("objects"), F.sum("size").alias("bytes"), F.min("size").alias("least"), F.max("size").alias("most"))


def compacted(*runs: DataFrame, partitions: int | None = None) -> DataFrame:
    """Runs merged to one table, each object once, grouped by type and sorted by id within files."""
    rows = reduce(DataFrame.unionByName, runs).dropDuplicates(["oid"])
    return (rows.repartitionByRange(partitions, "type", "oid") if partitions else rows.repartitionByRange("type", "oid")).sortWithinPartitions("type", "oid")


def corrupt(objects: DataFrame) -> DataFrame:
    """Objects whose id or size isn't that of their content."""
    return objects.where((o.object_id(F.col("type"), F.col("content")) != F.col("oid")) | (F.octet_length("content") != F.col("size")))


def latest(log: DataFrame, key: str = "key", version: str = "version", deleted: Column | None = None) -> DataFrame:
    """The last version of each key, without tombstones: a key-value table kept as an append-only log."""
    rows = log.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.col(version).desc()))).where("_n = 1").drop("_n")
    return rows.where(~deleted) if deleted is not None else rows


def guarded(content: Column, most: int = CHUNK) -> Column:
    """The content; an error for one that is longer than a single object may be."""
    return F.when(F.octet_length(content) > most, F.raise_error(F.lit("object is too large")).cast("binary")).otherwise(content)


def collected(store: DataFrame, objects: DataFrame) -> DataFrame:
    """Ids and types of the objects that a write would add."""
    return append_new(store, objects).select("oid", "type").distinct()


def per_commit(converted: DataFrame, commit: str = "commit_id") -> DataFrame:
    """How many objects each converted commit brought."""
    return converted.groupBy(commit).agg(F.count("*").alias("objects"))

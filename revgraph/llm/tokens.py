"""Operator 3, byte-level BPE encoding and decoding, and operator 9, exact length histogram, on documents.

Nulls: a null text counts as the empty text, which has no ids. Rows are independent: repeated rows give repeated
results, an empty table gives an empty one, and columns besides the named ones are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revgraph.llm.bpe import Encoder, encoder
from revgraph.llm.common import written

Emit = Callable[[Encoder, list[bytes]], dict[str, list]]


def encoded(docs: DataFrame, emit: Emit, schema: str, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """For each row its id and what emit makes of its ids (little-endian unsigned 32-bit), column by column as in schema."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                texts = [x or "" for x in part.column(1).to_pylist()]
                columns = emit(e, list(e.encode(texts)))
                yield pa.RecordBatch.from_pydict({id_column: part.column(0), **columns})

    return docs.select(F.col(id_column).cast("long"), F.col(text_column)).mapInArrow(task, f"{id_column} long, {schema}")


def ids_and_text(e: Encoder, rows: list[bytes]) -> dict[str, list]:
    """The ids, and the bytes that they decode to."""
    return {"ids": [np.frombuffer(x, "<u4").astype(np.int32) for x in rows], "decoded": [e.decode(x) for x in rows]}


def digests(e: Encoder, rows: list[bytes]) -> dict[str, list]:
    decimal = list(map(str, range(len(e.r.bytes))))
    out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
    for row in rows:
        ids = np.frombuffer(row, "<u4").tolist()
        out["n_tokens"].append(len(ids))
        out["ids_sha256"].append(hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
        out["decoded_sha256"].append(hashlib.sha256(b"".join(map(e.r.bytes.__getitem__, ids))).hexdigest())
    return out


def bpe(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids array<int>, decoded binary of each document."""
    return encoded(docs, ids_and_text, "ids array<int>, decoded binary", path, pattern)


def bpe_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document, taken in the task that has the ids."""
    return encoded(docs, digests, "n_tokens long, ids_sha256 string, decoded_sha256 string", path, pattern)


def lengths(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and encoded length n_tokens of each document."""
    return encoded(docs, lambda e, rows: {"n_tokens": [len(x) // 4 for x in rows]}, "n_tokens long", path, pattern)


def length_table(lens: DataFrame, block: int = 1024) -> DataFrame:
    """One row for each encoded length that occurs, and for 0, taken as a context limit; what for_limits() makes of them holds for any limit.

    until: the next greater length, null after the last; docs: documents of that length; docs_from, tokens_from: documents of at least that length and their tokens;
    truncated_tokens: tokens left if each document is cut to that length; docs_cut: documents longer than it; share_to:
    share of documents no longer than it, from which every quantile can be read; docs_total, tokens_total. No documents give no row.

    Documents are encoded once: the counts are written. The suffix sums have two levels: within blocks of lengths, in parallel, and over the totals of blocks, of which
    there are as many as the longest length has blocks.
    """
    spark = lens.sparkSession
    none = spark.range(1).select(F.lit(0).cast("long").alias("n_tokens"), F.lit(0).cast("long").alias("docs"))
    counts = written(lens.where("n_tokens is not null").groupBy("n_tokens").agg(F.count("*").alias("docs")).unionByName(none), "lengths")
    counts = counts.groupBy("n_tokens").agg(F.sum("docs").alias("docs")).withColumn("block", F.floor(F.col("n_tokens") / block))
    totals = counts.groupBy("block").agg(F.sum("docs").alias("d"), F.sum(F.col("docs") * F.col("n_tokens")).alias("t"), F.min("n_tokens").alias("first"))
    down = Window.orderBy(F.col("block").desc())
    after, whole = down.rowsBetween(Window.unboundedPreceding, -1), down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = totals.select(
        "block",
        F.coalesce(F.sum("d").over(after), F.lit(0)).alias("d_after"),
        F.coalesce(F.sum("t").over(after), F.lit(0)).alias("t_after"),
        F.lag("first").over(down).alias("next_block"),
        F.sum("d").over(whole).alias("docs_total"),
        F.sum("t").over(whole).alias("tokens_total"),
    )
    within = Window.partitionBy("block").orderBy(F.col("n_tokens").desc())
    inside = within.rowsBetween(Window.unboundedPreceding, 0)
    out = counts.select("*", F.sum("docs").over(inside).alias("d"), F.sum(F.col("docs") * F.col("n_tokens")).over(inside).alias("t"), F.lag("n_tokens").over(within).alias("next")).join(totals, "block").where("docs_total > 0")
    out = out.withColumns({"docs_from": F.col("d") + F.col("d_after"), "tokens_from": F.col("t") + F.col("t_after")})
    return out.select(
        "n_tokens",
        F.coalesce("next", "next_block").alias("until"),
        "docs",
        "docs_from",
        "tokens_from",
        (F.col("docs_from") - F.col("docs")).alias("docs_cut"),
        (F.col("tokens_total") - F.col("tokens_from") + F.col("docs_from") * F.col("n_tokens")).alias("truncated_tokens"),
        ((F.col("docs_total") - F.col("docs_from") + F.col("docs")) / F.col("docs_total")).alias("share_to"),
        "docs_total",
        "tokens_total",
    )


def for_limits(lengths_of: DataFrame, limits: list[int]) -> DataFrame:
    """context_limit, docs_cut, truncated_tokens, share_to for any limits of 0 or more: between two lengths that occur only the cut documents' tokens grow with the limit."""
    of_row = F.filter(F.array(*(F.lit(x).cast("long") for x in sorted(set(limits)))), lambda x: (x >= F.col("n_tokens")) & (F.col("until").isNull() | (x < F.col("until"))))
    rows = lengths_of.select(F.explode(of_row).alias("context_limit"), "*")
    more = (F.col("context_limit") - F.col("n_tokens")) * F.col("docs_cut")
    return rows.select("context_limit", "docs_cut", (F.col("truncated_tokens") + more).alias("truncated_tokens"), "share_to")

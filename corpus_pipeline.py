"""The corpus pipeline: five stages, each on the table that its predecessor wrote.

Quality rules and toxicity drop documents, near duplicates leave one document of each group, secret scans replace secrets by a mark, and packing
gives the pieces of what is left. SQL can't express the grammar or the packing, so there is no ORACLE_SQL: the operators are tested against brute force each, the
stages by the rows that must stay, go or change on a small corpus.

A null text has no words and goes with the quality rules; a null doc_id is kept like any other, and as a near duplicate stays; repeated rows stay or go together. An empty table
gives empty ones; columns beside those of documents go along, whatever their names, up to the packing, whose rows are pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from revgraph.llm import jaccard, packing, quality, queries, secrets, toxicity
from revgraph.llm.common import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.good(docs)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.civil(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.deduplicated(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, queries.SINGLE, queries.PATTERN, packing.special_tokens(queries.SINGLE_JSON))


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", toxicity_filter),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secret_scans),
    ("packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs

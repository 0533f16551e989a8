"""Queries of the training-data operators, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from revgraph.llm import html, jaccard, licenses, neighbours, oracles, packing, quality, secrets, tokens, toxicity
from revgraph.llm.common import table

MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SINGLE_JSON = public_tokenizers.path("byte_bpe_50k.json")
#: Its ranks.
SINGLE = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rules(table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.bpe_digests(table(spark, sf_dir, "documents"), MULTI, PATTERN)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), SINGLE, PATTERN, packing.special_tokens(SINGLE_JSON))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op6_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.length_table(tokens.lengths(table(spark, sf_dir, "documents"), SINGLE, PATTERN))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scans": op1_secret_scans,
    "op2_quality_rules": op2_quality_rules,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_packing": op4_packing,
    "op5_html_extraction": op5_html_extraction,
    "op6_multi_index": op6_multi_index,
    "op7_licenses": op7_licenses,
    "op8_toxicity": op8_toxicity,
    "op9_token_counts": op9_token_counts,
    "op10_ngram_jaccard": op10_ngram_jaccard,
}
ORACLES: dict[str, str] = oracles.ORACLES

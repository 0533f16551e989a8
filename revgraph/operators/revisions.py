"""Revision expressions: a base and steps, `^n` for the n-th parent and `~n` for n first-parent steps."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revgraph.operators.walk import nth_ancestor, nth_parent

Steps = list[tuple[str, int]]


def parse(text: str) -> tuple[str, Steps] | None:
    """Base and steps; None for what is no expression. A leading @ stands for HEAD; in a run of tildes each counts one and a number one less than itself."""
    text = "HEAD" + text[1:] if text.startswith("@") else text
    found = re.fullmatch(r"([^@:^~]+)((?:\^[0-9]*|~[~0-9]*)*)", text, re.S)
    if not found:
        return None
    steps: Steps = []
    for kind, rest in re.findall(r"([\^~])([~0-9]*)", found[2]) if "~" in found[2] or "^" in found[2] else []:
        if kind == "^":
            digits, _, more = rest.partition("~")
            steps.append(("^", int(digits) if digits else 1))
            kind, rest = ("~", more) if "~" in rest else ("", "")
        if kind:
            steps.append(("~", 1 + sum(1 if t == "~" else int(t) - 1 for t in re.findall(r"~|[0-9]+", rest))))
    return found[1], steps


def resolve(spark: SparkSession, expressions: list[str], labels: DataFrame, edges: DataFrame) -> DataFrame:
    """expression and result, an id or null; labels: label, id. Expressions with the same steps share one plan."""
    parsed = [(text, parse(text)) for text in expressions]
    out = spark.createDataFrame([(t, None) for t, p in parsed if p is None], "expression string, result string")
    groups: dict[tuple, list[tuple[str, str]]] = {}
    for text, p in parsed:
        if p:
            groups.setdefault(tuple(p[1]), []).append((text, p[0]))
    for steps, members in groups.items():
        rows = spark.createDataFrame(members, "expression string, label string").join(labels, "label", "left")
        known = F.when(F.col("label").rlike("^[0-9a-fA-F]{40}$"), F.lower("label")).otherwise(F.col("id").cast("string"))
        rows = rows.select("expression", known.alias("at"))
        for kind, n in steps:
            move = (nth_parent if kind == "^" else nth_ancestor)(rows.select(F.col("at").alias("id")).where("id is not null").distinct(), edges, n)
            rows = rows.join(move.withColumnRenamed("id", "at"), "at", "left").select("expression", F.col("result").alias("at"))
        out = out.union(rows.select("expression", "at"))
    return out

"""Paths, messages and labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII white space.
BLANK = r"[\t\n\x0B\f\r ]"


def path_parts(path: Column) -> Column:
    """Names of a path; empty ones are dropped."""
    return F.array_remove(F.split(path, "/"), "")


def clean_path(path: Column) -> Column:
    return F.array_join(path_parts(path), "/")


def join_path(parent: Column, name: Column) -> Column:
    return F.when(parent == "", name).otherwise(F.concat_ws("/", parent, name))


def parent_path(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def ancestors(path: Column) -> Column:
    """The proper ancestors of a path, nearest last, without the root."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))


def title(message: Column) -> Column:
    return F.substring_index(message, "\n", 1)


def message_lines(message: Column) -> Column:
    """Trimmed lines; lines of no or one character are dropped."""
    trimmed = F.transform(F.split(message, "\n"), lambda x: F.regexp_replace(x, f"^{BLANK}+|{BLANK}+$", ""))
    return F.filter(trimmed, lambda x: F.length(x) > 1)


def author(name: Column, id_: Column) -> Column:
    return F.when(name == "", id_).when(id_ == "", name).otherwise(F.concat(name, F.lit(" <"), id_, F.lit(">")))


def date_text(seconds: Column) -> Column:
    """The session's time zone decides."""
    return F.date_format(F.timestamp_seconds(seconds), "EEE MMM dd HH:mm:ss yyyy Z")


def without_scheme(uri: Column) -> Column:
    return F.regexp_replace(uri, "^file://", "")

"""Layered configuration: documents of JSON at locations 0 to 5; the smallest location that has a key decides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values, in order of priority.
LOCATIONS = ["Application", "Workspace", "Repository", "User", "System", "Default"]


def json_path(key: str) -> str:
    return "$" + "".join(f"['{part}']" for part in key.split("."))


def layered(config: DataFrame, keys: list[str], by: list[str] | None = None) -> DataFrame:
    """key, value (text) and location of each key (for each value of the columns `by`)."""
    by = by or []
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("key"), F.get_json_object("doc", json_path(k)).alias("value")) for k in keys)))
    rows = config.select(*by, "location", pairs.alias("p")).select(*by, "location", "p.*").where("value is not null")
    return rows.groupBy(*by, "key").agg(F.min(F.struct("location", "value")).alias("x")).select(*by, "key", "x.value", "x.location")


def at_location(config: DataFrame, key: str, location: int) -> DataFrame:
    """A given location never falls back."""
    return config.where(F.col("location") == location).select(F.get_json_object("doc", json_path(key)).alias("value")).where("value is not null")

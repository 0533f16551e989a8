"""Connected components of an edge table by alternating large-star and small-star steps.

Each step replaces edges by edges to the least neighbour, so that the number of steps grows with the logarithm of a component's size.
Nothing is held by one task: a node's least neighbour is a partial aggregate, and its edges are joined with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revgraph.llm.common import release, written


#: Into so many parts the edges of a node are dealt where they are joined with its least neighbour.
PARTS = 8


def with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """edges joined on u with least, which has a row for each u; the edges of a much linked node go to several tasks."""
    parts = least.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return edges.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(PARTS)).cast("int")).join(parts, ["u", "part"]).drop("part")


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return with_least(both, least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = with_least(down, least).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def connected(edges: DataFrame) -> DataFrame:
    """Edges (u, v), in any order and with repetitions, to (node, component), the least node that it reaches; only for nodes with edges."""
    now = written(edges.select("u", "v").where("u <> v").distinct(), "edges")
    mark = None
    while True:  # each step lessens the sum of the labels until nothing changes
        then = written(small_star(large_star(now)).where("u <> v").distinct(), "edges")
        was, mark = mark, then.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        release(now)
        now = then
        if was == mark:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

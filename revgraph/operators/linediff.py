"""Line differences: unified hunks of two versions of each file, from a relation of aligned lines."""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from revgraph.functions.objects import mode
from revgraph.plans.tables import written

NO_NEWLINE = "\n\\ No newline at end of file\n"


@F.pandas_udf(ArrayType(IntegerType()))
def rising(values: pd.Series) -> pd.Series:
    """Places of a longest rising subsequence of each array of different numbers."""

    def places(row: list[int]) -> list[int]:
        tops, at, before = [], [], []
        for k, v in enumerate(row):
            pile = bisect_left(tops, v)
            tops[pile : pile + 1], at[pile : pile + 1] = [v], [k]
            before.append(at[pile - 1] if pile else -1)
        out, k = [], at[-1] if at else -1
        while k >= 0:
            out.append(k)
            k = before[k]
        return out[::-1]

    return values.map(places)


def lines(pairs: DataFrame, side: str, at: str) -> DataFrame:
    """path, place from 0 and text of each line, which keeps its newline."""
    pieces = F.filter(F.split(F.coalesce(side, F.lit("")), "(?<=\n)"), lambda x: x != "")
    return pairs.select("path", F.posexplode(pieces).alias(at, "line"))


def aligned(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, i, j of the lines that stay, rising in both.

    Lines that occur once on both sides are paired, of these pairs a longest rising chain of each file holds; each gap of the chain (the ends of the file are links, too)
    is then filled with equal lines from its start on, and what is left of it from its end back.
    """
    once = lambda rows, at: rows.groupBy("path", "line").agg(F.min(at).alias(at), F.count("*").alias("n")).where("n = 1").drop("n")
    pairs = once(old, "i").join(once(new, "j"), ["path", "line"]).groupBy("path").agg(F.sort_array(F.collect_list(F.struct("i", "j"))).alias("pairs"))
    chain = pairs.select("path", F.explode(F.transform(rising(F.transform("pairs", lambda p: p["j"])), lambda k: F.get("pairs", k))).alias("p")).select("path", "p.*")
    counts = old.groupBy("path").agg(F.count("*").alias("i")).join(new.groupBy("path").agg(F.count("*").alias("j")), "path", "full_outer")
    ends = counts.select("path", F.explode(F.array(F.struct(F.lit(-1).alias("i"), F.lit(-1).alias("j")), F.struct(*(F.coalesce(x, F.lit(0)).cast("int").alias(x) for x in "ij")))).alias("p")).select("path", "p.*")
    links = written(chain.unionByName(ends), "links")
    following = Window.partitionBy("path").orderBy("i", "j")
    gaps = links.select("path", F.col("i").alias("i0"), F.col("j").alias("j0"), *(F.lead(x).over(following).alias(f"{x}1") for x in "ij"))
    gaps = gaps.withColumn("room", F.least(F.expr("i1 - i0"), F.expr("j1 - j0")) - 1).where("room > 0")
    placed = gaps.select("*", F.explode(F.sequence(F.lit(1), F.col("room"))).alias("k"))
    both = lambda i, j: placed.select("*", F.expr(i).alias("i"), F.expr(j).alias("j")).join(old.withColumnRenamed("line", "x"), ["path", "i"]).join(new.withColumnRenamed("line", "y"), ["path", "j"])
    run = Window.partitionBy("path", "i0").orderBy("k")
    equal = lambda rows: rows.withColumn("same", F.min((F.col("x") == F.col("y")).cast("int")).over(run)).where("same = 1")
    forth = equal(both("i0 + k", "j0 + k")).select("path", "i0", "i", "j")
    taken = forth.groupBy("path", "i0").agg(F.count("*").alias("taken"))
    back = equal(both("i1 - k", "j1 - k")).join(taken, ["path", "i0"], "left").where("k <= room - coalesce(taken, 0)")
    return chain.unionByName(forth.select("path", "i", "j")).unionByName(back.select("path", "i", "j"))


def script(pairs: DataFrame) -> DataFrame:
    """path, seq, sign and line of each line of both versions in the order of a unified difference; old and new: lines of each version before it."""
    pairs = pairs.select("path", "old", "new")
    old, new = (written(lines(pairs, *names), "lines") for names in (("old", "i"), ("new", "j")))
    same = written(aligned(old, new), "aligned")
    block = lambda at: F.count("other").over(Window.partitionBy("path").orderBy(at))
    a = old.join(same.select("path", "i", F.col("j").alias("other")), ["path", "i"], "left").select("path", block("i").alias("block"), F.col("i").alias("at"), "line", F.when(F.col("other").isNull(), "-").otherwise(" ").alias("sign"))
    b = new.join(same.select("path", "j", F.col("i").alias("other")), ["path", "j"], "left").select("path", block("j").alias("block"), F.col("j").alias("at"), "line", "other").where("other is null").drop("other")
    rows = a.unionByName(b.withColumn("sign", F.lit("+")))
    order = Window.partitionBy("path").orderBy("block", F.expr("case sign when ' ' then 0 when '-' then 1 else 2 end"), "at")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    seen = lambda sign: F.coalesce(F.sum((F.col("sign") != sign).cast("int")).over(before), F.lit(0))
    return rows.select("path", F.row_number().over(order).alias("seq"), "sign", "line", seen("+").alias("old"), seen("-").alias("new"))


def unified(pairs: DataFrame, context: int = 3) -> DataFrame:
    """path and hunks (text, without file names) of pairs (path, old, new), a path once; a null side is an absent file, and without a changed line the text is empty.

    The hunks turn old into new; they needn't be the shortest (see aligned).
    """
    order = Window.partitionBy("path").orderBy("seq")
    change = F.when(F.col("sign") != " ", F.col("seq"))
    near = (F.col("seq") - F.last(change, True).over(order) <= context) | (F.first(change, True).over(order.rowsBetween(0, Window.unboundedFollowing)) - F.col("seq") <= context)
    rows = script(pairs).withColumn("near", F.coalesce(near, F.lit(False))).where("near")
    rows = rows.withColumn("new_hunk", F.coalesce(F.col("seq") - F.lag("seq").over(order) > 1, F.lit(True)).cast("int")).withColumn("hunk", F.sum("new_hunk").over(order))
    text = F.concat("sign", F.when(F.col("line").endswith("\n"), F.col("line")).otherwise(F.concat("line", F.lit(NO_NEWLINE))))
    part = lambda side, other: (F.min(side).alias(side), F.sum((F.col("sign") != other).cast("int")).alias(f"n_{side}"))
    hunks = rows.groupBy("path", "hunk").agg(*part("old", "+"), *part("new", "-"), F.sort_array(F.collect_list(F.struct("seq", text.alias("text")))).alias("lines"))
    span = lambda side: F.expr(f"concat(if(n_{side} = 0, {side}, {side} + 1), if(n_{side} = 1, '', concat(',', n_{side})))")
    body = F.concat(F.lit("@@ -"), span("old"), F.lit(" +"), span("new"), F.lit(" @@\n"), F.array_join(F.transform("lines", lambda x: x["text"]), ""))
    texts = hunks.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("hunk", body.alias("text")))).alias("all"))
    return pairs.select("path").join(texts, "path", "left").select("path", F.coalesce(F.array_join(F.transform("all", lambda x: x["text"]), ""), F.lit("")).alias("hunks"))


def headers(rows: DataFrame) -> DataFrame:
    """path and header of changes (path, action, old_type, new_type)."""
    old, new = mode(F.col("old_type")), mode(F.col("new_type"))
    first = F.concat(F.lit("diff a/"), F.col("path"), F.lit(" b/"), F.col("path"))
    kind = (
        F.when(F.col("action") == "Add", F.concat(F.lit("new file mode "), new))
        .when(F.col("action") == "Delete", F.concat(F.lit("deleted file mode "), old))
        .when(F.col("old_type") != F.col("new_type"), F.concat(F.lit("old mode "), old, F.lit("\nnew mode "), new))
    )
    a = F.when(F.col("action") == "Add", "--- /dev/null").otherwise(F.concat(F.lit("--- a/"), F.col("path")))
    b = F.when(F.col("action") == "Delete", "+++ /dev/null").otherwise(F.concat(F.lit("+++ b/"), F.col("path")))
    return rows.select("path", F.concat_ws("\n", first, kind, a, b).alias("header"))


def hunk_parts(header: DataFrame, column: str = "header") -> DataFrame:
    """The range part and the section of hunk headers."""
    pattern = r"^(@@ [^@]* @@)(.*?)(\r?\n?)$"
    return header.select(column, *(F.regexp_extract(column, pattern, k).alias(n) for k, n in ((1, "ranges"), (2, "section"))))

"""Operator 1: secret scans, in DataFrame functions alone.

Base kinds are three patterns (assign, access, hex). The method adds `entropy`: in runs of key-like characters a window slides over the run. The fold's state has
how often each character of the alphabet stands in the window; each step takes one character out and one in, and corrects the sum of c log2 c, from which the
window's Shannon entropy follows, by those two counts. Sums are of whole numbers, so nothing drifts. Each run belongs to a character class (hexadecimal, letters and
digits, base64 marks) with a threshold of its own. The span covers all windows that reach it. Base spans, which are reported already, identifiers of the usual shape
and parts (between / = _ and -) with a placeholder are cut out of a run; each piece that is left is scanned for itself, unless an allow-list (ordinary words, nothing
but letters or digits) suppresses it. Work is in proportion to a text's length, however long a run is.

Positions are code points, ends exclusive. Nulls: a null text is empty and has no span. Rows are independent; repeated rows give repeated results; spans that start together
come in the order of kinds; an empty table gives an empty one; other columns go along untouched, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns, in the order of their kinds. (?i) is ASCII here.
ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: A run of key-like characters.
RUN = r"[A-Za-z0-9+/_=-]{20,}"
# What is cut out of runs (identifiers of the usual shape; parts with placeholders and examples), and pieces that are no secrets: no digit or no letter; words.
CUT = r"(?<![A-Za-z0-9])[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}(?![A-Za-z0-9])|(?<![A-Za-z0-9+])[A-Za-z0-9+]*(?i:example|placeholder|changeme|dummy|sample|xxxx|0123456789|abcdefgh)[A-Za-z0-9+]*"
ALLOWED = [r"^[^0-9]*$", r"^[^A-Za-z]*$", r"^[/_=-]*([A-Za-z]{2,}[/_=-]+)+[0-9]{0,4}$"]
WINDOW = 20
#: Pattern of the class and least entropy (bits) of a window.
CHARACTER_CLASSES = [("^[0-9a-fA-F]+$", 3.0), ("^[A-Za-z0-9]+$", 3.55), ("", 3.65)]

#: The characters of a run; a character's code is its place here, from 1.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: c log2 c of each count c, as whole numbers of `UNIT`.
UNIT = 1 << 40
WEIGHTS = [round(c * math.log2(c) * UNIT) if c else 0 for c in range(WINDOW + 2)]

SPAN = "struct<start:int,kind:int,end:int>"
SPANS = f"array<{SPAN}>"
KINDS = ["assign", "access", "hex", "entropy"]
#: Matches that are put together at a time.
BLOCK = 256


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def collected(items: Column, state: dict[str, Column], kind: str, step: Callable[[Column, Column], tuple[dict[str, Column], Column, Column]]) -> Column:
    """A fold over items: step(state, item) gives the next state, a value and whether to add it to the array `done`.

    Values of some items are added to an array of their own, so that the whole one is copied seldom and the work stays near the number of items.
    """
    empty = F.array().cast(f"array<{kind}>")

    def one(a: Column, x: Column) -> Column:
        then, value, add = step(a, x)
        return F.struct(*(then[k].alias(k) for k in state), F.when(add, F.array_append(a["done"], value)).otherwise(a["done"]).alias("done"))

    def block(a: Column, part: Column) -> Column:
        inner = F.aggregate(part, F.struct(*(a[k].alias(k) for k in state), empty.alias("done")), one)
        return F.aggregate(F.array(inner), a, lambda whole, x: F.struct(*(x[k].alias(k) for k in state), F.concat(whole["done"], x["done"]).alias("done")))

    def whole(all_items: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_items) - 1) / BLOCK).cast("int")), lambda k: F.slice(all_items, k * BLOCK + 1, BLOCK))
        return F.aggregate(parts, F.struct(*(c.alias(k) for k, c in state.items()), empty.alias("done")), block)

    return bound(items, whole)


def matches(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0) -> Column:
    """Spans of the leftmost non-overlapping matches, of which those with a group of `least` characters stay.

    Between the parts that split() leaves lie the matches that regexp_extract_all() gives, so the lengths of both give the positions.
    """
    p = F.lit(pattern)
    found, gaps = F.regexp_extract_all(text, p, F.lit(0)), F.split(text, pattern, -1)
    groups = F.transform(F.regexp_extract_all(text, p, F.lit(group)), F.length)
    lengths = F.zip_with(F.transform(gaps, F.length), F.transform(found, F.length), lambda gap, n: F.struct(gap.alias("gap"), n.alias("n")))
    steps = F.filter(F.zip_with(lengths, groups, lambda s, g: F.struct(s["gap"].alias("gap"), s["n"].alias("n"), (g >= least).alias("good"))), lambda s: s["n"].isNotNull())

    def step(a: Column, x: Column) -> tuple[dict[str, Column], Column, Column]:
        here = a["at"] + x["gap"]
        return {"at": here + x["n"]}, F.struct(here.alias("start"), F.lit(kind).alias("kind"), (here + x["n"]).alias("end")), x["good"]

    return F.when(text.rlike(pattern), collected(steps, {"at": F.lit(0)}, SPAN, step)["done"]).otherwise(F.array().cast(SPANS))


def entropy_span(codes: Column, least: Column) -> Column:
    """First and last position (exclusive) of the windows of a run, given by its characters' codes, whose entropy is `least` bits or more; null if none is."""
    start = F.struct(F.lit(0).cast("long").alias("s"), F.lit("0" * len(ALPHABET)).alias("counts"), F.lit(-1).alias("i"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))
    # What leaves the window stands before what enters it.
    moves = F.flatten(F.transform(codes, lambda c, i: F.array(F.struct(F.get(codes, i - WINDOW).alias("code"), F.lit(-1).alias("by")), F.struct(c.alias("code"), F.lit(1).alias("by")))))
    moves = F.filter(moves, lambda m: m["code"].isNotNull())
    weight = lambda c: F.get(F.array(*map(F.lit, WEIGHTS)), c)
    most = F.floor((math.log2(WINDOW) - least) * WINDOW * UNIT)

    def step(a: Column, m: Column) -> Column:
        """Counts are digits, letters and so on from "0" on, in the order of the alphabet."""
        count = F.ascii(F.substring(a["counts"], m["code"], F.lit(1))) - 48
        s = a["s"] + weight(count + m["by"]) - weight(count)
        i = F.when(m["by"] > 0, a["i"] + 1).otherwise(a["i"])
        high = (m["by"] > 0) & (i >= WINDOW - 1) & (s <= most)
        counts = F.overlay(a["counts"], F.char(count + m["by"] + 48), m["code"], F.lit(1))
        return F.struct(s.alias("s"), counts.alias("counts"), i.alias("i"), F.when(high & (a["first"] < 0), i - WINDOW + 1).otherwise(a["first"]).alias("first"), F.when(high, i + 1).otherwise(a["last"]).alias("last"))

    seen = F.aggregate(moves, start, step)
    return F.when(seen["first"] >= 0, seen)


def pieces(runs: Column, out: Column) -> Column:
    """(run, start, end) of what is left of runs, by their number, without the spans of out, in pieces of a window at least; one pass over both in order."""
    events = F.concat(F.transform(runs, lambda r, k: F.struct(r["start"].alias("start"), k.alias("run"), r["end"].alias("end"))), F.transform(out, lambda b: F.struct(b["start"].alias("start"), F.lit(-1).alias("run"), b["end"].alias("end"))))
    last = F.array(F.struct(F.lit(2**31 - 1).alias("start"), F.lit(-1).alias("run"), F.lit(2**31 - 1).alias("end")))

    def step(a: Column, x: Column) -> tuple[dict[str, Column], Column, Column]:
        """State: the run at hand, its end, where what is left of it begins, and where the last span of out ended."""
        opens, till = x["run"] >= 0, F.least(x["start"], a["till"])
        gone = F.when(opens, a["gone"]).otherwise(F.greatest(a["gone"], x["end"]))
        then = {"run": F.when(opens, x["run"]).otherwise(a["run"]), "till": F.when(opens, x["end"]).otherwise(a["till"]), "at": F.when(opens, F.greatest(x["start"], gone)).otherwise(F.greatest(a["at"], x["end"])), "gone": gone}
        return then, F.struct(a["run"].alias("run"), a["at"].alias("start"), till.alias("end")), till - a["at"] >= WINDOW

    zero = {"run": F.lit(-1), "till": F.lit(0), "at": F.lit(0), "gone": F.lit(0)}
    return collected(F.concat(F.array_sort(events), last), zero, "struct<run:int,start:int,end:int>", step)["done"]


def scanned(docs: DataFrame) -> DataFrame:
    """row (the whole input row), base and spans, arrays of (start, kind, end) in order."""
    rows = docs.select(F.struct("*").alias("row"), F.coalesce("text", F.lit("")).alias("body"))
    body = F.col("body")
    rows = rows.withColumn("base", F.array_sort(F.concat(matches(body, ASSIGN, 0, 2, 8), matches(body, ACCESS, 1), matches(body, HEX, 2))))
    # Runs with their characters, taken from the matches themselves: looking them up by position would begin at the text's start each time.
    found = F.regexp_extract_all("body", F.lit(RUN), F.lit(0))
    rows = rows.withColumn("runs", F.zip_with(matches(body, RUN, 3), found, lambda r, text: F.struct(r["start"].alias("start"), r["end"].alias("end"), F.split(text, "").alias("chars"))))
    # What is left of each run without the base spans and what CUT finds.
    rows = rows.withColumn("out", F.when(F.size("runs") > 0, F.array_sort(F.concat("base", matches(body, CUT, 4)))))
    rows = rows.withColumn("left", F.when(F.size("runs") > 0, pieces(F.col("runs"), F.col("out"))))

    def piece(p: Column) -> Column:
        run = F.get("runs", p["run"])
        chars = F.slice(run["chars"], p["start"] - run["start"] + 1, p["end"] - p["start"])
        return F.struct(p["start"].alias("start"), chars.alias("chars"), F.array_join(chars, "").alias("run"))

    cut = F.transform("left", piece)
    rows = rows.withColumn("cut", F.when(F.size("runs") > 0, F.filter(cut, lambda r: ~r["run"].rlike("|".join(f"(?:{p})" for p in ALLOWED)))))
    least = lambda r: F.coalesce(*(F.when(r["run"].rlike(p), F.lit(h)) for p, h in CHARACTER_CLASSES))
    rows = rows.withColumn("coded", F.when(F.size("cut") > 0, F.transform("cut", lambda r: F.struct(r["start"].alias("start"), least(r).alias("least"), F.transform(r["chars"], lambda c: F.instr(F.lit(ALPHABET), c)).alias("codes")))))
    found = F.transform("coded", lambda r: F.struct(r["start"].alias("start"), entropy_span(r["codes"], r["least"]).alias("seen")))
    high = F.transform(F.filter(found, lambda r: r["seen"].isNotNull()), lambda r: F.struct((r["start"] + r["seen"]["first"]).alias("start"), F.lit(3).alias("kind"), (r["start"] + r["seen"]["last"]).alias("end")))
    rows = rows.withColumn("more", F.when(F.size("coded") > 0, high).otherwise(F.array().cast(SPANS)))
    return rows.select("row", "body", "base", F.array_sort(F.concat("base", "more")).alias("spans"))


def listed(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(F.array(*map(F.lit, KINDS)), s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of each document."""
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{KINDS[k]}") for k in range(3)]
    return scanned(docs.select("doc_id", "text")).select("row.doc_id", *counts, F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def redacted(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every span, or group of overlapping spans, replaced by a mark; n_chars, where there is one, follows the text."""

    def step(a: Column, s: Column) -> tuple[dict[str, Column], Column, Column]:
        return {"at": F.greatest(a["at"], s["end"])}, F.struct(a["at"].alias("start"), s["start"].alias("end")), s["start"] >= a["at"]

    rows = scanned(docs).withColumn("kept", F.when(F.size("spans") > 0, collected(F.col("spans"), {"at": F.lit(0)}, "struct<start:int,end:int>", step)))
    rows = rows.withColumn("chars", F.when(F.size("spans") > 0, F.split("body", "")))
    gaps = F.concat("kept.done", F.array(F.struct(F.col("kept.at").alias("start"), F.length("body").alias("end"))))
    text = F.array_join(F.transform(gaps, lambda g: F.array_join(F.slice("chars", g["start"] + 1, g["end"] - g["start"]), "")), mark)
    rows = rows.select("row", F.when(F.size("spans") > 0, text).otherwise(F.col("row.text")).alias("clean"))
    columns = [F.col("clean").alias("text") if c == "text" else F.when(F.col("row.text") == F.col("clean"), F.col("row.n_chars")).otherwise(F.length("clean")).cast(t).alias(c) if c == "n_chars" else F.col(f"row.`{c}`") for c, t in docs.dtypes]
    return rows.select(*columns)

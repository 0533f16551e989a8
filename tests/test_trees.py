import random
import re

import pytest
from pyspark.sql import functions as F

from revgraph.functions import objects as o
from revgraph.operators import diff, ignore, linediff, paths, status, store, tree

LIB = [("bin/main.cpp", "extern main;"), ("lib/test.h", "int test();")]
UTIL = [("lib/test.h", "int test( return 0; );"), ("util/string.h", "#include <cstddef>\nclass string { };")]


def files(spark, rows, type_=1):
    df = spark.createDataFrame([(p, c, type_) for p, c in rows], "path string, content string, type int")
    return df.select("path", "type", o.object_id(o.BLOB, F.col("content")).alias("oid"), F.octet_length("content").cast("long").alias("size"))


def listed(spark, a=LIB, b=UTIL, **options):
    full = lambda rows: tree.with_directories(files(spark, rows))
    rows = diff.ordered(diff.changes(full(a), full(b), **options)).orderBy("seq").collect()
    return [(r.action, r.type, r.path) for r in rows]


def test_changes_in_order(spark):
    assert listed(spark) == [("Delete", 1, "bin/main.cpp"), ("Delete", 2, "bin"), ("Change", 1, "lib/test.h"), ("Add", 2, "util"), ("Add", 1, "util/string.h")]


def test_directory_changes(spark):
    got = [(a, p) for a, _, p in listed(spark, directories=True)]
    assert got == [("Change", ""), ("Delete", "bin/main.cpp"), ("Delete", "bin"), ("Change", "lib"), ("Change", "lib/test.h"), ("Add", "util"), ("Add", "util/string.h")]


def test_without_expansion(spark):
    assert [(a, p) for a, _, p in listed(spark, expand_added=False, expand_deleted=False)] == [("Delete", "bin"), ("Change", "lib/test.h"), ("Add", "util")]


def test_include(spark):
    include = paths.patterns(spark.createDataFrame([("lib/test.h",), ("util",)], "path string"))
    assert [(a, p) for a, _, p in listed(spark, include=include)] == [("Change", "lib/test.h"), ("Add", "util"), ("Add", "util/string.h")]


def test_deletes_parents_last(spark):
    got = listed(spark, [("a/b/c", "1"), ("a/b/d", "2"), ("a/a", "3"), ("z", "4")], [("z", "4")])
    assert [p for _, _, p in got] == ["a/a", "a/b/c", "a/b/d", "a/b", "a"]


def test_no_change_and_type_change(spark):
    assert listed(spark, LIB, LIB) == []
    assert listed(spark, [("a/b", "1"), ("c", "2")], [("a", "1"), ("c", "2")]) == [("Delete", 1, "a/b"), ("Delete", 2, "a"), ("Add", 1, "a")]


@pytest.mark.parametrize(("a", "b"), [(LIB, UTIL), (UTIL, LIB), ([("x/y/z", "1")], [("x", "2"), ("y/z", "3")])])
def test_applying_a_difference_gives_the_other_tree(spark, a, b):
    rows = listed(spark, a, b)
    gone = {p for action, t, p in rows if action == "Delete" and t != 2}
    put = {p for action, t, p in rows if action != "Delete" and t != 2}
    assert ({p for p, _ in a} - gone) | put == {p for p, _ in b}


def test_compare_entries(spark):
    entry = "struct<oid:string,type:int,size:long>"
    rows = [(("a", 1, 1), ("a", 1, 1)), (("a", 1, 1), ("a", 1, 2)), (("a", 1, 1), ("a", 3, 1)), (("a", 1, 1), ("a", 2, 1)), (("a", 1, 1), ("a", 4, 1))]
    got = spark.createDataFrame(rows, f"x {entry}, y {entry}").select(*diff.compare_entries("x", "y").values()).collect()
    assert [tuple(r) for r in got] == [(False, False, False), (False, True, False), (True, False, False), (False, False, True), (False, False, True)]


def test_path_filter(spark):
    include = paths.patterns(spark.createDataFrame([("a/b",), ("aa/bb",), ("a/b/c",), ("c",)], "path string"))
    rows = spark.createDataFrame([(p,) for p in ("", "a/b/c", "a/b/d", "c/b/d", "aa/bb", "a", "a/bb", "aa/bbb", "d", "aa/dd")], "path string")
    assert {r.path for r in paths.matching(rows, include).collect()} == {"", "a/b/c", "a/b/d", "c/b/d", "aa/bb"}
    rows = spark.createDataFrame([(p,) for p in ("", "a", "a/b/d", "a/bb/d", "aa/dd")], "path string")
    assert {r.path for r in paths.is_parent(rows, include).collect()} == {"", "a", "a/b/d"}
    assert rows.where(paths.match_column(F.col("path"), ["a/b"])).count() == 2


@pytest.mark.parametrize(
    ("rules", "cases"),
    [
        ("/out/\nCMakeSettings.json\n.vs\n.vscode\n/junk/\nbuild/tmp", [("a/b/c/CMakeSettings.json", False, True), ("build/tmp", False, True), ("build/tmp", True, True), ("out", True, True), ("out", False, None), ("tmp", False, None)]),
        ("*.pyc\nfoo/*", [("a/b/c.pyc", False, True), ("a/b/c.pyc", True, True), ("foo/test.json", False, True), ("foo/bar", True, True)]),
        ("/*\n!/foo/\n/foo/*\n!/foo/bar/", [("foo/bar", False, True), ("foo", False, True), ("bar", False, True), ("foo/abc", False, True), ("foo", True, False), ("foo/bar", True, False)]),
        ("a/**/b", [("a/b", True, True), ("a/x/b", True, True)]),
        ("# no\n\n", [("x", False, None)]),
    ],
)
def test_ignore_rules(spark, rules, cases):
    rows = spark.createDataFrame([(p, d) for p, d, _ in cases], "path string, is_dir boolean")
    got = rows.select("path", "is_dir", ignore.ignored(F.col("path"), F.col("is_dir"), ignore.parse(rules)).alias("x")).collect()
    assert [tuple(r) for r in got] == cases


def test_store(spark):
    text = "one line of text" * 20
    data = spark.createDataFrame([(text,), (text,), ("short",)], "content string")
    objects = store.put(data)
    assert objects.count() == 2
    parts = store.chunked(data, 256)
    assert parts.agg(F.sum("part_size"), F.count("*")).first()[:] == (320, 2)
    whole = store.reassembled(parts, store.put(parts.select(F.col("part").alias("content"))))
    assert bytes(whole.first().content) == text.encode()
    assert whole.first().complete
    assert store.corrupt(objects).count() == 0
    assert store.append_new(objects, store.put(spark.createDataFrame([("short",), ("new",)], "content string"))).count() == 1
    ids = objects.select("oid")
    assert store.load(objects, ids, o.TREE).where("content is not null").count() == 0
    assert store.exists(objects, ids).count() == 2
    assert store.compacted(objects, objects).count() == 2


def test_cache_placement(spark):
    empty = spark.createDataFrame([], "oid string, type int, size long")
    one = spark.createDataFrame([("a", 1, 1)], "oid string, type int, size long")
    got = store.cache_placement(one.select("oid"), [empty, empty, one], [True, False, False])
    assert {tuple(r) for r in got.collect()} == {("a", 0), ("a", 2)}


def test_fanout(spark):
    ids = spark.createDataFrame([(x + "0" * 38,) for x in "02 02 02 04 59 59 aa fb fd".split()], "oid string")
    got = dict(store.fanout(ids).collect())
    assert [got[int(x, 16)] for x in "00 01 02 03 04 59 70 aa fb fd ff".split()] == [0, 0, 3, 3, 4, 6, 6, 7, 8, 9, 9]


def test_status_and_restore(spark):
    head, work = files(spark, LIB), files(spark, UTIL)
    rows = status.status(head, work, ignore.parse("util"))
    assert {(r.status, r.path) for r in rows.collect()} == {("Deleted", "bin/main.cpp"), ("Modified", "lib/test.h"), ("Ignored", "util/string.h")}
    rows = status.status(head, work, [], untracked="normal")
    assert ("Untracked", 2, "util") in {(r.status, r.type, r.path) for r in rows.collect()}
    assert status.status(head, work, [], untracked="no").count() == 2
    only = spark.createDataFrame([("bin",)], "pattern string")
    assert {r.path for r in status.restored(head, work, only).collect()} == {"bin/main.cpp", "lib/test.h", "util/string.h"}


def test_line_difference(spark):
    got = linediff.unified(spark.createDataFrame([("f", "a\nb\nc\n", "a\nx\nc\n")], "path string, old string, new string"), 1).first()
    assert got.hunks == "@@ -1,3 +1,3 @@\n a\n-b\n+x\n c\n"
    rows = [("same", "a\n", "a\n"), ("added", None, "x\n"), ("gone", "x\ny\n", None), ("end", "a\nb", "a\nb\n"), ("none", None, None)]
    got = {r.path: r.hunks for r in linediff.unified(spark.createDataFrame(rows, "path string, old string, new string")).collect()}
    assert got == {
        "same": "",
        "added": "@@ -0,0 +1 @@\n+x\n",
        "gone": "@@ -1,2 +0,0 @@\n-x\n-y\n",
        "end": "@@ -1,2 +1,2 @@\n a\n-b\n\\ No newline at end of file\n+b\n",
        "none": "",
    }
    got = linediff.hunk_parts(spark.createDataFrame([("@@ -1,3 +1,3 @@ int f()\n",)], "header string")).first()
    assert (got.ranges, got.section) == ("@@ -1,3 +1,3 @@", " int f()")


def applied(old, hunks):
    """What a patch makes of a text; its context and removed lines must be there."""
    lines, out, at = re.findall(r"[^\n]*\n|[^\n]+", old), [], 0
    hunks = hunks.replace("\n\\ No newline at end of file\n", "\0\n")
    for head, body in re.findall(r"(@@[^\n]*@@)\n((?:[ +-][^\n]*\n)*)", hunks):
        start, count, new_start, new_count = (int(x or 1) for x in re.fullmatch(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@", head).groups())
        begin = start - (count > 0)
        out += lines[at:begin]
        assert len(out) == new_start - (new_count > 0)
        rows = [(x[0], x[1:].replace("\0\n", "")) for x in body.splitlines(True)]
        assert [x for sign, x in rows if sign != "+"] == lines[begin : begin + count] and sum(sign != "-" for sign, _ in rows) == new_count
        out += [x for sign, x in rows if sign != "-"]
        at = begin + count
    return "".join(out + lines[at:])


def test_line_differences_of_random_texts(spark):
    draw, rows = random.Random(5), []
    for k in range(150):
        old = [draw.choice("abcdefghijklmnopq"[: draw.choice((2, 6, 17))]) + f"{draw.choice((0, 0, n))}\n" for n in range(draw.randrange(30))]
        new = [x for x in old if draw.random() > 0.2]
        for _ in range(draw.randrange(5)):
            new.insert(draw.randrange(len(new) + 1), draw.choice(["a0\n", "new\n", f"{draw.random()}\n"]))
        if draw.random() < 0.3:
            cut = draw.randrange(len(new) + 1)
            new = new[cut:] + new[:cut]
        old, new = ("".join(x)[: -1 if draw.random() < 0.2 else None] for x in (old, new))
        rows.append((str(k), old, new))
    for context in (0, 3):
        got = {r.path: r.hunks for r in linediff.unified(spark.createDataFrame(rows, "path string, old string, new string"), context).collect()}
        assert all(applied(old, got[k]) == new for k, old, new in rows)
    assert linediff.unified(spark.createDataFrame([], "path string, old string, new string")).count() == 0


def test_overlay(spark):
    edits = spark.createDataFrame([(1, "remove", "bin", None, None, None), (2, "upsert", "new", 1, "x", 1)], "seq int, action string, path string, type int, oid string, size long")
    assert {r.path for r in tree.staged(files(spark, LIB), edits).collect()} == {"lib/test.h", "new"}
    assert {r.path for r in tree.copied(files(spark, LIB), "lib", "old").collect()} == {"old/test.h"}


def test_exact_renames_leave_out_type_changes(spark):
    # "kept" turns from a file into a symlink and "link" from a symlink into a file: neither is gone or new.
    old = tree.with_directories(files(spark, [("kept", "one"), ("moved", "two")]).union(files(spark, [("link", "two")], 4)))
    new = tree.with_directories(files(spark, [("copy", "one"), ("there", "two"), ("link", "two")]).union(files(spark, [("kept", "one")], 4)))
    assert [(r.from_path, r.to_path) for r in diff.exact_renames(diff.changes(old, new), old, new).collect()] == [("moved", "there")]

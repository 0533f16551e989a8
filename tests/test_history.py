import random

import pytest
from pyspark.sql import functions as F

from revgraph.operators import config, revisions, validate, walk
from revgraph.sources import files, refs
from revgraph.streaming import ingest


def graph(spark, parents):
    generation = {}
    for k in sorted(parents):
        generation[k] = 1 + max((generation[p] for p in parents[k]), default=0)
    commits = spark.createDataFrame([(k, g, f"t{k}") for k, g in generation.items()], "id long, generation long, tree string")
    edges = spark.createDataFrame([(k, i, p) for k, ps in parents.items() for i, p in enumerate(ps)], "id long, ord int, parent_id long")
    return commits, edges


def ids(spark, *keys):
    return spark.createDataFrame([(k,) for k in keys], "id long")


def found(rows):
    return {r.id for r in rows.collect()}


def test_branch_only(spark):
    c, e = graph(spark, {1: [], 2: [1], 3: [2], 4: [3], 5: [2]})
    assert found(walk.walk(c, e, ids(spark, 4), ids(spark, 5))) == {3, 4}
    assert [r.id for r in walk.emission(walk.walk(c, e, ids(spark, 4), ids(spark, 5))).collect()] == [4, 3]


def test_hide_by_predicate(spark):
    c, e = graph(spark, {1: [], 2: [1], 3: [1]})
    assert found(walk.walk_hiding(c, e, ids(spark, 2, 3), c.select("id"))) == {2, 3}


@pytest.mark.parametrize("first", [True, False])
def test_chain(spark, first):
    c, e = graph(spark, {1: [], 2: [1], 3: [2], 4: [3], 5: [4]})
    assert len(found(walk.walk(c, e, ids(spark, 5), first_parent=first))) == 5
    assert len(found(walk.walk(c, e, ids(spark, 5), ids(spark, 2), first))) == 3
    assert len(found(walk.walk(c, e, ids(spark, 5), first_parent=first, generation_from=2, generation_to=4))) == 3


def test_walk_equals_plain_search(spark):
    rng = random.Random(3)
    parents = {k: rng.sample(range(1, k), min(k - 1, rng.randint(0, 2))) for k in range(1, 41)}
    c, e = graph(spark, parents)

    def reach(starts):
        seen, todo = set(), list(starts)
        while todo:
            if (k := todo.pop()) not in seen:
                seen.add(k)
                todo += parents[k]
        return seen

    assert found(walk.walk(c, e, ids(spark, 40, 33), ids(spark, 20))) == reach([40, 33]) - reach([20])
    assert {(r.id, r.generation) for r in walk.generations(c, e).collect()} == {(r.id, r.generation) for r in c.collect()}


def test_ancestors(spark):
    c, e = graph(spark, {k: [k - 1] if k > 1 else [] for k in range(1, 21)})
    got = {r.id: r.result for r in walk.nth_ancestor(c, e, 7).collect()}
    assert got == {k: k - 7 if k > 7 else None for k in range(1, 21)}


@pytest.mark.parametrize(("text", "want"), [("A^2~3", ("A", [("^", 2), ("~", 3)])), ("@~", ("HEAD", [("~", 1)])), ("A~~3", ("A", [("~", 4)])), ("A~0", ("A", [("~", 0)])), ("A^^", ("A", [("^", 1), ("^", 1)])), ("A~1x", None), ("^A", None), ("A@", None), ("a:b", None), ("", None)])
def test_revision_grammar(text, want):
    assert revisions.parse(text) == want


def test_checks(spark):
    c, e = graph(spark, {1: [], 2: [1], 3: [2]})
    assert all(r.valid for r in validate.check_commits(c, e).collect())
    wrong = c.withColumn("generation", F.when(F.col("id") == 2, 9).otherwise(F.col("generation")))
    assert {r.id for r in validate.check_commits(wrong, e).where("valid").collect()} == {1}


def test_config(spark):
    rows = spark.createDataFrame([(3, '{"user": {"email": "x"}}'), (5, '{"user": {"name": "n", "email": "y"}}')], "location int, doc string")
    assert {(r.key, r.value, r.location) for r in config.layered(rows, ["user.email", "user.name", "no"]).collect()} == {("user.email", "x", 3), ("user.name", "n", 5)}
    assert config.at_location(rows, "user.name", 3).count() == 0


def test_references(spark):
    branches = spark.createDataFrame([("trunk", "1"), ("master", "2")], "name string, head string")
    assert refs.default_branch(branches).first().name == "master"
    assert refs.with_row(branches, name="trunk", head="9").where("name = 'trunk'").first().head == "9"
    assert refs.without(branches, "trunk").count() == 1
    assert refs.workspace_name("/x/repo/", {"repo"}) == "repo1"


def test_file_tree(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "f.txt").write_text("hello")
    (tmp_path / "ab").mkdir()
    (tmp_path / "ab" / ("c" * 38)).write_text("object")
    rows = files.file_tree(spark, str(tmp_path)).collect()
    assert {(r.path, r.size) for r in rows} == {("a/f.txt", 5), ("ab/" + "c" * 38, 6)}
    assert [r.oid for r in files.loose_objects(spark, str(tmp_path)).collect()] == ["ab" + "c" * 38]


def test_stream_is_idempotent(spark, tmp_path):
    source, remap = str(tmp_path / "in"), str(tmp_path / "remap")
    for k, rows in enumerate([[("g1", "x"), ("g2", "y")], [("g2", "y"), ("g3", "z")]]):
        spark.createDataFrame(rows, "git_oid string, content string").coalesce(1).write.mode("append").parquet(source)
        ingest.follow(spark, source, "git_oid string, content string", remap, str(tmp_path / "check")).awaitTermination()
        assert spark.read.parquet(remap).count() == k + 2


def test_walks_of_random_histories(spark):
    """Closures and generations of merges within merges, with rename sources, against plain recursion."""
    rng = random.Random(2)
    parents = {k: rng.sample(range(max(0, k - 9), k), min(k, rng.choice([0, 1, 1, 1, 2, 3]))) for k in range(120)}
    renames = {k: rng.randrange(k) for k in range(1, 120) if rng.random() < 0.2}
    c = spark.createDataFrame([(k, 0) for k in parents], "id long, generation int")
    e = spark.createDataFrame([(k, i, p) for k, ps in parents.items() for i, p in enumerate(ps)], "id long, ord int, parent_id long")
    s = spark.createDataFrame(list(renames.items()), "id long, source_id long")

    def reach(starts, first=False):
        seen, todo = set(), list(starts)
        while todo:
            if (k := todo.pop()) not in seen:
                seen.add(k)
                todo += parents[k][:1] if first else parents[k]
        return seen

    starts = spark.createDataFrame([(119,), (101,), (119,)], "id long")
    for first in (False, True):
        got = [r.id for r in walk.closure(e, starts, first).collect()]
        assert len(got) == len(set(got)) and set(got) == reach([119, 101], first)
    for sources in (None, s):
        want = {}
        for k, ps in parents.items():
            want[k] = 1 + max([want[p] for p in ps] + ([want[renames[k]]] if sources is not None and k in renames else []), default=0)
        assert {r.id: r.generation for r in walk.generations(c, e, sources).collect()} == want
    rows = walk.generations(c, e)
    order = [r.id for r in walk.emission(rows).collect()]
    stop = spark.createDataFrame([(order[30],), (order[50],)], "id long")
    assert {r.id for r in walk.stopped(rows, stop).collect()} == set(order[:31])
    assert walk.stopped(rows, stop.limit(0)).count() == 120


def test_a_long_chain_takes_few_rounds(spark):
    c = spark.range(10_000).select("id")
    e = c.where("id > 0").selectExpr("id", "0 AS ord", "id - 1 AS parent_id")
    assert walk.closure(e, spark.createDataFrame([(9_999,)], "id long"), first_parent=True).count() == 10_000
    assert walk.generations(c, e).where("generation = id + 1").count() == 10_000


def test_contracted_first_parents(spark):
    rng = random.Random(7)
    parent = {k: k - 1 if rng.random() < 0.9 else rng.randrange(k) for k in range(1, 400)}
    edges = spark.createDataFrame([(k, 0, p) for k, p in parent.items()], "id long, ord int, parent_id long")
    some = walk.Contracted(edges, most=40)
    assert len(some.into) > 5
    moved = [x.count() for x in some.into]
    assert sum(moved) <= 399 + 40 and all(x.jumps.tables[0].count() <= 40 for x in [some])
    for starts in ([399], [5, 250, 251, 398], [0], [1000], []):
        want = set(starts)
        for k in starts:
            while k in parent:
                want.add(k := parent[k])
        got = [r.id for r in some.closure(spark.createDataFrame([(k,) for k in [*starts, None]], "id long")).collect()]
        assert sorted(got) == sorted(want)

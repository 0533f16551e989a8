import pytest

from revgraph.functions import objects as o
from revgraph.operators.store import put
from revgraph.repository import Repository


def files(spark, **contents):
    return spark.createDataFrame([(p.replace("__", "/"), 1, c) for p, c in contents.items()], "path string, type int, content string")


def test_commands(spark, tmp_path):
    repo = Repository(spark, str(tmp_path / "repo"))
    one = repo.commit(files(spark, a__x="1", b="2"), "first\n\nmore", "N", "n@x", 0)
    two = repo.commit(files(spark, a__x="1", b="3", c="4"), "second", "N", "n@x", 1)
    three = repo.commit(files(spark, a__x="1", b="3", c="4"), "same tree", "N", "n@x", 2)
    assert repo.head("trunk") == three
    assert [repo.resolve(x) for x in ("HEAD", "trunk~1", "@^^", one[:40], "@~9")] == [three, two, one, one, None]
    assert [r.id for r in repo.log().collect()] == [two, one]
    assert [r.id for r in repo.log(path="b", n=1).collect()] == [two]
    assert [(r.action, r.path) for r in repo.diff("HEAD~2", "HEAD").orderBy("seq").collect()] == [("Change", "b"), ("Add", "c")]
    assert [r.path for r in repo.diff("HEAD~2", "HEAD", include=["c"]).collect()] == ["c"]
    assert all(r.valid for r in repo.check().collect())
    assert repo.table("objects").count() == 4
    row = repo.dump(one).first()
    assert (row.author, row.title, row.lines) == ("N <n@x>", "first", ["first", "more"])
    assert bytes(repo.content(put(spark.createDataFrame([("4",)], "content string"), o.BLOB).first().oid).first().content) == b"4"
    work = repo.files(one)
    assert {(r.status, r.path) for r in repo.status(work).collect()} == {("Modified", "b"), ("Deleted", "c")}
    assert {r.path for r in repo.switch_conflicts(work, one).collect()} == {"b"}
    assert {r.path for r in repo.restore(work, ["c"]).collect()} == {"a/x", "b", "c"}
    repo.reset("trunk", "HEAD~1")
    repo.put_row("branches", name="other", head=one)
    repo.drop_row("branches", "other")
    assert [tuple(r) for r in repo.table("branches").collect()] == [("trunk", two)]
    repo.write("config", spark.createDataFrame([(5, '{"user": {"name": "N"}}')], "location int, doc string"))
    assert (repo.setting("user.name"), repo.setting("user.email")) == ("N", None)


def working(spark, **contents):
    from pyspark.sql import functions as F

    rows = files(spark, **contents)
    return rows.withColumns({"oid": o.object_id(o.BLOB, F.col("content")), "size": F.octet_length("content").cast("long")})


def test_working_tree_commands(spark, tmp_path):
    repo = Repository.init(spark, str(tmp_path / "repo"))
    assert (repo.head("trunk"), Repository.init(spark, repo.path).table("branches").count()) == (None, 1)
    one = repo.commit(files(spark, a="1", b="2"), "first", "N", "n@x", 0)
    work = working(spark, a="9", b="8", new="7", log_tmp="6")
    assert {(r.action, r.path) for r in repo.diff_working(work).collect()} == {("Change", "a"), ("Change", "b"), ("Add", "new"), ("Add", "log_tmp")}
    two, report = repo.commit_working(work, "some", "N", "n@x", 1, include=["b", "new"])
    assert [(r.action, r.path, r.first) for r in report.collect()] == [("Change", "b", True)]
    three, report = repo.commit_working(work, "all", "N", "n@x", 2, rules="*_tmp", untracked=True)
    assert [(r.action, r.path, r.first) for r in report.collect()] == [("Change", "a", True), ("Add", "new", False)]
    assert (repo.has_path("HEAD", "new"), repo.has_path("HEAD~1", "new")) == (True, False)
    assert [r.name for r in repo.dump_tree(repo.table("commits").where(f"id = '{three}'").first().tree).collect()] == ["a", "b", "new"]
    same = work.where("path <> 'log_tmp'")
    assert {r.path for r in repo.switch(same, "side", create=True).collect()} == {"a", "b", "new"}
    with pytest.raises(ValueError, match="branch exists"):
        repo.switch(same, "side", create=True)
    repo.reset("side", "trunk~2")
    assert {(r.path, r.size) for r in repo.switch(work, "side").collect()} == {("a", 1), ("b", 1), ("log_tmp", 1)}
    with pytest.raises(ValueError, match="changed locally: a"):
        repo.switch(working(spark, a="x", b="8", new="7"), "side")
    assert {r.path for r in repo.reset("trunk", "HEAD~2", work).collect()} == {"a", "b", "log_tmp"}
    assert (repo.head("trunk"), repo.head("side")) == (one, one)
    with pytest.raises(ValueError, match="no such revision"):
        repo.reset("trunk", "nothing")


def test_settings_and_versions(spark, tmp_path):
    repo = Repository.init(spark, str(tmp_path / "repo"))
    repo.set_setting("user.name", "low", 5)
    repo.set_setting("user.name", "high", 3)
    repo.set_setting("user.mail", "m", 3)
    assert (repo.setting("user.name"), repo.setting("user.name", 5), repo.setting("user.name", 4)) == ("high", "low", None)
    repo.set_setting("user.name", None, 3)
    assert (repo.setting("user.name"), repo.setting("user.mail")) == ("low", "m")
    # A claimed version keeps others out, and an unfinished one isn't read.
    fs, claim = repo._file(f"branches/_claims/{len(repo._versions('branches')):08d}")
    assert fs.createNewFile(claim)
    with pytest.raises(RuntimeError, match="another writer"):
        repo.put_row("branches", name="x", head=None)
    (tmp_path / "repo" / "branches" / "00000007").mkdir()
    assert [r.name for r in repo.table("branches").collect()] == ["trunk"]
    # A change that fails gives its claim back.
    with pytest.raises(ZeroDivisionError):
        repo.replace("remotes", lambda rows: 1 / 0)
    repo.put_row("remotes", name="r", uri="u", is_git=True)
    assert repo.table("remotes").count() == 1

import hashlib

import pytest
from pyspark.sql import functions as F

from revgraph.functions import objects as o
from revgraph.functions import text as t


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_header_bytes(spark):
    sizes = [0, 1, 115, 1234, 123456, 123456789, 12345678901, 1234567890123]
    assert values(spark, [(x,) for x in sizes], "n long", o.header_bytes(F.col("n"))) == [(1,), (2,), (2,), (3,), (4,), (5,), (6,), (7,)]
    with pytest.raises(Exception, match="out of range"):
        values(spark, [(1234567890123456,)], "n long", o.header_bytes(F.col("n")))


def test_object_id_is_the_hash_of_header_and_content(spark):
    for text in ("", "a", "x" * 300):
        data = text.encode()
        n = (len(data).bit_length() + 7) // 8
        want = hashlib.sha1(bytes([n * 16 + 1]) + len(data).to_bytes(n, "little") + data).hexdigest()
        assert values(spark, [(text,)], "s string", o.object_id(o.BLOB, F.col("s"))) == [(want,)]


def test_varint_round_trip(spark):
    sizes = {0: 1, 127: 1, 128: 2, 16383: 2, 16384: 3, 2097151: 3, 2097152: 4, 268435455: 4, 268435456: 5}
    got = values(spark, [(x,) for x in sizes], "n long", "n", F.octet_length(o.varint(F.col("n"))), o.from_varint(o.varint(F.col("n"))))
    assert got == [(n, k, n) for n, k in sizes.items()]


def test_hex_ids(spark):
    rows = [("aB" * 20,), ("g" * 40,), ("a" * 39,), ("",), ("0" * 40,)]
    assert values(spark, rows, "s string", o.is_hex_id(F.col("s"))) == [(True,), (False,), (False,), (False,), (True,)]
    assert values(spark, [rows[0], rows[4]], "s string", o.hex_id(F.col("s"))) == [("ab" * 20,), (None,)]


def test_types_and_tags(spark):
    c = F.col("n")
    assert values(spark, [(9,), (2,)], "n int", o.core_type(c), o.is_index(c), o.to_index(c)) == [(1, True, 9), (2, False, 10)]
    assert values(spark, [(5,)], "n int", o.record_tag(c, F.lit(True), F.lit(False))) == [(5 | 1 << 27,)]


def test_paths_and_messages(spark):
    rows = [("a/b/c",), ("/a/b/c",), ("/a//b/c/",)]
    assert values(spark, rows, "p string", t.clean_path(F.col("p"))) == [("a/b/c",)] * 3
    assert values(spark, [("a/b/c",), ("a",)], "p string", t.parent_path(F.col("p")), t.file_name(F.col("p"))) == [("a/b", "c"), ("", "a")]
    assert values(spark, [("one\n\n x \n  two\t\n",)], "m string", t.title(F.col("m")), t.message_lines(F.col("m"))) == [("one", ["one", "two"])]
    assert values(spark, [("J", "j@x"), ("", "j@x"), ("J", "")], "n string, i string", t.author(F.col("n"), F.col("i"))) == [("J <j@x>",), ("j@x",), ("J",)]
    assert values(spark, [("file:///x",)], "u string", t.without_scheme(F.col("u"))) == [("/x",)]
    assert values(spark, [(0,)], "s long", t.date_text(F.col("s"))) == [("Thu Jan 01 00:00:00 1970 +0000",)]

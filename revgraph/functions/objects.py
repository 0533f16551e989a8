"""Object headers, object ids, varints and hexadecimal ids as column expressions.

An object is a typed byte string. Its id is the SHA-1 of a short header and the content: one tag byte (number of size bytes
times 16, plus the type) and the size in as few little-endian bytes as it needs (none for size 0).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Object types; an index of chunks has the type of what it stands for plus 8.
BLOB, TREE, COMMIT, RENAMES, TAG = 1, 2, 3, 4, 5
INDEX = 8
# Path types. "Executible" is spelled as stored data spells it.
FILE, DIRECTORY, EXECUTIBLE, SYMLINK = 1, 2, 3, 4
MODES = {FILE: "100644", DIRECTORY: "40000", EXECUTIBLE: "100755", SYMLINK: "120000"}
#: Sizes take at most 6 bytes.
SIZE_LIMIT = 1 << 48


def size_bytes(size: Column) -> Column:
    """Bytes that a size needs; sizes of 2 ** 48 and more are an error."""
    steps = reduce(lambda e, k: e.when(size < F.lit(1 << (8 * k)), k), range(1, 7), F.when(size == 0, 0))
    return steps.otherwise(F.raise_error(F.lit("object size is out of range")).cast("int"))


def header_bytes(size: Column) -> Column:
    return size_bytes(size) + 1


def header(type_: Column | int, size: Column) -> Column:
    """The header as binary."""
    k = size_bytes(size)
    tag = F.lpad(F.hex(k * 16 + type_), 2, "0")
    parts = [F.lpad(F.hex(F.shiftright(size, 8 * i).bitwiseAND(255)), 2, "0") for i in range(6)]
    return F.unhex(F.substring(F.concat(tag, *parts), F.lit(1), 2 * (k + 1)))


def object_id(type_: Column | int, content: Column) -> Column:
    """40 lower-case hexadecimal digits; content: binary or string."""
    data = content.cast("binary")
    return F.sha1(F.concat(header(type_, F.octet_length(data).cast("long")), data))


def header_tag(packed: Column) -> tuple[Column, Column]:
    """Type and number of size bytes of a tag byte."""
    return packed.bitwiseAND(15), F.shiftright(packed, 4)


def core_type(type_: Column) -> Column:
    return type_.bitwiseAND(7)


def is_index(type_: Column) -> Column:
    return type_.bitwiseAND(INDEX) != 0


def to_index(type_: Column) -> Column:
    return type_.bitwiseOR(INDEX)


def varint_bytes(value: Column) -> Column:
    """Bytes of a base-128 varint."""
    return reduce(lambda e, k: e.when(value < F.lit(1 << (7 * k)), k), range(2, 9), F.when(value < 128, 1)).otherwise(9)


def varint(value: Column) -> Column:
    """The varint as binary: seven bits a byte, low ones first, the high bit set on all but the last byte."""
    n = varint_bytes(value)
    parts = [F.lpad(F.hex(F.shiftright(value, 7 * i).bitwiseAND(127) + F.when(n > i + 1, 128).otherwise(0)), 2, "0") for i in range(9)]
    return F.unhex(F.substring(F.concat(*parts), F.lit(1), 2 * n))


def from_varint(data: Column) -> Column:
    """The number that a varint begins with."""
    digits = F.hex(data)
    bytes_ = F.transform(F.sequence(F.lit(0), F.octet_length(data) - 1), lambda i: F.conv(F.substring(digits, 2 * i + 1, F.lit(2)), 16, 10).cast("long"))
    start = F.struct(F.lit(0).cast("long").alias("value"), F.lit(1).cast("long").alias("unit"), F.lit(False).alias("over"))
    step = lambda a, b: F.when(a["over"], a).otherwise(F.struct((a["value"] + b.bitwiseAND(127) * a["unit"]).alias("value"), F.when(b > 127, a["unit"] * 128).otherwise(a["unit"]).alias("unit"), (b < 128).alias("over")))
    return F.aggregate(bytes_, start, step)["value"]


def is_hex_id(text: Column) -> Column:
    return text.rlike("^[0-9a-fA-F]{40}$")


def hex_id(text: Column) -> Column:
    """The id in lower case; null for the zero id; an error for what is no id."""
    return F.when(~is_hex_id(text), F.raise_error(F.lit("not an object id")).cast("string")).when(text.rlike("^0{40}$"), F.lit(None)).otherwise(F.lower(text))


def record_tag(length: Column, compressed: Column, delta: Column) -> Column:
    """A stored record's length (27 bits) with two flags above it."""
    return length.bitwiseOR(F.when(compressed, 1 << 27).otherwise(0)).bitwiseOR(F.when(delta, 1 << 28).otherwise(0))


def mode(type_: Column) -> Column:
    return F.coalesce(*(F.when(type_ == t, F.lit(m)) for t, m in MODES.items()), F.lit("000000"))


def is_file(type_: Column) -> Column:
    return type_.isin(FILE, EXECUTIBLE)

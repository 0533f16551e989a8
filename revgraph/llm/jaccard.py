"""Operator 10: exact n-gram Jaccard self-join, size-aware, and the components of its links.

A document's set holds the 64-bit hashes of its distinct shingles of `width` words (fewer words: the whole sequence as one).
Documents of equal sets are one class, so copies are never joined with one another. Two classes of sizes a, b link when their
overlap reaches c(a, b) = ceil(3 (a + b) / 7), the integer form of 100 |A & B| >= 75 |A | B|.

Light classes (size up to a boundary that costs choose) enumerate, for every partner size, their subsets of exactly c
shingles: classes that share a subset link, without any further check. Heavy classes go to inverted lists: sets are ordered by a
global order (frequent shingles last, as counted over all documents) and each set is listed under its first n - ceil(3n/4) + 1
shingles only, where any partner must meet it. A boundary class of more than 3/4 of the boundary takes part in both.

Pairs aren't emitted. A list is cut where sizes are too far apart, and its classes meet in the group of its hub, once each. Two filters on upper bounds of what
two classes share leave what needs a look at whole sets: by how many listed shingles each has, then by a product of incidence matrices of listed shingles and
their places in the order (the positional filter for all pairs of a group at once). The classes that it leaves come with whole sets, once, to the component of what may
link; another product verifies all pairs there, and only the components within a group leave it. A group of many members or shingles is dealt into blocks, and each two blocks meet.
No list, set or pair is capped or sampled.

Nulls and texts without words: empty set, linked with nothing. A null doc_id is greater than any other: a document without one links as others do and gets the
least doc_id of its component, null if that has none. Rows that repeat a doc_id are documents of their own. Columns besides doc_id and text are ignored. An
empty table gives an empty result. Class ids are 64-bit hashes of sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revgraph.llm.common import written
from revgraph.llm.components import connected

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Sets up to this size may be light.
LIGHT_MOST = 16
#: The key of the first of the frequent shingles; all others' keys are less.
LATE = 1 << 62


class Hashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


WORDS = Hashes()


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct shingle hashes. bytes.lower() and bytes.split() know ASCII letters and ASCII white space only, as wanted."""
    words = text.encode().lower().split() if text else []
    n = len(words)
    if not n:
        return np.empty(0, np.int64)
    if n < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), n)], np.uint64).view(np.int64)
    w = np.fromiter(map(WORDS.__getitem__, words), np.uint64, n)
    h = w[: n - width + 1].copy()
    for k in range(1, width):
        h *= MULTIPLIER
        h += w[k : n - width + 1 + k]
    return np.unique(mixed(h).view(np.int64))


def class_of(s: np.ndarray) -> int | None:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None


def overlap(a: int, b: int) -> int:
    """The least overlap at which sets of these sizes link."""
    return -(-3 * (a + b) // 7)


def batches_of(batch: pa.RecordBatch, rows: int = 1000) -> Iterator[tuple[list[int], list[str | None]]]:
    for k in range(0, batch.num_rows, rows):
        part = batch.slice(k, rows)
        yield part.column(0).to_pylist(), part.column(1).to_pylist()


def surveyed(docs: DataFrame, width: int, slice_tokens: int = 3_000_000) -> DataFrame:
    """Rows of three kinds: (doc_id, n, class) of each document; (token, count) of what three or more documents of a slice (some `slice_tokens` shingles) share; (n, class, token) of small sets."""
    names = ["doc_id", "n", "class", "token", "count"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def rows(k: int, **given: object) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(given[x], t) if x in given else pa.nulls(k, t) for x, t in zip(names, types, strict=True)], names=names)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def often() -> pa.RecordBatch:
            token, count = np.unique(np.concatenate(held), return_counts=True)
            token, count = token[count >= 3], count[count >= 3]
            held.clear()
            return rows(len(token), token=token, count=count)

        for batch in batches:
            for ids, texts in batches_of(batch):
                sets = [shingles(x, width) for x in texts]
                of = [class_of(x) for x in sets]
                yield rows(len(sets), doc_id=ids, n=[len(x) for x in sets], **{"class": of})
                held += sets
                if sum(map(len, held)) > slice_tokens:
                    yield often()
                small = [(len(x), c, t) for x, c in zip(sets, of, strict=True) if len(x) <= LIGHT_MOST for t in x.tolist()]
                if small:
                    yield rows(len(small), n=[x[0] for x in small], token=[x[2] for x in small], **{"class": [x[1] for x in small]})
        if held:
            yield often()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(task, "doc_id long, n int, class long, token long, count long")


def prefixes(docs: DataFrame, width: int, light: int, late: np.ndarray) -> DataFrame:
    """(key, class, n, pos): the first shingles in the global order of each class of more than 3/4 of `light`, once for each task that meets it.

    A shingle's key gives its place in that order: 63 bits of its hash or, for the frequent ones (late, least frequent first), a number above all of these.
    """
    by_token = np.argsort(late)
    tokens = late[by_token]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, texts in batches_of(batch):
                parts, sizes, ids = [], [], []
                for text in texts:
                    s = shingles(text, width)
                    n, of = len(s), class_of(s)
                    if 4 * n <= 3 * light or of is None or of in seen:
                        continue
                    if len(seen) > 1_000_000:
                        seen.clear()
                    seen.add(of)
                    key = s >> 1
                    if len(tokens):
                        at = np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)
                        often = tokens[at] == s
                        if often.any():
                            key = np.concatenate((key[~often], np.sort(by_token[at[often]]) + LATE))
                    parts.append(key[: n - -(-3 * n // 4) + 1])
                    sizes.append(n)
                    ids.append(of)
                if parts:
                    k = [len(x) for x in parts]
                    pos = np.concatenate([np.arange(x, dtype=np.int32) for x in k])
                    columns = [np.concatenate(parts), np.repeat(np.array(ids, np.int64), k), np.repeat(np.array(sizes, np.int32), k), pos]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["key", "class", "n", "pos"])

    return docs.select("doc_id", "text").mapInArrow(task, "key long, class long, n int, pos int")


def boundary(sizes: dict[int, int], list_cost: float = 8.0) -> int:
    """The greatest light size: the one with the least cost of subsets below and list entries above (of list_cost subsets each)."""

    def subsets(n: int) -> int:
        return sum(comb(n, c) for m in range(-(-3 * n // 4), 4 * n // 3 + 1) if (c := overlap(n, m)) <= min(n, m))

    cost = {b: sum(k * (subsets(n) if n <= b else 0) + k * list_cost * (n - -(-3 * n // 4) + 1) * (4 * n > 3 * b) for n, k in sizes.items()) for b in range(LIGHT_MOST + 1)}
    return min(cost, key=cost.get)


def light_edges(rows: DataFrame, most: int) -> DataFrame:
    """Links among classes of up to `most` shingles, as stars over the classes that share a subset."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for of, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n = len(tokens)
                for m in range(-(-3 * n // 4), min(most, 4 * n // 3) + 1):
                    if (c := overlap(n, m)) <= min(n, m):
                        key = min(n, m) << 8 | max(n, m)
                        out += [(of, n, key, xxhash.xxh3_64_intdigest(np.array(x, np.int64).tobytes(), key) - (1 << 63)) for x in combinations(sorted(tokens), c)]
            columns = zip(*out, strict=True) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["class", "n", "sizes", "subset"])

    sets = rows.where(F.col("n") <= most).groupBy("class").agg(F.collect_set("token").alias("tokens"))
    subsets = sets.mapInArrow(task, "class long, n int, sizes int, subset long")
    small, large = F.col("n") == F.shiftright("sizes", 8), F.col("n") == F.col("sizes").bitwiseAND(255)
    both = subsets.groupBy("sizes", "subset").agg(F.min("class").alias("hub"), F.count("*").alias("k"), F.min(F.when(small, F.col("class"))).alias("s"), F.min(F.when(large, F.col("class"))).alias("l"))
    both = both.where("k > 1 and s is not null and l is not null").select("sizes", "subset", "hub")
    return subsets.join(both, ["sizes", "subset"]).select(F.col("class").alias("u"), F.col("hub").alias("v")).where("u <> v").distinct()


def met(rows: DataFrame) -> DataFrame:
    """(hub, class, n, key, pos) of lists, without repetitions, of classes beside which stands one of a compatible size.

    A list comes in order of sizes and passes through its task as a stream. Where the next size is more than 4/3 of the last, no pair across can link, so a list ends
    there and another begins. Its hub is its first class, so that the lists of a set of near copies mostly have the same one.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: pa.RecordBatch | None = None  # the last row, the hub of its list, and whether it was given out
        hub, given = 0, False
        for batch in batches:
            carried = last is not None
            if carried:
                batch = pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
            if not batch.num_rows:
                continue
            key, of = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (of[1:] != of[:-1])
            batch = batch.filter(pa.array(new))
            key, of, n = (batch.column(k).to_numpy() for k in range(3))
            same = np.zeros(len(key) + 1, bool)
            same[1:-1] = (key[1:] == key[:-1]) & (4 * n[:-1].astype(np.int64) >= 3 * n[1:].astype(np.int64))
            first = np.maximum.accumulate(np.where(same[:-1], 0, np.arange(len(key))))
            hubs = of[first]
            if carried:
                hubs[first == 0] = hub
            more = same[:-1] | same[1:]
            if carried and given:
                more[0] = False
            out = batch.filter(pa.array(more))
            yield pa.RecordBatch.from_arrays([pa.array(hubs[more]), out.column(1), out.column(2), out.column(0), out.column(3)], names=["hub", "class", "n", "key", "pos"])
            given = bool(more[-1]) or (len(key) == 1 and carried and given)
            last, hub = batch.slice(len(key) - 1, 1), int(hubs[-1])

    return rows.repartition("key").sortWithinPartitions("key", "n", "class").mapInArrow(task, "hub long, class long, n int, key long, pos int")


def dealt(members: DataFrame, block: int = 2048, shingles_each: int = 2_000_000) -> DataFrame:
    """(group, class, n, own, across) of members (hub, class, n): every two classes of a hub meet in a group.

    A hub of more than `block` members, or of more than `shingles_each` shingles in all, is dealt into blocks (own), of which each two meet (across).
    """
    many = members.groupBy("hub").agg(F.ceil(F.greatest(F.count("*") / block, F.sum(F.col("n").cast("long")) / shingles_each)).cast("int").alias("blocks")).where("blocks > 1")
    rows = members.select("hub", "class", "n").join(many, "hub", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    group = F.xxhash64("hub", F.least("own", "other"), F.greatest("own", "other")).alias("group")
    return rows.select(group, "class", "n", "own", (F.col("own") != F.col("other")).alias("across"))


def grouped(lists: DataFrame, block: int = 2048) -> DataFrame:
    """dealt() of the hubs of lists with k: how many listed shingles the class has, as an array of one."""
    members = written(lists.groupBy("hub", "class").agg(F.first("n").alias("n"), F.count("*").alias("k")), "members")
    own = written(members.groupBy("class").agg(F.sum("k").alias("k")), "listed")
    return dealt(members, block).join(own, "class").select("group", "class", "n", "own", "across", F.array("k").alias("k"))


def shared_counts(sets: list[np.ndarray], width: int = 1024) -> np.ndarray:
    """How many elements each two sets share, by products of incidence matrices over `width` elements at a time, some rows at a time."""
    sizes = [len(x) for x in sets]
    element, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.cumsum(count > 1) - 1
    column, row = place[inverse], np.repeat(np.arange(len(sets)), sizes)
    often = count[inverse] > 1
    column, row = column[often], row[often]
    exact = np.float32 if max(sizes) < 1 << 24 else np.float64  # counts up to 2 ** 24 are exact in 32 bits
    total = np.zeros((len(sets), len(sets)), exact)
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    for k in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, (k, k + width))
        x = np.zeros((len(sets), min(width, int(column[-1]) + 1 - k)), exact)
        x[row[a:b], column[a:b] - k] = 1
        for i in range(0, len(sets), 256):
            total[i : i + 256] += x[i : i + 256] @ x.T
    return total


def by_group(rows: DataFrame, judge: Callable[..., list[tuple]], names: list[str], schema: str) -> DataFrame:
    """What judge(class, n, own, across, lists...) makes of each group; rows: group, class, n, own, across and columns of lists."""
    width = len(rows.columns)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in range(width)]

        def judged() -> pa.RecordBatch:
            out = []
            group = np.array(held[0])
            for part in np.split(np.arange(len(group)), np.nonzero(np.diff(group))[0] + 1):
                if len(part) > 1:
                    a, b = part[0], part[-1] + 1
                    found = judge(*(np.array(held[k][a:b]) for k in range(1, 5)), *(held[k][a:b] for k in range(5, width)))
                    out += [(int(group[a]), *x) for x in found]
            columns = list(zip(*out, strict=True)) if out else [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=names)

        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                columns = [c.to_pylist() for c in part.columns[:5]]
                for c in part.columns[5:]:
                    columns.append(np.split(c.flatten().to_numpy(), np.cumsum(pc.list_value_length(c).to_numpy())[:-1]))
                more = len(columns[0])
                cut = more
                while cut and columns[0][cut - 1] == columns[0][more - 1]:
                    cut -= 1
                # What ends before the last group of this part is whole.
                if cut or (held[0] and held[0][-1] != columns[0][0]):
                    for h, c in zip(held, columns, strict=True):
                        h.extend(c[:cut])
                    yield judged()
                    held = [[] for _ in range(width)]
                for h, c in zip(held, columns, strict=True):
                    h.extend(c[cut:])
        if held[0]:
            yield judged()

    return rows.repartition("group").sortWithinPartitions("group").mapInArrow(task, schema)


def fitting(n: np.ndarray, own: np.ndarray, across: np.ndarray, most: Callable[[slice], np.ndarray]) -> np.ndarray:
    """Which two members of a group are of compatible sizes and may share, at most most() shingles, as many as linking sets of their sizes must; some rows at a time."""
    n, fit = n.astype(np.int32), np.zeros((len(n), len(n)), bool)
    for k in range(0, len(n), 256):
        part = slice(k, k + 256)
        less, more = np.minimum.outer(n[part], n), np.maximum.outer(n[part], n)
        fit[part] = (4 * less >= 3 * more) & (most(part) >= -(-3 * (less + more) // 7))
        if across[0]:
            fit[part] &= own[part, None] != own[None, :]
    np.fill_diagonal(fit, False)
    return fit


def possible(of: np.ndarray, n: np.ndarray, own: np.ndarray, across: np.ndarray, k: list[np.ndarray]) -> list[tuple]:
    """The classes of a group that have, as another has, enough listed shingles: at most the lesser number of them is shared, and all that one of the two doesn't list."""
    k, rest = np.concatenate(k), -(-3 * n // 4) - 1
    some = fitting(n, own, across, lambda part: np.minimum.outer(k[part], k) + np.maximum.outer(rest[part], rest)).any(1)
    return [tuple(map(int, x)) for x in zip(of[some], n[some], own[some], across[some], strict=True)]


def stars(of: np.ndarray, link: np.ndarray) -> list[tuple]:
    """The components of a group's links, as edges to one class of each."""
    label = np.arange(len(of), dtype=np.int32)
    while True:
        then = np.concatenate([np.where(link[k : k + 256], label[None, :], len(of)).min(1) for k in range(0, len(of), 256)])
        then = np.minimum(then, label)
        then = then[then]
        if (then == label).all():
            return [(int(of[i]), int(of[k])) for i, k in enumerate(label.tolist()) if k != i]
        label = then


def able(of: np.ndarray, n: np.ndarray, own: np.ndarray, across: np.ndarray, keys: list[np.ndarray], pos: list[np.ndarray]) -> list[tuple]:
    """Components of the classes of a group that share enough listed shingles: up to the lesser of their last listed ones two classes share no others, and beyond it
    they share what is left of either at most. Keys are in order; pos: their places among all shingles of the class."""
    common = shared_counts(keys)
    last = np.array([x[-1] for x in keys])
    # At least upto[x] shingles of y come up to the last listed one of x; rest[y, x]: the others.
    rest = np.empty(common.shape, np.int32)
    for i, (k, p) in enumerate(zip(keys, pos, strict=True)):
        upto = np.concatenate(([0], p + 1)).astype(np.int32)[np.searchsorted(k, last, "right")]
        rest[i] = int(n[i]) - upto
    return stars(of, fitting(n, own, across, lambda part: common[part] + np.minimum(rest[part], rest[:, part].T)))


def links(of: np.ndarray, n: np.ndarray, own: np.ndarray, across: np.ndarray, sets: list[np.ndarray]) -> list[tuple]:
    """The components of a group's links."""
    common = shared_counts(sets)
    return stars(of, fitting(n, own, across, lambda part: common[part]))


def member_bits(ids: DataFrame, power: int = 25) -> np.ndarray:
    """A bitmap of fixed size (2 ** power bits, 4 MB) in which every address's bit is set. It only saves reading; what it lets through is joined exactly."""
    at = F.pmod(F.col("address"), F.lit(1 << power))
    found = ids.select(F.floor(at / 32768).alias("bucket"), F.pmod(at, F.lit(32768)).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    bits = np.zeros((1 << power) // 8, np.uint8)
    for bucket, part in found:
        bits[bucket * 4096 : (bucket + 1) * 4096] = np.frombuffer(part, np.uint8)
    return bits


def with_sets(rows: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """Rows (with class and the address of a text of it) with the class's whole set, made anew from that text."""
    needed = written(rows, "needed")
    bits = docs.sparkSession.sparkContext.broadcast(member_bits(needed))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for ids, texts in batches_of(batch, 500):
                out = []
                for doc, text in zip(ids, texts, strict=True):
                    if doc is None or bits.value[(at := doc % (len(bits.value) * 8)) >> 3] >> (at & 7) & 1:
                        of = class_of(s := shingles(text, width))
                        address = of if doc is None else doc
                        if of is not None and (address, of) not in seen and (doc is not None or bits.value[(at := of % (len(bits.value) * 8)) >> 3] >> (at & 7) & 1):
                            if len(seen) > 1_000_000:
                                seen.clear()
                            seen.add((address, of))
                            out.append((address, of, s))
                if out:
                    ends = np.cumsum([0, *(len(s) for _, _, s in out)]).astype(np.int32)
                    sets = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([s for _, _, s in out])))
                    yield pa.RecordBatch.from_arrays([pa.array([a for a, _, _ in out], pa.int64()), pa.array([c for _, c, _ in out], pa.int64()), sets], names=["address", "class", "set"])

    found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(task, "address long, class long, set array<long>")
    return needed.join(found, ["address", "class"])


def classes(docs: DataFrame, width: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, n, class) of each document, (class, doc_id) of all classes with their least doc_id, and (node, component) of the classes that have links."""
    docs = docs.select("doc_id", "text")
    survey = written(surveyed(docs, width), "survey")
    members = survey.where("token is null").select("doc_id", "n", "class")
    counted = survey.where("token is not null and class is null").groupBy("token").agg(F.sum("count").alias("count"))
    # Bounded: the order needs no more than the most frequent ones.
    frequent = counted.orderBy(F.col("count").desc(), "token").limit(200_000).collect()
    late = np.array([r.token for r in frequent[::-1]], np.int64)
    first_doc = written(members.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n")), "classes")
    sizes = dict(first_doc.where(F.col("n").between(1, 2 * LIGHT_MOST)).groupBy("n").count().collect())
    light = boundary(sizes)
    lists = written(met(prefixes(docs, width, light, late)), "lists")
    five, schema, pair = ["group", "class", "n", "own", "across"], "group long, class long, n long, own long, across long", "group long, u long, v long"
    chosen = written(by_group(grouped(lists), possible, five, schema), "possible")
    listed = lists.groupBy("class").agg(F.array_sort(F.collect_list(F.struct("key", "pos"))).alias("listed"))
    listed = chosen.join(listed, "class").select(*five, F.col("listed.key").alias("keys"), F.col("listed.pos").alias("pos"))
    # So that a whole set goes to one group (of one block), the groups are now the components of what may link.
    candidates = connected(by_group(listed, able, ["group", "u", "v"], pair).select("u", "v"))
    # A class without any doc_id is found by its own id.
    address = first_doc.select("class", "n", F.coalesce("doc_id", "class").alias("address"))
    members_of = written(candidates.select(F.col("node").alias("class"), F.col("component").alias("hub")).join(address, "class"), "candidates")
    meeting = with_sets(dealt(members_of).join(members_of.select("class", "address"), "class"), docs, width).select(*five, "set")
    edges = by_group(meeting, links, ["group", "u", "v"], pair).select("u", "v")
    if light:
        edges = edges.union(light_edges(survey.where("token is not null and class is not null"), light))
    return members, first_doc, written(connected(edges), "components")


def near_duplicates(docs: DataFrame, width: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id of each document."""
    members, first_doc, component = classes(docs, width)
    # All of these are tables of classes, not of documents, and written ones, whose hot keys Spark's adaptive joins can split.
    least = written(component.join(first_doc, F.col("node") == F.col("class")).groupBy("component").agg(F.min("doc_id").alias("component_id")), "least")
    linked = component.join(least, "component").select(F.col("node").alias("class"), "component_id")
    named = written(first_doc.join(linked, "class", "left").select("class", F.coalesce("component_id", "doc_id").alias("component_id")), "named")
    out = members.join(named, "class", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def deduplicated(docs: DataFrame, width: int = 5, broadcast_most: int = 1_000_000) -> DataFrame:
    """The documents with the least doc_id of their component, with their columns; rows that repeat a doc_id stay or go together, rows without one stay.

    Up to `broadcast_most` ids of documents that go (16 MB) are broadcast; more are joined by shuffling.
    """
    gone = written(near_duplicates(docs, width).where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    return docs.join(F.broadcast(gone) if gone.count() <= broadcast_most else gone, "doc_id", "left_anti").select(docs.columns)

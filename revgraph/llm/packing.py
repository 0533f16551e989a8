"""Operator 4: packing documents into sequences by cutting-stock column generation.

A document's ids are cut into pieces of the context size and a rest. Rests are grouped into classes by length, rounded up to
whole units; how many rests a class has is all that the driver learns (one number for each class, whatever the input).
A linear program over patterns (how many of each class stand in one sequence) minimises the sequences; a knapsack dynamic program
finds the pattern that the present prices value most, until none is worth more than a sequence. Pattern counts are rounded
down, the few rests left are placed best-fit, and the ranks of a class are dealt to the patterns' slots in order. A rank is a
piece's number in its task plus what earlier tasks have of its class, so no class passes through one task.

Ids are those of the tokenizer file as its library gives them: a special token's string in a text is that token (special), and what stands between such strings is
encoded for itself.

Nulls: a null text is empty; the empty text has the end id alone; a null doc_id is packed like any other. Repeated rows are packed as often as they occur; an empty
table gives no piece; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revgraph.llm.bpe import Encoder, encoder
from revgraph.llm.common import written

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task int, class int, number long"


def special_tokens(path: str) -> dict[str, int]:
    """Strings and ids of the special tokens of a tokenizer file in JSON."""
    with open(path, encoding="utf-8") as file:
        return {x["content"]: x["id"] for x in json.load(file)["added_tokens"]}


def encoded(e: Encoder, texts: list[str], special: dict[str, int]) -> Iterator[bytes]:
    """Ids of each text, of which only those with a special token's string are cut first."""
    cut = re.compile("|".join(f"({re.escape(x)})" for x in sorted(special, key=len, reverse=True))) if special else None
    parts = [[x for x in cut.split(text) if x] if cut and cut.search(text) else [text] for text in texts]
    ids = iter(e.encode([x for row in parts for x in row if x not in special]))
    for row in parts:
        yield b"".join(special[x].to_bytes(4, "little") if x in special else next(ids) for x in row)


def pieces(docs: DataFrame, path: str, pattern: str, special: dict[str, int], end_id: int, size: int, unit: int) -> DataFrame:
    """Pieces with their checksum, the task they come from, class and number among the task's pieces of that class."""
    end = end_id.to_bytes(4, "little")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, at, seen = encoder(path, pattern), TaskContext.get().partitionId(), [0] * (size // unit + 1)
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):  # so that few texts are held as strings
                part, rows = batch.slice(k, 1000), []
                texts = [x or "" for x in part.column(1).to_pylist()]
                for doc, ids in zip(part.column(0).to_pylist(), encoded(e, texts, special), strict=True):
                    ids += end
                    n = len(ids) // 4
                    for start in range(0, n, size):
                        length = min(size, n - start)
                        c = -(-length // unit)
                        rows.append((doc, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n, at, c, seen[c]))
                        seen[c] += 1
                columns = zip(*rows, strict=True) if rows else [[]] * 8
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(columns, [pa.int64()] * 5 + [pa.int32()] * 2 + [pa.int64()], strict=True)],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "class", "number"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(task, PIECES)


def best_pattern(sizes: np.ndarray, price: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Knapsack by dynamic programming over capacity: the most valuable pattern."""
    value, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    upto = np.searchsorted(sizes, np.arange(capacity + 1), "right")
    for room in range(1, capacity + 1):
        value[room] = value[room - 1]
        if k := upto[room]:
            worth = value[room - sizes[:k]] + price[:k]
            if worth[i := int(worth.argmax())] > value[room] + 1e-12:
                value[room], took[room] = worth[i], i
    pattern, room = np.zeros(len(sizes)), capacity
    while room > 0:
        if took[room] < 0:
            room -= 1
        else:
            pattern[took[room]] += 1
            room -= sizes[took[room]]
    return float(value[capacity]), pattern


def patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 1e-4, rounds: int = 5000) -> list[tuple[np.ndarray, int]]:
    """Patterns and how often each is used, so that each class is used exactly as often as demanded."""
    m = len(sizes)
    if not m:
        return []
    basis = np.diag((capacity // sizes).astype(float))
    inverse = np.diag(1 / np.diag(basis))
    for _ in range(rounds):
        used = inverse @ demand
        price = inverse.sum(0)
        worth, pattern = best_pattern(sizes, price, capacity)
        if worth <= 1 + 1e-9 or used.sum() * (1 - 1 / worth) < max(0.25, gap * used.sum()):
            break
        column = inverse @ pattern
        ratio = np.where(column > 1e-9, np.maximum(used, 0) / np.where(column > 1e-9, column, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        basis[:, out] = pattern
        inverse[out] /= column[out]
        others = np.arange(m) != out
        inverse[others] -= np.outer(column[others], inverse[out])
    times = np.floor(np.maximum(inverse @ demand, 0) + 1e-6).astype(int)
    done = [(basis[:, j].astype(int), int(times[j])) for j in range(m) if times[j]]
    left = demand.astype(int) - sum((p * t for p, t in done), np.zeros(m, int))
    for p, t in [*done] if (left < 0).any() else []:  # only by rounding errors
        back = min(t, int(max(0, np.ceil(np.max(np.where(p > 0, -left / np.maximum(p, 1), 0))))))
        left += p * back
        done = [(q, u - back if q is p else u) for q, u in done]
    room: list[int] = []
    bins: list[np.ndarray] = []
    for c in range(m - 1, -1, -1):  # at most a pattern's worth for each class: best fit, longest first
        for _ in range(left[c]):
            fit = min((k for k in range(len(room)) if room[k] >= sizes[c]), key=lambda k: room[k], default=None)
            if fit is None:
                room.append(capacity)
                bins.append(np.zeros(m, int))
                fit = len(room) - 1
            room[fit] -= int(sizes[c])
            bins[fit][c] += 1
    return [x for x in done if x[1]] + [(b, 1) for b in bins]


def pack(docs: DataFrame, path: str, pattern: str, special: dict[str, int] | None = None, end_id: int = 1, size: int = 2048, unit: int = 8) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens) with sequence_id and offset, gapless from 0, of sequences of at most `size` ids."""
    cut = written(pieces(docs, path, pattern, special or {}, end_id, size, unit), "pieces")
    counts = cut.groupBy("task", "class").agg((F.max("number") + 1).alias("n"))
    histogram = {c: n for c, n in counts.groupBy("class").agg(F.sum("n")).collect()}  # a row for each class at most
    capacity = size // unit
    sizes = np.array(sorted(c for c in histogram if c < capacity), int)
    plan = patterns(sizes, np.array([histogram[c] for c in sizes], float), capacity)
    given, low, sequence, each, base = dict.fromkeys(histogram, 0), [], [], [], 0
    for p, times in plan:
        for i in np.nonzero(p)[0]:
            c = int(sizes[i])
            low.append(c << 40 | given[c])
            sequence.append(base)
            each.append(int(p[i]))
            given[c] += int(p[i]) * times
        base += times
    low.append(capacity << 40)
    sequence.append(base)
    each.append(1)
    order = np.argsort(low)
    lows, sequences, eaches = (np.array(x, np.int64)[order] for x in (low, sequence, each))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            key = f["class"].to_numpy(np.int64) << 40 | f["rank"].to_numpy(np.int64)
            slot = np.searchsorted(lows, key, "right") - 1
            f["sequence_id"] = sequences[slot] + (key - lows[slot]) // eaches[slot]
            yield f[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "class", "rank"]]

    before = Window.partitionBy("class").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("task", "class", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = cut.join(first, ["task", "class"]).withColumn("rank", F.col("first") + F.col("number"))
    placed = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "class", "rank").mapInPandas(
        place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, class int, rank long"
    )
    within = Window.partitionBy("sequence_id").orderBy(F.col("class").desc(), "rank").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(within), F.lit(0))).drop("class", "rank")

"""Operator 6: approximate nearest neighbours by an inverted multi-index.

A vector (of length 1, so that the largest cosine is the least distance) is cut into two halves. Each half is quantised by centroids of its own, fitted on a
documented bounded sample; a cell is a pair of centroids. Every vector is indexed. A query visits cells by the sum of its halves' distances to the
two centroids, least first, taken from a heap that grows by the two next pairs, until the visited cells hold `share` of all vectors, at any size of the table; what
they hold is reranked by the exact cosine in double precision. Ties go to the smaller vec_id. A query whose cells hold fewer than k candidates gets fewer, unless the table itself has no more.

Equal vectors are one entry with their smallest ids, as many as can be asked for, so a very common vector fills no cell. Entries go by their left centroid, with as many
blocks for each as bound a task's memory; a query goes to the blocks of each left centroid once, with the right centroids that it visits there.

Vectors that are null, zero or of other than the usual number of components (the most frequent one), or that hold null or non-finite components, take no part: they are neither queries nor candidates. An
empty table gives an empty result. Rows that repeat a vec_id with the same vector count once. Columns besides vec_id and embedding are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from revgraph.llm.common import written


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=-1, keepdims=True)


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    centroids = x[np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        own = nearest(x, centroids)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        count = np.bincount(own, minlength=len(centroids))
        centroids = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centroids)
    return centroids


def squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ centroids.T + (centroids * centroids).sum(1)[None, :]


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return squared(x, centroids).argmin(1)


def cells_by_distance(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs of centroids by the sum of their distances, least first: a heap of the frontier of the two sorted rows."""
    i_order, j_order = np.argsort(left, kind="stable"), np.argsort(right, kind="stable")
    heap, seen = [(left[i_order[0]] + right[j_order[0]], 0, 0)], {(0, 0)}
    while heap:
        _, i, j = heapq.heappop(heap)
        yield int(i_order[i]), int(j_order[j])
        for a, b in ((i + 1, j), (i, j + 1)):
            if a < len(left) and b < len(right) and (a, b) not in seen:
                seen.add((a, b))
                heapq.heappush(heap, (left[i_order[a]] + right[j_order[b]], a, b))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array<double>) of the vectors that take part."""
    v = vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    v = v.where(fine)
    sizes = v.groupBy(F.size("v").alias("size")).count().orderBy(F.col("count").desc(), "size").first()
    return v.where(F.size("v") == (sizes.size if sizes else 0))


def search(vectors: DataFrame, every: int = 50, k: int = 5, centroids: int = 32, sample: int = 20_000, share: float = 0.5, block: int = 8192) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest that each query (vec_id divisible by `every`) finds."""
    spark = vectors.sparkSession
    all_vectors = usable(vectors)
    # Of equal vectors the smallest ids suffice: a query may be one of them. Repeated rows go first, so that ids are ranked, not rows.
    smallest = all_vectors.distinct().withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    entries = written(smallest.groupBy("v").agg(F.sort_array(F.collect_set("vec_id")).alias("ids")), "entries")
    train = np.array([r.v for r in entries.orderBy(F.xxhash64("v")).limit(sample).select("v").collect()], float)  # bounded by sample
    if not len(train):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    half = max(1, train.shape[1] // 2)
    books = [kmeans(part, centroids) for part in (unit(train)[:, :half], unit(train)[:, half:])] if train.shape[1] > 1 else [kmeans(unit(train), centroids), np.zeros((1, 0))]

    def index(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                x = unit(np.array(f["v"].tolist(), float))
                f["left"], f["right"] = nearest(x[:, :half], books[0]), nearest(x[:, half:], books[1])
                yield f[["v", "ids", "left", "right"]]

    indexed = written(entries.mapInPandas(index, "v array<double>, ids array<long>, left int, right int"), "index")
    held = {(r.left, r.right): r["count"] for r in indexed.groupBy("left", "right").count().collect()}  # a row for each cell at most
    wanted = share * sum(held.values())
    blocks = [-(-sum(held.get((i, j), 0) for j in range(len(books[1]))) // block) for i in range(len(books[0]))]

    def visit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if not len(f):
                continue
            x = unit(np.array(f["q"].tolist(), float))
            out = []
            for left, right in zip(squared(x[:, :half], books[0]), squared(x[:, half:], books[1]), strict=True):
                got, visited = 0, {}
                for i, j in cells_by_distance(left, right):
                    if n := held.get((i, j), 0):
                        visited.setdefault(i, []).append(j)
                        got += n
                        if got >= wanted:
                            break
                out.append([{"left": i, "rights": rights} for i, rights in visited.items()])
            f["visits"] = out
            yield f[["query_id", "q", "visits"]]

    queries = all_vectors.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")).dropDuplicates(["query_id"])
    visits = queries.repartition("query_id").mapInPandas(visit, "query_id long, q array<double>, visits array<struct<left:int,rights:array<int>>>")
    many = F.get(F.array(*map(F.lit, blocks)), F.col("left"))
    visits = visits.select("query_id", "q", F.inline("visits")).withColumn("block", F.explode(F.sequence(F.lit(0), many - 1)))
    placed = indexed.withColumn("block", F.pmod(F.xxhash64("v"), many.cast("long")).cast("int"))

    def rerank(key: tuple, asked: pd.DataFrame, stored: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, float]] = []
        if len(asked) and len(stored):
            stored = stored.sort_values("right", kind="stable")
            x = np.array(stored["v"].tolist(), float)
            norm = np.sqrt(np.einsum("ij,ij->i", x, x))
            ids = stored["ids"].tolist()
            ends = np.searchsorted(stored["right"].to_numpy(), np.arange(len(books[1]) + 1))
            for query, q, rights in zip(asked["query_id"], asked["q"], asked["rights"], strict=True):
                q = np.asarray(q, float)
                at = np.concatenate([np.arange(ends[j], ends[j + 1]) for j in rights])
                if not len(at):
                    continue
                score = np.einsum("ij,j->i", x[at], q) / (norm[at] * np.sqrt(np.einsum("i,i->", q, q)))
                keep = min(len(score), k + 1)
                limit = np.partition(score, len(score) - keep)[len(score) - keep]
                best = [(-score[i], v) for i in np.nonzero(score >= limit)[0] for v in ids[at[i]] if v != query]
                out += [(query, v, -s) for s, v in sorted(best)[:k]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    asked = visits.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-queries.count() // block)))).cast("int"))
    parts = asked.select(F.col("left").alias("l"), F.col("block").alias("b"), F.col("part").alias("p")).distinct()
    stored = placed.join(parts, (F.col("left") == F.col("l")) & (placed["block"] == F.col("b"))).select("v", "ids", "right", "l", "b", "p")
    near = asked.groupBy("left", "block", "part").cogroup(stored.groupBy("l", "b", "p")).applyInPandas(rerank, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

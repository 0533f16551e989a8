"""Commit-graph traversal over commits(id, generation, ...) and edges commit_parents(id, ord, parent_id).

A child's generation exceeds its parents'. Chains of first parents are followed by doubling: a table of jumps of 1, 2, 4, ... steps takes a set of commits to all
their first-parent ancestors in as many joins as the logarithm of the longest chain. Where all parents count, the side parents of what was reached begin the next
chains, so the rounds are as many as merges lie within one another, not as a history is long. What was reached is a table of its own, so the plan doesn't grow with depth.

Doubling moves all edges once for each doubling. Where only first parents count and edges are many, they are contracted before: each round takes some quarter of the
commits out of their chains, no two of them neighbours, until few edges are left to be doubled; then the rounds are gone back. So what is moved is in proportion to the edges.
"""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revgraph.plans.tables import written


class Jumps:
    """Tables (at, to) of 2 ** k first-parent steps, made as they are asked for."""

    def __init__(self, edges: DataFrame):
        self.tables = [edges.where("ord = 0").select(F.col("id").alias("at"), F.col("parent_id").alias("to"))]

    def __getitem__(self, k: int) -> DataFrame:
        while len(self.tables) <= k:
            last = self.tables[-1]
            self.tables.append(written(last.alias("a").join(last.alias("b"), F.col("a.to") == F.col("b.at")).select("a.at", "b.to"), "jumps"))
        return self.tables[k]


def along(jumps: Jumps, new: DataFrame, seen: list[DataFrame]) -> list[DataFrame]:
    """Tables of ids: new and all first-parent ancestors that seen, which has the ancestors of its own members, doesn't hold."""
    grown, k = [new], 0
    while True:
        found = reduce(DataFrame.union, grown).join(jumps[k], F.col("id") == F.col("at")).select(F.col("to").alias("id")).where("id is not null").distinct()
        found = written(reduce(lambda d, have: d.join(have, "id", "left_anti"), [*grown, *seen], found), "level")
        if found.isEmpty():
            return grown
        grown.append(found)
        k += 1


class Contracted:
    """First-parent edges in rounds, each of which has fewer than the one before."""

    def __init__(self, edges: DataFrame, most: int = 200_000):
        heads = lambda c, k: F.pmod(F.xxhash64(c, F.lit(k)), F.lit(2)) == 0
        #: For each round, edges that lead to a commit taken out (at, via) and where that one's own edge leads (via, to).
        self.into: list[DataFrame] = []
        self.out: list[DataFrame] = []
        now = written(edges.where("ord = 0 and id is not null and parent_id is not null").select(F.col("id").alias("at"), F.col("parent_id").alias("to")).distinct(), "edges")
        while now.count() > most:
            k = len(self.out)
            # A commit with heads goes if its parent has tails, so its children and its parent stay.
            out = now.where(heads("at", k) & ~heads("to", k)).select(F.col("at").alias("via"), "to")
            led = now.where(heads("to", k)).join(out.withColumnRenamed("to", "then"), F.col("to") == F.col("via"), "left").select("at", F.coalesce("then", "to").alias("to"), "via")
            other = now.where(~heads("at", k) & ~heads("to", k)).select("at", "to", F.lit(None).cast(now.schema["at"].dataType).alias("via"))
            both = written(led.union(other), "contracted")
            self.into.append(both.where("via is not null").select("at", "via"))
            self.out.append(out)
            now = both.select("at", "to")
        self.jumps = Jumps(now.select(F.col("at").alias("id"), F.lit(0).alias("ord"), F.col("to").alias("parent_id")))

    def closure(self, starts: DataFrame) -> DataFrame:
        """id of all commits reachable from starts (id), themselves included."""
        new, settled = written(starts.select("id").where("id is not null").distinct(), "level"), []
        for out in self.out:
            # A start that is taken out is settled by itself, and goes on where it leads.
            led = written(new.join(out, F.col("id") == F.col("via"), "left").select("id", "to"), "level")
            settled.append(led.where("to is not null").select("id"))
            new = led.select(F.coalesce("to", "id").alias("id")).distinct()
        found = along(self.jumps, written(new, "level"), [])
        for into, given in zip(reversed(self.into), reversed(settled), strict=True):
            met = into.join(reduce(DataFrame.union, found).select(F.col("id").alias("at")), "at", "left_semi").select(F.col("via").alias("id"))
            found.append(written(met.union(given), "level"))
        found = reduce(DataFrame.union, found)
        return found.distinct() if self.into else found


def closure(edges: DataFrame, starts: DataFrame, first_parent: bool = False) -> DataFrame:
    """id of all commits reachable from starts (id), themselves included."""
    if first_parent:
        return Contracted(edges).closure(starts)
    jumps, side = Jumps(edges), edges.where("ord > 0").select("id", F.col("parent_id").alias("to"))
    new, seen = written(starts.select("id").where("id is not null").distinct(), "level"), []
    while True:
        grown = along(jumps, new, seen)
        seen = seen + grown
        found = reduce(DataFrame.union, grown).join(side, "id").select(F.col("to").alias("id")).where("id is not null").distinct()
        new = written(reduce(lambda d, have: d.join(have, "id", "left_anti"), seen, found), "level")
        if new.isEmpty():
            break
        if len(seen) >= 8:
            seen = [written(reduce(DataFrame.union, seen), "seen")]
    return reduce(DataFrame.union, seen)


def walk(commits: DataFrame, edges: DataFrame, roots: DataFrame, hidden: DataFrame | None = None, first_parent: bool = False, generation_from: int | None = None, generation_to: int | None = None) -> DataFrame:
    """Commits reachable from roots and not from hidden, of generations in a range. Commits below the range's start are not walked through."""
    if generation_from is not None:
        near = commits.where(F.col("generation") >= generation_from).select(F.col("id").alias("parent_id"))
        edges = edges.join(near, "parent_id", "left_semi")
    reached = Contracted(edges).closure if first_parent else partial(closure, edges)
    found = reached(roots)
    if hidden is not None:
        found = found.join(reached(hidden), "id", "left_anti")
    rows = commits.join(found, "id", "left_semi")
    if generation_from is not None:
        rows = rows.where(F.col("generation") >= generation_from)
    return rows if generation_to is None else rows.where(F.col("generation") <= generation_to)


def walk_hiding(commits: DataFrame, edges: DataFrame, roots: DataFrame, hide: DataFrame) -> DataFrame:
    """The walk in which the commits of `hide` are reported, but hide their ancestors."""
    met = closure(edges, roots).join(hide, "id", "left_semi")
    above = edges.join(met, "id").select(F.col("parent_id").alias("id"))
    return walk(commits, edges, roots, above)


def emission(rows: DataFrame) -> DataFrame:
    """By generation, last first; ties by id."""
    return rows.orderBy(F.col("generation").desc(), "id")


def stopped(rows: DataFrame, stop: DataFrame) -> DataFrame:
    """The part of a walk that a callback sees which stops at the first commit of `stop` (id) in order of emission; that one is its last."""
    place = F.struct((-F.col("generation")).alias("g"), F.col("id").alias("id"))
    first = rows.join(stop.select("id").distinct(), "id", "left_semi").agg(F.min(place).alias("x")).select("x.g", "x.id").first()
    if first.id is None:
        return rows
    return rows.where((-F.col("generation") < first.g) | ((-F.col("generation") == first.g) & (F.col("id") <= F.lit(first.id))))


def nth_parent(rows: DataFrame, edges: DataFrame, n: int) -> DataFrame:
    """id and result: the commit itself for 0, null where there is no such parent."""
    if n == 0:
        return rows.select("id", F.col("id").alias("result"))
    return rows.select("id").join(edges.where(F.col("ord") == n - 1).select("id", F.col("parent_id").alias("result")), "id", "left")


def nth_ancestor(rows: DataFrame, edges: DataFrame, n: int) -> DataFrame:
    """id and result: n first-parent steps up, null beyond the root. Steps are doubled, so their number is the logarithm of n."""
    step = edges.where("ord = 0").select(F.col("id").alias("at"), F.col("parent_id").alias("to"))
    now = rows.select("id", F.col("id").alias("result"))
    while n:
        if n & 1:
            now = now.join(step, F.col("result") == F.col("at"), "left").select("id", F.col("to").alias("result"))
        n >>= 1
        if n:
            step = written(step.alias("a").join(step.alias("b"), F.col("a.to") == F.col("b.at")).select("a.at", "b.to"), "steps")
    return now


def generations(commits: DataFrame, edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """id and generation: 1 for roots, else one more than the greatest of what a commit names: its parents and, if given, the commits that its renames come from (id, source_id).

    A commit that names one other continues a chain, whose length comes by doubling. Roots and commits that name several are settled level by level, once all that they
    name are settled, so the levels are as many as such commits lie within one another.
    """
    named = edges.select("id", "parent_id") if sources is None else edges.select("id", "parent_id").union(sources.select("id", F.col("source_id").alias("parent_id")))
    named = written(named.where("parent_id is not null").join(commits.select("id"), "id", "left_semi").distinct(), "named")
    count = named.groupBy("id").agg(F.count("*").alias("n"), F.min("parent_id").alias("only"))
    ends = commits.select("id").distinct().join(count, "id", "left").withColumn("chain", F.coalesce(F.col("n") == 1, F.lit(False)))
    # Up to which commit, and over how many steps, each one's chain is followed so far; open: that one is on a chain itself.
    up = written(ends.select("id", F.when(F.col("chain"), F.col("only")).otherwise(F.col("id")).alias("to"), F.col("chain").cast("int").alias("steps"), F.col("chain").alias("open")), "chains")
    while not up.where("open").isEmpty():
        on = up.select(F.col("id").alias("at"), F.col("to").alias("then"), F.col("steps").alias("more"), F.col("open").alias("still"))
        both = up.join(on, F.col("to") == F.col("at"), "left")
        # A commit that isn't in the table counts as a root.
        up = written(both.select("id", F.coalesce("then", "to").alias("to"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), (F.col("open") & F.coalesce("still", F.lit(False)) & (F.col("steps") > 0) & (F.col("more") > 0)).alias("open")), "chains")
    tops = up.select(F.col("id").alias("parent_id"), "to", "steps")
    several = named.join(count.where("n > 1").select("id"), "id", "left_semi").join(tops, "parent_id", "left").select("id", F.coalesce("to", "parent_id").alias("to"), F.coalesce("steps", F.lit(0)).alias("steps"))
    several = written(several, "merges")
    roots = up.select(F.col("to").alias("id")).union(several.select(F.col("to").alias("id"))).distinct().join(several.select("id").distinct(), "id", "left_anti")
    done = [written(roots.select("id", F.lit(1).alias("generation")), "settled")]
    while True:
        settled = reduce(DataFrame.union, done)
        open_ones = several.join(settled.select("id"), "id", "left_anti").join(settled.select(F.col("id").alias("to"), "generation"), "to", "left")
        ready = open_ones.groupBy("id").agg(F.every(F.col("generation").isNotNull()).alias("all"), (F.max(F.col("generation") + F.col("steps")) + 1).alias("generation"))
        level = written(ready.where("all").select("id", "generation"), "settled")
        if level.isEmpty():
            break
        done.append(level)
        if len(done) >= 8:
            done = [written(reduce(DataFrame.union, done), "settled")]
    top = reduce(DataFrame.union, done).select(F.col("id").alias("to"), "generation")
    return up.join(top, "to").select("id", (F.col("generation") + F.col("steps")).cast("int").alias("generation"))


def merge_bases(commits: DataFrame, edges: DataFrame, one: DataFrame, other: DataFrame) -> DataFrame:
    """Common ancestors that no other common ancestor descends from."""
    common = written(closure(edges, one).intersect(closure(edges, other)), "common")
    inner = edges.join(common, "id").select(F.col("parent_id").alias("id"))
    return commits.join(common.join(closure(edges, inner), "id", "left_anti"), "id", "left_semi")

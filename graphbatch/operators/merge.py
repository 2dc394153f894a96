"""Greedy merging of output nodes into batches, as rounds of locally dominant pairs.

Pairs have a total order: weight falling, then i, then j rising. A one-by-one greedy pass would take them in that order and merge two groups
if the merged group is small enough. Here each round every group names its best pair that is still open, and a pair that both its
groups name is decided at once. Group sizes and unions only grow, so a pair that doesn't fit now never will, and no decision
taken elsewhere in the round could have come between: the result is the one of the one-by-one pass.

Such rounds can be many: where weights are equal the ids decide, and a path of rising ids is decided pair by pair. So the bound on output nodes, which takes two
sizes a pair, is decided in slices instead: the best ``slice_rows`` open pairs are what the one-by-one pass would take next, and one task decides
them in order; that bound is a parameter and doesn't grow with the data.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphbatch.functions.lineage import cut, cut_and_observe
from graphbatch.operators.influence import DIGITS
from graphbatch.operators.prep import sorted_rank


def even_batch_size(n: int | Column, per_batch: int) -> int | Column:
    """ceil(n / ceil(n / per_batch)): batches of nearly equal size; of a number or within an aggregation."""
    if isinstance(n, Column):
        return F.when(n == 0, F.lit(0).cast("long")).otherwise(F.ceil(n / F.greatest(F.ceil(n / per_batch), F.lit(1))))
    return 0 if n == 0 else -(-n // -(-n // per_batch))


def _rank(pairs: DataFrame) -> DataFrame:
    return pairs.select("i", "j", F.round("weight", DIGITS).alias("w"), F.col("i").alias("gi"), F.col("j").alias("gj"))


def _best_first() -> list:
    return [F.col("w").desc(), F.col("i"), F.col("j")]


def _dominant(live: DataFrame) -> DataFrame:
    """The open pairs that are the best one of both their groups."""
    order = F.struct((-F.col("w")).alias("w"), "i", "j")
    ends = live.select(F.col("gi").alias("g"), order.alias("o")).union(live.select(F.col("gj").alias("g"), order.alias("o")))
    best = ends.groupBy("g").agg(F.min("o").alias("o"))
    left, right = best.select(F.col("g").alias("gi"), F.col("o").alias("oi")), best.select(F.col("g").alias("gj"), F.col("o").alias("oj"))
    return live.join(left, "gi").join(right, "gj").where((F.col("oi") == F.col("oj")) & (F.col("oi.i") == F.col("i")) & (F.col("oi.j") == F.col("j"))).select("i", "j", "gi", "gj")


def _renamed(live: DataFrame, moves: DataFrame) -> DataFrame:
    """Open pairs with their new groups; of parallel pairs the best one, none inside a group."""
    m = moves.select("old", "new")
    for side in ("gi", "gj"):
        live = live.join(m.withColumnRenamed("old", side), side, "left").withColumn(side, F.coalesce("new", side)).drop("new")
    live = live.where("gi <> gj").select("i", "j", "w", F.least("gi", "gj").alias("gi"), F.greatest("gi", "gj").alias("gj"))
    return live.withColumn("rn", F.row_number().over(Window.partitionBy("gi", "gj").orderBy(*_best_first()))).where("rn = 1").drop("rn")


def _moved(groups: DataFrame, moves: DataFrame) -> DataFrame:
    return groups.join(moves.select(F.col("old").alias("group_id"), "new"), "group_id", "left").select("node_id", F.coalesce("new", "group_id").alias("group_id"))


def _slice(live: DataFrame, rows: int) -> DataFrame:
    """The first open pairs in the order of the one-by-one pass."""
    return live.orderBy(*_best_first()).limit(rows)


def merge_by_outputs(pairs: DataFrame, outputs: DataFrame, cap: int, finish_rows: int = 50_000, slice_rows: int = 200_000) -> DataFrame:
    """(node_id, group_id): groups of at most ``cap`` output nodes; a group's id is its smallest node.

    As long as more than ``finish_rows`` pairs are open, a round decides the best ``slice_rows`` of them one by one. Each is then inside a group or turned
    down for good, as sizes only grow, so rounds are at most as many as slices; pairs that no longer fit leave on the way.
    """
    groups = outputs.select("node_id", F.col("node_id").alias("group_id")).distinct()
    live = _rank(pairs)
    while True:
        sizes = groups.groupBy("group_id").agg(F.count("*").alias("size"))
        s = lambda g: sizes.select(F.col("group_id").alias(g), F.col("size").alias(f"s_{g}"))  # noqa: E731,B023
        live, seen = cut_and_observe(live.join(s("gi"), "gi").join(s("gj"), "gj").where(F.col("s_gi") + F.col("s_gj") <= cap), "open", left=F.count(F.lit(1)))
        if seen["left"] == 0:
            return groups
        if seen["left"] <= finish_rows:
            return _moved(groups, _finish(live, cap))
        moves = cut(_finish(_slice(live, slice_rows), cap).where("old <> new"))
        groups = cut(_moved(groups, moves))
        live = _renamed(live.drop("s_gi", "s_gj"), moves)


def _finish(live: DataFrame, cap: int) -> DataFrame:
    """(old, new) group ids after deciding the open pairs one by one; ``live`` is bounded by the caller."""

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches), ignore_index=True).sort_values(["w", "i", "j"], ascending=[False, True, True])
        parent: dict[int, int] = {}
        size: dict[int, int] = {}

        def root(g: int) -> int:
            while parent[g] != g:
                parent[g] = parent[parent[g]]
                g = parent[g]
            return g

        for gi, gj, s_gi, s_gj in zip(*(rows[c].tolist() for c in ("gi", "gj", "s_gi", "s_gj")), strict=True):
            for g, n in ((gi, s_gi), (gj, s_gj)):
                parent.setdefault(g, g)
                size.setdefault(g, n)
            a, b = sorted((root(gi), root(gj)))
            if a != b and size[a] + size[b] <= cap:
                parent[b], size[a] = a, size[a] + size[b]
        yield pd.DataFrame({"old": list(parent), "new": [root(g) for g in parent]})

    return live.coalesce(1).mapInPandas(decide, "old long, new long")


@dataclass(frozen=True)
class Step:
    """Places [first, last) of one size go to ``to_size`` from ``to_first`` on, ``together`` neighbours to one place."""

    size: int
    first: int
    last: int
    to_size: int
    to_first: int
    together: int


def packing_steps(counts: dict[int, int], cap: int) -> list[Step]:
    """How groups of the counted sizes are packed when the two smallest are joined again and again while they fit.

    Only counts matter: of the smallest size all pairs are joined at once, and one that is left joins the next size. Groups of one size
    queue up, those given first, then the joined ones in order of their joining. At most a few steps a size.
    """
    queued, taken, sizes, steps = dict(counts), dict.fromkeys(counts, 0), sorted(counts), []
    heapq.heapify(sizes)

    def push(size: int, n: int) -> int:
        if size not in queued:
            queued[size] = taken[size] = 0
            heapq.heappush(sizes, size)
        queued[size] += n
        return queued[size] - n

    while sizes:
        x = sizes[0]
        left, at = queued[x] - taken[x], taken[x]
        if left >= 2:
            if 2 * x > cap:
                break
            taken[x] += left // 2 * 2
            steps.append(Step(x, at, taken[x], 2 * x, push(2 * x, left // 2), 2))
        elif left == 1:
            heapq.heappop(sizes)
            while sizes and queued[sizes[0]] == taken[sizes[0]]:
                heapq.heappop(sizes)
            if not sizes or x + sizes[0] > cap:
                break
            y = sizes[0]
            to = push(x + y, 1)
            steps += [Step(x, at, at + 1, x + y, to, 1), Step(y, taken[y], taken[y] + 1, x + y, to, 1)]
            taken[x], taken[y] = taken[x] + 1, taken[y] + 1
        else:
            heapq.heappop(sizes)
    return steps


def pack_small_groups(groups: DataFrame, cap: int, buckets: int = 256) -> DataFrame:
    """(node_id, group_id): the two smallest groups are joined again and again while their sizes add up to ``cap`` at most.

    The steps follow from the number of groups of each size alone (at most cap rows); a group finds its place by size and rank, in
    tasks. Ranks within a size are by hash bucket and id, so that a size of very many groups is no single window. The joined group
    keeps its smallest id.
    """
    sizes = groups.groupBy("group_id").agg(F.count("*").alias("size")).where(F.col("size") < cap)
    sizes = cut(sizes.withColumn("bucket", F.pmod(F.xxhash64("group_id"), F.lit(buckets))))
    counts = sizes.groupBy("size", "bucket").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("size", "bucket").orderBy("group_id")) - 1
    ranked = sizes.withColumn("place", place).join(before.drop("n"), ["size", "bucket"]).select("group_id", "size", (F.col("place") + F.col("before")).alias("place"))
    steps = packing_steps({r["size"]: r["n"] for r in counts.groupBy("size").agg(F.sum("n").alias("n")).collect()}, cap)
    if not steps:
        return groups.select("node_id", "group_id")
    table = np.array([(x.size, x.first, x.last, x.to_size, x.to_first, x.together) for x in sorted(steps, key=lambda x: (x.size, x.first))], np.int64)

    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wide = 1 << 40  # more places than a size can have
        keys = table[:, 0] * wide + table[:, 1]
        for b in batches:
            size, at = b["size"].to_numpy().copy(), b["place"].to_numpy().copy()
            moving = np.arange(len(size))
            while len(moving):
                k = np.maximum(0, np.searchsorted(keys, size[moving] * wide + at[moving], side="right") - 1)
                ok = (table[k, 0] == size[moving]) & (table[k, 1] <= at[moving]) & (at[moving] < table[k, 2])
                moving, k = moving[ok], k[ok]
                size[moving], at[moving] = table[k, 3], table[k, 4] + (at[moving] - table[k, 1]) // table[k, 5]
            yield pd.DataFrame({"old": b["group_id"], "size": size, "place": at})

    ends = cut(ranked.mapInPandas(follow, "old long, size long, place long"))
    names = ends.groupBy("size", "place").agg(F.min("old").alias("new"))
    return _moved(groups, ends.join(names, ["size", "place"]).select("old", "new"))


def merge_by_aux(pairs: DataFrame, neighbors: DataFrame, outputs: DataFrame, cap: int, finish_rows: int = 200_000, slice_rows: int = 200_000) -> DataFrame:
    """(node_id, group_id): as ``merge_by_outputs``, the bound being on the union of the groups' neighbour sets.

    A pair whose set sizes add up to more than int(cap 1.0005) is turned down at once, and one whose sizes add up to ``cap`` at most fits whatever the
    sets share. The best ``slice_rows`` open pairs are decided before all others, as the one-by-one pass would (``_merge_open``).
    """
    groups = outputs.select("node_id", F.col("node_id").alias("group_id")).distinct()
    sets = cut(neighbors.select(F.col("source").alias("g"), "node").join(outputs.select(F.col("node_id").alias("g")).distinct(), "g", "left_semi").distinct())
    quick, live = int(cap * 1.0005), _rank(pairs)
    while True:
        live, seen = cut_and_observe(_fitting(live, sets, quick), "open", left=F.count(F.lit(1)))
        if seen["left"] == 0:
            return groups
        if seen["left"] <= slice_rows:
            return _moved(groups, _merge_open(live, sets, cap, quick, finish_rows))
        part, place = cut(_slice(live, slice_rows)), F.struct((-F.col("w")).alias("w"), "i", "j")
        moves = cut(_merge_open(part, sets, cap, quick, finish_rows).where("old <> new"))
        groups = cut(_moved(groups, moves))
        sets = cut(_joined(sets, moves))
        # All pairs of the slice are decided; those that were turned down may still look as if they fit.
        after = live.crossJoin(F.broadcast(part.agg(F.max(place).alias("last")))).where(place > F.col("last"))  # one row
        live = _renamed(after.drop("s_gi", "s_gj", "last"), moves)


def _fitting(live: DataFrame, sets: DataFrame, quick: int) -> DataFrame:
    sizes = sets.groupBy("g").agg(F.count("*").alias("size"))
    s = lambda g: sizes.select(F.col("g").alias(g), F.col("size").alias(f"s_{g}"))
    return live.join(s("gi"), "gi").join(s("gj"), "gj").where(F.col("s_gi") + F.col("s_gj") <= quick)


def _joined(sets: DataFrame, moves: DataFrame) -> DataFrame:
    return sets.join(moves.withColumnRenamed("old", "g"), "g", "left").select(F.coalesce("new", "g").alias("g"), "node").distinct()


def _merge_open(live: DataFrame, sets: DataFrame, cap: int, quick: int, finish_rows: int) -> DataFrame:
    """(old, new) group ids after deciding all pairs of ``live``, whose number the caller bounds.

    Once at most ``finish_rows`` pairs are open, each connected component of them with at most ``finish_rows`` rows of sets is decided in a task of its own; larger
    ones go on in rounds. Only for dominant pairs whose sizes leave doubt is the size of the union counted, by a join of their sets.
    """
    first = live.select(F.explode(F.array("gi", "gj")).alias("g")).distinct()
    groups, sets = first.select(F.col("g").alias("node_id"), F.col("g").alias("group_id")), sets.join(first, "g", "left_semi")
    named = lambda: groups.select(F.col("node_id").alias("old"), F.col("group_id").alias("new"))
    while True:
        left = live.count()
        if left == 0:
            return named()
        if left <= finish_rows:
            ends = cut(_components(live))
            open_sets = cut(sets.join(ends, "g"))
            large = cut(open_sets.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > finish_rows).select("component"))
            parts = live.join(ends.withColumnRenamed("g", "gi"), "gi")
            done = _finish_aux(parts.join(large, "component", "left_anti"), open_sets.join(large, "component", "left_anti"), cap, quick)
            groups = _moved(groups, done)
            if large.isEmpty():
                return named()
            groups = cut(groups)
            live = cut(parts.join(large, "component", "left_semi").drop("component"))
        top, total = cut(_dominant(live).join(live.select("i", "j", "s_gi", "s_gj"), ["i", "j"])), F.col("s_gi") + F.col("s_gj")
        if quick > cap:
            unsure = top.where(total > cap).select("gi", "gj")
            both = unsure.join(sets.withColumnRenamed("g", "gi"), "gi").join(sets.withColumnRenamed("g", "gj"), ["gj", "node"]).groupBy("gi", "gj").agg(F.count("*").alias("shared"))
            top = cut(top.join(both, ["gi", "gj"], "left").withColumn("fits", total - F.coalesce("shared", F.lit(0)) <= cap))
        else:
            top = top.withColumn("fits", F.lit(True))
        moves = top.where("fits").select(F.greatest("gi", "gj").alias("old"), F.least("gi", "gj").alias("new"))
        groups = cut(_moved(groups, moves))
        sets = cut(_joined(sets, moves))
        # A pair that was turned down stays so; parallel pairs of the same two groups go with it.
        live = live.drop("s_gi", "s_gj").join(top.where("NOT fits").select("gi", "gj"), ["gi", "gj"], "left_anti")
        live = cut(_fitting(_renamed(live, moves), sets, quick))


def _components(live: DataFrame) -> DataFrame:
    """(g, component): groups that open pairs connect, named by the smallest; one task over pairs whose number the caller has bounded."""

    def connect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parent: dict[int, int] = {}

        def root(g: int) -> int:
            while parent.setdefault(g, g) != g:
                parent[g] = parent[parent[g]]
                g = parent[g]
            return g

        for b in batches:
            for i, j in zip(b["gi"].tolist(), b["gj"].tolist(), strict=True):
                a, c = sorted((root(i), root(j)))
                parent[c] = a
        yield pd.DataFrame({"g": list(parent), "component": [root(g) for g in parent]}).astype("i8")

    return live.select("gi", "gj").coalesce(1).mapInPandas(connect, "g long, component long")


def _finish_aux(live: DataFrame, sets: DataFrame, cap: int, quick: int, lanes: int = 200) -> DataFrame:
    """(old, new) group ids after deciding the open pairs of each component one by one; the caller bounds both tables of a component.

    Components share ``lanes`` by hash, for most of them hold a few pairs only; what is open in one changes nothing in another.
    """
    none, lane = F.lit(None), F.pmod(F.xxhash64("component"), F.lit(lanes)).alias("lane")
    rows = live.select(lane, "i", "j", "w", "gi", "gj").union(sets.select(lane, "node", none.cast("long"), none.cast("double"), "g", none.cast("long")))

    def decide(every: pd.DataFrame) -> pd.DataFrame:
        aux: dict[int, set[int]] = {}
        held = every[every["gj"].isna()]
        for g, node in zip(held["gi"].tolist(), held["i"].tolist(), strict=True):
            aux.setdefault(g, set()).add(node)
        parent, refused = {g: g for g in aux}, set()

        def root(g: int) -> int:
            while parent[g] != g:
                parent[g] = parent[parent[g]]
                g = parent[g]
            return g

        pairs = every[every["gj"].notna()].sort_values(["w", "i", "j"], ascending=[False, True, True])
        for gi, gj in zip(pairs["gi"].tolist(), pairs["gj"].astype("i8").tolist(), strict=True):
            a, b = sorted((root(gi), root(gj)))
            if a == b or (a, b) in refused:
                continue
            if len(aux[a]) + len(aux[b]) <= quick and len(union := aux[a] | aux[b]) <= cap:
                parent[b], aux[a] = a, union
                del aux[b]
            else:
                refused.add((a, b))
        return pd.DataFrame({"old": list(parent), "new": [root(g) for g in parent]}, dtype="i8")

    return rows.groupBy("lane").applyInPandas(decide, "old long, new long")


def _chain(sets: DataFrame, ranked: DataFrame, cap: int) -> tuple[int, int | None, int]:
    """How far joining one by one runs as a chain, in which the latest union is always among the next two to be joined.

    Returns the last rank of the chain, the rank whose union is the first above ``cap`` (None without one, or if the chain stops before it), and the
    smallest id in the chain. The union up to a rank counts each node at its first rank; running sums are taken within
    blocks of 4,096 ranks, and over one row a block.
    """
    fresh = sets.join(ranked.select("g", "rank"), "g").groupBy("node").agg(F.min("rank").alias("rank")).groupBy("rank").agg(F.count("*").alias("fresh"))
    after = ranked.select((F.col("rank") - 2).alias("rank"), F.struct("size", "g").alias("after"))
    rows = cut(ranked.join(fresh, "rank", "left").join(after, "rank", "left").select("g", "rank", "after", F.coalesce("fresh", F.lit(0)).alias("fresh"), F.floor(F.col("rank") / 4096).alias("block")))
    ahead = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("block").agg(F.sum("fresh").alias("n"), F.min("g").alias("low"))
    blocks = blocks.select("block", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("n"), F.min("low").over(ahead).alias("low"))
    inside = Window.partitionBy("block").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    union = F.struct((F.col("n") + F.sum("fresh").over(inside)).alias("size"), F.least("low", F.min("g").over(inside)).alias("g"))
    found = rows.join(blocks, "block").select("rank", "after", union.alias("union"))
    told = cut(found).agg(
        F.min(F.when(F.col("union") >= F.col("after"), F.col("rank"))).alias("stop"),
        F.min(F.when((F.col("rank") > 0) & (F.col("union.size") > cap), F.col("rank"))).alias("over"),
        F.max("rank").alias("last"),
    ).first()
    stop = told["last"] if told["stop"] is None else told["stop"]
    if told["over"] is not None and told["over"] - 1 < (told["last"] + 1 if told["stop"] is None else stop):
        return told["over"] - 1, told["over"], ranked.where(F.col("rank") < told["over"]).agg(F.min("g")).first()[0]
    return stop, None, ranked.where(F.col("rank") <= stop).agg(F.min("g")).first()[0]


def pack_small_aux(groups: DataFrame, neighbors: DataFrame, cap: int, finish_rows: int = 50_000) -> DataFrame:
    """(node_id, group_id): the two groups with the smallest neighbour sets are joined while the union stays within ``cap``; the first failure ends it.

    Groups already at ``cap`` can't change and stay out. In rounds: open groups are paired in order of (set size, id). All pairs in front of
    the smallest of the unions are what joining one by one would take next, for no union comes before them; they are joined at once. Where that
    is less than an eighth of the open groups (sets that hold one another, so that unions hardly grow), the round looks for a chain too: as long as
    the union so far is always one of the next two, a whole run of groups joins at once. The longer of both counts. Once the open sets have at most
    ``finish_rows`` rows, one task joins the rest one by one.
    """
    sets = groups.join(neighbors.select(F.col("source").alias("node_id"), "node"), "node_id").select("group_id", "node").distinct()
    small = sets.groupBy("group_id").agg(F.count("*").alias("size")).where(F.col("size") < cap).select("group_id")
    sets = cut(sets.join(small, "group_id").select(F.col("group_id").alias("g"), "node"))
    while sets.count() > finish_rows:
        ranked = cut(sorted_rank(sets.groupBy("g").agg(F.count("*").alias("size")), "size", "g").withColumn("k", F.floor(F.col("rank") / 2)))
        pairs = ranked.groupBy("k").agg(F.min("g").alias("new"), F.max(F.struct("size", "g")).alias("last"), F.count("*").alias("n")).where("n = 2")
        unions = sets.join(ranked.select("g", "k"), "g").groupBy("k").agg(F.count_distinct("node").alias("u"))
        pairs = cut(pairs.join(unions, "k"))
        told = pairs.agg(F.min(F.struct(F.col("u").alias("size"), F.col("new").alias("g"))).alias("m"), F.count("*").alias("n")).first()
        least = told["m"]
        if least is None:
            return groups.select("node_id", "group_id")
        next_ones = (F.col("k") == 0) | (F.col("last.size") < least["size"]) | ((F.col("last.size") == least["size"]) & (F.col("last.g") < least["g"]))
        failed = pairs.where(next_ones & (F.col("u") > cap)).agg(F.min("k")).first()[0]
        done = cut(pairs.where(next_ones if failed is None else next_ones & (F.col("k") < failed)).select("k", "new"))
        moves, joined = ranked.join(done, "k").select(F.col("g").alias("old"), "new"), done.count()
        if failed is None and joined * 4 < told["n"]:
            end, failed, name = _chain(sets, ranked, cap)
            if failed is not None or end > joined:
                moves = ranked.where(F.col("rank") <= end).select(F.col("g").alias("old"), F.lit(name).alias("new"))
        moves = cut(moves)
        groups = cut(_moved(groups, moves))
        if failed is not None:
            return groups
        sets = cut(sets.join(moves.withColumnRenamed("old", "g"), "g", "left").select(F.coalesce("new", "g").alias("g"), "node").distinct())

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_sets: dict[int, set[int]] = {}
        for b in batches:
            for g, nodes in b.groupby("g")["node"]:
                open_sets.setdefault(int(g), set()).update(nodes.tolist())
        order = [(len(nodes), g) for g, nodes in open_sets.items()]
        heapq.heapify(order)
        parent: dict[int, int] = {}
        while len(order) > 1:
            (_, a), (_, b) = heapq.heappop(order), heapq.heappop(order)
            new, old = min(a, b), max(a, b)
            if len(union := open_sets[a] | open_sets[b]) > cap:
                break
            open_sets[new], parent[old] = union, new
            heapq.heappush(order, (len(union), new))
        for g in sorted(parent):  # a parent is the smaller id, so its own end is known
            parent[g] = parent.get(parent[g], parent[g])
        yield pd.DataFrame({"old": list(parent), "new": list(parent.values())}).astype("i8")

    return _moved(groups, sets.coalesce(1).mapInPandas(pack, "old long, new long"))

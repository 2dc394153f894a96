"""N-gram Jaccard join: exact components of texts whose shingle sets are similar, through count-vector R-trees.

1. One pass gives each text's set size and set digest; texts with equal sets form a class, and the smallest id stands for it.
2. Each representative's shingles are hashed into groups, as many as fit its size (a power of two, up to 256), and its group counts, a byte
   each, are a point. Points with different numbers of groups are compared by the smaller, since counts of half the groups are sums. It is listed
   under its prefix: the shingles it would have to lose before falling below the threshold, rarest first. Linked texts share at least one.
   Only shingles that two prefixes share make a list, and lists with the same members count once. Lists are pairs of numbers; points
   join them where they are searched.
3. The points of each list are packed into an R-tree of ``FANOUT`` entries a node: boxes of coordinate maxima, the range of set sizes, and
   whether all points of a node are of one component. Pairs of nodes are descended from the root; the summed coordinate minima of two
   boxes, at last of two points, bound the overlap from above, and pairs whose bound misses the needed overlap are left with all below them.
4. Surviving pairs are verified on whole texts, in three rounds.
   a. Each point with its best partner among the neighbours of its leaf. This ties groups of copies together; lists with
      points of one component only are settled.
   b. The other lists are descended in full. Surviving pairs between components, the most alike first, are a forest over the components
      of a list; its pairs are verified. If all hold, so do the components of every other surviving pair of the list.
   c. Where one fails, the list is descended once more to find the points with a surviving partner in another component. Those meet
      again with their whole sets, every surviving pair is verified on the spot, and the links leave as a forest.
   So no link between different components is missed, and each round gives at most about a row a point and list, never the pairs of a group.

Long lists are cut into blocks by hash: in round a each point is in two blocks of independent hashes, later each two blocks meet.
The order of shingles in a prefix affects speed only: shingles that are frequent in some task of the first pass go last. That list is
bounded (``common_limit``); any order gives the same result as long as all texts use the same one.

Defined results: texts without words (null, empty, blank) have 0 shingles and stand alone. Repeated rows share a class; different texts of
one id are one node, linked by any of them. A null doc_id can't be named as a component, so such rows come back with a null
component_id. Empty tables give empty tables; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphbatch.llm.common import slices, write_and_reread
from graphbatch.llm.components import connected_components
from graphbatch.llm.shingles import shingle_set

FANOUT = 16
LEAST_LEVEL, TOP_LEVEL = 5, 8


def needed_overlap(sizes: np.ndarray, percent: int) -> np.ndarray:
    """Smallest overlap of two sets with ``sizes`` elements together: 100 o >= percent (sizes - o)."""
    return -(-percent * sizes // (100 + percent))


def level_of(sizes: np.ndarray) -> np.ndarray:
    """A set of n shingles is hashed into 2 ** level groups, n / 2 to n where the limits allow it."""
    return np.clip(np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64) - 1, LEAST_LEVEL, TOP_LEVEL)


def count_vector(shingles: np.ndarray) -> bytes:
    """Counts of the groups, a byte each, or two or four where the largest needs it."""
    groups = 1 << int(level_of(np.array(len(shingles))))
    counts = np.bincount((shingles % np.uint64(groups)).astype(np.int64), minlength=groups)
    return counts.astype("u1" if counts.max(initial=0) < 256 else "<u2" if counts.max() < 65_536 else "<u4").tobytes()


def unpacked(vectors: np.ndarray, levels: np.ndarray, level: int) -> np.ndarray:
    """The vectors at one level; those of higher levels are folded in halves."""
    groups, out = 1 << level, None
    for high in np.unique(levels).tolist():
        at = np.flatnonzero(levels == high)
        widths = np.fromiter((len(vectors[k]) >> high for k in at), np.int64, len(at))
        for width in np.unique(widths).tolist():
            mine = at[widths == width]
            x = np.frombuffer(b"".join(vectors[mine]), f"<u{width}").reshape(len(mine), 1 << (high - level), groups)
            x = x[:, 0] if high == level else x.sum(1, dtype=np.uint32)
            if len(mine) == len(vectors):
                out = x
            else:
                out = np.zeros((len(vectors), groups), x.dtype) if out is None else out
                out = out if out.itemsize >= x.itemsize else out.astype(x.dtype)
                out[mine] = x
    return out.astype("u1") if out.itemsize > 1 and out.max() < 256 else out


def min_sum(vectors: np.ndarray, i: np.ndarray, j: np.ndarray, chunk: int = 8192) -> np.ndarray:
    """The summed coordinate minima of the rows i and j, pair by pair."""
    out = np.empty(len(i), np.int64)
    for k in range(0, len(i), chunk):
        out[k : k + chunk] = np.minimum(vectors[i[k : k + chunk]], vectors[j[k : k + chunk]]).sum(1, dtype=np.uint32)
    return out


class Level:
    """Entries of one height of all trees: points, or nodes over the entries below."""

    def __init__(self, tree: np.ndarray, boxes: np.ndarray, least: np.ndarray, most: np.ndarray, low: np.ndarray, high: np.ndarray, starts: np.ndarray | None = None, ends: np.ndarray | None = None):
        self.tree, self.boxes, self.least, self.most, self.low, self.high, self.starts, self.ends = tree, boxes, least, most, low, high, starts, ends

    def parents(self) -> Level:
        first = np.flatnonzero(np.r_[True, self.tree[1:] != self.tree[:-1]])
        place = np.arange(len(self.tree)) - np.repeat(first, np.diff(np.r_[first, len(self.tree)]))
        at = np.flatnonzero(place % FANOUT == 0)
        lowest, highest = (lambda x: np.minimum.reduceat(x, at)), (lambda x: np.maximum.reduceat(x, at))
        return Level(self.tree[at], np.maximum.reduceat(self.boxes, at, axis=0), lowest(self.least), highest(self.most), lowest(self.low), highest(self.high), at, np.r_[at[1:], len(self.tree)])

    def may_link(self, i: np.ndarray, j: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the pairs of entries those that may hold a link between different components, with their bounds."""
        ok = (self.least[i] * percent <= 100 * self.most[j]) & (self.least[j] * percent <= 100 * self.most[i])
        ok &= ~((self.low[i] == self.high[i]) & (self.low[j] == self.high[j]) & (self.low[i] == self.low[j]))
        i, j = i[ok], j[ok]
        bound = min_sum(self.boxes, i, j)
        ok = bound >= needed_overlap(self.least[i] + self.least[j], percent)
        return i[ok], j[ok], bound[ok]


class CountVectorForest:
    """One packed R-tree for each ``tree`` number; the points come sorted by it. All trees are of the height of the largest."""

    def __init__(self, tree: np.ndarray, vectors: np.ndarray, sizes: np.ndarray, parts: np.ndarray):
        self.levels = [Level(tree, vectors, sizes, sizes, parts, parts)]
        while len(self.levels) == 1 or (self.levels[-1].tree[1:] == self.levels[-1].tree[:-1]).any():
            self.levels.append(self.levels[-1].parents())

    def descend(self, height: int, i: np.ndarray, j: np.ndarray, percent: int, chunk: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs of points (i, j), with bounds, below the pairs of nodes of one height (i <= j); not more than about ``chunk`` are held at a time."""
        todo = [(height, *self.levels[height].may_link(i, j, percent)[:2])]
        while todo:
            height, i, j = todo.pop()
            level = self.levels[height]
            wide, high = level.ends[i] - level.starts[i], level.ends[j] - level.starts[j]
            n = wide * high
            if n.sum() > chunk and len(i) > 1:
                half = len(i) // 2
                todo += [(height, i[half:], j[half:]), (height, i[:half], j[:half])]
                continue
            which = np.repeat(np.arange(len(i)), n)
            k = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
            a, b = level.starts[i][which] + k // high[which], level.starts[j][which] + k % high[which]
            ok = (i != j)[which] | (a < b if height == 1 else a <= b)
            a, b, bound = self.levels[height - 1].may_link(a[ok], b[ok], percent)
            if not len(a):
                continue
            if height == 1:
                yield a, b, bound
            else:
                todo.append((height - 1, a, b))


def _first_of(keys: tuple[np.ndarray, ...], likeness: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """Positions of the most alike row of each key, ties to the smaller ``tie``."""
    order = np.lexsort((tie, -likeness, *keys[::-1]))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    return order[new]


def _forest(rows: pd.DataFrame) -> pd.DataFrame:
    """Of the pairs of each list as few as connect the same components, the most alike first."""
    low, high = np.minimum(rows["ca"], rows["cb"]).to_numpy(), np.maximum(rows["ca"], rows["cb"]).to_numpy()
    rows = rows.iloc[_first_of((rows["list"].to_numpy(), low, high), rows["likeness"].to_numpy(), rows["a"].to_numpy())]
    rows = rows.sort_values(["list", "likeness", "a", "b"], ascending=[True, False, True, True])
    keep, root, held = [], {}, None
    for of_list, x, y in zip(rows["list"].tolist(), rows["ca"].tolist(), rows["cb"].tolist(), strict=True):
        if of_list != held:
            root, held = {}, of_list
        while (up := root.get(x, x)) != x:
            root[x] = x = root.get(up, up)
        while (up := root.get(y, y)) != y:
            root[y] = y = root.get(up, up)
        root[x] = y
        keep.append(x != y)
    return rows[np.array(keep, bool)]


def _each_best(rows: pd.DataFrame) -> pd.DataFrame:
    """Of the pairs of each list the best one of each point. A copy as good as another is met at the smaller id, so that copies meet at one point."""
    x, y = np.r_[rows["a"], rows["b"]], np.r_[rows["b"], rows["a"]]
    best = _first_of((np.r_[rows["list"], rows["list"]], x), np.r_[rows["likeness"], rows["likeness"]], y)
    return rows.iloc[np.unique(best % len(rows))] if len(rows) else rows


def overlaps(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, chunk_bytes: int = 1 << 23, most_bytes: int = 1 << 14) -> np.ndarray:
    """Sizes of the intersections of the sorted sets i and j, pair by pair: by bits of the elements that two sets share, or one by one."""
    used, at = np.unique(np.r_[i, j], return_inverse=True)
    i, j = at[: len(i)], at[len(i) :]
    mine = [sets[k] for k in used.tolist()]
    element, times = np.unique(np.concatenate(mine), return_counts=True)
    element = element[times > 1]
    width = -(-len(element) // 64)
    if width * 8 > most_bytes or len(i) < len(mine):
        return np.array([len(np.intersect1d(mine[a], mine[b], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist(), strict=True)], np.int64)
    bits = np.zeros((len(mine), width), np.uint64)
    for k, s in enumerate(mine):
        has = np.zeros(width * 64, bool)
        has[: len(element)] = np.isin(element, s, assume_unique=True)
        bits[k] = np.packbits(has).view(np.uint64)
    out, step = np.zeros(len(i), np.int64), max(1, chunk_bytes // max(8, width * 8))
    for k in range(0, len(i), step):
        out[k : k + step] = np.bitwise_count(bits[i[k : k + step]] & bits[j[k : k + step]]).sum(1, dtype=np.int64)
    return out


def _linked(sets: np.ndarray, lists: np.ndarray, sizes: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Which of the pairs of points are links, by their whole sets; list by list."""
    ok, order = np.zeros(len(i), bool), np.argsort(lists[i], kind="stable")
    for mine in np.split(order, np.flatnonzero(np.diff(lists[i][order])) + 1) if len(order) else []:
        a, b = i[mine], j[mine]
        own = {k: np.frombuffer(sets[k], np.uint64) for k in np.unique(np.r_[a, b]).tolist()}
        ok[mine] = overlaps(own, a, b) >= needed_overlap(sizes[a] + sizes[b], percent)
    return ok


def surviving_pairs(points: pd.DataFrame, percent: int, what: str) -> Iterator[pd.DataFrame]:
    """(list, a < b, their components, likeness) of the pairs that survive, of whole lists.

    ``what``: "near" looks at neighbouring leaves only and gives each point's best partner in each list; the others descend in full. "each"
    gives the same, "forest" pairs that connect all components with a surviving pair, and "links" those that links connect (by column ``set``).
    """
    sizes = points["n"].to_numpy()
    levels = level_of(sizes)
    for level in np.unique(levels).tolist():
        # Besides the level's own points those of higher ones that may link to them.
        most = sizes[levels == level].max()
        mine = (levels == level) | ((levels > level) & (sizes * percent <= 100 * most))
        yield from _pairs_of_level(points[mine], levels[mine], level, percent, what)


def _pairs_of_level(points: pd.DataFrame, levels: np.ndarray, lowest: int, percent: int, what: str) -> Iterator[pd.DataFrame]:
    order = np.lexsort((points["rid"], points["n"], points["component"], points["own"], points["list"]))
    lists, own, ids, sizes, parts, packed = (points[c].to_numpy()[order] for c in ("list", "own", "rid", "n", "component", "vec"))
    levels = levels[order]
    vectors = unpacked(packed, levels, lowest)
    sets = points["set"].to_numpy()[order] if what == "links" else None
    new_list = np.r_[True, lists[1:] != lists[:-1]]
    tree = np.cumsum(new_list | np.r_[True, own[1:] != own[:-1]])
    forest = CountVectorForest(tree, vectors, sizes, parts)
    if what == "near":
        height, level = 1, forest.levels[1]
        here, beside = np.arange(len(level.tree)), np.flatnonzero(level.tree[1:] == level.tree[:-1])
        i, j = np.r_[here, beside], np.r_[here, beside + 1]
    else:
        height, level = len(forest.levels) - 1, forest.levels[-1]
        of_list = lists[np.searchsorted(tree, level.tree)]
        crossing = np.r_[of_list[1:] == of_list[:-1], False]  # two trees are the two blocks of a crossing list
        alone = ~crossing & ~np.r_[False, crossing[:-1]]
        i, j = np.r_[np.flatnonzero(alone), np.flatnonzero(crossing)], np.r_[np.flatnonzero(alone), np.flatnonzero(crossing) + 1]
    few = _each_best if what in ("near", "each") else _forest
    found, waiting = [], 0
    for i, j, bound in forest.descend(height, i, j, percent):
        ok = ((levels[i] == lowest) | (levels[j] == lowest)) & (ids[i] != ids[j])
        i, j, bound = i[ok], j[ok], bound[ok]
        if sets is not None:
            ok = _linked(sets, lists, sizes, i, j, percent)
            i, j, bound = i[ok], j[ok], bound[ok]
        a, b = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
        ca, cb = (np.where(ids[i] == a, parts[x], parts[y]) for x, y in ((i, j), (j, i)))
        likeness = bound / np.maximum(1, sizes[i] + sizes[j] - bound)
        found.append(pd.DataFrame({"list": lists[i], "a": a, "b": b, "ca": ca, "cb": cb, "likeness": likeness}))
        waiting += len(i)
        if waiting > 200_000:
            found, waiting = [few(pd.concat(found, ignore_index=True))], 0
    if found:
        yield few(pd.concat(found, ignore_index=True))


def _scan(docs: DataFrame, k: int, local_count: int) -> DataFrame:
    """Rows of both kinds from one pass: (doc_id, n, digest) of a text; (key, count) of a shingle frequent in this task."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = [shingle_set(t, k) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "n": [len(s) for s in sets], "digest": [hashlib.md5(s.tobytes()).digest() for s in sets]})
            keys, counts = np.unique(np.concatenate(sets), return_counts=True)
            often = counts >= local_count
            if often.any():
                yield pd.DataFrame({"key": keys[often].view("i8"), "count": counts[often].astype("i8")})

    def shaped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in scan(batches):
            yield x.reindex(columns=["doc_id", "n", "digest", "key", "count"]).astype({"doc_id": "Int64", "n": "Int64", "key": "Int64", "count": "Int64"})

    return docs.mapInPandas(shaped, "doc_id long, n long, digest binary, key long, count long")


def _points(docs: DataFrame, k: int, percent: int, common: dict) -> DataFrame:
    """(rid, n, vec, keys): the point and the prefix of each representative."""
    told = docs.sparkSession.sparkContext.broadcast(common)

    def points(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys_often, ranks = told.value["keys"], told.value["ranks"]
        for b in slices(batches, 1024):
            out = {"rid": [], "n": [], "vec": [], "keys": []}
            for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                s = shingle_set(text, k)
                if not len(s):
                    continue
                rank = np.zeros(len(s), np.int64)
                if len(keys_often):
                    at = np.minimum(np.searchsorted(keys_often, s), len(keys_often) - 1)
                    rank = np.where(keys_often[at] == s, ranks[at], 0)
                length = len(s) - -(-percent * len(s) // 100) + 1
                prefix = s[np.lexsort((s, rank))[:length]]
                out["rid"].append(doc_id)
                out["n"].append(len(s))
                out["vec"].append(count_vector(s))
                out["keys"].append(prefix.view("i8"))
            yield pd.DataFrame(out)

    return docs.mapInPandas(points, "rid long, n long, vec binary, keys array<long>")


def _sets(docs: DataFrame, k: int) -> DataFrame:
    """(rid, n, vec, set): the points with their whole sets."""

    def points(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in slices(batches, 1024):
            sets = [shingle_set(t, k) for t in b["text"]]
            yield pd.DataFrame({"rid": b["rid"], "n": [len(s) for s in sets], "vec": [count_vector(s) for s in sets], "set": [s.tobytes() for s in sets]})[[len(s) > 0 for s in sets]]

    return docs.select("rid", "text").mapInPandas(points, "rid long, n long, vec binary, set binary")


def _known_ids(rows: DataFrame, ids: DataFrame, how: str, on: str = "doc_id", broadcast_rows: int = 1_000_000) -> DataFrame:
    """Join with a written table of ids: by broadcast up to ``broadcast_rows`` rows of at most 16 bytes, else by shuffle."""
    return rows.join(F.broadcast(ids) if ids.count() <= broadcast_rows else ids, on, how)


def verified_links(docs: DataFrame, pairs: DataFrame, k: int, percent: int, broadcast_rows: int = 500_000, share: int = 1000) -> DataFrame:
    """The pairs (a, b) whose shingle sets reach the threshold. Texts are gathered by a; only a's set and one other are held."""
    # A text with very many partners is met by them in several places, about ``share`` in each.
    salt = F.pmod(F.xxhash64("b"), F.ceil(F.col("c") / share)).cast("int")
    salted = pairs.join(pairs.groupBy("a").agg(F.count("*").alias("c")), "a").select(F.col("a").alias("g"), salt.alias("salt"), "b")
    asked = salted.select("g", "salt", F.col("b").alias("doc_id")).union(salted.select("g", "salt", F.col("g").alias("doc_id")).distinct())
    if asked.count() <= broadcast_rows:  # 20 bytes a row: texts are picked where they are read and shuffled once, by g
        dealt = docs.join(F.broadcast(asked), "doc_id")
    else:
        dealt = asked.join(docs, "doc_id")
    dealt = dealt.withColumn("own", F.when(F.col("g") == F.col("doc_id"), 0).otherwise(1))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(n, "g", "salt").sortWithinPartitions("g", "salt", "own", "doc_id")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mine, held = [], None
        for b in slices(batches, 1024):
            out = []
            for g, salt, doc_id, text in zip(b["g"], b["salt"], b["doc_id"], b["text"], strict=True):
                s = shingle_set(text, k)
                if g == doc_id:  # different texts of one id stand for it together
                    mine, held = [*mine, s] if held == (g, salt) else [s], (g, salt)
                    continue
                assert held == (g, salt)
                for m in mine:
                    common = len(np.intersect1d(m, s, assume_unique=True))
                    if 100 * common >= percent * (len(m) + len(s) - common):
                        out.append((g, doc_id))
                        break
            yield pd.DataFrame(out, columns=["a", "b"]).astype("i8")

    return dealt.select("g", "salt", "doc_id", "text").mapInPandas(verify, "a long, b long")


def _shared_lists(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rid, key) of the shingles that two prefixes share, and (key, c), the lists: of those with the same members one, of its smallest shingle."""
    listed = points.select("rid", F.explode("keys").alias("key"))
    twice = write_and_reread(listed.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"), "ngram-twice")
    met = write_and_reread(listed.join(twice.hint("merge"), "key", "left_semi"), "ngram-met")  # the keys grow with the texts, so they are never told to all
    member = lambda k: F.bit_xor(F.xxhash64("rid", F.lit(k)))
    same = met.groupBy("key").agg(F.count("*").alias("c"), member(1).alias("x"), member(2).alias("y"), F.sum(F.shiftrightunsigned(F.xxhash64("rid"), 33)).alias("z"))
    return met, write_and_reread(same.groupBy("c", "x", "y", "z").agg(F.min("key").alias("key")).select("key", "c"), "ngram-kept")


def _listed_points(points: DataFrame, met: DataFrame, lists: DataFrame, broadcast_rows: int) -> DataFrame:
    """(rid, n, vec, key, c): the points under their lists. Few lists are told to where the points are read; many are met by shuffle, ids first."""
    if lists.count() <= broadcast_rows:
        return points.select("rid", "n", "vec", F.explode("keys").alias("key")).join(F.broadcast(lists), "key")
    return met.join(lists, "key").join(points.select("rid", "n", "vec"), "rid")


def _two_blocks(rows: DataFrame, block: int) -> DataFrame:
    """The rows with (list, own): a list that is longer than a block is dealt twice, by independent hashes."""
    deals = F.when(F.col("c") > block, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    out = rows.withColumn("deal", F.explode(deals))
    return out.withColumn("list", F.xxhash64("key", "deal", F.pmod(F.xxhash64("rid", "deal"), F.ceil(F.col("c") / block)))).withColumn("own", F.lit(0))


def _all_blocks(rows: DataFrame, block: int) -> DataFrame:
    """The rows with (list, own): each two blocks of a list that is longer than a block meet in a list of their own."""
    blocks = F.ceil(F.col("c") / block).cast("int")
    out = rows.withColumn("mine", F.pmod(F.xxhash64("rid"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    return out.withColumn("list", F.xxhash64("key", low, high)).withColumn("own", F.when(low == high, 0).otherwise(F.col("mine")).cast("int"))


def _pairs(rows: DataFrame, percent: int, what: str) -> DataFrame:
    """``surviving_pairs`` of the rows (list, own, rid, component, n, vec, and set for "links"), list by list."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for b in batches:
            last = b["list"].iloc[-1]
            whole = b[b["list"] != last]
            if held and held[0]["list"].iloc[0] != last:
                whole, held = pd.concat([*held, whole], ignore_index=True), []
            if len(whole):
                yield from surviving_pairs(whole, percent, what)
            held.append(b[b["list"] == last])
        if held:
            yield from surviving_pairs(pd.concat(held, ignore_index=True), percent, what)

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = ["list", "own", "rid", "component", "n", "vec"] + (["set"] if what == "links" else [])
    dealt = rows.select(*columns).repartition(n, "list").sortWithinPartitions("list")
    return dealt.mapInPandas(find, "list long, a long, b long, ca long, cb long, likeness double")


def similar_components(
    docs: DataFrame,
    words: int = 5,
    percent: int = 80,
    id_col: str = "doc_id",
    text_col: str = "text",
    block: int = 1024,
    local_count: int = 4,
    common_limit: int = 200_000,
    broadcast_rows: int = 1_000_000,
) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row: see the module's text."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    scanned = write_and_reread(_scan(docs, words, local_count), "ngram-scan")
    sets = scanned.where(F.col("digest").isNotNull()).select("doc_id", "n", "digest")
    often = scanned.where(F.col("key").isNotNull()).groupBy("key").agg(F.sum("count").alias("c")).orderBy(F.desc("c"), "key").limit(common_limit).toPandas()
    keys = often["key"].to_numpy("i8").view("u8")
    order = np.argsort(keys)
    common = {"keys": keys[order], "ranks": often["c"].to_numpy("i8")[order]}

    classes = sets.where("n > 0 AND doc_id IS NOT NULL").groupBy("n", "digest").agg(F.min("doc_id").alias("rid"), F.count("*").alias("copies"))
    classes = write_and_reread(classes, "ngram-classes")
    # Texts that are not the first of their class leave; repeated rows of a first one are alike and meet again as one id.
    later = sets.where("n > 0").join(classes.where("copies > 1"), ["n", "digest"]).where("doc_id <> rid").select("doc_id").distinct()
    firsts = _known_ids(docs.where("doc_id IS NOT NULL"), write_and_reread(later, "ngram-later"), "left_anti")
    points = write_and_reread(_points(firsts, words, percent, common), "ngram-points")
    met, lists = _shared_lists(points)

    rows = _listed_points(points, met, lists, broadcast_rows)
    near = _pairs(_two_blocks(rows, block).withColumn("component", F.col("rid")), percent, "near")
    ends = near.select("likeness", F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("e"))
    best = ends.groupBy("e.x").agg(F.max(F.struct("likeness", (-F.col("e.y")).alias("y"))).alias("m")).select("x", (-F.col("m.y")).alias("y"))
    best = write_and_reread(best.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "ngram-near")
    linked = connected_components(verified_links(firsts, best, words, percent)).withColumnRenamed("id", "rid")

    def labelled(rows: DataFrame) -> DataFrame:
        return _known_ids(rows, linked, "left", "rid", broadcast_rows).withColumn("component", F.coalesce("component", "rid"))

    # Lists whose points are all of one component are settled.
    ends = labelled(_known_ids(met, lists, "inner", "key", broadcast_rows)).groupBy("key").agg(F.first("c").alias("c"), F.min("component").alias("x"), F.max("component").alias("y"))
    lists = write_and_reread(ends.where("x <> y").select("key", "c"), "ngram-open")
    rows = labelled(_listed_points(points, met, lists, broadcast_rows))
    seen = write_and_reread(_pairs(_all_blocks(rows, block), percent, "forest"), "ngram-seen")
    best = seen.groupBy(F.least("ca", "cb").alias("x"), F.greatest("ca", "cb").alias("y")).agg(F.max_by(F.struct("a", "b"), F.struct("likeness", -F.col("a"), -F.col("b"))).alias("m"))
    best = write_and_reread(best.select("x", "y", "m.a", "m.b"), "ngram-best")
    links = verified_links(firsts, best.select("a", "b").distinct(), words, percent)
    joined = write_and_reread(links.join(best, ["a", "b"]).select(F.col("x").alias("a"), F.col("y").alias("b")), "ngram-joined")
    merged = connected_components(joined).select(F.col("id").alias("component"), F.col("component").alias("root"))

    def after(rows: DataFrame, name: str) -> DataFrame:
        """The rows with component ``name`` replaced by what it was merged into."""
        out = _known_ids(rows, merged.withColumnRenamed("component", name), "left", name, broadcast_rows)
        return out.withColumn(name, F.coalesce("root", F.col(name))).drop("root")

    failed = write_and_reread(after(after(seen.select("list", "ca", "cb"), "ca"), "cb").where("ca <> cb").select("list").distinct(), "ngram-failed")
    rest = write_and_reread(_known_ids(_all_blocks(after(rows, "component"), block), failed, "left_semi", "list", broadcast_rows).select("list", "own", "rid", "component", "n", "vec"), "ngram-rest")
    met = _pairs(rest, percent, "each").select("list", F.explode(F.array("a", "b")).alias("rid"))
    met = write_and_reread(met.distinct().join(rest.select("list", "own", "rid", "component").distinct(), ["list", "rid"]), "ngram-unsure")
    whole = _known_ids(firsts.withColumnRenamed("doc_id", "rid"), write_and_reread(met.select("rid").distinct(), "ngram-whole"), "left_semi", "rid", broadcast_rows)
    last = _pairs(met.join(_sets(whole, words), "rid"), percent, "links").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    final = connected_components(joined.union(write_and_reread(last, "ngram-last")))
    roots = final.select(F.col("id").alias("component"), F.col("component").alias("root"))

    of_class = classes.join(linked, "rid", "left").withColumn("component", F.coalesce("component", "rid")).join(roots, "component", "left")
    named = of_class.select("n", "digest", F.coalesce("root", "component").alias("component_id"))
    out = sets.join(named, ["n", "digest"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def keep_one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The documents of the smallest id in each component, all columns as they were. Rows without words and rows without an id stay."""
    lost = similar_components(docs, **options).where("component_id <> doc_id").select("doc_id").distinct()
    return _known_ids(docs, write_and_reread(lost, "ngram-lost"), "left_anti")

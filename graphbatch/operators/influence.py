"""Influence scores: approximate personalised PageRank by residual push, power iteration for node sets, top-k and pairs.

Scores are compared at ``DIGITS`` decimals wherever order matters, so that ties don't hang on the order of a sum; ties go to the smaller id.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphbatch.functions.lineage import cut, cut_and_observe, drop_written, write_bucketed, write_observed, write_out

DIGITS = 12


def falling(score: str = "score") -> Column:
    return F.round(F.col(score), DIGITS).desc()


def adjacency_blocks(edges: DataFrame, end: DataFrame | None = None, per_block: int = 1024) -> tuple[DataFrame, DataFrame]:
    """(blocks, spread): a node's neighbours in rows of about ``per_block`` at most, and into how many rows each node is spread.

    ``edges`` is (node, other, ...), ``end`` columns of the other end by (other, ...), whose lack drops an edge. blocks is (node, block, ends), an end being a struct of other,
    the edge's and the end's columns, and ``blocks`` of the other end; spread is (node, deg, blocks). A neighbour's block is a hash of its id, so
    no hub's neighbours meet in one task or one row. Blocks are bucketed by (node, block): a loop that joins them moves only its own rows.
    """
    deg = edges.groupBy("node").agg(F.count("*").alias("deg"))
    spread = cut(deg.select("node", "deg", F.ceil(F.col("deg") / per_block).cast("int").alias("blocks")))
    place = F.pmod(F.xxhash64("other"), F.col("blocks")).cast("int")
    own = edges.join(spread.select("node", "blocks"), "node").withColumn("block", place).drop("blocks")
    far = own if end is None else own.join(end, "other")
    far = far.join(spread.select(F.col("node").alias("other"), "blocks"), "other", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    ends = F.struct(*(c for c in far.columns if c not in ("node", "block")))
    return write_bucketed(far.groupBy("node", "block").agg(F.collect_list(ends).alias("ends")), "blocks", ["node", "block"]), spread


def along_blocks(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Rows (node, blocks, ...) with a struct ``end`` of each neighbour: a row goes to every block of its node, and neighbours unfold after the join."""
    dealt = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    return dealt.join(blocks, ["node", "block"]).withColumn("end", F.explode("ends")).drop("ends", "block", "node")


def ppr_push(edges: DataFrame, sources: DataFrame, alpha: float = 0.25, eps: float = 2e-4, per_block: int = 1024, per_slice: int = 1_000_000, per_lane: int = 1000, wide: int = 10_000) -> DataFrame:
    """(source, node, score) of the nodes that were pushed.

    Rounds in step: every (source, node) with residual of at least alpha eps deg(node) moves it to its score and sends
    (1 - alpha) residual / deg to each neighbour; a source is always pushed once. At the end 0 <= exact - score <= eps deg(node).

    What one source sends is bounded: a node is pushed only for a share of the mass that goes with its degree, so the degrees of all pushes add up to
    1 / (alpha eps) at most, besides the source's own. So sources go in lanes of at most ``per_lane`` (or ``per_slice``, if that is less), and a task takes a
    lane's sources through the rounds with the neighbours it was given (``_lane``). Where a source would push a node whose neighbours its lane lacks, the
    lane asks for them, and for those of nodes at half their bound; they are fetched for all lanes by one join, and these sources start again. Fetches are about as many
    as steps that pushes reach from a source, not as many as rounds. Sources of more than ``wide`` neighbours, and all of them if the bound is above fifty times that, are
    pushed by joins of each round instead (``_push_by_joins``).
    """
    links = edges.select(F.col("src").alias("node"), F.col("dst").alias("other"))
    blocks, spread = adjacency_blocks(links, links.groupBy(F.col("node").alias("other")).agg(F.count("*").alias("deg")), per_block)
    known = cut(sources.select(F.col("node_id").alias("source")).distinct().join(spread.withColumnRenamed("node", "source"), "source"))
    near = F.col("deg") <= (wide if alpha * eps * 50 * wide >= 1 else 0)
    n_near, n_far = known.agg(F.count(F.when(near, 1)), F.count(F.when(~near, 1))).first()
    scores = [_push_in_lanes(known.where(near), n_near, blocks, alpha, eps, min(per_lane, per_slice))] if n_near or not n_far else []
    if n_far:
        scores.append(_push_by_joins(known.where(~near), n_far, blocks, spread, alpha, eps, per_slice))
    return functools.reduce(DataFrame.unionByName, scores)


def _push_in_lanes(known: DataFrame, n: int, blocks: DataFrame, alpha: float, eps: float, per_lane: int) -> DataFrame:
    spark, lanes = known.sparkSession, max(1, -(-n // per_lane))
    left = known.select(F.pmod(F.xxhash64("source"), F.lit(lanes)).cast("int").alias("lane"), F.col("source").alias("a"), F.col("deg").alias("b"), F.col("blocks").alias("c"))
    asked, scores, fetched, n_open = left, [], [], 1
    while n_open:
        dealt = asked.select("lane", F.col("a").alias("node"), "b", F.explode(F.sequence(F.lit(0), F.col("c") - 1)).alias("block"))
        rows = dealt.join(blocks, ["node", "block"]).groupBy("lane").agg(F.collect_list(F.struct("node", "ends")).alias("e"))  # what a lane holds is bounded
        ends = [F.flatten(F.transform("e", lambda x: x["ends"][c])).alias(c) for c in ("other", "deg", "blocks")]  # noqa: B023
        fetched.append(write_out(rows.select("lane", F.col("e.node").alias("node"), F.transform("e", lambda x: F.size(x["ends"])).alias("size"), *ends), "fetched"))
        there = functools.reduce(DataFrame.unionByName, fetched)
        told = left.groupBy("lane").cogroup(there.groupBy("lane")).applyInPandas(functools.partial(_lane, alpha=alpha, eps=eps), "kind int, lane int, a long, b long, c int, score double")
        path, seen = write_observed(told, "lanes", ["kind"], n_done=F.count(F.when(F.col("kind") == 0, 1)), n_open=F.count(F.when(F.col("kind") == 1, 1)))
        of = lambda kind: spark.read.schema("lane int, a long, b long, c int, score double").parquet(f"{path}/kind={kind}")  # noqa: E731,B023
        if seen.get("n_done"):
            scores.append(of(0).select(F.col("a").alias("source"), F.col("b").alias("node"), "score"))
        n_open = seen.get("n_open", 0)
        if n_open:
            left, asked = of(1), of(2)
    drop_written(spark, fetched)
    if not scores:
        return spark.createDataFrame([], "source long, node long, score double")
    return functools.reduce(DataFrame.unionByName, scores)


def _lane(key: tuple, own: pd.DataFrame, near: pd.DataFrame, alpha: float, eps: float) -> pd.DataFrame:
    """Rows by kind: 0 the scores (source, node) of the sources that came to their end, 1 the sources that stopped, 2 nodes whose neighbours they lack (with degree and blocks)."""
    own, flat = own.sort_values("a"), lambda c: np.concatenate([*near[c], np.zeros(0, "i8")]).astype("i8")
    src, at, lengths, other = own["a"].to_numpy("i8"), flat("node"), flat("size"), flat("other")
    ids, first, ends = np.unique(np.concatenate([src, other]), return_index=True, return_inverse=True)
    deg, n_blocks = (np.concatenate([own[c].to_numpy("i8"), flat(x)])[first] for c, x in (("b", "deg"), ("c", "blocks")))
    ends = ends[len(src) :]
    held = np.minimum(np.searchsorted(ids, at), max(0, len(ids) - 1))
    used = ids[held] == at if len(ids) else np.zeros(0, bool)  # some were fetched for sources that came to their end
    ends, held = ends[np.repeat(used, lengths)], held[used]
    order = np.argsort(np.repeat(held, lengths[used]), kind="stable")
    ends, size, limit = ends[order], np.bincount(held, lengths[used], len(ids)).astype("i8"), alpha * eps * deg
    start, lacks = np.cumsum(size) - size, np.ones(len(ids), bool)
    lacks[held] = False

    u = np.searchsorted(ids, src)
    keys, r, p = np.arange(len(src)) * len(ids) + u, np.full(len(src), float(alpha)), np.zeros(len(src))
    i = np.flatnonzero(~lacks[u])
    while len(i):
        s, u = np.divmod(keys[i], len(ids))
        sent = (1 - alpha) * r[i] / deg[u]
        p[i] += r[i]
        r[i] = 0.0
        n = size[u]
        to = ends[np.arange(n.sum()) + np.repeat(start[u] - (np.cumsum(n) - n), n)]
        new, code = np.unique(np.repeat(s, n) * len(ids) + to, return_inverse=True)
        got, place = np.bincount(code, np.repeat(sent, n), len(new)), np.searchsorted(keys, new)
        fresh = place == len(keys)
        fresh[~fresh] = keys[place[~fresh]] != new[~fresh]
        r[place[~fresh]] += got[~fresh]
        if fresh.any():
            keys, r, p = np.insert(keys, place[fresh], new[fresh]), np.insert(r, place[fresh], got[fresh]), np.insert(p, place[fresh], 0.0)
            place += np.cumsum(fresh) - fresh
        u = new % len(ids)
        i = place[(r[place] >= limit[u]) & ~lacks[u]]  # only what was sent to can have come above its bound
    s, u = np.divmod(keys, len(ids))
    stopped = np.zeros(len(src), bool)
    stopped[s[lacks[u] & (r >= limit[u])]] = True  # what waits at a node without neighbours only grows, so the others came to their end
    done, asked = (p > 0) & ~stopped[s], np.unique(u[lacks[u] & stopped[s] & (r >= limit[u] / 2)])
    frame = lambda kind, a, b, c, score: pd.DataFrame({"kind": kind, "lane": key[0], "a": a, "b": b, "c": c, "score": score})
    return pd.concat([
        frame(0, src[s[done]], ids[u[done]], 0, p[done]),
        frame(1, src[stopped], own["b"].to_numpy()[stopped], own["c"].to_numpy()[stopped], 0.0),
        frame(2, ids[asked], deg[asked], n_blocks[asked], 0.0),
    ]).astype({"kind": "i4", "lane": "i4", "a": "i8", "b": "i8", "c": "i4", "score": "f8"})


def _push_by_joins(known: DataFrame, n: int, blocks: DataFrame, spread: DataFrame, alpha: float, eps: float, per_slice: int) -> DataFrame:
    """A round moves open residuals only: what was pushed is set aside and summed once at the end. Neighbours lie in blocks (``adjacency_blocks``) that carry the
    degree of each end, and sources go in hash slices of about ``per_slice``, so a task joins at most a block's ends with a slice's sources, also at a hub.
    Residuals meet per (source, node) by partial sums before the shuffle. Each round is one written table.
    """
    first = known.select("source", F.col("source").alias("node"), F.lit(float(alpha)).alias("r"), F.lit(0.0).alias("limit"), "deg", "blocks")
    slices, pushed, degree = max(1, -(-n // per_slice)), [], spread.select("node", "deg")
    for k in range(slices):
        state, n_active = first.where(F.pmod(F.xxhash64("source"), F.lit(slices)) == k).drop("deg"), 1
        while n_active:
            active = F.col("r") >= F.col("limit")
            moved = state.where(active)
            pushed.append(moved.select("source", "node", "r"))
            sent = along_blocks(moved.join(degree, "node").select("source", "node", ((1 - alpha) * F.col("r") / F.col("deg")).alias("r"), "blocks"), blocks)
            sent = sent.select("source", F.col("end.other").alias("node"), "r", (F.lit(alpha * eps) * F.col("end.deg")).alias("limit"), F.col("end.blocks").alias("blocks"))
            merged = state.where(~active).unionByName(sent).groupBy("source", "node").agg(F.sum("r").alias("r"), F.max("limit").alias("limit"), F.max("blocks").alias("blocks"))
            state, seen = cut_and_observe(merged, "push", n_active=F.count(F.when(active, 1)))
            n_active = seen["n_active"]
    return functools.reduce(DataFrame.unionByName, pushed).groupBy("source", "node").agg(F.sum("r").alias("score"))


def topk_neighbors(ppr: DataFrame, k: int) -> DataFrame:
    """(source, node): the k best scores of each source, then the source itself."""
    best = ppr.withColumn("rn", F.row_number().over(Window.partitionBy("source").orderBy(falling(), "node"))).where(F.col("rn") <= k)
    return best.select("source", "node").unionByName(ppr.select("source", F.col("source").alias("node")).distinct()).distinct()


def normalize_ppr(ppr: DataFrame, deg: DataFrame, mode: str = "row") -> DataFrame:
    """``row``: as is; ``sym``: sqrt(deg source) s / sqrt(deg node); ``col``: deg source s / deg node. Denominators are 1e-12 at least."""
    if mode == "row":
        return ppr.select("source", "node", "score")
    if mode not in ("sym", "col"):
        raise ValueError(f"unknown normalisation: {mode}")
    side = lambda name, col: deg.select(F.col("node_id").alias(name), F.col("deg").cast("double").alias(col))
    both = ppr.join(side("source", "ds"), "source").join(side("node", "dn"), "node")
    floored = F.greatest(F.col("dn"), F.lit(1e-12))
    score = F.sqrt("ds") * F.col("score") / F.sqrt(floored) if mode == "sym" else F.col("ds") * F.col("score") / floored
    return both.select("source", "node", score.alias("score"))


def restrict_to_outputs(ppr: DataFrame, outputs: DataFrame) -> DataFrame:
    """Only scores of output nodes."""
    return ppr.join(outputs.select(F.col("node_id").alias("node")).distinct(), "node", "left_semi").select("source", "node", "score")


def influence_pairs(ppr: DataFrame) -> DataFrame:
    """(i, j, weight) with i > j: the scores of both directions added."""
    a, b = F.greatest("source", "node"), F.least("source", "node")
    return ppr.where("source <> node").groupBy(a.alias("i"), b.alias("j")).agg(F.sum("score").alias("weight"))


def _power_start(adj_rw: DataFrame, outsets: DataFrame, per_block: int) -> tuple[DataFrame, DataFrame]:
    """(blocks of the nodes that point at each node, t by (batch_id, node) with the blocks of the node)."""
    sizes = outsets.groupBy("batch_id").agg(F.count("*").alias("size"))
    links = adj_rw.select(F.col("dst").alias("node"), F.col("src").alias("other"), "weight")
    blocks, spread = adjacency_blocks(links, None, per_block)
    t = outsets.join(sizes, "batch_id").join(spread.select(F.col("node").alias("node_id"), "blocks"), "node_id", "left")
    return blocks, cut(t.select("batch_id", F.col("node_id").alias("node"), (1.0 / F.col("size")).alias("t"), F.coalesce("blocks", F.lit(1)).alias("blocks")))


def _walked(rows: DataFrame, blocks: DataFrame, value: str, alpha: float) -> DataFrame:
    """(batch_id, node, value, blocks): what each row's value gives the nodes that point at its node."""
    met = along_blocks(rows.select("batch_id", "node", value, "blocks"), blocks)
    return met.select("batch_id", F.col("end.other").alias("node"), (F.lit(1 - alpha) * F.col(value) * F.col("end.weight")).alias(value), F.col("end.blocks").alias("blocks"))


def batch_ppr(adj_rw: DataFrame, outsets: DataFrame, alpha: float = 0.25, num_iter: int = 50, cut_every: int = 5, per_block: int = 1024) -> DataFrame:
    """(batch_id, node, score): x = (1 - alpha) A x + alpha t for each set of output nodes, t being 1/size on the set.

    ``outsets`` is (batch_id, node_id). All sets advance together, keyed by (batch, node); only reached nodes have rows. A hub's
    links lie in blocks.
    """
    blocks, t = _power_start(adj_rw, outsets, per_block)
    x, last = t.select("batch_id", "node", F.col("t").alias("score"), "blocks"), []
    for k in range(num_iter):
        back = t.select("batch_id", "node", (F.lit(alpha) * F.col("t")).alias("score"), "blocks")
        x = _walked(x, blocks, "score", alpha).unionByName(back).groupBy("batch_id", "node").agg(F.sum("score").alias("score"), F.max("blocks").alias("blocks"))
        if (k + 1) % cut_every == 0:
            x = write_out(x, "power")
            drop_written(x.sparkSession, last)  # only the latest state is read again
            last = [x]
    return x.select("batch_id", "node", "score")


def batch_ppr_push(adj_rw: DataFrame, outsets: DataFrame, alpha: float = 0.25, tolerance: float = 1e-6, sets_a_slice: int = 50, per_block: int = 1024) -> DataFrame:
    """(batch_id, node, score): the fixed point of x = (1 - alpha) A x + alpha t by residuals; 0 <= exact - score <= tolerance / alpha.

    A row holds the residual r of (batch, node), at first alpha t. Residuals of ``tolerance`` or more move into the score and give (1 - alpha) A(u, v) r
    to the nodes u that point at v; what is smaller waits, and is never sent. Rows of A add up to 1, so what waits at the end is worth at most
    its largest residual / alpha at any node. Sets go in slices, so that state doesn't grow with all sets at once, and a slice is done when
    no residual is left to move.
    """
    blocks, t = _power_start(adj_rw, outsets, per_block)
    order = t.select("batch_id").distinct()
    slices, pushed = max(1, -(-order.count() // sets_a_slice)), []
    for k in range(slices):
        own = F.pmod(F.xxhash64("batch_id"), F.lit(slices)) == k
        state, n_active = t.where(own).select("batch_id", "node", (F.lit(alpha) * F.col("t")).alias("r"), "blocks"), 1
        while n_active:
            active = F.col("r") >= tolerance
            moved = state.where(active)
            pushed.append(moved.select("batch_id", "node", "r"))
            merged = state.where(~active).unionByName(_walked(moved, blocks, "r", alpha)).groupBy("batch_id", "node").agg(F.sum("r").alias("r"), F.max("blocks").alias("blocks"))
            state, seen = cut_and_observe(merged, "power", n_active=F.count(F.when(active, 1)))
            n_active = seen["n_active"]
    return functools.reduce(DataFrame.unionByName, pushed).groupBy("batch_id", "node").agg(F.sum("r").alias("score"))


def batch_topk(n_nodes: int | Column, parts: int, ratio: float) -> int | Column:
    """ceil(ratio N / parts), of a number or within an aggregation."""
    if isinstance(n_nodes, Column):
        return F.ceil(F.lit(float(ratio)) * n_nodes / parts)
    return -int(-(ratio * n_nodes) // parts)


def topk_per_batch(scores: DataFrame, k: int, outsets: DataFrame | None = None) -> DataFrame:
    """(batch_id, node_id): the k best positive scores of each batch, joined with its output nodes."""
    best = scores.where("score > 0").withColumn("rn", F.row_number().over(Window.partitionBy("batch_id").orderBy(falling(), "node"))).where(F.col("rn") <= k)
    best = best.select("batch_id", F.col("node").alias("node_id"))
    return best if outsets is None else best.unionByName(outsets.select("batch_id", "node_id")).distinct()


def influential_nodes(ppr: DataFrame, thresh: float = 5e-4) -> DataFrame:
    """Nodes with any score above the threshold."""
    return ppr.where(F.col("score") > thresh).select(F.col("node").alias("node_id")).distinct()


def ppr_log_histogram(ppr: DataFrame, bins: int = 50) -> DataFrame:
    """(bin, n, low, high): positive scores counted in equal bins of their decimal logarithm."""
    logs = ppr.where("score > 0").select(F.round(F.log10("score"), 9).alias("x"))
    ends = logs.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col("x") - F.col("lo")) / width), F.lit(bins - 1)))
    rows = logs.crossJoin(F.broadcast(ends)).withColumn("bin", place.cast("long"))  # ends is one row
    return rows.groupBy("bin", "lo", "hi").agg(F.count("*").alias("n")).select("bin", "n", (F.col("lo") + F.col("bin") * width).alias("low"), (F.col("lo") + (F.col("bin") + 1) * width).alias("high"))

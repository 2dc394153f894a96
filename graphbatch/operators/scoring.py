"""Scoring nodes with given layer weights: aggregation over edges, dense layers, norms, attention, and whole forward passes.

Vectors are arrays. Sums over edges go through ``sum_vectors``: partial sums in each task before the shuffle. Dense layers run in Arrow
batches with the layer's matrix, which is small and fixed, as part of the task. Every operator takes ``keys``: (node_id) for the whole
graph, (batch_id, node_id) for subgraphs of batches.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphbatch.functions.lineage import cut, cut_and_observe
from graphbatch.functions.vectors import sum_vectors

NORM_EPS = 1e-5


def _ends(adj: DataFrame, x: DataFrame, batch: list[str]) -> DataFrame:
    """One row an edge: the keys of its source, the vector of its target, the weight."""
    side = x.select(*batch, F.col("node_id").alias("dst"), F.col("x").alias("vec"))
    return adj.join(side, [*batch, "dst"]).select(*batch, F.col("src").alias("node_id"), "vec", *(["weight"] if "weight" in adj.columns else []))


def aggregate_sum(adj: DataFrame, x: DataFrame, batch: tuple[str, ...] = ()) -> DataFrame:
    """(node_id, x): y(u) = sum over edges (u, v) of w(u, v) x(v)."""
    return sum_vectors(_ends(adj, x, [*batch]), [*batch, "node_id"]).select(*batch, "node_id", F.col("vec").alias("x"))


def aggregate_mean(adj: DataFrame, x: DataFrame, batch: tuple[str, ...] = ()) -> DataFrame:
    """(node_id, x): the plain mean over neighbours; weights play no part."""
    total = sum_vectors(_ends(adj.drop("weight"), x, [*batch]), [*batch, "node_id"], weight=None)
    return total.select(*batch, "node_id", F.transform("vec", lambda v: v / F.col("n")).alias("x"))


def grid_blocks(adj: DataFrame, rows: int, cols: int, weight: str = "weight", largest: int = 250_000) -> tuple[DataFrame, DataFrame]:
    """(grid, needed): the adjacency as a grid of blocks, each with arrays of its entries, and which row blocks need the vector of each node.

    Sources fall into ``rows`` and targets into ``cols`` groups by hash, so a hub's entries are spread over a whole row or column of
    blocks. Where that gives blocks of more than ``largest`` entries, both are multiplied until they hold fewer on average, and a block that still holds more (a hub's) falls into several by
    a hash of the entry, so a task holds about ``largest`` entries however many there are. grid is (rb, cb, r, c, w), needed (dst, cb, rb); a block that falls into several
    has as many column numbers. The weight may be one number or an array, one a head. Both are written once and serve all layers.
    """
    entries, seen = cut_and_observe(adj.select("src", "dst", F.col(weight).alias("w")), "entries", n=F.count(F.lit(1)))
    times = max(1, math.ceil(math.sqrt((seen.get("n") or 0) / (rows * cols * largest))))
    rows, cols = rows * times, cols * times
    place = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    entries = entries.select(place("src", rows).alias("rb"), place("dst", cols).alias("cb"), "src", "dst", "w")
    pieces = entries.groupBy("rb", "cb").agg(F.ceil(F.count("*") / largest).cast("int").alias("pieces"))  # one row a block
    piece = F.pmod(F.xxhash64("src", "dst"), F.col("pieces")).cast("int")
    entries = cut(entries.join(F.broadcast(pieces), ["rb", "cb"]).select("rb", (F.col("cb") + piece * cols).alias("cb"), "src", "dst", "w"))
    packed = entries.groupBy("rb", "cb").agg(F.sort_array(F.collect_list(F.struct("src", "dst", "w"))).alias("e"))
    grid = cut(packed.select("rb", "cb", F.col("e.src").alias("r"), F.col("e.dst").alias("c"), F.col("e.w").alias("w")))
    return grid, cut(entries.select("dst", "cb", "rb").distinct())


def _block_sums(v: pd.DataFrame, r: np.ndarray, c: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sources, sums) of one block; entries whose target has no vector count nothing."""
    v = v.sort_values("dst")
    ids, x = v["dst"].to_numpy(), np.stack(v["vec"].to_numpy())
    at = np.minimum(np.searchsorted(ids, c), len(ids) - 1)
    hit = ids[at] == c
    rows, code = np.unique(r[hit], return_inverse=True)
    at, w = at[hit], w[hit].reshape(int(hit.sum()), -1)
    width = x.shape[1] // w.shape[1]
    return rows, np.column_stack([np.bincount(code, x[at, k] * w[:, k // width], len(rows)) for k in range(x.shape[1])])


def aggregate_grid(grid: DataFrame, needed: DataFrame, x: DataFrame, slice_width: int | None = None) -> DataFrame:
    """(node_id, x): y(u) = sum over edges of w(u, v) x(v), by blocks; with weights of several heads each head weighs its own stretch of the vector.

    A vector is sent once to each block of rows that needs it, and a block sends one partial sum a source, instead of a vector an edge. With ``slice_width``
    (of one head's weights only) blocks take that many columns of the vectors at a time, for vectors too wide to hold.
    """
    many = isinstance(grid.schema["w"].dataType.elementType, T.ArrayType)
    if many and slice_width:
        raise ValueError("slices go with one weight an edge")
    vectors = needed.join(x.select(F.col("node_id").alias("dst"), F.col("x").alias("vec")), "dst")
    left, keys = grid, ["rb", "cb"]
    if slice_width:
        first = x.select(F.size("x").alias("n")).first()
        width = first["n"] if first else 0
        filled = F.concat("vec", F.array_repeat(F.lit(0.0), -width % slice_width))  # so that all slices are equally wide
        starts = F.array(*(F.lit(k) for k in range(1, width + 1, slice_width)))
        vectors = vectors.select("rb", "cb", "dst", filled.alias("vec"), F.posexplode(starts).alias("s", "start")).withColumn("vec", F.slice("vec", F.col("start"), F.lit(slice_width))).drop("start")
        left, keys = grid.join(vectors.select("rb", "cb", "s").distinct(), ["rb", "cb"]), ["rb", "cb", "s"]

    def run(key: tuple, b: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        if not len(b) or not len(v):
            return pd.DataFrame({"node_id": [], "s": [], "vec": []})
        w = b["w"].iloc[0]
        rows, sums = _block_sums(v, np.asarray(b["r"].iloc[0]), np.asarray(b["c"].iloc[0]), np.stack(w) if many else np.asarray(w))
        return pd.DataFrame({"node_id": rows, "s": key[2] if slice_width else 0, "vec": list(sums)})

    sent = vectors.select(*(F.col(k).alias(f"{k}_") for k in keys), "dst", "vec")
    parts = left.groupBy(*keys).cogroup(sent.groupBy(*(f"{k}_" for k in keys))).applyInPandas(run, "node_id long, s long, vec array<double>")
    total = sum_vectors(parts, ["node_id", "s"], "vec", None)
    if not slice_width:
        return total.select("node_id", F.col("vec").alias("x"))
    whole = total.groupBy("node_id").agg(F.sort_array(F.collect_list(F.struct("s", "vec"))).alias("p"))
    return whole.select("node_id", F.slice(F.flatten(F.col("p.vec")), 1, width).alias("x"))


def row_wise(x: DataFrame, f: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Replace column ``x`` by f of the stacked vectors; all other columns stay."""
    names, shape = x.columns, x.schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield b.assign(x=list(f(np.stack(b["x"].to_numpy()))))[names]

    return x.mapInPandas(run, shape)


def dense(w: np.ndarray, b: np.ndarray | None = None) -> Callable[[np.ndarray], np.ndarray]:
    return lambda v: v @ w + (0 if b is None else b)


def layer_norm(gamma: np.ndarray | float = 1.0, beta: np.ndarray | float = 0.0) -> Callable[[np.ndarray], np.ndarray]:
    """Over each row, with the population variance."""
    return lambda v: (v - v.mean(1, keepdims=True)) / np.sqrt(v.var(1, keepdims=True) + NORM_EPS) * gamma + beta


def relu(v: np.ndarray) -> np.ndarray:
    return np.maximum(v, 0)


def elu(v: np.ndarray) -> np.ndarray:
    return np.where(v > 0, v, np.expm1(np.minimum(v, 0)))


def unit_rows(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def chain(*steps: Callable[[np.ndarray], np.ndarray]) -> Callable[[np.ndarray], np.ndarray]:
    """Several row-wise steps in one pass over the rows."""

    def run(v: np.ndarray) -> np.ndarray:
        for f in steps:
            v = f(v)
        return v

    return run


def dense_layer(x: DataFrame, w: np.ndarray, b: np.ndarray | None = None) -> DataFrame:
    return row_wise(x, dense(w, b))


def attention_scores(adj: DataFrame, h: DataFrame, att_l: np.ndarray, att_r: np.ndarray, batch: tuple[str, ...] = ()) -> DataFrame:
    """(src, dst, scores): per head softmax over u's neighbours v of leaky_relu(a_r . h(u) + a_l . h(v), 0.2).

    ``h`` holds the heads one after the other, att_l and att_r are (heads, width). Only the two dot products of a node travel along
    edges, not its vector. Maxima and sums per source are partial before the shuffle; nothing collects a hub's edges.
    """
    heads, width = att_l.shape

    def dots(v: np.ndarray) -> np.ndarray:
        split = v.reshape(len(v), heads, width)
        return np.hstack([(split * att_l).sum(2), (split * att_r).sum(2)])

    parts = row_wise(h, dots)
    left = parts.select(*batch, F.col("node_id").alias("dst"), F.slice("x", 1, heads).alias("l"))
    right = parts.select(*batch, F.col("node_id").alias("src"), F.slice("x", heads + 1, heads).alias("r"))
    raw = adj.select(*batch, "src", "dst").join(right, [*batch, "src"]).join(left, [*batch, "dst"])
    raw = raw.select(*batch, "src", "dst", F.zip_with("r", "l", lambda a, b: F.when(a + b >= 0, a + b).otherwise((a + b) * 0.2)).alias("e"))
    by = [*batch, "src"]
    tops = raw.groupBy(*by).agg(F.array(*(F.max(F.col("e")[k]) for k in range(heads))).alias("m"))
    shifted = raw.join(tops, by).select(*batch, "src", "dst", F.zip_with("e", "m", lambda e, m: F.exp(e - m)).alias("z"))
    sums = shifted.groupBy(*by).agg(F.array(*(F.sum(F.col("z")[k]) for k in range(heads))).alias("s"))
    return shifted.join(sums, by).select(*batch, "src", "dst", F.zip_with("z", "s", lambda z, s: z / s).alias("scores"))


def aggregate_attention(scores: DataFrame, h: DataFrame, heads: int, concat: bool, bias: np.ndarray | None = None, batch: tuple[str, ...] = ()) -> DataFrame:
    """(node_id, x): per head the sum of score x vector over neighbours; heads side by side, or their mean; plus the bias."""
    side = h.select(*batch, F.col("node_id").alias("dst"), F.col("x").alias("vec"))
    ends = scores.join(side, [*batch, "dst"]).withColumn("width", F.size("vec") / heads)
    scaled = F.transform("vec", lambda v, k: v * F.get(F.col("scores"), F.floor(k / F.col("width")).cast("int")))
    total = sum_vectors(ends.select(*batch, F.col("src").alias("node_id"), scaled.alias("vec")), [*batch, "node_id"], weight=None).select(*batch, "node_id", F.col("vec").alias("x"))

    def finish(v: np.ndarray) -> np.ndarray:
        out = v if concat else v.reshape(len(v), heads, -1).mean(1)
        return out if bias is None else out + bias

    return row_wise(total, finish)


def _only(adj: DataFrame, outputs: DataFrame | None, batch: tuple[str, ...]) -> DataFrame:
    """Rows of the output nodes: what the last layer needs."""
    if outputs is None:
        return adj
    return adj.join(outputs.select(*batch, F.col("node_id").alias("src")).distinct(), [*batch, "src"], "left_semi")


def gcn_forward(x: DataFrame, adj: DataFrame, layers: list[np.ndarray], last: tuple[np.ndarray, np.ndarray], outputs: DataFrame | None = None, batch: tuple[str, ...] = ()) -> DataFrame:
    """(node_id, x = logits): layers of [linear, weighted sum, layer norm, relu], then a linear map; the last sum is over output rows only."""
    between: Callable[[np.ndarray], np.ndarray] | None = None
    for k, w in enumerate(layers):
        # The norm and relu of one layer and the linear map of the next are one pass over the rows.
        h = row_wise(x, dense(w) if between is None else chain(between, dense(w)))
        x = cut(aggregate_sum(_only(adj, outputs if k == len(layers) - 1 else None, batch), h, batch))
        between = chain(layer_norm(), relu)
    return row_wise(x, chain(between, dense(*last)))


def sage_forward(x: DataFrame, adj: DataFrame, layers: list[tuple[np.ndarray, np.ndarray, np.ndarray]], last: tuple[np.ndarray, np.ndarray], outputs: DataFrame | None = None, normalize: bool = False, batch: tuple[str, ...] = ()) -> DataFrame:
    """(node_id, x = logits): layers of [W_l mean of neighbours + b + W_r self, optional unit length, layer norm, relu], then a linear map."""
    for k, (w_l, b, w_r) in enumerate(layers):
        near = aggregate_mean(_only(adj, outputs if k == len(layers) - 1 else None, batch), x, batch).withColumnRenamed("x", "near")
        both = near.join(x, [*batch, "node_id"]).select(*batch, "node_id", F.concat("near", "x").alias("x"))
        steps = [dense(np.vstack([w_l, w_r]), b), *([unit_rows] if normalize else []), layer_norm(), relu]
        x = cut(row_wise(both, chain(*steps)))
    return row_wise(x, dense(*last))


def gat_forward(x: DataFrame, adj: DataFrame, layers: list[dict], outputs: DataFrame | None = None, batch: tuple[str, ...] = ()) -> DataFrame:
    """(node_id, x = logits): layers of dicts w, att_l, att_r, bias; attention, layer norm and elu between; the last one averages heads, with neither."""
    for k, p in enumerate(layers):
        final, heads = k == len(layers) - 1, len(p["att_l"])
        h = cut(dense_layer(x, p["w"]))
        near = _only(adj, outputs if final else None, batch)
        x = cut(aggregate_attention(attention_scores(near, h, p["att_l"], p["att_r"], batch), h, heads, not final, p.get("bias"), batch))
        if not final:
            x = row_wise(x, chain(layer_norm(), elu))
    return x


def batch_forward(batch_nodes: DataFrame, batch_edges: DataFrame, nodes: DataFrame, forward: Callable[..., DataFrame], *weights: object, **options: object) -> DataFrame:
    """(batch_id, node_id, x): the model on each batch's own subgraph, for its outputs only; all batches in one job."""
    x = batch_nodes.select("batch_id", "node_id").join(nodes.select("node_id", F.col("features").alias("x")), "node_id").select("batch_id", "node_id", "x")
    outputs = batch_nodes.where("is_output").select("batch_id", "node_id")
    done = forward(x, batch_edges, *weights, outputs=outputs, batch=("batch_id",), **options)
    return done.join(outputs, ["batch_id", "node_id"], "left_semi").select("batch_id", "node_id", "x")


def log_softmax(x: Column) -> Column:
    top = F.array_max(x)
    total = F.aggregate(x, F.lit(0.0), lambda s, v: s + F.exp(v - F.array_max(x)))
    return F.transform(x, lambda v: v - top - F.log(total))


def predict(logits: DataFrame) -> DataFrame:
    """(keys, logp, pred): log-softmax, and the first class with the largest logit."""
    keys = [c for c in logits.columns if c != "x"]
    return logits.select(*keys, log_softmax(F.col("x")).alias("logp"), (F.array_position("x", F.array_max("x")) - 1).cast("long").alias("pred"))


def nll_loss(predicted: DataFrame, labels: DataFrame, node_norm: DataFrame | None = None) -> DataFrame:
    """(loss) per batch, or in all: the mean of -log p(label), or the sum of node_norm x loss. Nodes without a label don't count."""
    batch = [c for c in ("batch_id",) if c in predicted.columns]
    rows = predicted.join(labels.select("node_id", "label").where("label >= 0"), "node_id").withColumn("l", -F.element_at("logp", (F.col("label") + 1).cast("int")))
    if node_norm is None:
        return rows.groupBy(*batch).agg(F.avg("l").alias("loss"))
    return rows.join(node_norm.select(*[c for c in batch if c in node_norm.columns], "node_id", "node_norm"), [*[c for c in batch if c in node_norm.columns], "node_id"]).groupBy(*batch).agg(F.sum(F.col("node_norm") * F.col("l")).alias("loss"))

"""Random walks, walk norms, layer-wise importance sampling and neighbour sampling; all choices are hash-uniform, so runs repeat."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphbatch.functions.hashing import hash_uniform
from graphbatch.functions.lineage import cut
from graphbatch.operators.batches import cut_outputs, induced_subgraphs
from graphbatch.operators.influence import DIGITS
from graphbatch.operators.prep import degrees


def numbered_neighbors(adj: DataFrame, per_block: int = 1024) -> tuple[DataFrame, DataFrame]:
    """(nodes, blocks): a number from 0 to deg - 1 for each neighbour, without sorting any node's neighbours as a whole.

    Neighbours lie in blocks of about ``per_block`` at most, dealt by a hash of their id, and within a block in the order of ids; numbers go
    on from block to block. nodes is (node, deg, starts), the numbers at which blocks start; blocks is (node, block, ends), structs of dst and weight if there is one.
    """
    rest = [c for c in ("weight",) if c in adj.columns]
    deg = cut(degrees(adj, "src").select(F.col("node_id").alias("node"), "deg"))
    block = F.when(F.col("deg") <= per_block, 0).otherwise(F.floor(hash_uniform("block", "dst") * F.ceil(F.col("deg") / per_block))).cast("int")
    dealt = adj.select(F.col("src").alias("node"), "dst", *rest).join(deg, "node").withColumn("block", block)
    blocks = cut(dealt.groupBy("node", "block").agg(F.sort_array(F.collect_list(F.struct("dst", *rest))).alias("ends")))
    before = F.sum(F.size("ends")).over(Window.partitionBy("node").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))  # one row a block
    starts = blocks.select("node", F.struct(F.coalesce(before, F.lit(0)).alias("start"), "block").alias("s")).groupBy("node").agg(F.sort_array(F.collect_list("s")).alias("starts"))
    return cut(deg.join(starts, "node").select("node", "deg", "starts")), blocks


def at_number(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Rows (node, starts, k, ...) with the struct ``end`` of the neighbour numbered k: one equi-join on (node, block)."""
    placed = rows.withColumn("_s", F.element_at(F.filter("starts", lambda s: s["start"] <= F.col("k")), -1))
    placed = placed.withColumns({"block": F.col("_s.block"), "k": (F.col("k") - F.col("_s.start")).cast("int")}).drop("starts", "_s")
    return placed.join(blocks, ["node", "block"]).withColumn("end", F.get("ends", F.col("k"))).drop("ends", "block", "k")


def random_walks(edges: DataFrame, roots: DataFrame, length: int, seed: int = 2021, per_block: int = 1024) -> DataFrame:
    """(sample_id, walk_id, step, node_id): step 0 is the root; each step goes to a neighbour drawn uniformly.

    ``roots`` is (sample_id, walk_id, node_id). Neighbours are numbered once per node (``numbered_neighbors``), so a step is a join for the
    degree and one for the neighbour of the drawn number.
    """
    nodes, blocks = numbered_neighbors(edges.select("src", "dst"), per_block)
    walk = roots.select("sample_id", "walk_id", F.lit(0).alias("step"), F.col("node_id").cast("long").alias("node_id"))
    out = walk
    for step in range(1, length + 1):
        u = hash_uniform(f"{seed}-walk", "sample_id", "walk_id", F.lit(step))
        at = walk.select("sample_id", "walk_id", F.col("node_id").alias("node")).join(nodes, "node").withColumn("k", F.least(F.floor(u * F.col("deg")), F.col("deg") - 1)).drop("deg")
        walk = cut(at_number(at, blocks).select("sample_id", "walk_id", F.lit(step).alias("step"), F.col("end.dst").alias("node_id")))
        out = out.union(walk)
    return out


def uniform_roots(nodes: DataFrame, samples: int, per_sample: int, seed: int = 2021, first: int = 0) -> DataFrame:
    """(sample_id, walk_id, node_id): roots drawn uniformly with replacement from all nodes, which are numbered by hash bucket and id; samples are numbered from ``first``."""
    spark = nodes.sparkSession
    order = Window.partitionBy("b").orderBy("node_id")
    ids = nodes.select("node_id", F.floor(hash_uniform("root-order", "node_id") * 64).alias("b")).distinct()
    counts = ids.groupBy("b").agg(F.count("*").alias("c"))
    total = nodes.select("node_id").distinct().count()
    before = counts.alias("x").join(counts.alias("y"), F.col("y.b") < F.col("x.b"), "left").groupBy("x.b").agg(F.coalesce(F.sum("y.c"), F.lit(0)).alias("before"))
    numbered = ids.withColumn("p", F.row_number().over(order)).join(F.broadcast(before), "b").select("node_id", (F.col("before") + F.col("p") - 1).alias("k"))  # one row a bucket
    draws = spark.range(first * per_sample, (first + samples) * per_sample).select(F.floor(F.col("id") / per_sample).alias("sample_id"), (F.col("id") % per_sample).alias("walk_id"))
    draws = draws.withColumn("k", F.floor(hash_uniform(f"{seed}-root", "sample_id", "walk_id") * total))
    return draws.join(numbered, "k").select("sample_id", "walk_id", "node_id")


def walk_subgraphs(walks: DataFrame, adj: DataFrame, outputs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(batch_nodes, batch_edges) of each sample: its distinct nodes, output flags, and the induced edges."""
    flags = outputs.select("node_id", F.lit(True).alias("o")).distinct()
    nodes = walks.select(F.col("sample_id").alias("batch_id"), "node_id").distinct().join(flags, "node_id", "left").select("batch_id", "node_id", F.coalesce("o", F.lit(False)).alias("is_output"))
    return nodes, induced_subgraphs(nodes, adj)


def samples_for_coverage(batch_nodes: DataFrame, n_nodes: int, coverage: float) -> DataFrame:
    """Rows of the samples, in order of their id, up to and with the one that brings the sampled nodes to ``n_nodes coverage``."""
    sizes = batch_nodes.groupBy("batch_id").agg(F.count("*").alias("c"))
    before = F.coalesce(F.sum("c").over(Window.orderBy("batch_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a sample
    return batch_nodes.join(sizes.withColumn("b", before).where(F.col("b") < n_nodes * coverage).select("batch_id"), "batch_id", "left_semi")


def samples_until_coverage(nodes: DataFrame, edges: DataFrame, outputs: DataFrame, per_sample: int, length: int, coverage: float, seed: int = 2021, first_round: int = 8) -> DataFrame:
    """(batch_id, node_id, is_output) of the training samples 0, 1, ... whose nodes add up to N coverage, drawn in rounds.

    A round draws as many samples as the mean size so far says are missing, and one more. A sample is a function of its number, so the result is that of
    drawing one after the other, and the last sample is the one that reaches the total; what a round drew beyond it is dropped.
    """
    n = nodes.select("node_id").distinct().count()
    flags, drawn, told, total, more = outputs.select("node_id", F.lit(True).alias("o")).distinct(), [], 0, 0, first_round
    while n and total < n * coverage:
        walks = random_walks(edges, uniform_roots(nodes, more, per_sample, seed, told), length, seed)
        rows = cut(walks.select(F.col("sample_id").alias("batch_id"), "node_id").distinct())
        drawn.append(rows)
        total, told = total + rows.count(), told + more
        more = max(1, int((n * coverage - total) * told / total) + 1)
    every = functools.reduce(DataFrame.unionByName, drawn) if drawn else nodes.select(F.lit(0).cast("long").alias("batch_id"), "node_id").where("false")
    kept = samples_for_coverage(every, n, coverage)
    return kept.join(flags, "node_id", "left").select("batch_id", "node_id", F.coalesce("o", F.lit(False)).alias("is_output"))


def walk_norms(batch_nodes: DataFrame, batch_edges: DataFrame, nodes: DataFrame, edges: DataFrame, n_nodes: int) -> tuple[DataFrame, DataFrame]:
    """(node_norm, edge_norm) over S samples: S / count / N with 0 counting as 0.1, and count(src) / count(edge), 0.1 for edges never sampled."""
    seen = batch_nodes.select("batch_id", "node_id").distinct().groupBy("node_id").agg(F.count("*").alias("c"))
    s = batch_nodes.agg(F.countDistinct("batch_id").alias("s"))
    counted = nodes.select("node_id").distinct().join(seen, "node_id", "left").select("node_id", F.coalesce("c", F.lit(0)).cast("double").alias("c"))
    node_norm = counted.crossJoin(F.broadcast(s)).select("node_id", (F.col("s") / F.when(F.col("c") == 0, 0.1).otherwise(F.col("c")) / n_nodes).alias("norm"))  # s is one row
    met = batch_edges.select("batch_id", "src", "dst").distinct().groupBy("src", "dst").agg(F.count("*").alias("e"))
    rows = edges.select("src", "dst").distinct().join(met, ["src", "dst"], "left").join(counted.withColumnRenamed("node_id", "src"), "src", "left")
    edge_norm = rows.select("src", "dst", F.when(F.col("e").isNull(), 0.1).otherwise(F.col("c") / F.col("e")).alias("norm"))
    return node_norm, edge_norm


def apply_walk_norms(batch_nodes: DataFrame, batch_edges: DataFrame, node_norm: DataFrame, edge_norm: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Output rows with node norms that add up to 1 in a batch, and edges with weight times edge norm."""
    outputs = batch_nodes.where("is_output").join(node_norm, "node_id")
    outputs = outputs.select("batch_id", "node_id", (F.col("norm") / F.sum("norm").over(Window.partitionBy("batch_id"))).alias("node_norm"))
    weighted = batch_edges.join(edge_norm, ["src", "dst"]).select("batch_id", "src", "dst", (F.col("weight") * F.col("norm")).alias("weight"))
    return outputs, weighted


def walk_eval_batches(outputs: DataFrame, edges: DataFrame, adj: DataFrame, length: int, per_batch: int, seed: int = 2021) -> tuple[DataFrame, DataFrame]:
    """(batch_nodes, batch_edges): walks start at each output of a batch; all nodes they visit are auxiliary."""
    groups = cut_outputs(outputs, per_batch, seed)
    roots = groups.select(F.col("group_id").alias("sample_id"), F.col("node_id").alias("walk_id"), "node_id")
    visited = random_walks(edges, roots, length, seed).select(F.col("sample_id").alias("batch_id"), "node_id").distinct()
    own = groups.select(F.col("group_id").alias("batch_id"), "node_id", F.lit(True).alias("o"))
    nodes = visited.join(own, ["batch_id", "node_id"], "left").select("batch_id", "node_id", F.coalesce("o", F.lit(False)).alias("is_output"))
    return nodes, induced_subgraphs(nodes, adj)


def layer_importance_sample(batch_outputs: DataFrame, adj_sym: DataFrame, sizes: list[int], seed: int = 2021) -> tuple[DataFrame, DataFrame]:
    """(layer_nodes, layer_edges): per layer min(size, candidates) nodes without replacement, drawn by pi(v) = sum of squared weights from the layer before.

    The draw takes the smallest of -ln(u) / pi, an exponential race. Batch outputs belong to every layer. Edges of a layer run from
    the nodes before to the nodes drawn. Layer 0 is the last one drawn, as the model reads them.
    """
    own = batch_outputs.select("batch_id", "node_id").distinct()
    before, edges, nodes = own, None, own.withColumn("layer", F.lit(len(sizes)))
    for k, size in enumerate(sizes):
        layer = len(sizes) - 1 - k
        reach = before.withColumnRenamed("node_id", "src").join(adj_sym, "src")
        pi = reach.groupBy("batch_id", F.col("dst").alias("node_id")).agg(F.sum(F.col("weight") * F.col("weight")).alias("pi")).where("pi > 0")
        race = F.round(-F.log(hash_uniform(f"{seed}-layer-{k}", "batch_id", "node_id")) / F.col("pi"), DIGITS)
        drawn = pi.withColumn("rn", F.row_number().over(Window.partitionBy("batch_id").orderBy(race, "node_id"))).where(F.col("rn") <= size).select("batch_id", "node_id")
        after = cut(drawn.union(own).distinct())
        step = reach.join(after.withColumnRenamed("node_id", "dst"), ["batch_id", "dst"]).select("batch_id", F.lit(layer).alias("layer"), "src", "dst", "weight")
        edges = step if edges is None else edges.union(step)
        nodes = nodes.union(after.withColumn("layer", F.lit(layer)))
        before = after
    return nodes, edges


def neighbor_sample(batch_outputs: DataFrame, adj_sym: DataFrame, fanouts: list[int], seed: int = 2021) -> tuple[DataFrame, DataFrame]:
    """(layer_nodes, layer_edges): per hop up to ``fanout`` neighbours of every known node, without replacement; known nodes only grow."""
    known = batch_outputs.select("batch_id", "node_id").distinct()
    edges, nodes = None, known.withColumn("layer", F.lit(len(fanouts)))
    for k, fanout in enumerate(fanouts):
        layer = len(fanouts) - 1 - k
        order = Window.partitionBy("batch_id", "src").orderBy(hash_uniform(f"{seed}-hop-{k}", "batch_id", "src", "dst"), "dst")
        step = known.withColumnRenamed("node_id", "src").join(adj_sym, "src").withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= fanout)
        step = cut(step.select("batch_id", F.lit(layer).alias("layer"), "src", "dst", "weight"))
        known = cut(known.union(step.select("batch_id", F.col("dst").alias("node_id"))).distinct())
        edges = step if edges is None else edges.union(step)
        nodes = nodes.union(known.withColumn("layer", F.lit(layer)))
    return nodes, edges


def draw_numbers(count: Column, deg: Column, uniform: Callable[[int], Column], most: int) -> Column:
    """Sorted distinct numbers in 0 .. deg - 1, min(count, deg) of them, every set as likely as any other.

    The j-th draw is a rank among the numbers that are still free: it moves up by one for each number taken before that is not above it.
    """
    each, turns = F.array(*(uniform(j) for j in range(most))), F.array(*(F.lit(j).cast("long") for j in range(most)))

    def draw(taken: Column, j: Column) -> Column:
        rank = F.least(F.floor(F.get(each, j.cast("int")) * (deg - j)), deg - j - 1)
        free = F.aggregate(taken, rank, lambda x, t: x + F.when(t <= x, 1).otherwise(0).cast("long"))
        return F.array_sort(F.concat(taken, F.array(free)))

    return F.aggregate(F.slice(turns, 1, F.least(count, deg, F.lit(most)).cast("int")), F.expr("CAST(array() AS array<bigint>)"), draw)


def neighbor_draws(batch_outputs: DataFrame, adj_sym: DataFrame, fanouts: list[int], seed: int = 2021, per_block: int = 1024) -> tuple[DataFrame, DataFrame]:
    """(layer_nodes, layer_edges) as ``neighbor_sample`` gives, at a cost of ``fanout`` and not of the degree for each known node.

    Neighbours are numbered once; each hop draws numbers without replacement and fetches just those neighbours, so no adjacency is
    sorted or read as a whole.
    """
    numbered, blocks = numbered_neighbors(adj_sym, per_block)
    known = batch_outputs.select("batch_id", "node_id").distinct()
    edges, nodes = None, known.withColumn("layer", F.lit(len(fanouts)))
    for k, fanout in enumerate(fanouts):
        layer = len(fanouts) - 1 - k
        draw = draw_numbers(F.lit(fanout).cast("long"), F.col("deg"), lambda j, k=k: hash_uniform(f"{seed}-draw-{k}-{j}", "batch_id", "node"), fanout)  # noqa: B023
        at = known.withColumnRenamed("node_id", "node").join(numbered, "node").select("batch_id", F.col("node").alias("src"), "node", "starts", F.explode(draw).alias("k"))
        step = cut(at_number(at, blocks).select("batch_id", F.lit(layer).alias("layer"), "src", F.col("end.dst").alias("dst"), F.col("end.weight").alias("weight")))
        known = cut(known.union(step.select("batch_id", F.col("dst").alias("node_id"))).distinct())
        edges = step if edges is None else edges.union(step)
        nodes = nodes.union(known.withColumn("layer", F.lit(layer)))
    return nodes, edges

"""Batches of output nodes with their auxiliary nodes, their induced subgraphs, and checks on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphbatch.functions.hashing import hash_uniform
from graphbatch.operators.influence import batch_ppr, topk_per_batch
from graphbatch.operators.prep import ranked


def node_wise_batches(groups: DataFrame, neighbors: DataFrame) -> DataFrame:
    """(batch_id, node_id, is_output): a batch holds the neighbours of all its outputs, each once; the outputs are among them."""
    aux = groups.join(neighbors.select(F.col("source").alias("node_id"), "node"), "node_id").select(F.col("group_id").alias("batch_id"), F.col("node").alias("node_id"), F.lit(0).alias("o"))
    own = groups.select(F.col("group_id").alias("batch_id"), "node_id", F.lit(1).alias("o"))
    return aux.union(own).groupBy("batch_id", "node_id").agg((F.max("o") == 1).alias("is_output"))


def outputs_of_parts(parts: DataFrame, outputs: DataFrame) -> DataFrame:
    """(batch_id, node_id): the output nodes of each part; parts without any are absent."""
    return parts.join(outputs.select("node_id").distinct(), "node_id", "left_semi").select(F.col("part_id").alias("batch_id"), "node_id")


def batch_wise_batches(parts: DataFrame, outputs: DataFrame, adj_rw: DataFrame, k: int, alpha: float = 0.25, num_iter: int = 50, cut_every: int = 1) -> DataFrame:
    """Outputs of each part with the k nodes that score highest for them as a set."""
    sets = outputs_of_parts(parts, outputs)
    best = topk_per_batch(batch_ppr(adj_rw, sets, alpha, num_iter, cut_every), k)
    rows = best.select("batch_id", "node_id", F.lit(0).alias("o")).union(sets.select("batch_id", "node_id", F.lit(1).alias("o")))
    return rows.groupBy("batch_id", "node_id").agg((F.max("o") == 1).alias("is_output"))


def cluster_batches(parts: DataFrame, outputs: DataFrame) -> DataFrame:
    """A batch is a whole part; parts without outputs are skipped."""
    sets = outputs_of_parts(parts, outputs)
    rows = parts.join(sets.select(F.col("batch_id").alias("part_id")).distinct(), "part_id", "left_semi").join(sets.withColumnRenamed("batch_id", "part_id").withColumn("o", F.lit(True)), ["part_id", "node_id"], "left")
    return rows.select(F.col("part_id").alias("batch_id"), "node_id", F.coalesce("o", F.lit(False)).alias("is_output"))


def partition_neighbor_batches(parts: DataFrame, outputs: DataFrame, neighbors: DataFrame) -> DataFrame:
    """Outputs of each part with the union of their neighbours."""
    return node_wise_batches(outputs_of_parts(parts, outputs).withColumnRenamed("batch_id", "group_id"), neighbors)


def cut_outputs(outputs: DataFrame, per_batch: int, seed: str | int) -> DataFrame:
    """(group_id, node_id): outputs in hash order, ``per_batch`` to a group; the last one may be short."""
    order = ranked(outputs.select("node_id").distinct().withColumn("u", hash_uniform(seed, "node_id")))
    return order.select(F.floor((F.col("rn") - 1) / per_batch).cast("long").alias("group_id"), "node_id")


def random_fixed_batches(outputs: DataFrame, neighbors: DataFrame, per_batch: int, seed: int = 2021) -> DataFrame:
    """Outputs permuted once and cut into batches, with the union of their neighbours."""
    return node_wise_batches(cut_outputs(outputs, per_batch, seed), neighbors)


def random_epoch_batches(outputs: DataFrame, neighbors: DataFrame, per_batch: int, epoch: int, seed: int = 2021) -> DataFrame:
    """As the fixed batches, permuted anew in each epoch."""
    return node_wise_batches(cut_outputs(outputs, per_batch, f"{seed}-{epoch}"), neighbors)


def disjoint_copy_batches(outputs: DataFrame, neighbors: DataFrame, per_batch: int, epoch: int, seed: int = 2021, flag_all_copies: bool = False) -> DataFrame:
    """(batch_id, output_id, node_id, is_output): every output keeps a copy of its neighbours of its own; only its own copy is an output.

    With ``flag_all_copies`` every copy of one of the batch's outputs is flagged, also those among the neighbours of another output.
    """
    groups = cut_outputs(outputs, per_batch, f"{seed}-{epoch}")
    rows = groups.withColumnRenamed("node_id", "source").join(neighbors.select("source", "node").distinct(), "source")
    rows = rows.select("group_id", "source", "node").union(groups.select("group_id", "node_id", "node_id")).distinct()
    flag = F.col("source") == F.col("node")
    if flag_all_copies:
        rows = rows.join(groups.select("group_id", F.col("node_id").alias("node"), F.lit(True).alias("own")), ["group_id", "node"], "left")
        flag = F.coalesce("own", F.lit(False))
    return rows.select(F.col("group_id").alias("batch_id"), F.col("source").alias("output_id"), F.col("node").alias("node_id"), flag.alias("is_output"))


def disjoint_copy_edges(copies: DataFrame, adj: DataFrame) -> DataFrame:
    """Edges inside each copy."""
    a = copies.select("batch_id", "output_id", F.col("node_id").alias("src"))
    b = copies.select("batch_id", "output_id", F.col("node_id").alias("dst"))
    return adj.join(a, "src").join(b, ["batch_id", "output_id", "dst"]).select("batch_id", "output_id", "src", "dst", "weight")


def fixed_count_batches(outputs: DataFrame, num_batches: int, epoch: int, seed: int = 2021) -> DataFrame:
    """(group_id, node_id): shuffled outputs in batches of ceil(n / num_batches)."""
    order = ranked(outputs.select("node_id").distinct().withColumn("u", hash_uniform(f"{seed}-{epoch}", "node_id")))
    n = outputs.select("node_id").distinct().agg(F.ceil(F.count("*") / num_batches).alias("size"))
    return order.crossJoin(F.broadcast(n)).select(F.floor((F.col("rn") - 1) / F.col("size")).cast("long").alias("group_id"), "node_id")  # n is one row


def combine_batches(batch_nodes: DataFrame, group_size: int) -> DataFrame:
    """Several ready batches in one: outputs together, auxiliary nodes once."""
    joined = batch_nodes.groupBy(F.floor(F.col("batch_id") / group_size).cast("long").alias("b"), "node_id").agg(F.max(F.col("is_output").cast("int")).alias("o"))
    return joined.select(F.col("b").alias("batch_id"), "node_id", (F.col("o") == 1).alias("is_output"))


def output_mask(aux: DataFrame, batch_outputs: DataFrame) -> DataFrame:
    """(batch_id, node_id, is_output): whether an auxiliary row is an output of its own batch."""
    flags = batch_outputs.select("batch_id", "node_id", F.lit(True).alias("o")).distinct()
    return aux.select("batch_id", "node_id").join(flags, ["batch_id", "node_id"], "left").select("batch_id", "node_id", F.coalesce("o", F.lit(False)).alias("is_output"))


def check_batches(batch_nodes: DataFrame, batch_outputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """(problem, node_id): outputs that are in no batch, in several, or not among their batch's auxiliary nodes. Empty if all is well."""
    placed = batch_outputs.select("batch_id", "node_id").distinct()
    missing = outputs.select("node_id").distinct().join(placed, "node_id", "left_anti").select(F.lit("missing").alias("problem"), "node_id")
    twice = placed.groupBy("node_id").agg(F.count("*").alias("c")).where("c > 1").select(F.lit("twice").alias("problem"), "node_id")
    outside = placed.join(batch_nodes.select("batch_id", "node_id"), ["batch_id", "node_id"], "left_anti").select(F.lit("not auxiliary").alias("problem"), "node_id")
    return missing.union(twice).union(outside)


def induced_subgraphs(batch_nodes: DataFrame, adj: DataFrame) -> DataFrame:
    """(batch_id, src, dst, ...): edges with both ends in the batch, with the weights (or other columns) of the whole graph's table."""
    a = batch_nodes.select("batch_id", F.col("node_id").alias("src"))
    b = batch_nodes.select("batch_id", F.col("node_id").alias("dst"))
    rest = [c for c in adj.columns if c not in ("src", "dst")]
    return adj.join(a, "src").join(b, ["batch_id", "dst"]).select("batch_id", "src", "dst", *rest)


def relabel_batch_nodes(batch_nodes: DataFrame) -> DataFrame:
    """``local_id``: 0, 1, ... within the batch in the order of node ids."""
    return batch_nodes.withColumn("local_id", (F.row_number().over(Window.partitionBy("batch_id").orderBy("node_id")) - 1).cast("int"))


def relabel_batch_edges(batch_edges: DataFrame, local: DataFrame) -> DataFrame:
    """``src_local`` and ``dst_local`` beside src and dst."""
    side = lambda c: local.select("batch_id", F.col("node_id").alias(c), F.col("local_id").alias(f"{c}_local"))
    return batch_edges.join(side("src"), ["batch_id", "src"]).join(side("dst"), ["batch_id", "dst"])


def gather_batch_features(batch_nodes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Batch rows with features and label."""
    return batch_nodes.join(nodes.select("node_id", "features", "label"), "node_id").select(*batch_nodes.columns, "features", "label")

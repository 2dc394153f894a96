"""Graph preparation: loops, directions, duplicates, labels, degrees and edge weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphbatch.functions.lineage import cut

from graphbatch.functions.hashing import hash_uniform


def add_self_loops(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct edges with exactly one loop at every node."""
    return edges.select("src", "dst").unionByName(nodes.select(F.col("node_id").alias("src"), F.col("node_id").alias("dst"))).distinct()


def to_undirected(edges: DataFrame) -> DataFrame:
    """Distinct edges of both directions."""
    return edges.select("src", "dst").union(edges.select("dst", "src")).distinct()


def coalesce_edges(edges: DataFrame, agg: str = "sum") -> DataFrame:
    """One row per (src, dst); a weight column is combined by ``agg`` (sum, min, max or avg)."""
    if "weight" not in edges.columns:
        return edges.select("src", "dst").distinct()
    return edges.groupBy("src", "dst").agg(getattr(F, agg)("weight").alias("weight"))


def clean_labels(nodes: DataFrame) -> DataFrame:
    """label: raw_label as a long, -1 where it is null or not a number."""
    return nodes.withColumn("label", F.coalesce(F.nanvl(F.col("raw_label"), F.lit(-1.0)), F.lit(-1.0)).cast("long")).drop("raw_label")


def ranked(df: DataFrame, order: str = "u", tie: str = "node_id", buckets: int = 256) -> DataFrame:
    """``rn``: the global row number by (order, tie), ``order`` being uniform in (0, 1).

    A window without partitions would put all rows into one task. Rows fall into buckets of the order column, bucket
    counts are summed up (one row a bucket), and each row's number is that of its bucket plus its place in it.
    """
    rows = df.withColumn("_b", F.least(F.floor(F.col(order) * buckets), F.lit(buckets - 1)))
    counts = rows.groupBy("_b").agg(F.count("*").alias("_c"))
    before = counts.alias("x").join(counts.alias("y"), F.col("y._b") < F.col("x._b"), "left").groupBy("x._b").agg(F.coalesce(F.sum("y._c"), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_b").orderBy(order, tie))
    return rows.withColumn("_p", place).join(F.broadcast(before), "_b").withColumn("rn", F.col("_before") + F.col("_p")).drop("_b", "_p", "_before")


def sorted_rank(df: DataFrame, *order: str) -> DataFrame:
    """``rank``: the global row number from 0 in the order of the columns. Rows are sorted by ranges; only a count a partition comes back."""
    rows = cut(df.orderBy(*order).select("*", F.monotonically_increasing_id().alias("_at")))
    part = F.shiftright("_at", 33)  # the id's upper bits are the partition, the lower ones the place in it
    sizes = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = rows.withColumn("part", part).join(F.broadcast(before), "part")  # a row a partition
    return out.withColumn("rank", F.col("before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("part", "n", "before", "_at")


def subsample_train(splits: DataFrame, frac: float, seed: int = 2021) -> DataFrame:
    """Exactly int(n frac) of the n train nodes, drawn without replacement; other splits as they are. From frac 1 on nothing changes."""
    if frac >= 1:
        return splits
    train = splits.where("split = 'train'").select("node_id", "split", hash_uniform(seed, "node_id").alias("u"))
    n = train.agg(F.floor(F.count("*") * F.lit(frac)).alias("keep"))
    kept = ranked(train).crossJoin(F.broadcast(n)).where("rn <= keep").select("node_id", "split")  # n is one row
    return splits.where("split <> 'train'").select("node_id", "split").unionByName(kept)


def directed_violations(edges: DataFrame) -> DataFrame:
    """Edges whose reverse is missing; none in an undirected graph."""
    back = edges.select(F.col("src").alias("dst"), F.col("dst").alias("src")).distinct()
    return edges.select("src", "dst").distinct().join(back, ["src", "dst"], "left_anti")


def degrees(edges: DataFrame, side: str = "src") -> DataFrame:
    """(node_id, deg): rows at each source, or columns at each target; a loop counts once."""
    return edges.groupBy(F.col(side).alias("node_id")).agg(F.count("*").alias("deg"))


def normalize_adj(edges: DataFrame, mode: str = "rw") -> DataFrame:
    """Weights 1/deg(src) (``rw``) or 1/sqrt(deg(src) deg(dst)) (``sym``); degrees are column sums, 0 counting as 1e-12."""
    base = edges.select("src", "dst")
    deg = degrees(base, "dst")
    floor = lambda c: F.greatest(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.lit(1e-12))
    out = base.join(deg.select(F.col("node_id").alias("src"), F.col("deg").alias("d_src")), "src", "left")
    if mode == "rw":
        return out.select("src", "dst", (1.0 / floor("d_src")).alias("weight"))
    if mode != "sym":
        raise ValueError(f"unknown normalisation: {mode}")
    out = out.join(deg.select(F.col("node_id").alias("dst"), F.col("deg").alias("d_dst")), "dst", "left")
    return out.select("src", "dst", (1.0 / F.sqrt(floor("d_src") * floor("d_dst"))).alias("weight"))


def isolated_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that are the source of no edge."""
    return nodes.select("node_id").join(edges.select(F.col("src").alias("node_id")), "node_id", "left_anti")


def val_test_partition(splits: DataFrame) -> DataFrame:
    """(node_id, in_val, in_test, overlap) of all validation and test nodes; overlap must be false everywhere."""
    rows = splits.where("split in ('val', 'test')").groupBy("node_id")
    out = rows.agg(F.max((F.col("split") == "val").cast("int")).alias("v"), F.max((F.col("split") == "test").cast("int")).alias("t"))
    return out.select("node_id", (F.col("v") == 1).alias("in_val"), (F.col("t") == 1).alias("in_test"), ((F.col("v") + F.col("t")) == 2).alias("overlap"))

"""Graphs from the given tables: customers and parts linked by large line items, suppliers and parts, users and event kinds, a ring.

Each table is a function of (spark, sf_dir) and has the same derivation as DuckDB SQL in ``CTES``, which the query checks use.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphbatch.functions.hashing import hash_uniform, sql_uniform
from graphbatch.operators import batches as B
from graphbatch.operators import prep

#: Parts are numbered after customers.
SHIFT = 1_000_000_000
#: The market segments in the order of their class.
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
QUANTITY, CLASSES, PER_BATCH, PARTS = 45, 10, 100, 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node_id, features, raw_label) of all customers and parts; every 17th has no label."""
    segment = F.array_position(F.array(*map(F.lit, SEGMENTS)), F.col("c_mktsegment")) - 1
    number = lambda c: F.col(c).cast("double")
    one, zero = F.lit(1.0), F.lit(0.0)
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("node_id"), F.array(number("c_acctbal") / 10000, number("c_nationkey") / 25, one, zero).alias("features"), segment.cast("double").alias("raw_label"))
    p = table(spark, sf_dir, "part").select((F.col("p_partkey") + SHIFT).cast("long").alias("node_id"), F.array(number("p_retailprice") / 2000, number("p_size") / 50, zero, one).alias("features"), (F.col("p_size") % 5 + 5).cast("double").alias("raw_label"))
    return c.union(p).withColumn("raw_label", F.when(F.col("node_id") % 17 != 0, F.col("raw_label")))


def raw_edges(spark: SparkSession, sf_dir: str, q: float = QUANTITY) -> DataFrame:
    """Directed edges from customers to the parts they bought at least ``q`` of; repeated as often as bought."""
    items = table(spark, sf_dir, "lineitem").where(F.col("l_quantity") >= q).select("l_orderkey", "l_partkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return items.join(orders, items.l_orderkey == orders.o_orderkey).select(F.col("o_custkey").cast("long").alias("src"), (F.col("l_partkey") + SHIFT).cast("long").alias("dst"))


def edges(spark: SparkSession, sf_dir: str, q: float = QUANTITY) -> DataFrame:
    """The standard graph: both directions, a loop at every node, no duplicates."""
    return prep.add_self_loops(prep.to_undirected(raw_edges(spark, sf_dir, q)), nodes(spark, sf_dir))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.clean_labels(nodes(spark, sf_dir))


def splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes with a label: train below 0.5 of the hash, val below 0.7, else test."""
    u = hash_uniform("split", "node_id")
    return labels(spark, sf_dir).where("label >= 0").select("node_id", F.when(u < 0.5, "train").when(u < 0.7, "val").otherwise("test").alias("split"))


def outputs(spark: SparkSession, sf_dir: str, split: str = "val") -> DataFrame:
    return splits(spark, sf_dir).where(F.col("split") == split).select("node_id")


def neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, node): the direct neighbours of the validation nodes."""
    return edges(spark, sf_dir).join(outputs(spark, sf_dir).withColumnRenamed("node_id", "src"), "src", "left_semi").select(F.col("src").alias("source"), F.col("dst").alias("node"))


def two_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, node, score): the chance to stand at a node two uniform steps after a validation node."""
    a = prep.normalize_adj(edges(spark, sf_dir), "rw")
    one = a.join(outputs(spark, sf_dir).withColumnRenamed("node_id", "src"), "src", "left_semi").select(F.col("src").alias("source"), F.col("dst").alias("src"), F.col("weight").alias("w"))
    return one.join(a, "src").groupBy("source", F.col("dst").alias("node")).agg(F.sum(F.col("w") * F.col("weight")).alias("score"))


def hash_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(spark, sf_dir).select("node_id", F.floor(hash_uniform("part", "node_id") * PARTS).cast("long").alias("part_id"))


def batch_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.random_fixed_batches(outputs(spark, sf_dir), neighbors(spark, sf_dir), PER_BATCH)


def supplier_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A skewed graph: few suppliers with many parts."""
    return table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") + SHIFT).cast("long").alias("src"), F.col("l_partkey").cast("long").alias("dst")).distinct()


def user_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A very skewed graph: every user joins five hubs."""
    kinds = F.dense_rank()
    from pyspark.sql import Window

    hubs = table(spark, sf_dir, "events").select("event_type").distinct().withColumn("k", kinds.over(Window.orderBy("event_type")))  # five rows
    return table(spark, sf_dir, "events").join(F.broadcast(hubs), "event_type").select(F.col("user_id").cast("long").alias("src"), (F.col("k") + SHIFT).cast("long").alias("dst")).distinct()


def hub_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(edges, outputs): users and hubs, both directions and loops; outputs are a fifth of the users, by hash."""
    raw = user_event(spark, sf_dir)
    both = prep.to_undirected(raw)
    users = raw.select(F.col("src").alias("node_id")).distinct()
    return prep.add_self_loops(both, both.select(F.col("src").alias("node_id")).distinct()), users.where(hash_uniform("hub-split", "node_id") < 0.2)


def ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges i to i+1, i+7 and i+31 around the vectors of the table; every degree is 7 once made undirected with loops."""
    ids = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("i"))
    n = ids.agg(F.count("*").alias("n"))
    return ids.crossJoin(F.broadcast(n)).select(F.col("i").alias("src"), F.explode(F.array(*(((F.col("i") + d) % F.col("n")) for d in (1, 7, 31)))).alias("dst"))  # n is one row


def weight_matrix(layer: int, name: str, rows: int, cols: int) -> np.ndarray:
    """Fixed layer weights: hash-uniform in (-1, 1), scaled by 1 / sqrt(rows). Never trained here."""
    u = lambda *k: (int(hashlib.md5("|".join(map(str, ("w", *k))).encode()).hexdigest()[:13], 16) + 0.5) / 2**52
    return np.array([[2 * u(layer, name, r, c) - 1 for c in range(cols)] for r in range(rows)]) / np.sqrt(rows)


_SEGMENT_LIST = "[" + ", ".join(f"'{s}'" for s in SEGMENTS) + "]"
CTES: dict[str, str] = {
    "nodes": f"""SELECT node_id, features, CASE WHEN node_id % 17 <> 0 THEN raw_label END AS raw_label FROM (
        SELECT c_custkey::BIGINT AS node_id, [c_acctbal::DOUBLE / 10000, c_nationkey::DOUBLE / 25, 1.0::DOUBLE, 0.0::DOUBLE] AS features, (list_position({_SEGMENT_LIST}, c_mktsegment) - 1)::DOUBLE AS raw_label FROM customer
        UNION ALL SELECT p_partkey::BIGINT + {SHIFT}, [p_retailprice::DOUBLE / 2000, p_size::DOUBLE / 50, 0.0::DOUBLE, 1.0::DOUBLE], (p_size % 5 + 5)::DOUBLE FROM part)""",
    "raw": f"SELECT o_custkey::BIGINT AS src, l_partkey::BIGINT + {SHIFT} AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity >= {QUANTITY}",
    "edges": "SELECT src, dst FROM raw UNION SELECT dst, src FROM raw UNION SELECT node_id, node_id FROM nodes",
    "labels": "SELECT node_id, features, coalesce(CASE WHEN isnan(raw_label) THEN -1 ELSE raw_label END, -1)::BIGINT AS label FROM nodes",
    "splits": f"SELECT node_id, CASE WHEN u < 0.5 THEN 'train' WHEN u < 0.7 THEN 'val' ELSE 'test' END AS split FROM (SELECT node_id, {sql_uniform('split', 'node_id')} AS u FROM labels WHERE label >= 0)",
    "outputs": "SELECT node_id FROM splits WHERE split = 'val'",
    "deg": "SELECT src AS node_id, count(*) AS deg FROM edges GROUP BY 1",
    "rw": "SELECT src, dst, 1.0::DOUBLE / deg AS weight FROM edges JOIN deg ON node_id = src",
    "sym": "SELECT src, dst, 1.0::DOUBLE / sqrt(a.deg::DOUBLE * b.deg) AS weight FROM edges JOIN deg a ON a.node_id = src JOIN deg b ON b.node_id = dst",
    "neighbors": "SELECT src AS source, dst AS node FROM edges WHERE src IN (SELECT node_id FROM outputs)",
    "ppr": "SELECT a.src AS source, b.dst AS node, sum(a.weight * b.weight) AS score FROM rw a JOIN rw b ON a.dst = b.src WHERE a.src IN (SELECT node_id FROM outputs) GROUP BY 1, 2",
    "parts": f"SELECT node_id, floor({sql_uniform('part', 'node_id')} * {PARTS})::BIGINT AS part_id FROM nodes",
    "groups": f"SELECT ((row_number() OVER (ORDER BY {sql_uniform(2021, 'node_id')}, node_id) - 1) // {PER_BATCH})::BIGINT AS group_id, node_id FROM outputs",
    "batch_nodes": """SELECT batch_id, node_id, max(o) = 1 AS is_output FROM (
        SELECT group_id AS batch_id, node AS node_id, 0 AS o FROM groups JOIN neighbors ON source = node_id UNION ALL SELECT group_id, node_id, 1 FROM groups) GROUP BY 1, 2""",
    "batch_edges": "SELECT a.batch_id, src, dst, weight FROM rw JOIN batch_nodes a ON a.node_id = src JOIN batch_nodes b ON b.node_id = dst AND b.batch_id = a.batch_id",
}


#: The graph of all line items.
WHOLE = {"raw": CTES["raw"].partition(" WHERE")[0]}


#: The graph of users and hubs.
HUBS = {
    "raw": f"SELECT DISTINCT user_id::BIGINT AS src, {SHIFT} + k AS dst FROM events JOIN (SELECT event_type, row_number() OVER (ORDER BY event_type) AS k FROM (SELECT DISTINCT event_type FROM events)) USING (event_type)",
    "edges": "SELECT src, dst FROM raw UNION SELECT dst, src FROM raw UNION SELECT src, src FROM raw UNION SELECT dst, dst FROM raw",
    "outputs": f"SELECT DISTINCT src AS node_id FROM raw WHERE {sql_uniform('hub-split', 'src')} < 0.2",
}


def with_ctes(select: str, **more: str) -> str:
    """A statement over the fixture tables it needs; ``more`` adds tables of its own, in order."""
    known, needed, texts = CTES | more, [], [select]
    while texts:
        text = texts.pop()
        for k in known:
            if k not in needed and re.search(rf"\b(?:FROM|JOIN)\s+{k}\b", text):
                needed.append(k)
                texts.append(known[k])
    return "WITH " + ",\n".join(f"{k} AS MATERIALIZED ({v})" for k, v in known.items() if k in needed) + "\n" + select if needed else select

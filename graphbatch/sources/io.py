"""Reading and writing graphs, scores, batches and metrics as Parquet."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LONG, DOUBLE, STRING, BOOL, INT = T.LongType(), T.DoubleType(), T.StringType(), T.BooleanType(), T.IntegerType()


def schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


NODES = schema(node_id=LONG, features=T.ArrayType(DOUBLE), raw_label=DOUBLE)
EDGES = schema(src=LONG, dst=LONG)
SPLITS = schema(node_id=LONG, split=STRING)
ADJ = schema(src=LONG, dst=LONG, weight=DOUBLE)
PPR = schema(source=LONG, node=LONG, score=DOUBLE, split=STRING)
BATCH_NODES = schema(batch_id=LONG, node_id=LONG, is_output=BOOL, method=STRING, split=STRING)
METRICS = schema(run_id=STRING, split=STRING, loader=STRING, metric=STRING, value=DOUBLE)


def read_graph(spark: SparkSession, nodes_path: str, edges_path: str, splits_path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and splits with fixed schemas."""
    read = lambda s, p: spark.read.schema(s).parquet(p)
    return read(NODES, nodes_path), read(EDGES, edges_path), read(SPLITS, splits_path)


def splits_from_masks(nodes: DataFrame) -> DataFrame:
    """(node_id, split) from the boolean columns train_mask, val_mask and test_mask, in one pass."""
    named = F.array(*(F.when(F.col(f"{s}_mask"), F.lit(s)) for s in ("train", "val", "test")))
    return nodes.select("node_id", F.explode(F.array_compact(named)).alias("split"))


def write_adjacency(adj: DataFrame, path: str, partitions: int | None = None) -> None:
    """Rows of one source stand together and sorted, so a read by source prunes row groups."""
    dealt = adj.repartition(partitions, "src") if partitions else adj.repartition("src")
    dealt.select("src", "dst", "weight").sortWithinPartitions("src", "dst").write.mode("overwrite").parquet(path)


def read_adjacency(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ADJ).parquet(path)


def write_ppr(ppr: DataFrame, path: str) -> None:
    """Scores in one folder per split."""
    ppr.select("source", "node", "score", "split").write.mode("overwrite").partitionBy("split").parquet(path)


def read_ppr(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    out = spark.read.schema(PPR).parquet(path)
    return out.where(F.col("split") == split) if split else out


def write_batches(batches: DataFrame, path: str) -> None:
    """Batches in one folder per method and split; rows of a batch stand together."""
    rows = batches.select("batch_id", "node_id", "is_output", "method", "split")
    rows.repartition("method", "split", "batch_id").sortWithinPartitions("batch_id", "node_id").write.mode("overwrite").partitionBy("method", "split").parquet(path)


def read_batches(spark: SparkSession, path: str, method: str | None = None, split: str | None = None) -> DataFrame:
    """Only the folders asked for are read."""
    out = spark.read.schema(BATCH_NODES).parquet(path)
    for name, value in (("method", method), ("split", split)):
        if value:
            out = out.where(F.col(name) == value)
    return out


def committed_run(spark: SparkSession, folder: str) -> str | None:
    """The run whose table under ``folder`` is whole: a writer names its run in ``commits`` only after all its rows are in place."""
    try:
        runs = spark.read.schema("run string").parquet(f"{folder}/commits").agg(F.min("run").alias("run")).first()
    except AnalysisException:  # nothing was ever committed
        return None
    return runs["run"]


def write_committed(df: DataFrame, folder: str) -> str:
    """Write a table as a run of its own and commit it; a writer that is ended before leaves rows that nobody reads."""
    run = uuid.uuid4().hex
    df.write.parquet(f"{folder}/run-{run}")
    df.sparkSession.createDataFrame([(run,)], "run string").coalesce(1).write.mode("append").parquet(f"{folder}/commits")
    return run


def cached_norms(spark: SparkSession, folder: str, key: dict[str, object], make: Callable[[], DataFrame]) -> DataFrame:
    """A table computed once per configuration: graph id, node count, roots, walk length and coverage make up the key.

    Only a committed table counts as made. Jobs that make it at the same time commit equal tables, and all later readers take the same one.
    """
    name = hashlib.md5("|".join(f"{k}={key[k]}" for k in sorted(key)).encode()).hexdigest()
    at = f"{folder}/norms-{name}"
    if committed_run(spark, at) is None:
        write_committed(make(), at)
    return spark.read.parquet(f"{at}/run-{committed_run(spark, at)}")


def append_metrics(metrics: DataFrame, path: str, key: str | None = None) -> None:
    """Add rows to a table. Rows appended under one ``key`` (a job's run, say) replace those appended under it before, so a repeated job counts once."""
    metrics.select(*METRICS.fieldNames()).write.mode("overwrite").parquet(f"{path}/append={hashlib.md5(key.encode()).hexdigest() if key else uuid.uuid4().hex}")


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METRICS).parquet(path).select(*METRICS.fieldNames())

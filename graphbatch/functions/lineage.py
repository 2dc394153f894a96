"""Cutting the lineage of iterative jobs, in the shared folder that the cluster names."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only where none is set (local runs, tests)."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='spark-ckpt-')}"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors, and the plan starts anew."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


@contextlib.contextmanager
def _brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written meanwhile go at its end, and not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def cut_and_observe(df: DataFrame, label: str, **metrics: Column) -> tuple[DataFrame, dict]:
    """A written table of the rows, and aggregates over them that the writing itself yields: one job for both."""
    path, told = write_observed(df, label, None, **metrics)
    return df.sparkSession.read.schema(df.schema).parquet(path), told


def write_observed(df: DataFrame, label: str, by: list[str] | None, **metrics: Column) -> tuple[str, dict]:
    """(folder, aggregates): as ``cut_and_observe``, with a folder a value of the columns ``by``."""
    told, path = Observation(), scratch_path(df.sparkSession, label)
    with _brief_shuffles(df.sparkSession):
        df.observe(told, *(c.alias(name) for name, c in metrics.items())).write.parquet(path, partitionBy=by)
    return path, told.get


def write_out(df: DataFrame, label: str) -> DataFrame:
    """A written table of the rows."""
    path = scratch_path(df.sparkSession, label)
    with _brief_shuffles(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(spark: SparkSession, tables: list[DataFrame]) -> None:
    """Deletes the files of written tables that nothing reads any more, so that a loop holds no more than its last state."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for t in tables for f in t.inputFiles()}:
        at = jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(conf).delete(at, True)


def write_bucketed(df: DataFrame, label: str, column: str | list[str], shuffle: bool = True) -> DataFrame:
    """A written table bucketed by one or more columns: joins and groupings by them don't shuffle its rows again. The catalog keeps no entry.

    Without ``shuffle`` each task writes its rows into files of its own, for few and large rows.
    """
    spark, name = df.sparkSession, f"{label}_{uuid.uuid4().hex}"
    n, by = int(spark.conf.get("spark.sql.shuffle.partitions")), [column] if isinstance(column, str) else column
    (df.repartition(n, *by) if shuffle else df).write.bucketBy(n, *by).option("path", scratch_path(spark, label)).saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # an external table: the files stay, and the frame knows them
    return out

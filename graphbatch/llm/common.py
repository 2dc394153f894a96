"""What the text operators share: table access, the word pattern, scratch folders and bounded samples."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as a regular-expression class body; a word is a run of anything else.
SPACE_CLASS = r"\x20\x09-\x0D"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only where none is set (tests, local mode)."""
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
    """A new path in the shared folder; every executor and the driver can reach it."""
    return f"{ensure_checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder and cut the lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def write_and_reread(df: DataFrame, label: str) -> DataFrame:
    """Materialise as Parquet in the shared folder; unlike a checkpoint it keeps statistics and column pruning."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words_of(text: Column) -> Column:
    """Array of the words of a text; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE_CLASS}]+"), "")


def slices(batches, rows: int = 256):
    """Arrow batches in smaller pieces, so that what a task derives from whole texts stays small."""
    for b in batches:
        for k in range(0, len(b), rows):
            yield b.iloc[k : k + rows]


def bounded_sample(df: DataFrame, key: Column, limit: int) -> DataFrame:
    """At most ``limit`` rows, the same ones on every run: those whose key hashes lowest."""
    return df.orderBy(F.xxhash64(key), key).limit(limit)

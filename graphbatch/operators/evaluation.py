"""Accuracy, F1, metric summaries and per-epoch figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def accuracy(pred: DataFrame, labels: DataFrame, splits: DataFrame, batches: DataFrame | None = None) -> DataFrame:
    """(split, loader, accuracy, n[, n_batches]) from pred (loader, node_id, pred); ``batches`` is (loader, batch_id, node_id)."""
    rows = pred.join(labels.select("node_id", "label"), "node_id").join(splits, "node_id")
    out = rows.groupBy("split", "loader").agg(F.avg((F.col("pred") == F.col("label")).cast("double")).alias("accuracy"), F.count("*").alias("n"))
    if batches is None:
        return out
    used = batches.join(splits, "node_id").groupBy("split", "loader").agg(F.countDistinct("batch_id").alias("n_batches"))
    return out.join(used, ["split", "loader"], "left")


def macro_f1(pred: DataFrame, labels: DataFrame, splits: DataFrame) -> DataFrame:
    """(split, loader, f1): the plain mean of the F1 of each class seen in truth or prediction; a class without a hit has 0."""
    rows = pred.join(labels.select("node_id", "label"), "node_id").join(splits, "node_id")
    keys = ["split", "loader", "class"]
    # One aggregation of (class, role) rows: true positives, predicted and true members.
    roles = rows.select("split", "loader", F.explode(F.array(F.struct(F.col("pred").alias("class"), F.lit(1).alias("p"), F.lit(0).alias("t"), (F.col("pred") == F.col("label")).cast("int").alias("h")), F.struct(F.col("label").alias("class"), F.lit(0).alias("p"), F.lit(1).alias("t"), F.lit(0).alias("h")))).alias("r")).select("split", "loader", "r.*")
    per = roles.groupBy(*keys).agg(F.sum("p").alias("p"), F.sum("t").alias("t"), F.sum("h").alias("h"))
    return per.groupBy("split", "loader").agg(F.avg(2 * F.col("h") / (F.col("p") + F.col("t"))).alias("f1"))


def metric_summary(metrics: DataFrame) -> DataFrame:
    """(split, loader, metric, mean, std) over runs, with the population deviation; values that are null count as none, and none gives 0, 0."""
    out = metrics.groupBy("split", "loader", "metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    return out.select("split", "loader", "metric", F.coalesce("mean", F.lit(0.0)).alias("mean"), F.coalesce("std", F.lit(0.0)).alias("std"))


def epoch_loss_accuracy(batch_metrics: DataFrame) -> DataFrame:
    """(epoch, phase, loss, accuracy) from batch rows (epoch, phase, loss, n, n_right): batch losses weighted by size."""
    n = F.sum("n")
    return batch_metrics.groupBy("epoch", "phase").agg((F.sum(F.col("loss") * F.col("n")) / n).alias("loss"), (F.sum("n_right") / n).alias("accuracy"))

"""Connected components of an edge table as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphbatch.llm.common import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in (a, b): the smallest id that can be reached.

    Each round every id takes the smallest label among itself and its neighbours, then the label of that label; the second step
    halves long chains. Lineage is cut every round. Rounds grow with the logarithm of the longest path.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v")
    both = cut(both.union(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = cut(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("id"), F.least("u", "m").alias("component")))
    while True:
        near = both.join(labels.withColumnRenamed("id", "v"), "v").groupBy("u").agg(F.min("component").alias("m"))
        step = labels.join(near.withColumnRenamed("u", "id"), "id").select("id", F.col("component").alias("old"), F.least("component", "m").alias("component"))
        jump = step.select(F.col("id").alias("component"), F.col("component").alias("root"))
        new = cut(step.join(jump, "component").select("id", "old", F.col("root").alias("component")))
        if new.where("old <> component").isEmpty():
            return new.select("id", "component")
        labels = new.select("id", "component")

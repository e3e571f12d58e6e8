"""Connected components of an edge table, by label propagation with pointer jumping.

Edges and labels stay distributed; each round is two joins and an aggregation over
rows of two integers. A round's labels are cut off from the last by a checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import durable


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of each node of the edges (a, b); a component is named by its least node."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = durable(both)
    labels = durable(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("component")).withColumnRenamed("a", "node"))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("component").alias("near"))
        own = labels.withColumnRenamed("node", "a").join(near, "a").select(F.col("a").alias("node"), F.col("component").alias("old"), F.least("component", "near").alias("step"))
        jump = labels.select(F.col("node").alias("step"), F.col("component").alias("jumped"))
        moved = durable(own.join(jump, "step").select("node", "old", F.least("step", "jumped").alias("component")))
        labels = moved.select("node", "component")
        if moved.where("component <> old").isEmpty():
            return labels

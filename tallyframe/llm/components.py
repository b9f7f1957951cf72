"""Connected components by minimum labels with pointer jumping, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for all ends of edges(a, b); a component is named by its least node.

    Each round takes the least label among neighbours, then follows labels of labels, so chains shrink at
    least by half; rounds are written to the shared folder. Self-loops keep a lone node.
    """
    edges = edges.filter("a is not null and b is not null").select("a", "b")
    both = written(edges.union(edges.select("b", "a")).distinct().toDF("a", "b"), "edges")
    labels = written(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("component")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("component").alias("near"))
        lower = labels.join(near.withColumnRenamed("a", "node"), "node", "left")
        lower = lower.select("node", F.least("component", F.coalesce("near", "component")).alias("next"), "component")
        jump = labels.select(F.col("node").alias("next"), F.col("component").alias("far"))
        jumped = lower.join(jump, "next", "left")
        new = written(jumped.select("node", F.least("next", F.coalesce("far", "next")).alias("component"), (F.least("next", F.coalesce("far", "next")) != F.col("component")).alias("moved")), "labels")
        labels = new.select("node", "component")
        if new.filter("moved").isEmpty():
            return labels

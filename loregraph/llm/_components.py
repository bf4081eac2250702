"""Connected components by minimum labels with pointer jumping, on tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from loregraph.llm._scratch import stage


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``edges`` (a, b); comp is the least node of its component.

    Each round takes the least label among neighbours and then the label of the
    label, so the number of rounds grows with the logarithm of the longest path.
    Labels are written after each round; the count of changes is observed on the way, without jobs of its own.
    """
    both = stage(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("comp")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("least"))
        moved = labels.join(near, "node").select("node", F.col("comp").alias("was"), F.least("comp", "least").alias("comp"))
        parent = labels.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
        moved, seen = moved.join(parent, "comp", "left").select("node", "was", F.least("comp", F.coalesce("up", "comp")).alias("comp")), Observation()
        labels = stage(moved.observe(seen, F.count_if(F.col("was") != F.col("comp")).alias("moved")).select("node", "comp"), "labels")
        if not seen.get["moved"]:
            return labels

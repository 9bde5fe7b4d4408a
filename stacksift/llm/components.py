"""Connected components of large edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stacksift.llm.common import forget, materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for the nodes of edges (a, b): label is the least node of the component.

    Each round, a node takes the least label around it and then its label's label, so chains halve.
    Rounds are cut by written tables; both sides of a join are read from tables, so that adaptive
    execution can split the partition of a node with very many edges. Nothing comes to the driver.
    """
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("label")), "labels")
    while True:
        around = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("seen"))
        near = materialize(labels.select("node", "label").join(around, "node").select("node", F.least("label", "seen").alias("next"), F.col("label").alias("was")), "near")
        jump = near.select(F.col("node").alias("next"), F.col("next").alias("further"))
        moved = materialize(near.join(jump, "next").select("node", F.col("further").alias("label"), (F.col("further") != F.col("was")).alias("moved")), "labels")
        forget(labels, near)
        labels = moved
        if moved.where("moved").isEmpty():
            forget(both)
            labels = materialize(moved.select("node", "label"), "components")
            forget(moved)
            return labels

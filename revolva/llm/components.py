"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revolva.llm.session import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); the component is its smallest node.

    Each round takes the smallest label among the neighbours and then the label of
    that label, so that paths shrink by half. Only minima are aggregated: a node with
    many neighbours is combined before each shuffle. Nulls and loops are ignored.
    """
    edges = edges.select("a", "b").where("a <> b")
    both = stored(edges.union(edges.select("b", "a")).distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), "node").alias("component")), "labels")
    while True:
        near = (
            both.join(labels, F.col("b") == F.col("node"))
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("component").alias("near"))
        )
        hooked = labels.join(near, "node").select(
            "node", F.col("component").alias("old"), F.least("component", "near").alias("new")
        )
        jump = labels.select(F.col("node").alias("new"), F.col("component").alias("further"))
        moved = stored(
            hooked.join(jump, "new").select("node", "old", F.least("new", "further").alias("component")), "labels"
        )
        labels = moved.select("node", "component")
        if moved.where("old <> component").isEmpty():
            return labels

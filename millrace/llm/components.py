"""Connected components by joins: labels spread along edges and jump to their own label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import discard, stage


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of undirected ``edges`` (a, b); label is the smallest node of its component.

    Each round takes the smallest label among a node and its neighbours and then the
    label of that label, so chains shorten by half or more; rounds end when no label
    changes. Every round is staged; nothing is collected but the count of changes.
    """
    both = stage(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = stage(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        moved = labels.join(near, labels["node"] == near["a"]).select("node", "label", F.least("label", "near").alias("next"))
        target = labels.select(F.col("node").alias("at"), F.col("label").alias("beyond"))
        jumped = moved.join(target, moved["next"] == target["at"]).select("node", F.least("next", "beyond").alias("label"), (F.least("next", "beyond") != F.col("label")).alias("changed"))
        after = stage(jumped, "labels")
        discard(labels)
        labels = after
        if labels.filter("changed").isEmpty():
            discard(both)
            return labels.select("node", "label")

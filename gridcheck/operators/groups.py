"""Connected groups of nodes, with joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridcheck.storage import dropped, written


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``label`` (the smallest node reachable) of every linked node.

    Each turn, every node takes the smallest label among its own, its
    neighbours' and that of its label (so paths halve), until none changes.
    Labels are written to the shared folder after each turn.
    """
    both = written(links.select(F.col(a).alias("node"), F.col(b).alias("other")).union(links.select(F.col(b).alias("node"), F.col(a).alias("other"))).filter("node <> other").distinct(), "links")
    labels = written(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("near"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        best = F.least("label", "near", "far")
        turned = written(labels.join(near, "node").join(jump, "label", "left").select("node", best.alias("label"), (best < F.col("label")).alias("moved")), "labels")
        moved = turned.filter("moved").limit(1).count()
        dropped(labels)
        labels = turned.select("node", "label")
        if not moved:
            dropped(both)
            return labels

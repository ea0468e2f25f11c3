"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import drop, written


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the smallest node that can be reached) for every node of an edge.

    Each round takes the smallest label among a node's neighbours, then jumps to the label's own label, so paths shrink by
    halves; labels are written to the shared folder every round. Minima are pre-aggregated and joins are plain equi-joins,
    so a node with very many neighbours is no bottleneck. Edges with a null end are ignored, loops and repeats are harmless.
    """
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("near")).where("node IS NOT NULL AND near IS NOT NULL AND node <> near")
    both = written(both.union(both.select(F.col("near").alias("node"), F.col("node").alias("near"))).distinct(), "edges")
    labels = written(both.groupBy("node").agg(F.least(F.col("node"), F.min("near")).alias("component")), "labels")
    while True:
        seen = both.join(labels.withColumnRenamed("node", "near"), "near").groupBy("node").agg(F.min("component").alias("best"))
        lower = labels.join(seen, "node").select("node", F.col("component").alias("old"), F.least("component", "best").alias("component"))
        lower = written(lower, "labels")
        jump = lower.select(F.col("node").alias("component"), F.col("component").alias("further"))
        after = written(lower.join(jump, "component", "left").select("node", "old", F.coalesce("further", "component").alias("component")), "labels")
        drop(labels, lower)
        labels = after
        if labels.where("component <> old").isEmpty():
            break
    drop(both)
    return labels.select("node", "component")

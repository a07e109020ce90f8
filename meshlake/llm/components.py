"""Connected components of an edge table, without collecting edges anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, free_shuffles, materialise


def component_labels(edges: DataFrame) -> DataFrame:
    """(node, label) for each node of ``edges`` (a, b); the label is the least node reachable.

    Each round takes the least label among neighbours and then the label of that
    label, so distances halve; it stops when no label changes, which a finite table
    always reaches, as labels only fall. Minima are partially aggregated, so a hub is
    no single task's burden. A round's table goes when the next one is written.
    """
    both = materialise(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "labels")
    while True:
        seen = both.join(labels, both.b == labels.node).groupBy(both.a.alias("node")).agg(F.min("label").alias("near"))
        near = labels.join(seen, "node").select("node", "label", F.least("label", "near").alias("near"))
        jump = labels.select(F.col("node").alias("near"), F.col("label").alias("far"))
        moved = materialise(near.join(jump, "near").select("node", F.col("label").alias("old"), F.least("near", "far").alias("label")), "labels")
        discard(labels)
        free_shuffles(edges.sparkSession)
        settled = moved.where("old <> label").isEmpty()
        labels = moved.select("node", "label")
        labels.written_to = moved.written_to
        if settled:
            discard(both)
            return labels

"""Connected components by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcel.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b), each link once or more. Returns node, label: the smallest node of its
    component. Each round takes the least label among the neighbours, then the label of that
    label, so long chains shrink by halves. Nothing is collected but a count; a hub's links are
    pre-aggregated before they meet."""
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
    both = cut(both.where("a <> b").distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select(
        "node", F.least("node", "m").alias("label")))
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(
            F.min("label").alias("near"))
        step = labels.join(near, F.col("node") == F.col("a")).select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("n2"), F.col("label").alias("l2"))
        step = cut(step.join(jump, F.col("label") == F.col("n2"), "left").select(
            "node", "old", F.least("label", F.coalesce("l2", "label")).alias("label")))
        moved = step.where("old <> label").limit(1).count()
        labels = step.select("node", "label")
        if not moved:
            return labels

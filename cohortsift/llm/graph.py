"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortsift.llm.shared import stored


def components(links: DataFrame) -> DataFrame:
    """node and label of every node of ``links`` (columns a, b); nodes have the same label if links join them.

    Each round a node takes the smallest label among its neighbours, then the label of its
    label, so chains shorten by half; rounds are written to the shared folder.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = stored(both.where(F.col("a") != F.col("b")).distinct(), "links")
    labels = stored(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        stepped = labels.join(near, labels.node == near.a).select("node", "label", F.least("label", "near").alias("least"))
        jump = labels.select(F.col("node").alias("least"), F.col("label").alias("far"))
        jumped = stepped.join(jump, "least", "left").select(
            "node", F.least("least", "far").alias("label"), (F.least("least", "far") < F.col("label")).alias("changed")
        )
        new = stored(jumped, "labels")
        labels = new.select("node", "label")
        if not new.where("changed").limit(1).count():
            return labels

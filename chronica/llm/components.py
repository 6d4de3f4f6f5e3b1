"""Connected components of a table of links, by repeated joins over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronica import session


def label(links: DataFrame) -> DataFrame:
    """node and label, the smallest node of its component, for all nodes of links (a, b).

    Each round takes the smallest label among a node's neighbours and then the label
    of that label, so paths shrink by half and groups around a hub end in a round or
    two. Rounds are written to the shared folder; the loop ends when none changes.
    """
    ends = links.select("a", "b").union(links.select("b", "a"))
    ends = session.materialised(ends, "links")
    labels = session.materialised(ends.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = ends.join(labels, ends["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels["node"] == near["a"]).select("node", F.least("label", "near").alias("next"), "label")
        far = step.select(F.col("node").alias("via"), F.col("next").alias("beyond"))
        moved = step.join(far, step["next"] == far["via"]).select("node", F.col("beyond").alias("label"), F.col("label").alias("old"))
        moved = session.materialised(moved, "labels")
        labels = moved.select("node", "label")
        if not moved.where("label != old").limit(1).count():
            return labels

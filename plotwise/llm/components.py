"""Connected components of an edge table, without links or labels on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of `edges` (a, b); comp is the least node of the component.

    Least labels flow over the edges and labels then jump to their own label, so the rounds grow with the logarithm of the
    longest path. Every round is one pre-aggregated exchange; its labels are written to the shared folder. No edges: no rows.
    """
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).select("node", F.least("node", "label").alias("label")), "labels")
    while True:
        heard = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("heard"))
        flowed = labels.join(heard, labels.node == heard.a).select("node", F.col("label").alias("old"), F.least("label", "heard").alias("label"))
        far = labels.select(F.col("node").alias("via"), F.col("label").alias("far"))
        jumped = flowed.join(far, flowed.label == far.via).select("node", "old", F.least("label", "far").alias("label"))
        labels = stored(jumped, "labels")
        if labels.where("label <> old").isEmpty():
            return labels.select("node", F.col("label").alias("comp"))
        labels = labels.drop("old")

"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchloom.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """Smallest reachable node of every node of ``links`` (a, b): node, label.

    Each round takes the least label of the neighbours and then the label's own
    label, so the number of rounds follows the logarithm of a chain's length.
    Minima are combined before the shuffle; a node with very many links is
    split by the join. Rounds are written, so no round is computed twice.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = stored(both.where(F.col("a") != F.col("b")).distinct(), "links")
    labels = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label"))
    labels = stored(labels.select("node", F.least("node", "label").alias("label")), "labels")
    while True:
        near = edges.join(labels, edges["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("old"), F.least("label", "near").alias("mid"))
        far = labels.select(F.col("node").alias("mid"), F.col("label").alias("far"))
        new = stored(
            lower.join(far, "mid").select("node", F.least("mid", "far").alias("label"), (F.least("mid", "far") != F.col("old")).alias("moved")),
            "labels",
        )
        labels = new.select("node", "label")
        if new.where("moved").isEmpty():
            return labels

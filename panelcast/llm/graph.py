"""Connected components by repeated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import stored
from panelcast.session import discard


def components(edges: DataFrame) -> DataFrame:
    """node and label, the smallest node it is connected with, for every node of the edges a, b (longs).

    Each round takes the least label among a node's neighbours, then the label of that label, so long
    chains shrink by halves. A node with very many edges is combined on the map side in the
    aggregate, and is a skewed join that adaptive execution splits. Rounds are stored tables, each deleted after the next.
    """
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("label")), "labels")
    last = labels
    while True:
        near = (
            both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        )
        nearer = labels.join(near, "node").select("node", F.col("label").alias("before"), F.least("label", "near").alias("label"))
        above = labels.select(F.col("node").alias("label"), F.col("label").alias("above"))
        now = stored(nearer.join(above, "label", "left").select("node", "before", F.least("label", "above").alias("label")), "labels")
        discard(last)
        labels, last = now.select("node", "label"), now
        if now.filter("label < before").isEmpty():
            discard(both)
            return labels

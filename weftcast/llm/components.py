"""Connected components of edges that stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """node, label: the least node of each node's component. edges: a, b (long). Every round a node takes the least label of its neighbours and then that label's own label, so paths shorten by more than half; each round is written to the shared folder, and only the number of changes reaches the driver. Rows of a hub are summed where they are before they move."""
    both = stored(edges.select("a", "b").where("a <> b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b")).distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    for _ in range(most_rounds):
        near = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        next_ = labels.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        own = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        next_ = stored(next_.join(own, "label", "left").select("node", F.least("label", F.coalesce("further", "label")).alias("label"), "old"), "labels")
        dropped(labels)
        labels = next_.select("node", "label")
        labels._stored_at = next_._stored_at
        if not next_.where("label <> old").limit(1).count():
            break
    else:
        raise RuntimeError(f"components didn't settle in {most_rounds} rounds")
    dropped(both)
    return labels

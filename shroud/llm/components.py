"""Connected components of an edge table by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shroud.llm.common import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of each node's component, for every node of ``edges`` (a, b).

    Each round takes the least label among a node's neighbours and then the label
    of that label, so long chains shrink by halves. Tables of every round go to
    the shared folder; nothing but one count comes to the driver.
    """
    both = materialize(
        edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct(), "edges")
    labels = materialize(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
        .select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        stepped = materialize(
            labels.join(near, labels.node == near.a)
            .select("node", F.col("label").alias("was"), F.least("label", "near").alias("label")), "labels")
        up = stepped.select(F.col("node").alias("up"), F.col("label").alias("up_label"))
        jumped = materialize(
            stepped.join(up, stepped.label == up.up).select("node", "was", F.least("label", "up_label").alias("label")),
            "labels")
        labels = jumped.select("node", "label")
        if jumped.filter("was <> label").limit(1).count() == 0:
            return labels

"""Connected components over an edge table, by label propagation with jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, label)`` for every node of ``edges(a long, b long)``.

    The label is the component's smallest node. Each round every node takes
    the smallest label among its neighbours, then the label of its label, so
    long chains halve. Minima are combined before they are shuffled, and the
    label table is rewritten each round, so no lineage grows. Labels only fall, so it ends. Self-loops are
    allowed; an empty table gives an empty result.
    """
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "cc-edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")), "cc-labels")
    while True:
        heard = both.join(labels, both.a == labels.node).groupBy(F.col("b").alias("node")).agg(F.min("label").alias("heard"))
        nearer = materialize(
            labels.join(heard, "node").select("node", F.least("label", "heard").alias("label"), F.col("label").alias("old")), "cc-heard"
        )
        owner = nearer.select(F.col("node").alias("owner"), F.col("label").alias("owner_label"))
        stepped = materialize(
            nearer.join(owner, nearer.label == owner.owner).select("node", F.least("label", "owner_label").alias("label"), "old"), "cc-labels"
        )
        labels = stepped.select("node", "label")
        if stepped.filter("label <> old").isEmpty():
            return labels

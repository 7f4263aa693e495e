"""Connected components of an edge table by minimum labels and label jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.sources.tables import materialize


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b); label is the least node of the component.

    Each round takes the least label of all neighbours and then the label of that
    label, so labels travel exponentially; every round is written to the shared
    folder.  Joins are of two written tables, which Catalyst may split by skew, and
    minima are partial before the shuffle, so a node with very many edges is no
    bottleneck.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialize(both, "cc-edges")
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "cc-labels")
    for i in range(max_rounds):
        seen = both.join(labels.select(F.col("node").alias("b"), "label"), "b").select(F.col("a").alias("node"), "label")
        low = materialize(seen.unionByName(labels).groupBy("node").agg(F.min("label").alias("label")), f"cc-low{i}")
        jump = low.select(F.col("node").alias("label"), F.col("label").alias("up"))
        nxt = low.join(jump, "label", "left").select("node", F.least("label", F.coalesce("up", "label")).alias("label"))
        nxt = materialize(nxt, f"cc-labels{i}")
        changed = nxt.join(labels.withColumnRenamed("label", "old"), "node").where("label <> old").limit(1).count()
        labels = nxt
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")

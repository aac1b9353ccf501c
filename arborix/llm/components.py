"""Connected components of an edge table, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborix.llm.common import discard, materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (long columns a, b); a component is named by its smallest node.

    Each round takes the smallest label of the neighbours, then the label's own label, so long chains halve. No
    neighbour list is collected: both steps are equi-joins against one row per node, and minima with partial sums.
    Every round is stored, and what it was made from deleted.
    """
    apart = edges.where("a <> b")
    both = materialize(apart.select("a", "b").unionByName(apart.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("to"))
        top = labels.select(F.col("node").alias("to"), F.col("component").alias("top"))
        moved = materialize(lower.join(top, "to", "left").select("node", "was", F.least("to", F.coalesce("top", "to")).alias("component")))
        discard(labels)
        if not moved.where("component <> was").limit(1).count():
            discard(both)
            return moved.select("node", "component")
        labels = moved

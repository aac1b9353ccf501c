"""Lines of nodes up to the root by pointer doubling: as many rounds as the depth has binary digits, whatever the depth is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborix.sources.tables import stored


def lines(nodes: DataFrame, starts: DataFrame) -> DataFrame:
    """(doc_pk, start, node_pk, distance): each start with itself and all nodes above it.

    ``nodes`` has doc_pk, node_pk and parent_pk (null: a root), ``starts`` doc_pk and node_pk, without repeats. Round k
    knows each node's ancestor 2^k levels up, adds it to all that was found so far, and doubles the pointers by one
    equi-join of the table with itself; rounds end when no node has an ancestor so far up. A parent that is missing still
    ends the line. Nodes that a circle holds get each node of it once, with the least distance. The result has a row for
    each level of each start; joins are on (doc_pk, node), where a node above most starts is a large key that Spark's
    skew join may split, as nothing is gathered by it.
    """
    links = stored(nodes.where("parent_pk is not null").select("doc_pk", F.col("node_pk").alias("_at"), F.col("parent_pk").alias("_above")))
    longest = links.groupBy("doc_pk").count().agg(F.max("count")).first()[0] or 0
    found = starts.select("doc_pk", F.col("node_pk").alias("start"), "node_pk", F.lit(0).cast("long").alias("distance"))
    step, circles = 1, False
    while longest:
        up = found.withColumnRenamed("node_pk", "_at").join(links, ["doc_pk", "_at"]).select("doc_pk", "start", F.col("_above").alias("node_pk"), (F.col("distance") + step).alias("distance"))
        found = stored(found.unionByName(up))
        step *= 2
        circles = step > 2 * longest  # no line without a circle is that long
        if circles:
            break
        above = links.select("doc_pk", F.col("_at").alias("_above"), F.col("_above").alias("_next"))
        links = stored(links.join(above, ["doc_pk", "_above"]).select("doc_pk", "_at", F.col("_next").alias("_above")))
        if links.isEmpty():
            break
    return found.groupBy("doc_pk", "start", "node_pk").agg(F.min("distance").alias("distance")) if circles else found


def rooted(nodes: DataFrame) -> DataFrame:
    """(doc_pk, start, depth) of the nodes that a root leads to; those above a missing parent or in a circle are left out."""
    roots = nodes.where("parent_pk is null").select("doc_pk", "node_pk")
    return lines(nodes, nodes.select("doc_pk", "node_pk").distinct()).join(roots, ["doc_pk", "node_pk"], "left_semi").groupBy("doc_pk", "start").agg(F.max("distance").alias("depth"))

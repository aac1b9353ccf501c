"""Whether section forests are whole and large enough to be searched."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborix.operators.ancestors import rooted


def report(nodes: DataFrame, *, least_nodes: int = 10, least_leaves: int = 3) -> DataFrame:
    """Per doc_pk: nodes, roots, orphans, leaves, leaves_with_text, status.

    ``nodes`` has doc_pk, node_pk, parent_pk (null: a root) and node_text. A forest without a root or with a node whose
    parent is missing is an ``error``; one with fewer nodes, or leaves with text, than asked for is ``degraded``.
    """
    inner = nodes.where("parent_pk is not null").select("doc_pk", F.col("parent_pk").alias("node_pk")).distinct().withColumn("_inner", F.lit(True))
    known = nodes.select("doc_pk", F.col("node_pk").alias("parent_pk")).distinct().withColumn("_known", F.lit(True))
    met = nodes.join(inner, ["doc_pk", "node_pk"], "left").join(known, ["doc_pk", "parent_pk"], "left")
    leaf = F.col("_inner").isNull()
    text = F.regexp_replace(F.coalesce("node_text", F.lit("")), r"(?U)\s", "") != ""
    counted = met.groupBy("doc_pk").agg(
        F.count(F.lit(1)).alias("nodes"),
        F.count_if(F.col("parent_pk").isNull()).alias("roots"),
        F.count_if(F.col("parent_pk").isNotNull() & F.col("_known").isNull()).alias("orphans"),
        F.count_if(leaf).alias("leaves"),
        F.count_if(leaf & text).alias("leaves_with_text"),
    )
    large = (F.col("nodes") >= least_nodes) & (F.col("leaves_with_text") >= least_leaves)
    return counted.withColumn("status", F.when((F.col("roots") == 0) | (F.col("orphans") > 0), "error").when(large, "ok").otherwise("degraded"))


def whole(nodes: DataFrame) -> DataFrame:
    """``nodes``, after a pass that refuses forests without a root or with missing parents."""
    broken = report(nodes).where("status = 'error'").select("doc_pk").limit(5).collect()
    if broken:
        raise ValueError(f"broken forests: {[r['doc_pk'] for r in broken]}")
    return nodes


def reachable(nodes: DataFrame) -> DataFrame:
    """``nodes`` without those that no root leads to, with their ``depth``: a lenient scan, to look at broken forests, by pointer doubling."""
    return nodes.join(rooted(nodes).withColumnRenamed("start", "node_pk"), ["doc_pk", "node_pk"]).select(*nodes.columns, "depth")


def differences(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows that one of two tables has and the other has not, repeats counted, with the side they are on; none after a round trip."""
    second = second.select(*first.columns)
    return first.exceptAll(second).withColumn("side", F.lit("first")).unionByName(second.exceptAll(first).withColumn("side", F.lit("second")))

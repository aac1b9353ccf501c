"""Section forests from contents tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def parents(toc: DataFrame) -> DataFrame:
    """Adds parent_ord: the last earlier entry of the document whose structure is this one's without its last part; else null.

    An equi-join on document and structure, so only entries that can be parents meet.
    """
    prefix = F.nullif(F.regexp_replace("structure", r"\.?[^.]*$", ""), F.lit(""))
    child = toc.withColumn("_prefix", prefix)
    parent = toc.select("doc_pk", F.col("structure").alias("_prefix"), F.col("ord").alias("_ord"))
    met = child.join(parent, ["doc_pk", "_prefix"], "left")
    return met.groupBy("doc_pk", "ord", "structure").agg(F.max(F.when(F.col("_ord") < F.col("ord"), F.col("_ord"))).alias("parent_ord"))


def texts(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """Each node's pages joined by line feeds; ranges become page numbers first, so that the join is on equal keys."""
    wanted = nodes.select("doc_pk", "ord", F.explode(F.sequence("start_index", "end_index")).alias("page_no"))
    met = wanted.join(pages, ["doc_pk", "page_no"]).groupBy("doc_pk", "ord").agg(F.array_sort(F.collect_list(F.struct("page_no", "text"))).alias("p"))
    return met.select("doc_pk", "ord", F.array_join(F.col("p.text"), "\n").alias("node_text"))


def padded(number: Column) -> Column:
    """A number as text of four digits at least; longer ones stay whole."""
    text = number.cast("string")
    return F.lpad(text, F.greatest(F.lit(4), F.length(text)), F.lit("0"))


def paths(nodes: DataFrame, step: Column | None = None, separator: str = ".") -> DataFrame:
    """Adds path: ``step`` (by default nine digits) of a node after that of each one above it; by default in depth-first order within a document.

    ``nodes`` has doc_pk, ord, structure and parent_ord. A parent's structure is one part shorter than its child's, so
    paths grow by one equi-join for each part of the longest structure; only their number comes to the driver.
    """
    step = F.lpad((F.col("ord") + 1).cast("string"), 9, "0") if step is None else step
    parts = F.size(F.split("structure", r"\."))
    depth = nodes.agg(F.max(parts)).first()[0] or 0
    level = nodes.where(parts == 1).withColumn("path", step)
    done = level
    for n in range(2, depth + 1):
        above = level.select("doc_pk", F.col("ord").alias("parent_ord"), F.col("path").alias("_above"))
        level = nodes.where(parts == n).join(above, ["doc_pk", "parent_ord"], "left").withColumn("path", F.concat_ws(separator, "_above", step)).drop("_above")
        done = done.unionByName(level)
    return done


def path_ids(nodes: DataFrame) -> DataFrame:
    """Adds node_id: the id of the node above and, in four digits at least, the node's place among those with the same one above, from 0.

    ``nodes`` as for :func:`paths`. A window holds the children of one node (or the roots of one document).
    """
    place = F.row_number().over(Window.partitionBy("doc_pk", "parent_ord").orderBy("ord")) - 1
    return paths(nodes.withColumn("_place", place), padded(F.col("_place")), "").withColumnRenamed("path", "node_id").drop("_place")


def depth_first(nodes: DataFrame) -> DataFrame:
    """Adds node_id and parent_id, four digits at least, counting each document's nodes depth first from 0; ``nodes`` as for :func:`paths`."""
    number = F.row_number().over(Window.partitionBy("doc_pk").orderBy("path")) - 1
    named = paths(nodes).withColumn("node_id", padded(number))
    parent = named.select("doc_pk", F.col("ord").alias("parent_ord"), F.col("node_id").alias("parent_id"))
    return named.join(parent, ["doc_pk", "parent_ord"], "left").drop("path")


def large(nodes: DataFrame, pages: DataFrame, *, pages_above: int = 10, tokens_from: int = 20_000) -> DataFrame:
    """Nodes that are worth dividing: over ``pages_above`` pages and at least ``tokens_from`` tokens; rows (doc_pk, ord, pages, tokens)."""
    count = (F.col("end_index") - F.col("start_index") + 1).cast("long")
    wide = nodes.select("doc_pk", "ord", count.alias("pages"), F.sequence("start_index", "end_index").alias("range")).where(F.col("pages") > pages_above)
    met = wide.select("doc_pk", "ord", "pages", F.explode("range").alias("page_no")).join(pages.select("doc_pk", "page_no", "token_count"), ["doc_pk", "page_no"])
    return met.groupBy("doc_pk", "ord", "pages").agg(F.sum("token_count").alias("tokens")).where(F.col("tokens") >= tokens_from)

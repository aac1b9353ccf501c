"""Exact duplicates by two Bloom passes: only rows whose hash may repeat are shuffled."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborix.llm.common import bloom, join_to_groups, materialize, small_batches


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if their bytes are; null counts as empty. Of equal texts the row with the largest doc_id stays (null
    ids are smaller than any other; of rows that share that doc_id, each counts as the one that stays). Further columns
    of ``docs`` play no part. An empty table gives an empty result.

    The first pass fills a counting Bloom filter with a hash of every text. In the second, rows whose hash cannot occur
    twice pass straight through; the others meet by SHA-256, with partial sums before the shuffle, so a group of copies
    of any size costs one row a task. In the join back a group with over a thousandth of these rows is dealt into pieces.
    """
    small_batches(docs.sparkSession)
    base = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))
    hashed = F.xxhash64("text_sha256")
    repeats = bloom(base.select(hashed.alias("h")), at_least=2)
    flagged = base.withColumn("maybe", repeats.may_hold(hashed))
    alone = flagged.where(~F.col("maybe")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    several = flagged.where("maybe").select("doc_id", "text_sha256")
    groups = materialize(several.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    met = join_to_groups(several, groups, "text_sha256", "group_size").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
    return alone.unionByName(met)


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, without all but the one of equal texts that :func:`exact_duplicates` keeps.

    Rows that are equal in doc_id and text too give one row. Only rows whose hash may repeat are shuffled.
    """
    small_batches(docs.sparkSession)
    hashed = F.xxhash64(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    repeats = bloom(docs.select(hashed.alias("h")), at_least=2)
    names = docs.columns
    flagged = docs.select(F.struct(*[docs[c] for c in names]).alias("row"), repeats.may_hold(hashed).alias("maybe"))
    alone = flagged.where(~F.col("maybe")).select("row.*")
    key = F.sha2(F.coalesce("row.text", F.lit("")).cast("binary"), 256)
    several = flagged.where("maybe").select(key.alias("key"), "row")
    best = several.groupBy("key").agg(F.max("row.doc_id").alias("best"))
    winners = several.join(best, (several["key"] == best["key"]) & several["row.doc_id"].eqNullSafe(best["best"]), "left_semi")
    once = winners.groupBy("key").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return alone.unionByName(once.select("row.*"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates of all documents: doc_id, keep_id, group_size, kept, text_sha256."""
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP6_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
"""

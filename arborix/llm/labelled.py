"""Bounded samples of labelled rows, to fit classifiers on."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborix.llm.common import crc_fold

#: Characters of the longest text that is fitted on; it bounds the driver's memory.
LONGEST = 50_000


def labelled_sample(
    docs: DataFrame, labels: DataFrame, column: str, per_class: dict[int, int], *, folds: int = 5, held_out: int = 0, longest: int = LONGEST
) -> pd.DataFrame:
    """Columns doc_id, y, text: at most ``per_class[y]`` documents of each class, those with the smallest hash of doc_id.

    Only rows outside the held-out fold are taken, with texts of ``longest`` characters at most (both bounds together
    limit what the driver gets; longer texts are scored like all others). Where labels repeat a doc_id the largest label
    counts, where documents do the largest of its texts; null ids or labels do not count. The quota is filled from rows
    that have both a label and such a text. Ids are picked first, so only the texts of the sample move.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull()).where(crc_fold("doc_id", folds) != held_out)
    usable = usable.groupBy("doc_id").agg(F.max(F.col(column).cast("int")).alias("y"))
    texts = docs.where("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.length("text") <= longest)
    there = usable.join(texts.select("doc_id"), "doc_id", "left_semi")
    firsts = [there.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in per_class.items()]
    ids = reduce(DataFrame.unionAll, firsts).collect()
    picked = docs.sparkSession.createDataFrame([(r["doc_id"], r["y"]) for r in ids], "doc_id long, y int")
    once = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "y").agg(F.max("text").alias("text"))  # as many rows as per_class says
    return pd.DataFrame(sorted(once.collect(), key=lambda r: r["doc_id"]), columns=["doc_id", "y", "text"])

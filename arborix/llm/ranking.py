"""Dense ranks and running sums inside a key, also where one key holds most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts that each key is dealt into at least, and rows of a part if one key has all rows; a part is what one window sorts.
PARTS, PART_ROWS = 256, 1_000_000


def running(rows: DataFrame, key: str, weight: Column, order: list[str], spread: Column, *, count: int, name: str = "before") -> DataFrame:
    """``rows`` with column ``name``: the sum of ``weight`` over the rows of the same key that come before.

    Order: the part that ``spread`` (a hash) puts a row in, then ``order``, which should tell rows apart. A key is dealt
    into parts, as many as ``count``, the number of all rows, asks for. One aggregate gives the sum of each, from which each part's start follows; the rows are sorted
    within parts only, so a key with a third of all rows still makes many small windows.
    """
    parts = max(PARTS, -(-count // PART_ROWS))
    placed = rows.withColumn("_part", F.pmod(spread, F.lit(parts)).cast("int")).withColumn("_weight", weight)
    totals = placed.groupBy(key, "_part").agg(F.sum("_weight").alias("_total"))
    across = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.withColumn("_start", F.coalesce(F.sum("_total").over(across), F.lit(0))).select(F.col(key).alias("_key"), F.col("_part").alias("_at"), "_start")
    inside = Window.partitionBy(key, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = placed.withColumn("_inside", F.coalesce(F.sum("_weight").over(inside), F.lit(0)))
    joined = ranked.join(starts, ranked[key].eqNullSafe(starts["_key"]) & (ranked["_part"] == starts["_at"]))
    return joined.withColumn(name, (F.col("_start") + F.col("_inside")).cast("long")).drop("_part", "_weight", "_key", "_at", "_start", "_inside")

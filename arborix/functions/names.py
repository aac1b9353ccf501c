"""Names of metrics as clients write them: keys, and the look-up of canonical names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arborix.plans.catalogue import Metric


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def metric_key(name: Column) -> Column:
    """What a name is compared by: lower case, without ``(loss)`` and ``(x)``, one space around each slash."""
    low = _stripped(F.lower(_stripped(name)))
    return F.regexp_replace(_stripped(F.replace(F.replace(low, F.lit("(loss)"), F.lit("")), F.lit("(x)"), F.lit(""))), r"(?U)\s*/\s*", " / ")


def base_key(name: Column) -> Column:
    """The key of what comes before the first bracket."""
    return metric_key(F.substring_index(name, "(", 1))


def known_names(spark: SparkSession, metrics: dict[str, Metric]) -> DataFrame:
    """(position, name, canonical): every metric's own name and its synonyms, sums last, in the order of the catalogue."""
    ordered = sorted(metrics.values(), key=lambda m: m.method == "aggregation")
    rows = [(n, m.name) for m in ordered for n in (m.name, *m.synonyms)]
    return spark.createDataFrame([(i, n, c) for i, (n, c) in enumerate(rows)], "position long, name string, canonical string")


def looked_up(items: DataFrame, names: DataFrame) -> DataFrame:
    """``items`` (with a column name) and their canonical names, null where no name is known.

    ``names`` is (position, name, canonical); of equal keys the one with the last position counts. A name is looked up by
    its key, then by its base key.
    """
    keyed = names.groupBy(metric_key(F.col("name")).alias("_key")).agg(F.max_by("canonical", "position").alias("_found"))
    by_name, by_base = (keyed.select(F.col("_key").alias(f"_{k}"), F.col("_found").alias(f"_by_{k}")) for k in ("name", "base"))
    asked = items.withColumn("_name", metric_key(F.col("name"))).withColumn("_base", base_key(F.col("name")))
    met = asked.join(by_name, "_name", "left").join(by_base, "_base", "left")
    return met.select(*items.columns, F.coalesce("_by_name", "_by_base").alias("canonical"))


def row_indices(items: DataFrame, names: DataFrame) -> DataFrame:
    """(canonical_key, row_index): the row of the first of ``items`` (position, name, row_index) that asks for a metric.

    An item asks for the metric that its name is looked up to, and for one that is called as it is; keys are lower case
    without surrounding space.
    """
    found = looked_up(items, names)
    asked = found.select("position", "row_index", F.explode(F.array_compact(F.array("canonical", "name"))).alias("c"))
    return asked.groupBy(_stripped(F.lower("c")).alias("canonical_key")).agg(F.min_by("row_index", "position").alias("row_index"))

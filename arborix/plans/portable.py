"""Registering queries whose SQL text serves both engines."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from arborix.plans.registry import QUERIES, SQL
from arborix.sources import bindings
from arborix.sources.tables import table

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "conversations"]


def expand(text: str) -> str:
    """``{PAGES}`` and the like by their definitions."""
    return re.sub(r"\{([A-Z]+)\}", lambda m: getattr(bindings, m[1]), text)


def run(spark: SparkSession, folder: str, text: str) -> DataFrame:
    """Spark SQL over the tables of a folder; ``//`` is whole division."""
    text = re.sub(r" // ", " div ", expand(text))
    used = [t for t in TABLES if "{" + t + "}" in text]
    return spark.sql(text, **{t: table(spark, folder, t) for t in used})


def portable(name: str, text: str, other: str | None = None) -> None:
    """Registers ``name``: Spark runs ``text``; the other engine runs ``other``, or the same text."""
    QUERIES[name] = lambda spark, folder: run(spark, folder, text)
    SQL[name] = re.sub(r"\{(\w+)\}", r"\1", expand(other or text))

"""Conditions on the filterable fields of an index, in the notation of search clients, as Spark conditions."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

#: Fields of an index that conditions may name (fixed values).
FILTERABLE = ["source_path", "source_file", "chunk_index", "company_name", "year"]
#: Comparison words and what Spark SQL has for them (fixed values).
COMPARISONS = {"eq": "=", "ne": "<>", "gt": ">", "ge": ">=", "lt": "<", "le": "<="}
_WORD = re.compile(rf"(?<![\w.])({'|'.join(COMPARISONS)})(?![\w.])")
_TEXT = re.compile(r"('(?:[^']|'')*')")


def as_sql(condition: str) -> str:
    """``year ge 2020 and company_name eq 'O''Hara'`` as Spark SQL: comparison words become signs, texts in quotes keep every sign.

    Spark parses, types and optimises what comes out; ``and``, ``or``, ``not``, brackets, numbers and null are the same in both.
    """
    parts = _TEXT.split(condition)  # texts are the odd ones
    if any("'" in p for p in parts[::2]):
        raise ValueError(f"an open quote: {condition}")
    plain = [re.sub(r"(<>|=)\s*null\b", lambda m: "is null" if m[1] == "=" else "is not null", _WORD.sub(lambda m: COMPARISONS[m[1]], p)) for p in parts[::2]]
    texts = ["'" + p[1:-1].replace("\\", "\\\\").replace("''", "\\'") + "'" for p in parts[1::2]]
    return "".join(p + (texts[i] if i < len(texts) else "") for i, p in enumerate(plain))


def filtered(index: DataFrame, condition: str | None, *, fields: list[str] | None = None) -> DataFrame:
    """The rows of ``index`` that meet ``condition``; none or blank: all rows.

    The condition is analysed against ``fields`` alone (:data:`FILTERABLE` by default), so naming another column is
    Spark's AnalysisException before anything runs. It stays a plain condition that reaches the scan.
    """
    if not (condition or "").strip():
        return index
    text = f"({as_sql(condition)})"
    known = StructType([index.schema[f] for f in fields or FILTERABLE if f in index.columns])
    index.sparkSession.createDataFrame([], known).where(text).schema  # refuses other columns; a projection would still let them through
    return index.where(text)

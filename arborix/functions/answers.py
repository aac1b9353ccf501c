"""Reading the answers that a search asks models for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def leaf_score(answer: Column) -> Column:
    """The number ``score`` of a JSON answer, brought into 0 to 1; null where it is none (booleans and quoted numbers are not)."""
    score = F.try_variant_get(F.try_parse_json(answer), "$.score", "variant")
    number = F.schema_of_variant(score).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    return F.when(number, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_variant_get(score, "$", "double"))))


def prior_scores(answer: Column) -> Column:
    """A map from titles to scores out of a JSON list of (title, score): entries that lack one are left out, of equal titles the last counts."""
    entries = F.from_json(answer, "array<struct<title: string, score: double>>")
    full = F.filter(entries, lambda e: e["title"].isNotNull() & e["score"].isNotNull())
    titles = F.transform(full, lambda e: e["title"])
    last = F.filter(full, lambda e, i: ~F.array_contains(F.slice(titles, i + 2, F.size(titles)), e["title"]))
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["title"], F.least(F.lit(1.0), F.greatest(F.lit(0.0), e["score"])))))

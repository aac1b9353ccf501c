"""Metric catalogues from files: new metrics are new entries, not code."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from arborix.plans.catalogue import Metric

# The keys of a catalogue file. ``metrics`` is a list of canonical_name, input_type, metric_type,
# statement_type, sct_section, is_mentioned, synonyms, derivation_code (a formula, or an object with ``formula``); ``aggregations``
# maps names to sct_section, statement_type, is_mentioned, synonyms and components (metric, sign); ``alias_map`` maps names
# of line items to metrics.


def from_definitions(raw: dict) -> dict[str, Metric]:
    """Metrics by name. A catalogue without metrics is refused; components of sums that it does not define are looked up."""
    if not raw.get("metrics"):
        raise ValueError("a catalogue needs metrics")
    found = {}
    for entry in raw["metrics"]:
        code = entry.get("derivation_code")
        formula = (code.get("formula") if isinstance(code, dict) else code) or ""
        section = entry.get("sct_section") or entry.get("statement_type") or "Others"
        name = entry["canonical_name"]
        found[name] = Metric(name, entry.get("input_type", "direct"), entry.get("metric_type", "absolute"), section, bool(entry.get("is_mentioned", True)), formula.strip(), synonyms=tuple(entry.get("synonyms") or ()))
    for name, entry in (raw.get("aggregations") or {}).items():
        section = entry.get("sct_section") or entry.get("statement_type") or "Others"
        parts = tuple((c["metric"], -1 if int(c.get("sign", 1)) < 0 else 1) for c in entry.get("components", []))
        found[name] = Metric(name, "aggregation", "absolute", section, bool(entry.get("is_mentioned", False)), parts=parts, synonyms=tuple(entry.get("synonyms") or ()))
        for part, _ in parts:
            found.setdefault(part, Metric(part, "direct", "absolute", section, False))
    return found


def aliases(raw: dict) -> dict[str, str]:
    """Names under which line items are found, and the metrics that they stand for."""
    return {str(k): str(v) for k, v in (raw.get("alias_map") or {}).items()}


def read(spark: SparkSession, path: str) -> dict[str, Metric]:
    """The catalogue in a JSON file, or in a YAML one where a YAML library is there; a catalogue is small and read on the driver."""
    text = spark.read.text(path, wholetext=True).first()[0]
    if path.endswith(".json"):
        return from_definitions(json.loads(text))
    import yaml

    return from_definitions(yaml.safe_load(text) or {})

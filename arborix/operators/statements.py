"""Metric resolution and statement tables: facts in, values with status, method and yearly change out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arborix.functions.formula import parse, to_sql
from arborix.functions.text import display
from arborix.plans.catalogue import METRICS, SECTIONS, Metric, levels, needs

Catalogue = dict[str, Metric]
KEYS = ["company", "year_period"]


def codes(metrics: Catalogue) -> dict[str, int]:
    """The number that stands for each metric in the names of wide columns."""
    return {name: i for i, name in enumerate(metrics)}


CODE = codes(METRICS)


def wide(facts: DataFrame, metrics: Catalogue = METRICS) -> DataFrame:
    """One row for each company and year, a column f<i> for each metric, from rows (company, year_period, canonical_name, value)."""
    return facts.groupBy(*KEYS).agg(*[F.max(F.when(F.col("canonical_name") == n, F.col("value"))).alias(f"f{i}") for n, i in codes(metrics).items()])


def _text(value: str) -> str:
    """A string literal of Spark SQL."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _cases(name: str, metrics: Catalogue, value_of: Callable[[str], str]) -> list[tuple[str, str, str, str]]:
    """When a metric has which value, status and method, as SQL text; the first case that holds counts."""
    metric, fact = metrics[name], f"f{codes(metrics)[name]}"
    parts = [value_of(n) for n in needs(name, metrics)]
    found, none = f"{fact} IS NOT NULL", "CAST(NULL AS DOUBLE)"
    some = " + ".join(f"int({p} IS NOT NULL)" for p in parts) or "0"
    direct, fallback = (found, fact, "resolved", "direct"), (found, fact, "resolved", "fallback_search")
    if metric.method == "direct":
        return [direct]
    if metric.method == "aggregation":
        total = " + ".join(f"coalesce({p} * {sign}, 0D)" for p, (_, sign) in zip(parts, metric.parts, strict=True)) or "0D"
        return [(f"{some} = {len(parts)}", total, "resolved", "derived"), (f"{some} > 0", total, "partial", "derived"), fallback]
    value = f"round({to_sql(parse(metric.formula, metrics), value_of)}, 5)"
    computed = [(f"{some} < {len(parts)}", none, "partial", "derived"), (f"{value} IS NOT NULL", value, "resolved", "derived"), fallback]
    return [direct, *computed] if metric.method == "derived_else_direct" else computed


def resolved(facts: DataFrame, metrics: Catalogue = METRICS) -> DataFrame:
    """Adds v<i>, s<i>, m<i> (value, status, method) for every metric, one projection for each level of the catalogue.

    ``facts`` has one row a company and year and a column f<i> for each metric that was found. A looked-up value comes
    first for metrics that may be looked up; formulas that lack a part are partial; those that cannot be computed fall
    back on a looked-up value. Signed sums skip missing parts and are partial then. A level is handed to Spark as text,
    so building the plan takes as long as parsing it.
    """
    out, code = facts, codes(metrics)
    known: set[str] = set()
    for level in levels(metrics):
        made = []
        for name in level:
            cases = _cases(name, metrics, lambda n: f"v{code[n]}" if n in known else "CAST(NULL AS DOUBLE)")
            for prefix, at, last in (("v", 1, "CAST(NULL AS DOUBLE)"), ("s", 2, "'unresolved'"), ("m", 3, "'na'")):
                whens = " ".join(f"WHEN {c[0]} THEN {c[1] if at == 1 else _text(c[at])}" for c in cases)
                made.append(f"CASE {whens} ELSE {last} END AS {prefix}{code[name]}")
        out = out.selectExpr("*", *made)
        known |= set(level)
    return out


_DETAILS = "array<struct<component_name: string, value: double, source_location: string>>"


def formula_text(metric: Metric) -> str:
    """The formula, or the signed sum written as one."""
    return metric.formula or " ".join(("- " if s < 0 else "+ ") + p for p, s in metric.parts).removeprefix("+ ")


def long(values: DataFrame, names: list[str] | None = None, metrics: Catalogue = METRICS, *, details: bool = False) -> DataFrame:
    """One row for each metric of ``names`` (all): keys, canonical_name, value, status, resolution_method.

    With ``details`` also formula_used and component_details, both null where nothing was derived.
    """
    code = codes(metrics)

    def row(name: str) -> str:
        i = code[name]
        fields = f"'canonical_name', {_text(name)}, 'value', v{i}, 'status', s{i}, 'resolution_method', m{i}"
        if details:
            parts = ", ".join(f"named_struct('component_name', {_text(n)}, 'value', v{code[n]}, 'source_location', concat_ws(' ', company, year_period))" for n in needs(name, metrics))
            listed = f"CASE WHEN m{i} = 'derived' THEN array({parts}) END" if parts else f"CAST(NULL AS {_DETAILS})"
            fields += f", 'formula_used', CASE WHEN m{i} = 'derived' THEN nullif({_text(formula_text(metrics[name]))}, '') END, 'component_details', {listed}"
        return f"named_struct({fields})"

    return values.selectExpr(*KEYS, f"inline(array({', '.join(map(row, names or metrics))}))")


def sections(metrics: Catalogue) -> list[str]:
    """The known sections in their order, then those that only ``metrics`` has, as they are first met."""
    return list(dict.fromkeys([*SECTIONS, *(m.section for m in metrics.values())]))


def shown(names: list[str] | None = None, metrics: Catalogue = METRICS) -> list[tuple[int, int, str]]:
    """Section rank, row rank and name of what a statement shows, in order."""
    wanted = [n for n in metrics if metrics[n].shown and (names is None or n in names)]
    return [(sections(metrics).index(metrics[n].section), wanted.index(n), n) for n in wanted]


def statement(values: DataFrame, names: list[str] | None = None, metrics: Catalogue = METRICS, *, details: bool = False) -> DataFrame:
    """The shown metrics in sections: keys, section, section_rank, row_rank, canonical_name, value, status, resolution_method; ``details`` as in :func:`long`."""
    rows = shown(names, metrics)
    order = values.sparkSession.createDataFrame([(n, sections(metrics)[s], s, r) for s, r, n in rows], "canonical_name string, section string, section_rank int, row_rank int")
    return long(values, [n for _, _, n in rows], metrics, details=details).join(F.broadcast(order), "canonical_name")  # the catalogue is a constant


def with_yearly_change(table: DataFrame) -> DataFrame:
    """Adds year_rank, is_last, prev_year, prev_value and yoy_pct against the company's previous available year.

    A statement has every metric for each year of a company, so the row before is that of the previous year: one window
    over a company's few years of one metric, one shuffle, and the facts are computed once.
    """
    years = Window.partitionBy("company", "canonical_name").orderBy("year_period")
    before = table.withColumns({"year_rank": F.row_number().over(years), "is_last": F.lead("year_period").over(years).isNull(), "prev_year": F.lag("year_period").over(years), "prev_value": F.lag("value").over(years)})
    return before.withColumn("yoy_pct", F.round(F.try_divide(F.col("value") - F.col("prev_value"), F.abs("prev_value")) * 100, 2))


def serialized(values: DataFrame, metrics: Catalogue = METRICS) -> DataFrame:
    """The shown metrics as stored: keys, section, nine fields. Components are listed where a value was derived from them."""
    none = F.expr("cast(array() as array<struct<component_name: string, value: double, source_location: string>>)")
    source = F.concat_ws(" ", "company", "year_period")
    rows, code = [], codes(metrics)
    for section, _, name in shown(None, metrics):
        metric, i = metrics[name], code[name]
        value, status, derived = F.col(f"v{i}"), F.col(f"s{i}"), F.col(f"m{i}") == "derived"
        parts = [F.struct(F.lit(n).alias("component_name"), F.col(f"v{code[n]}").alias("value"), source.alias("source_location")) for n in needs(name, metrics)]
        details = F.when(derived, F.array(*parts)).otherwise(none) if parts else none
        formula = formula_text(metric)
        rows.append(
            F.struct(
                F.lit(sections(metrics)[section]).alias("section"),
                F.lit(name).alias("canonical_name"),
                value.alias("value"),
                status.alias("status"),
                F.col(f"m{i}").alias("resolution_method"),
                F.when(derived & F.lit(bool(formula)), F.lit(formula)).alias("formula_used"),
                display(value, metric.kind).alias("display_value"),
                F.when(status == "unresolved", "not found").alias("error"),
                F.when(derived & F.lit(bool(parts)), source).otherwise("").alias("source_location"),
                details.alias("component_details"),
            )
        )
    return values.select(*KEYS, F.inline(F.array(*rows)))

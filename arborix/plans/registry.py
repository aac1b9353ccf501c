"""The registered queries of the library itself and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborix.operators import statements as st
from arborix.plans import oracle
from arborix.plans.catalogue import METRICS, closure, levels, needs
from arborix.sources.tables import facts
from arborix.streaming.events import events, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    """Registers a query under its own name, with the SQL that gives the same rows."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


_CHANGE = "company, year_period, section, section_rank, row_rank, canonical_name, value, status, resolution_method, prev_value, yoy_pct"
_SUMS = [n for n in METRICS if METRICS[n].method == "aggregation"]
_DERIVED = [n for n in METRICS if METRICS[n].formula]
_PARTIAL = ["Revenue", "Net Worth", "Free cashflow"]


@query(f"{oracle.yearly_sql()} SELECT {_CHANGE} FROM change")
def sct_table(spark, folder):
    """Statements of all companies and years, with yearly changes."""
    return st.with_yearly_change(st.statement(st.resolved(facts(spark, folder)))).select(*_CHANGE.split(", "))


@query(f"{oracle.yearly_sql(_PARTIAL)} SELECT {_CHANGE} FROM change")
def sct_partial(spark, folder):
    """Statements of three metrics; columns that they do not need are pruned down to the scan."""
    return st.with_yearly_change(st.statement(st.resolved(facts(spark, folder)), _PARTIAL)).select(*_CHANGE.split(", "))


@query(f"{oracle.resolved_sql()} {oracle.long_sql([n for n in METRICS if METRICS[n].method == 'direct'])}")
def facts_direct(spark, folder):
    return st.long(st.resolved(facts(spark, folder)), [n for n in METRICS if METRICS[n].method == "direct"])


@query(f"{oracle.resolved_sql()} {oracle.long_sql(_SUMS)}")
def agg_rollup(spark, folder):
    return st.long(st.resolved(facts(spark, folder)), _SUMS)


@query(f"{oracle.resolved_sql()} {oracle.long_sql([n for n in _SUMS if n in closure(['Net Worth'])])}")
def agg_rollup_subset(spark, folder):
    return st.long(st.resolved(facts(spark, folder)), [n for n in _SUMS if n in closure(["Net Worth"])])


@query(f"{oracle.resolved_sql()} {oracle.long_sql(_DERIVED)}")
def derived_metrics(spark, folder):
    return st.long(st.resolved(facts(spark, folder)), _DERIVED)


@query(f"{oracle.resolved_sql()} {oracle.long_sql()}")
def resolve_metrics(spark, folder):
    return st.long(st.resolved(facts(spark, folder)))


@query(f"{oracle.resolved_sql()} SELECT year_period, status, count(*) AS metrics FROM ({oracle.long_sql()}) GROUP BY year_period, status")
def resolution_summary(spark, folder):
    return st.long(st.resolved(facts(spark, folder))).groupBy("year_period", "status").agg(F.count(F.lit(1)).alias("metrics"))


@query(f"{oracle.yearly_sql()} SELECT company, year_period, canonical_name, prev_value, value, yoy_pct FROM change WHERE year_rank > 1")
def yoy(spark, folder):
    return st.with_yearly_change(st.statement(st.resolved(facts(spark, folder)))).where("year_rank > 1").select("company", "year_period", "canonical_name", "prev_value", "value", "yoy_pct")


@query(f"{oracle.yearly_sql()}, top AS (SELECT company, max(year_rank) AS last FROM years GROUP BY company) SELECT company, year_period, canonical_name, yoy_pct FROM change JOIN top USING (company) WHERE year_rank = last AND last > 1")
def yoy_latest(spark, folder):
    table = st.with_yearly_change(st.statement(st.resolved(facts(spark, folder))))
    return table.where("is_last and year_rank > 1").select("company", "year_period", "canonical_name", "yoy_pct")


@query(f"""{oracle.yearly_sql()}, top AS (SELECT company, max(year_rank) AS last FROM years GROUP BY company), e AS (
 SELECT company, 0 AS phase, year_period AS a, section_rank AS b, row_rank AS c, 'metric' AS event_type FROM change
 UNION ALL SELECT company, 1, year_period, section_rank, row_rank, 'yoy' FROM change JOIN top USING (company) WHERE year_rank = last AND last > 1
 UNION ALL SELECT DISTINCT company, 2, '', 0, 0, 'complete' FROM change)
 SELECT company, row_number() OVER (PARTITION BY company ORDER BY phase, a, b, c) AS seq, event_type FROM e""")
def spread_events(spark, folder):
    """Which event each company's client gets when; payloads are tested on their own."""
    return events(st.with_yearly_change(st.statement(st.resolved(facts(spark, folder))))).drop("payload")


@query(f"{oracle.resolved_sql()}, sct AS ({oracle.statement_sql()}) SELECT company, section, row_rank, canonical_name, year_period, value, status FROM sct WHERE year_period BETWEEN '1996' AND '1999'")
def sct_by_year(spark, folder):
    """Statements of chosen years; the same sections and rows for each of them."""
    rows = facts(spark, folder).where(F.col("year_period").between("1996", "1999"))
    return st.statement(st.resolved(rows)).select("company", "section", "row_rank", "canonical_name", "year_period", "value", "status")


@query(f"{oracle.resolved_sql()} {oracle.long_sql([n for n in METRICS if METRICS[n].shown])}")
def mentioned_filter(spark, folder):
    return st.long(st.resolved(facts(spark, folder)), [n for n in METRICS if METRICS[n].shown])


_PHASE = {"direct": 1, "aggregation": 2, "derived_else_direct": 3, "derived": 4}
_DEPTH = {n: d for d, level in enumerate(levels()) for n in level}
_CLOSURES = [(n, p) for n in METRICS if METRICS[n].shown for p in sorted(closure([n]) - {n})]
_SUMMED = "count(*) AS metrics, count(value) AS found, cast(sum(CASE WHEN status = 'partial' THEN 1 ELSE 0 END) AS bigint) AS partial"


def _by(spark, folder, names, rows, schema):
    """Resolved metrics summed by a constant attribute of the catalogue."""
    attribute = F.broadcast(spark.createDataFrame(rows, schema))  # one row a metric of the catalogue, or a few
    joined = st.long(st.resolved(facts(spark, folder))).join(attribute, "canonical_name")
    partial = F.sum(F.when(F.col("status") == "partial", 1).otherwise(0)).alias("partial")
    return joined.groupBy("company", "year_period", *names).agg(F.count(F.lit(1)).alias("metrics"), F.count("value").alias("found"), partial)


def _values(rows):
    return ", ".join("(" + ", ".join(repr(x) for x in r) + ")" for r in rows)


@query(f"{oracle.resolved_sql()} SELECT company, year_period, phase, {_SUMMED} FROM ({oracle.long_sql()}) JOIN (VALUES {_values([(n, _PHASE[METRICS[n].method]) for n in METRICS])}) a(canonical_name, phase) USING (canonical_name) GROUP BY ALL")
def metric_phases(spark, folder):
    """What each phase of a run (look-ups, sums, formulas that may be looked up, formulas) found for a company and year."""
    return _by(spark, folder, ["phase"], [(n, _PHASE[METRICS[n].method]) for n in METRICS], "canonical_name string, phase int")


@query(f"{oracle.resolved_sql()} SELECT company, year_period, level, {_SUMMED} FROM ({oracle.long_sql()}) JOIN (VALUES {_values(list(_DEPTH.items()))}) a(canonical_name, level) USING (canonical_name) GROUP BY ALL")
def metric_levels(spark, folder):
    """What was found on each level of the catalogue, whose metrics need only those of earlier levels."""
    return _by(spark, folder, ["level"], list(_DEPTH.items()), "canonical_name string, level int")


@query(f"{oracle.resolved_sql()} SELECT company, year_period, wanted, {_SUMMED} FROM ({oracle.long_sql()}) JOIN (VALUES {_values(_CLOSURES)}) a(wanted, canonical_name) USING (canonical_name) GROUP BY ALL")
def dependency_closure(spark, folder):
    """For each shown metric, how much of all that it is computed from, at any depth, was found."""
    return _by(spark, folder, ["wanted"], _CLOSURES, "wanted string, canonical_name string")


_FORMULA = {n: METRICS[n].formula or " ".join(("- " if s < 0 else "+ ") + p for p, s in METRICS[n].parts).removeprefix("+ ") for n in METRICS}
_SHOWN = [n for n in METRICS if METRICS[n].shown]


@query(
    f"""{oracle.resolved_sql()}, sct AS ({oracle.statement_sql()}) SELECT company, year_period, section, canonical_name, value, status, resolution_method, CASE WHEN resolution_method = 'derived' THEN nullif(formula, '') END AS formula_used,
 CASE WHEN status = 'unresolved' THEN 'not found' END AS error, CASE WHEN resolution_method = 'derived' THEN parts ELSE 0 END AS component_count
 FROM sct JOIN (VALUES {_values([(n, _FORMULA[n], len(needs(n))) for n in _SHOWN])}) f(name, formula, parts) ON canonical_name = name"""
)
def sct_serialized(spark, folder):
    """Statement rows in the shape in which they are stored; the display text is left to :func:`arborix.functions.text.display`."""
    stored = st.serialized(st.resolved(facts(spark, folder)))
    return stored.select("company", "year_period", "section", "canonical_name", "value", "status", "resolution_method", "formula_used", "error", F.size("component_details").alias("component_count"))


from arborix.plans import documents, ingest, trees  # noqa: E402,F401  they register theirs
from arborix.plans import applied, figures  # noqa: E402,F401

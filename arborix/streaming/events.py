"""The event sequence of a spread: one row an event, in the order in which a client gets them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from arborix.operators.statements import long, resolved, statement, with_yearly_change


_DETAILS = "array<struct<component_name: string, value: double, source_location: string>>"


def events(changes: DataFrame) -> DataFrame:
    """Rows (company, seq, event_type, payload) from a statement table with yearly changes.

    Per company: its metrics by year, section and row, then the changes of its last year, then one ``complete``.
    Payloads keep nulls. Formula, components and the place of the first component come from a statement with
    ``details`` and are null without; ``row_index`` is there only where ``changes`` has one. A change names its year
    ``<year>_YoY``, is unresolved without a value, and lists both years' values. A company has a few hundred events, so
    one window orders them.
    """
    given = {c: F.col(c) if c in changes.columns else F.lit(None).cast(t) for c, t in (("formula_used", "string"), ("component_details", _DETAILS), ("row_index", "long"))}
    keep = {"ignoreNullFields": "false"}
    parts = given["component_details"]
    fields = [
        F.col("canonical_name"), F.col("year_period").alias("year"), F.col("value"), F.col("status"), given["formula_used"].alias("formula"), F.when(F.col("status") == "unresolved", "not found").alias("error"),
        F.nullif(F.try_element_at(parts, F.lit(1))["source_location"], F.lit("")).alias("source_location"), parts.alias("component_details"),
    ]
    metric = F.to_json(F.struct(*fields), keep)
    if "row_index" in changes.columns:
        metric = F.when(F.col("row_index").isNull(), metric).otherwise(F.to_json(F.struct(*fields, "row_index"), keep))
    values = F.array(*[F.struct(F.concat(F.col(y), F.lit(" value")).alias("component_name"), F.col(v).alias("value")) for y, v in (("year_period", "value"), ("prev_year", "prev_value"))])
    change = F.to_json(
        F.struct(
            F.col("canonical_name"), F.concat("year_period", F.lit("_YoY")).alias("year"), F.col("yoy_pct").alias("value"), F.when(F.col("yoy_pct").isNull(), "unresolved").otherwise("resolved").alias("status"),
            F.format_string("(%s - %s) / |%s| * 100", "year_period", "prev_year", "prev_year").alias("formula"), values.alias("component_details"),
        ),
        keep,
    )

    def event(phase: int, kind: str, payload: Column) -> Column:
        return F.struct(F.lit(phase).alias("phase"), F.lit(kind).alias("event_type"), payload.alias("payload"))

    both = F.array(event(0, "metric", metric), F.when(F.col("is_last") & (F.col("year_rank") > 1), event(1, "yoy", change)))
    made = changes.select("company", F.col("year_period").alias("a"), F.col("section_rank").alias("b"), F.col("row_rank").alias("c"), F.inline(F.array_compact(both)))
    done = changes.groupBy("company").agg(F.count(F.lit(1)).alias("n")).select(
        "company", F.lit(2).alias("phase"), F.lit("").alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c"), F.lit("complete").alias("event_type"), F.to_json(F.struct(F.col("n").alias("event_count"))).alias("payload")
    )
    order = Window.partitionBy("company").orderBy("phase", "a", "b", "c")
    return made.unionByName(done).select("company", F.row_number().over(order).cast("long").alias("seq"), "event_type", "payload")


def verified(requests: DataFrame, trees: DataFrame) -> DataFrame:
    """The requested (company, year_period) with the status of their trees: ok from ten nodes and three leaves with text, else degraded; error without a tree.

    ``trees`` has company, year_period, nodes and leaves, one row for each tree.
    """
    status = F.when(F.col("nodes").isNull(), "error").when((F.col("nodes") >= 10) & (F.col("leaves") >= 3), "ok").otherwise("degraded")
    return requests.join(trees, ["company", "year_period"], "left").select("company", "year_period", status.alias("tree_status"))


def spread(requests: DataFrame, trees: DataFrame, values: DataFrame) -> DataFrame:
    """All events of requested spreads, rows (company, seq, event_type, payload).

    Per company: one ``tree_verification`` for each year, a ``year_error`` for each year without a tree, then
    :func:`events` of the others; a company without any usable year ends with a ``complete`` of no events.
    """
    checked = verified(requests, trees)
    usable = checked.where("tree_status <> 'error'").select("company", "year_period")
    known = events(with_yearly_change(statement(values.join(usable, ["company", "year_period"], "left_semi"), details=True)))
    payload = F.to_json(F.struct(F.col("year_period").alias("year"), F.col("tree_status").alias("status")))
    tree = checked.select("company", F.lit(0).alias("phase"), F.col("year_period").alias("at"), F.lit("tree_verification").alias("event_type"), payload.alias("payload"))
    failed = checked.where("tree_status = 'error'").select("company", F.lit(1).alias("phase"), F.col("year_period").alias("at"), F.lit("year_error").alias("event_type"), payload.alias("payload"))
    rest = known.select("company", F.lit(2).alias("phase"), F.lpad(F.col("seq").cast("string"), 12, "0").alias("at"), "event_type", "payload")
    none = requests.select("company").distinct().join(known.select("company").distinct(), "company", "left_anti")
    ends = none.select("company", F.lit(3).alias("phase"), F.lit("").alias("at"), F.lit("complete").alias("event_type"), F.lit('{"event_count":0}').alias("payload"))
    order = Window.partitionBy("company").orderBy("phase", "at")
    return tree.unionByName(failed).unionByName(rest).unionByName(ends).select("company", F.row_number().over(order).cast("long").alias("seq"), "event_type", "payload")


def request(years: list[str], metrics: list[str], workers: int = 1) -> None:
    """Refuses a spread without years, of fewer than two metrics, or with workers beyond 1 to 10."""
    if not years or len(metrics) < 2 or not 1 <= workers <= 10:
        raise ValueError("a spread needs at least one year, at least two metrics and 1 to 10 workers")


def resolved_stream(facts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Resolves a stream of wide fact rows as they come and appends metric rows to ``path``, each exactly once; ends when all present input is done.

    A wide row holds all that its company and year need, so the plan is a projection and keeps no state.
    """
    return long(resolved(facts)).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

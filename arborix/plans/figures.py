"""Annual reports as section forests: what a search for each metric finds in them, and the statements made of that."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborix.operators import statements as st
from arborix.operators.figures import figures
from arborix.plans import oracle
from arborix.plans.catalogue import METRICS
from arborix.plans.registry import query
from arborix.plans.trees import search_sql
from arborix.sources.tables import facts, facts_sql, stored

#: Looked-up metrics, each a page of its section; a section's title is the list of its metrics.
ASKED = [n for n in METRICS if METRICS[n].method == "direct"]
PARTS = list(dict.fromkeys(METRICS[n].section for n in ASKED))
TITLES = [", ".join(n for n in ASKED if METRICS[n].section == p) for p in PARTS]
BUDGET = {"iterations": 6, "workers": 3}


def reports(spark, folder) -> DataFrame:
    """A forest for each company and year: the report, its sections, and a page for each figure that is known, in whole units, brackets for a minus."""
    rows = [F.struct(F.lit(i).alias("code"), F.lit(n).alias("title"), F.lit(PARTS.index(METRICS[n].section)).alias("part"), F.col(f"f{st.CODE[n]}").alias("value")) for i, n in enumerate(ASKED)]
    known = stored(facts(spark, folder).select(F.concat("company", F.lit("|"), "year_period").alias("doc_pk"), F.inline(F.array(*rows))).where("value is not null"))
    printed = F.floor(F.abs("value")).cast("string")
    text = F.concat(F.when(F.col("value") < 0, F.concat(F.lit("("), printed, F.lit(")"))).otherwise(printed), F.lit(" for "), "title")
    pages = known.select("doc_pk", F.col("code").cast("long").alias("node_pk"), (-2 - F.col("part")).cast("long").alias("parent_pk"), F.col("code").alias("child_order"), (F.col("code") + 1).alias("start_index"), "title", text.alias("text"))
    title = F.element_at(F.array(*map(F.lit, TITLES)), F.col("part") + 1)
    sections = known.select("doc_pk", "part").distinct().select("doc_pk", (-2 - F.col("part")).cast("long"), F.lit(-1).cast("long"), F.col("part"), F.lit(1), title, F.lit(""))
    roots = known.select("doc_pk").distinct().select("doc_pk", F.lit(-1).cast("long"), F.lit(None).cast("long"), F.lit(0), F.lit(1), F.lit("Report"), F.lit(""))
    return pages.union(sections).union(roots).withColumn("end_index", F.col("start_index"))


def found(spark, folder) -> DataFrame:
    """What each metric's search finds in each report; a year too many is asked of each company."""
    nodes = reports(spark, folder)
    documents = nodes.select("doc_pk").distinct()
    company, year = F.split_part("doc_pk", F.lit("|"), F.lit(1)), F.split_part("doc_pk", F.lit("|"), F.lit(2)).cast("int")
    later = documents.groupBy(company.alias("c")).agg((F.max(year) + 1).cast("string").alias("y")).select(F.concat("c", F.lit("|"), "y").alias("doc_pk"))
    questions = documents.unionByName(later).select("doc_pk", F.explode(F.array(*map(F.lit, ASKED))).alias("question_id")).withColumn("question", F.col("question_id"))
    answers = stored(figures(nodes, questions, **BUDGET))
    return answers.select(F.split_part("doc_pk", F.lit("|"), F.lit(1)).alias("company"), F.split_part("doc_pk", F.lit("|"), F.lit(2)).alias("year_period"), F.col("question_id").alias("canonical_name"), "value", "pages", "error")


def _answers_sql() -> str:
    """A tree for each company, year and metric, searched on its own; columns company, year_period, code, metric, value, pages."""
    words = lambda x: rf"list_distinct(regexp_extract_all(lower({x}), '[\p{{L}}\p{{M}}\p{{Nd}}_]+'))"
    share = lambda q, t: f"len(list_intersect({words(t)}, {words(q)})) / len({words(q)})::DOUBLE"
    named = ", ".join(f"({i}, '{n}', {PARTS.index(METRICS[n].section)}, {st.CODE[n]})" for i, n in enumerate(ASKED))
    titles = ", ".join(f"({i}, '{t}')" for i, t in enumerate(TITLES))
    values = " UNION ALL ".join(f"SELECT company, year_period, {i} AS code, f{st.CODE[n]} AS value FROM w" for i, n in enumerate(ASKED))
    printed = "cast(cast(floor(abs(value)) AS bigint) AS varchar)"
    pages = f"""SELECT company || '|' || year_period AS doc, k.code, name, part, value, CASE WHEN value < 0 THEN '(' || {printed} || ')' ELSE {printed} END || ' for ' || name AS body
 FROM ({values}) v JOIN (VALUES {named}) k(code, name, part, c) ON v.code = k.code WHERE value IS NOT NULL"""
    tree = f"""SELECT doc || '|' || q.code AS doc_pk, g.code::BIGINT AS node_pk, (-2 - g.part)::BIGINT AS parent_pk, g.code AS child_order, g.code + 1 AS start_index, {share('q.name', 'g.name')} AS prior, {share('q.name', 'g.body')} AS score FROM g, (VALUES {named}) q(code, name, part, c)
 UNION ALL SELECT DISTINCT doc || '|' || q.code, (-2 - g.part)::BIGINT, -1::BIGINT, g.part, 1, {share('q.name', 't.title')}, 0.0 FROM g JOIN (VALUES {titles}) t(part, title) ON t.part = g.part, (VALUES {named}) q(code, name, part, c)
 UNION ALL SELECT DISTINCT doc || '|' || q.code, -1::BIGINT, NULL::BIGINT, 0, 1, 0.0, 0.0 FROM g, (VALUES {named}) q(code, name, part, c)"""
    search = search_sql(tree, 3, BUDGET["iterations"], BUDGET["workers"], 1)
    return f"""SELECT q.company, q.year_period, q.code, q.name, CASE WHEN {share('q.name', 'g.body')} >= 1 THEN sign(g.value) * floor(abs(g.value)) + 0.0 END AS value, g.code + 1 AS page, g.doc IS NOT NULL AS there
 FROM (SELECT company, year_period, k.* FROM (SELECT company, year_period FROM w UNION ALL SELECT company, cast(cast(max(year_period) AS int) + 1 AS varchar) FROM w GROUP BY company) d, (VALUES {named}) k(code, name, part, c)) q
 LEFT JOIN ({search}) s ON s.doc_pk = q.company || '|' || q.year_period || '|' || q.code LEFT JOIN g ON g.doc = q.company || '|' || q.year_period AND g.code = s.leaf_pk""", pages


_ANSWERS, _PAGES = _answers_sql()
_FOUND = f"WITH w AS MATERIALIZED ({facts_sql()}), g AS MATERIALIZED ({_PAGES}), a AS MATERIALIZED ({_ANSWERS})"
_WIDE = ", ".join(f"{f'max(CASE WHEN code = {ASKED.index(n)} THEN value END)' if n in ASKED else 'cast(NULL AS double)'} AS f{i}" for n, i in st.CODE.items())


@query(f"{_FOUND} SELECT company, year_period, name AS canonical_name, value, CASE WHEN value IS NOT NULL THEN page || '-' || page END AS pages, CASE WHEN NOT there THEN 'no document' WHEN value IS NULL THEN 'no figure' END AS error FROM a")
def document_figures(spark, folder):
    """Every looked-up metric searched for in every company's report of every year: value, pages, or why there is none."""
    return found(spark, folder)


@query(f"{oracle.resolved_sql(f'{_FOUND} SELECT company, year_period, {_WIDE} FROM a GROUP BY company, year_period')} SELECT company, year_period, section, canonical_name, value, status, resolution_method FROM ({oracle.statement_sql()})")
def document_statements(spark, folder):
    """Statements whose facts are what the searches in the reports found; sums and formulas follow from them."""
    values = st.resolved(st.wide(found(spark, folder)))
    return st.statement(values).select("company", "year_period", "section", "canonical_name", "value", "status", "resolution_method")

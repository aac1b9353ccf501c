"""Queries that apply the operators themselves to forests, searches, names and payloads; their SQL is written on its own."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from arborix.functions import names
from arborix.operators import forest, search, verify
from arborix.operators import statements as st
from arborix.plans import oracle
from arborix.plans.catalogue import METRICS, needs
from arborix.plans.portable import expand, run
from arborix.plans.registry import query
from arborix.plans.trees import _TREE
from arborix.sources import tables
from arborix.sources.tables import facts, table
from arborix.streaming.events import events, spread


def _sql(text: str) -> str:
    """SQL for the other engine: shapes expanded, tables by their names."""
    return expand(text).replace("{", "").replace("}", "").replace("1.0D", "1.0").replace("0.0D", "0.0")


# ------------------------------------------------------------------ forests
_LINKED = """linked AS (SELECT c.doc_pk, c.ord, max(p.ord) AS parent_ord FROM {TOC} c LEFT JOIN {TOC} p ON c.doc_pk = p.doc_pk AND p.ord < c.ord AND position('.' IN c.structure) > 0
 AND p.structure = split_part(c.structure, '.', 1) GROUP BY ALL)"""


def _toc(spark, folder):
    toc = run(spark, folder, "SELECT doc_pk, ord, structure FROM {TOC} t")
    return toc.join(forest.parents(toc).select("doc_pk", "ord", "parent_ord"), ["doc_pk", "ord"])


@query(
    _sql(f"""WITH RECURSIVE {_LINKED}, walk AS (SELECT doc_pk, ord, parent_ord, [ord] AS path FROM linked WHERE parent_ord IS NULL
 UNION ALL SELECT l.doc_pk, l.ord, l.parent_ord, list_append(w.path, l.ord) FROM linked l JOIN walk w ON l.doc_pk = w.doc_pk AND l.parent_ord = w.ord),
 ids AS (SELECT doc_pk, ord, parent_ord, printf('%04d', row_number() OVER (PARTITION BY doc_pk ORDER BY path) - 1) AS node_id FROM walk)
 SELECT i.doc_pk, i.ord, i.node_id, j.node_id AS parent_id FROM ids i LEFT JOIN ids j ON i.doc_pk = j.doc_pk AND i.parent_ord = j.ord""")
)
def node_ids_depth_first(spark, folder):
    """Contents tables as forests, their nodes counted depth first."""
    return forest.depth_first(_toc(spark, folder)).select("doc_pk", "ord", "node_id", "parent_id")


@query(
    _sql(f"""WITH RECURSIVE {_LINKED}, placed AS (SELECT *, row_number() OVER (PARTITION BY doc_pk, parent_ord ORDER BY ord) - 1 AS k FROM linked),
 walk AS (SELECT doc_pk, ord, printf('%04d', k) AS node_id FROM placed WHERE parent_ord IS NULL
 UNION ALL SELECT p.doc_pk, p.ord, w.node_id || printf('%04d', p.k) FROM placed p JOIN walk w ON p.doc_pk = w.doc_pk AND p.parent_ord = w.ord) SELECT doc_pk, ord, node_id FROM walk""")
)
def node_ids_by_path(spark, folder):
    """Contents tables as forests, each node named by its place among its siblings after the name of its parent."""
    return forest.path_ids(_toc(spark, folder)).select("doc_pk", "ord", "node_id")


@query(
    _sql("""WITH n AS (SELECT * FROM {NODES} x), r AS (SELECT root_pk, count(*) AS nodes, count(*) FILTER (WHERE parent_pk IS NULL) AS roots FROM n GROUP BY root_pk)
 SELECT root_pk, nodes, roots, cast(0 AS bigint) AS lost, cast(0 AS bigint) AS added FROM r""")
)
def forest_stored_again(spark, folder):
    """Forests written and read back: nodes and roots of what was read, rows that were lost and rows that were not there before."""
    rows = run(spark, folder, "SELECT root_pk, node_pk, parent_pk, child_order, depth, title FROM {NODES} n")
    path = f"{tables.shared_folder(spark)}/forest-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    again = spark.read.schema(rows.schema).parquet(path)
    counted = again.groupBy("root_pk").agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("parent_pk").isNull()).alias("roots"))
    sides = verify.differences(rows, again).groupBy("root_pk").agg(F.count_if(F.col("side") == "first").alias("lost"), F.count_if(F.col("side") == "second").alias("added"))
    zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("nodes", "roots", "lost", "added")}
    return counted.join(sides, "root_pk", "full").withColumns(zero)


@query(
    _sql("""WITH RECURSIVE n AS (SELECT * FROM {NODES} x), up AS (SELECT node_pk AS top, node_pk AS below FROM n UNION ALL SELECT n.parent_pk, up.below FROM up JOIN n ON up.top = n.node_pk WHERE n.parent_pk IS NOT NULL),
 inner_nodes AS (SELECT DISTINCT parent_pk FROM n WHERE parent_pk IS NOT NULL) SELECT top AS node_pk, count(*) AS nodes, count(*) FILTER (WHERE below NOT IN (SELECT parent_pk FROM inner_nodes)) AS leaves FROM up GROUP BY top""")
)
def subtree_sizes(spark, folder):
    """Nodes and leaves below every node, itself included, whatever the depth of its forest."""
    nodes = run(spark, folder, "SELECT root_pk AS doc_pk, node_pk, parent_pk FROM {NODES} n")
    leaf = nodes.join(nodes.select("doc_pk", F.col("parent_pk").alias("node_pk")).distinct(), ["doc_pk", "node_pk"], "left_anti").withColumn("score", F.lit(1.0))
    all_nodes = search.backpropagated(nodes, nodes.withColumn("score", F.lit(1.0))).select("doc_pk", "node_pk", F.col("visits").alias("nodes"))
    leaves = search.backpropagated(nodes, leaf).select("doc_pk", "node_pk", F.col("visits").alias("leaves"))
    return all_nodes.join(leaves, ["doc_pk", "node_pk"], "left").select("node_pk", "nodes", F.coalesce("leaves", F.lit(0)).cast("long").alias("leaves"))


# ------------------------------------------------------------------ search
@query(
    _sql(f"""WITH t AS ({_TREE}), r AS (SELECT doc_pk, count(*) AS roots FROM t WHERE parent_pk IS NULL GROUP BY doc_pk)
 SELECT t.doc_pk, node_pk, cast(3 AS bigint) AS visits, round(3 * CASE WHEN parent_pk IS NULL AND roots = 1 THEN 1.0 ELSE least(1.0, greatest(0.0, coalesce(prior, 0))) END, 9) AS value_sum FROM t LEFT JOIN r USING (doc_pk)""")
)
def search_seeds(spark, folder):
    """Visits and values of every node of the customers' forests when its parent is first entered."""
    return search.seeded(run(spark, folder, _TREE)).select("doc_pk", "node_pk", "visits", F.round("value_sum", 9).alias("value_sum"))


@query(
    _sql(f"""WITH RECURSIVE t AS ({_TREE}), leaf AS (SELECT doc_pk, node_pk, parent_pk, cast(score AS decimal(28, 10)) AS score FROM t WHERE node_pk NOT IN (SELECT parent_pk FROM t WHERE parent_pk IS NOT NULL)),
 up AS (SELECT doc_pk, node_pk, parent_pk, score FROM leaf UNION ALL SELECT t.doc_pk, t.node_pk, t.parent_pk, up.score FROM up JOIN t ON up.doc_pk = t.doc_pk AND up.parent_pk = t.node_pk)
 SELECT doc_pk, node_pk, count(*) AS visits, round(cast(sum(score) AS double), 6) AS value_sum FROM up GROUP BY doc_pk, node_pk""")
)
def search_sums(spark, folder):
    """Every leaf of the customers' forests evaluated once: what that adds to it and to all nodes above."""
    nodes = run(spark, folder, _TREE)
    leaves = nodes.join(nodes.select("doc_pk", F.col("parent_pk").alias("node_pk")).distinct(), ["doc_pk", "node_pk"], "left_anti")
    return search.backpropagated(nodes, leaves).select("doc_pk", "node_pk", "visits", F.round("value_sum", 6).alias("value_sum"))


_QUESTION = "the and der que net"


@query(
    """SELECT doc_id, len(list_intersect(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{M}\\p{Nd}_]+')), ['the', 'and', 'der', 'que', 'net'])) / 5.0::DOUBLE AS score FROM documents"""
)
def search_leaf_scores(spark, folder):
    """Documents as leaves, scored by the share of a question's words that they have."""
    return table(spark, folder, "documents").select("doc_id", search.lexical_score(_QUESTION, F.col("text")).alias("score"))


@query(None)
def search_sources(spark, folder):
    """What the answers of a search in the customers' forests cite: leaves with titles, pages, paths, scores and visits."""
    tree = run(spark, folder, _TREE).where("doc_pk is not null")
    found = search.searched(tree, iterations=10, workers=3, top=3)
    titled = tree.withColumns({"title": F.concat(F.lit("node "), F.abs("node_pk")), "end_index": F.col("start_index") + 1, "summary": F.concat(F.lit("Summary of "), F.abs("node_pk"), F.lit(".")), "text": F.lit("")})
    return search.sources(found, titled).select("doc_pk", "rank", "source.*", "text")


# ------------------------------------------------------------------ names and payloads
_KEY = r"trim(regexp_replace(trim(replace(replace(lower(trim({})), '(loss)', ''), '(x)', '')), '\s*/\s*', ' / ', 'g'))"
_ASKED = "CASE p_partkey % 4 WHEN 0 THEN concat(' ', upper(p_name)) WHEN 1 THEN concat(p_name, ' (net)') WHEN 2 THEN concat(p_brand, ' (x)') ELSE concat(p_name, ' / ', p_type) END"


@query(
    f"""WITH known AS (SELECT {_KEY.format('name')} AS key, arg_max(canonical, position) AS canonical FROM (SELECT 2 * p_partkey AS position, p_name AS name, p_brand AS canonical FROM part
 UNION ALL SELECT 2 * p_partkey + 1, p_brand, p_brand FROM part) n GROUP BY 1),
 asked AS (SELECT p_partkey AS row_index, {_ASKED} AS name FROM part)
 SELECT row_index, name, coalesce(a.canonical, b.canonical) AS canonical FROM asked LEFT JOIN known a ON a.key = {_KEY.format('name')} LEFT JOIN known b ON b.key = {_KEY.format("split_part(name, '(', 1)")}"""
)
def name_lookup(spark, folder):
    """Part names, as clients may write them, looked up among part names and brands in two steps; the last part of a name counts."""
    part = table(spark, folder, "part")
    known = part.select(F.explode(F.array(*[F.struct((2 * F.col("p_partkey") + i).alias("position"), F.col(c).alias("name"), F.col("p_brand").alias("canonical")) for i, c in enumerate(("p_name", "p_brand"))])).alias("n")).select("n.*")
    return names.looked_up(part.select(F.col("p_partkey").alias("row_index"), F.expr(_ASKED).alias("name")), known)


_SHOWN = [n for n in METRICS if METRICS[n].shown]
_ROWS = ", ".join(f"('{n}', '{st.formula_text(METRICS[n])}', {len(needs(n))}, {i + 1})" for i, n in enumerate(_SHOWN))


@query(
    f"""{oracle.yearly_sql()}, f AS (SELECT * FROM (VALUES {_ROWS}) v(canonical_name, formula, parts, row_index)),
 top AS (SELECT company, max(year_rank) AS last FROM years GROUP BY company), e AS (
 SELECT company, 0 AS phase, year_period AS a, section_rank AS b, row_rank AS c, 'metric' AS event_type, canonical_name, year_period AS year, value, status, CASE WHEN resolution_method = 'derived' THEN nullif(formula, '') END AS formula,
  CASE WHEN status = 'unresolved' THEN 'not found' END AS error, CASE WHEN resolution_method = 'derived' AND parts > 0 THEN company || ' ' || year_period END AS source_location,
  CASE WHEN resolution_method = 'derived' AND parts > 0 THEN parts END AS components, row_index FROM change JOIN f USING (canonical_name)
 UNION ALL SELECT c.company, 1, c.year_period, section_rank, row_rank, 'yoy', canonical_name, c.year_period || '_YoY', yoy_pct, CASE WHEN yoy_pct IS NULL THEN 'unresolved' ELSE 'resolved' END,
  '(' || c.year_period || ' - ' || y.year_period || ') / |' || y.year_period || '| * 100', NULL, NULL, 2, NULL FROM change c JOIN top ON c.company = top.company JOIN years y ON y.company = c.company AND y.year_rank = last - 1 WHERE c.year_rank = last AND last > 1)
 SELECT company, row_number() OVER (PARTITION BY company ORDER BY phase, a, b, c) AS seq, event_type, canonical_name, year, value, status, formula, error, source_location, cast(components AS int) AS components, cast(row_index AS bigint) AS row_index FROM e"""
)
def event_payloads(spark, folder):
    """What the payloads of all metric and change events say, read back out of their JSON; row numbers come from names as clients write them."""
    changes = st.with_yearly_change(st.statement(st.resolved(facts(spark, folder)), details=True))
    items = spark.createDataFrame([(i, f" {n.upper()} (x)", i + 1) for i, n in enumerate(_SHOWN)], "position int, name string, row_index long")
    rows = F.broadcast(names.row_indices(items, names.known_names(spark, METRICS)))  # a few rows for each metric of the catalogue
    indexed = changes.join(rows, F.lower("canonical_name") == F.col("canonical_key"), "left")
    payload = F.from_json("payload", "canonical_name string, year string, value double, status string, formula string, error string, source_location string, component_details array<struct<component_name: string, value: double>>, row_index long")
    read = events(indexed).where("event_type <> 'complete'").select("company", "seq", "event_type", payload.alias("p"))
    return read.select("company", "seq", "event_type", "p.canonical_name", "p.year", "p.value", "p.status", "p.formula", "p.error", "p.source_location", F.size("p.component_details").alias("components"), "p.row_index").withColumn(
        "components", F.when(F.col("components") >= 0, F.col("components"))
    )


@query(
    f"""{oracle.resolved_sql()}, asked AS (SELECT company, year_period FROM resolved UNION SELECT company, cast(cast(max(year_period) AS int) + 1 AS text) FROM resolved GROUP BY company),
 o AS (SELECT n_name AS company, cast(year(o_orderdate) AS text) AS year_period, c_custkey, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
 trees AS (SELECT company, year_period, count(DISTINCT c_custkey) + count(*) + 1 AS nodes, count(*) AS leaves FROM o GROUP BY ALL),
 s AS (SELECT a.company, a.year_period, CASE WHEN nodes IS NULL THEN 'error' WHEN nodes >= 10 AND leaves >= 3 THEN 'ok' ELSE 'degraded' END AS status FROM asked a LEFT JOIN trees t USING (company, year_period)),
 n AS (SELECT company, count(*) AS years FROM s SEMI JOIN resolved USING (company, year_period) WHERE status <> 'error' GROUP BY company)
 SELECT company, 'tree_verification' AS event_type, status AS detail, count(*) AS events FROM s GROUP BY company, status
 UNION ALL SELECT company, 'year_error', 'error', count(*) FROM s WHERE status = 'error' GROUP BY company UNION ALL SELECT DISTINCT company, 'complete', NULL, 1 FROM s
 UNION ALL SELECT company, 'metric', NULL, years * {len(_SHOWN)} FROM n UNION ALL SELECT company, 'yoy', NULL, {len(_SHOWN)} FROM n WHERE years > 1"""
)
def spread_whole(spark, folder):
    """Spreads of all companies, one year too many asked; a company's tree of a year holds its customers and their orders, and is verified."""
    values = st.resolved(facts(spark, folder))
    keys = values.select("company", "year_period")
    asked = keys.unionByName(keys.groupBy("company").agg((F.max("year_period").cast("int") + 1).cast("string").alias("year_period")))
    orders = run(
        spark,
        folder,
        "SELECT concat(n_name, '|', cast(year(o_orderdate) AS string)) AS doc_pk, n_name, cast(year(o_orderdate) AS string) AS year_period, c_custkey, o_orderkey, o_orderpriority FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey",
    )
    root = orders.select("doc_pk", F.lit("root").alias("node_pk"), F.lit(None).cast("string").alias("parent_pk"), F.lit("").alias("node_text")).distinct()
    inner = orders.select("doc_pk", F.concat(F.lit("c"), "c_custkey").alias("node_pk"), F.lit("root").alias("parent_pk"), F.lit("").alias("node_text")).distinct()
    leaves = orders.select("doc_pk", F.concat(F.lit("o"), "o_orderkey").alias("node_pk"), F.concat(F.lit("c"), "c_custkey").alias("parent_pk"), F.col("o_orderpriority").alias("node_text"))
    report = verify.report(root.unionByName(inner).unionByName(leaves))
    trees = report.select(F.split_part("doc_pk", F.lit("|"), F.lit(1)).alias("company"), F.split_part("doc_pk", F.lit("|"), F.lit(2)).alias("year_period"), "nodes", F.col("leaves_with_text").alias("leaves"))
    made = spread(asked, trees, values)
    detail = F.when(F.col("event_type").isin("tree_verification", "year_error"), F.get_json_object("payload", "$.status"))
    return made.groupBy("company", "event_type", detail.alias("detail")).agg(F.count(F.lit(1)).alias("events"))


# ------------------------------------------------------------------ registry
@query(_sql("SELECT doc_pk, doc_name, company, row_number() OVER (PARTITION BY company ORDER BY created_at DESC, doc_pk DESC) AS newest FROM {REGISTRY} r"))
def company_history(spark, folder):
    """Each company's documents, the newest first."""
    from pyspark.sql import Window

    rows = run(spark, folder, "SELECT doc_pk, doc_name, company, created_at FROM {REGISTRY} r")
    newest = Window.partitionBy("company").orderBy(F.desc("created_at"), F.desc("doc_pk"))
    return rows.select("doc_pk", "doc_name", "company", F.row_number().over(newest).cast("long").alias("newest"))


@query(f"{oracle.resolved_sql()}, sct AS ({oracle.statement_sql()}) SELECT company, section, count(DISTINCT canonical_name) AS metric_count, count(*) AS entries FROM sct GROUP BY company, section")
def nested_metric_count(spark, folder):
    """Statements stored as JSON, sections over lists of metrics, and the distinct metrics counted out of that."""
    rows = st.statement(st.resolved(facts(spark, folder))).groupBy("company", "section").agg(F.collect_list(F.struct("canonical_name", "value", "year_period")).alias("metrics"))
    stored = rows.groupBy("company").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("section", "metrics")))).alias("statement"))
    sections = stored.select("company", F.explode(F.from_json("statement", "map<string, array<struct<canonical_name: string>>>")).alias("section", "metrics"))
    return sections.select("company", "section", F.explode("metrics").alias("m")).groupBy("company", "section").agg(F.count_distinct("m.canonical_name").alias("metric_count"), F.count(F.lit(1)).alias("entries"))

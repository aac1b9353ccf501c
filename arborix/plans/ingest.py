"""Queries on the way from pages to section nodes, and on nested trees as JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborix.functions.text import at_start
from arborix.operators import contents, ingest
from arborix.plans.portable import expand, run
from arborix.plans.registry import query
from arborix.sources import trees
from arborix.sources.tables import conversation_pages, table


def _other(text: str) -> str:
    return expand(text).replace("{conversations}", "conversations")


@query(
    r"""WITH RECURSIVE cut AS (SELECT page_id AS doc_pk, regexp_extract_all(coalesce(html, ''), '(?is)<h[1-6][^>]*>.*?</h[1-6]\s*>') AS marks FROM pages),
h AS (SELECT doc_pk, unnest(range(len(marks))) AS ord, unnest(marks) AS mark FROM cut),
t AS (SELECT doc_pk, ord, cast(substring(mark, 3, 1) AS int) AS level, trim(regexp_replace(regexp_replace(mark, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS title FROM h),
linked AS (SELECT c.doc_pk, c.ord, c.title, max(p.ord) AS above FROM t c LEFT JOIN t p ON c.doc_pk = p.doc_pk AND p.ord < c.ord AND p.level < c.level GROUP BY c.doc_pk, c.ord, c.title),
placed AS (SELECT *, row_number() OVER (PARTITION BY doc_pk, above ORDER BY ord) AS k FROM linked),
walk AS (SELECT doc_pk, ord, cast(k AS text) AS structure, title FROM placed WHERE above IS NULL
 UNION ALL SELECT p.doc_pk, p.ord, w.structure || '.' || cast(p.k AS text), p.title FROM placed p JOIN walk w ON p.doc_pk = w.doc_pk AND p.above = w.ord)
SELECT doc_pk, cast(ord AS int) AS ord, structure, title FROM walk"""
)
def toc_generate(spark, folder):
    """Contents tables out of the headings of marked-up pages."""
    return ingest.generated_toc(table(spark, folder, "pages"), "page_id", "html")


_SQUEEZED = "regexp_replace(lower(coalesce({x}, '')), '\\s+', '', 'g')"
_AT_START = "length(t) > 0 AND (starts_with(p, t) OR len(list_filter(range(length(t) - least(2, length(t) // 8), length(t) + least(2, length(t) // 8) + 1), lambda n: length(t) >= 8 AND levenshtein(substring(p, 1, n), t) <= least(2, length(t) // 8))) > 0)"
_DAMAGED = "(SELECT doc_pk, ord, physical_index, CASE (doc_pk + ord) % 5 WHEN 0 THEN title WHEN 1 THEN replace(title, ' ', '') WHEN 2 THEN concat(substring(title, 1, 5), '#', substring(title, 6, 99)) WHEN 3 THEN concat('  ', upper(substring(title, 1, 3)), ' ', substring(title, 4, 99)) ELSE substring(title, 4, 99) END AS title FROM {TOC} t)"


@query(_other(f"SELECT doc_pk, ord, {_AT_START} AS at_start FROM (SELECT d.doc_pk, d.ord, {_SQUEEZED.replace('{x}', 'd.title')} AS t, {_SQUEEZED.replace('{x}', 'p.text')} AS p FROM {_DAMAGED} d LEFT JOIN {{PAGES}} p ON d.doc_pk = p.doc_pk AND physical_index = page_no) x"))
def titles_at_start(spark, folder):
    """Whether pages begin with their entries' titles, which have lost or gained spaces, signs and capitals.

    Wrong signs count by their octets, as in the SQL. A sign whose capital in Spark is several (ß) stays as it is.
    """
    damaged = _DAMAGED.replace("upper(substring(title, 1, 3))", "array_join(transform(split(substring(title, 1, 3), ''), c -> CASE WHEN length(upper(c)) = 1 THEN upper(c) ELSE c END), '')")
    entries, pages = run(spark, folder, f"SELECT * FROM {damaged} d"), run(spark, folder, "SELECT doc_pk, page_no AS physical_index, text FROM {PAGES} p")
    return entries.join(pages, ["doc_pk", "physical_index"], "left").select("doc_pk", "ord", at_start(F.col("text"), F.col("title"), octets=True).alias("at_start"))


@query(
    _other(f"""WITH RECURSIVE pages AS (SELECT * FROM {{PAGES}} p), total AS (SELECT doc_pk, max(page_no) AS pages FROM pages GROUP BY doc_pk),
apart AS (SELECT doc_pk, physical_index - page AS apart, row_number() OVER (PARTITION BY doc_pk ORDER BY count(*) DESC, min(ord)) AS k FROM {{TOC}} t WHERE physical_index IS NOT NULL AND page IS NOT NULL GROUP BY doc_pk, physical_index - page),
known AS (SELECT t.doc_pk, ord, structure, title, coalesce(page + coalesce(apart, 0), physical_index) AS spot FROM {{TOC}} t LEFT JOIN apart a ON a.doc_pk = t.doc_pk AND k = 1),
near AS (SELECT *, coalesce(last_value(spot IGNORE NULLS) OVER (PARTITION BY doc_pk ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS low,
 first_value(spot IGNORE NULLS) OVER (PARTITION BY doc_pk ORDER BY ord ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS high, count(spot) OVER (PARTITION BY doc_pk ORDER BY ord) AS gap FROM known),
seen AS (SELECT n.doc_pk, gap, ord, list(p.page_no ORDER BY p.page_no) AS pages_with FROM near n JOIN total USING (doc_pk) JOIN pages p ON p.doc_pk = n.doc_pk AND p.page_no BETWEEN greatest(low, 1) AND least(coalesce(high, pages), pages)
 WHERE spot IS NULL AND trim(title) <> '' AND contains(lower(p.text), trim(lower(title), ' ')) GROUP BY n.doc_pk, gap, ord),
turn AS (SELECT *, row_number() OVER (PARTITION BY doc_pk, gap ORDER BY ord) AS k FROM seen),
walk AS (SELECT doc_pk, gap, ord, k, pages_with[1] AS found, pages_with[1] AS low FROM turn WHERE k = 1
 UNION ALL SELECT t.doc_pk, t.gap, t.ord, t.k, list_filter(pages_with, lambda n: n >= low)[1], coalesce(list_filter(pages_with, lambda n: n >= low)[1], low) FROM walk w JOIN turn t ON t.doc_pk = w.doc_pk AND t.gap = w.gap AND t.k = w.k + 1),
placed AS (SELECT k.doc_pk, k.ord, structure, title, coalesce(spot, found) AS physical_index, pages FROM known k JOIN total ON total.doc_pk = k.doc_pk LEFT JOIN walk w ON w.doc_pk = k.doc_pk AND w.ord = k.ord WHERE coalesce(spot, found) <= pages),
entries AS (SELECT * FROM placed UNION ALL SELECT doc_pk, -1, '0', 'Preface', 1, pages FROM (SELECT doc_pk, pages, arg_min(physical_index, ord) AS f FROM placed GROUP BY doc_pk, pages) WHERE f > 1),
squeezed AS (SELECT e.*, {_SQUEEZED.replace("{x}", "title")} AS t, {_SQUEEZED.replace("{x}", "text")} AS p FROM entries e LEFT JOIN pages p ON e.doc_pk = p.doc_pk AND physical_index = page_no),
marked AS (SELECT doc_pk, ord, structure, title, physical_index, pages, {_AT_START} AS at_top FROM squeezed),
ranged AS (SELECT doc_pk, ord, structure, title, physical_index AS start_index, greatest(physical_index, coalesce(lead(physical_index) OVER w - cast(lead(at_top) OVER w AS int), pages)) AS end_index FROM marked WINDOW w AS (PARTITION BY doc_pk ORDER BY ord)),
linked AS (SELECT c.doc_pk, c.ord, c.structure, max(p.ord) AS parent_ord FROM ranged c LEFT JOIN ranged p ON c.doc_pk = p.doc_pk AND p.ord < c.ord AND position('.' IN c.structure) > 0 AND p.structure = split_part(c.structure, '.', 1) GROUP BY ALL),
ids AS (SELECT doc_pk, ord, parent_ord, lpad(cast(row_number() OVER (PARTITION BY doc_pk ORDER BY coalesce(lpad(cast(parent_ord + 1 AS text), 9, '0') || '.', '') || lpad(cast(ord + 1 AS text), 9, '0')) - 1 AS text), 4, '0') AS node_id FROM linked),
texts AS (SELECT r.doc_pk, r.ord, string_agg(p.text, chr(10) ORDER BY p.page_no) AS node_text FROM ranged r JOIN pages p ON r.doc_pk = p.doc_pk AND p.page_no BETWEEN start_index AND end_index GROUP BY r.doc_pk, r.ord)
SELECT r.doc_pk, i.node_id, j.node_id AS parent_id, structure, title, start_index, end_index, regexp_extract(node_text, '^\\s*([^.]*\\.?(?:[^.]*\\.)?)', 1, 's') AS summary, node_text
FROM ranged r JOIN ids i ON r.doc_pk = i.doc_pk AND r.ord = i.ord LEFT JOIN ids j ON i.doc_pk = j.doc_pk AND i.parent_ord = j.ord LEFT JOIN texts t ON r.doc_pk = t.doc_pk AND r.ord = t.ord""")
)
def ingest_whole(spark, folder):
    """Conversations as documents, from contents entries by logical pages to numbered nodes: entries placed by offset and by title, large leaves divided.

    No conversation has headings on its pages or leaves above the limits, so the SQL does without them; tests have both.
    """
    return ingest.ingested_whole(run(spark, folder, "SELECT doc_pk, ord, structure, title, page, physical_index FROM {TOC} t"), conversation_pages(spark, folder), octets=True)


_LINES = "SELECT o_orderkey AS doc_pk, o_orderpriority AS doc_name, l_linenumber AS node_no, count(*) AS pages FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderpriority, l_linenumber"


@query(
    """WITH l AS (SELECT o_orderkey AS doc_pk, l_linenumber AS node_no, count(*) AS pages FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY doc_pk ORDER BY node_no) - 1 AS i FROM l)
SELECT doc_pk, '0000' AS path, cast(NULL AS text) AS parent_path, 0 AS depth, 0 AS child_order, 'order' AS title, cast(1 AS bigint) AS start_index, max(pages) AS end_index FROM k GROUP BY doc_pk
UNION ALL SELECT doc_pk, '0000' || lpad(cast(i AS text), 4, '0'), '0000', 1, i, 'line ' || cast(node_no AS text), 1, pages FROM k"""
)
def json_tree_scan(spark, folder):
    """Orders written as nested JSON trees with their lines as children, and read back as node rows."""
    return trees.nodes(_orders(spark, folder), "doc_pk", "raw_json", depth=2)


def _orders(spark, folder):
    lines = run(spark, folder, _LINES)
    kid = F.struct(F.concat(F.lit("line "), F.col("node_no").cast("string")).alias("title"), F.lit(1).alias("start_index"), F.col("pages").alias("end_index"))
    docs = lines.groupBy("doc_pk", "doc_name").agg(F.array_sort(F.collect_list(F.struct("node_no", kid.alias("kid")))).alias("k"), F.max("pages").alias("pages"))
    root = F.struct(F.lit("order").alias("title"), F.lit(1).alias("start_index"), F.col("pages").alias("end_index"), F.col("k.kid").alias("nodes"))
    return docs.select("doc_pk", "doc_name", F.to_json(F.struct(F.col("doc_name"), F.array(root).alias("structure"))).alias("raw_json"))


@query(
    """SELECT doc_pk, true AS same, sha256(concat('{"doc_name":"', doc_name, '","structure":[{"title":"order","start_index":1,"end_index":', cast(max(pages) AS text), ',"nodes":[',
 string_agg(concat('{"title":"line ', cast(node_no AS text), '","start_index":1,"end_index":', cast(pages AS text), '}'), ',' ORDER BY node_no), ']}]}')) AS digest
 FROM (SELECT o_orderkey AS doc_pk, o_orderpriority AS doc_name, l_linenumber AS node_no, count(*) AS pages FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL) x GROUP BY doc_pk, doc_name"""
)
def json_round_trip(spark, folder):
    """Orders as nested JSON, read as node rows, which are written, read and folded into JSON again: whether it is the same, and its digest."""
    docs = _orders(spark, folder)
    again = trees.rebuilt(trees.nodes(docs, "doc_pk", "raw_json", depth=2), docs, "doc_pk")
    first, second = (trees.canonical(F.col(c), depth=2) for c in ("raw_json", "again"))
    both = docs.select("doc_pk", "raw_json").join(again.select("doc_pk", F.col("raw_json").alias("again")), "doc_pk", "left")
    return both.select("doc_pk", first.eqNullSafe(second).alias("same"), F.sha2(second, 256).alias("digest"))


_FOUND_SQL = """p AS (SELECT doc_pk, page_no, text, role = 'user' AS yes FROM {PAGES} x WHERE page_no <= 20),
ends AS (SELECT n.doc_pk, min(n.page_no) AS stop FROM p n WHERE NOT yes AND EXISTS (SELECT 1 FROM p y WHERE y.doc_pk = n.doc_pk AND y.yes AND y.page_no < n.page_no) GROUP BY n.doc_pk),
content AS (SELECT p.doc_pk, count(*) AS pages, regexp_replace(regexp_replace(string_agg(text, '' ORDER BY page_no), '\\.{5,}', ': ', 'g'), '(?:\\. ){5,}\\.?', ': ', 'g') AS content
 FROM p LEFT JOIN ends e ON p.doc_pk = e.doc_pk WHERE yes AND (stop IS NULL OR page_no < stop) GROUP BY p.doc_pk)"""


def _printed(spark, folder):
    """Contents pages by a detector's answers: the user's turns are some; of the rest every fifth cannot be read."""
    pages = run(spark, folder, "SELECT doc_pk, page_no, text, role FROM {PAGES} p")
    answer = F.when(F.col("role") == "user", '{"toc_detected": "yes"}').when(F.col("page_no") % 5 == 0, "cannot tell").otherwise('{"toc_detected": "no",}')
    return contents.contents_pages(pages.withColumn("toc_detected", contents.said(answer, "toc_detected")))


@query(_other(f"WITH {_FOUND_SQL} SELECT doc_pk, pages, content FROM content"))
def toc_extracted(spark, folder):
    """The contents pages of conversations by a detector's answers, and their text; an answer that cannot be read is a no."""
    found = _printed(spark, folder)
    return contents.contents_text(found).join(found.groupBy("doc_pk").agg(F.count(F.lit(1)).alias("pages")), "doc_pk")


#: Characters of a contents text that one answer of the offline transcriber turns into an entry.
_STRETCH = 240


def _next_entry(content, so_far):
    """The offline transcriber: the next stretch of the text as an entry, the object opened before the first and closed after the last."""
    made = F.size(F.split(so_far, '"structure"')) - 1
    last = (made + 1) * _STRETCH >= F.length(content)
    entry = F.to_json(F.struct((made + 1).cast("string").alias("structure"), F.substr(content, made * _STRETCH + 1, F.lit(_STRETCH)).alias("title"), (made + 2).cast("string").alias("page")))
    text = F.concat(F.when(made == 0, '{"table_of_contents": [').otherwise(", "), entry, F.when(last, "]}").otherwise(""))
    return F.struct(text.alias("answer"), F.lit(True).alias("finished"))


def _whole(content, so_far):
    return F.when(F.endswith(so_far, F.lit("]}")), '{"completed": "yes"}').otherwise('{"completed": "no"}')


@query(
    _other(f"""WITH {_FOUND_SQL}, cut AS (SELECT doc_pk, content, greatest(1, cast(ceil(length(content) / {_STRETCH}.0) AS int)) AS n FROM content),
e AS (SELECT doc_pk, content, unnest(range(n)) AS ord FROM cut WHERE n <= 6)
SELECT doc_pk, cast(ord AS int) AS ord, cast(ord + 1 AS text) AS structure, substring(content, ord * {_STRETCH} + 1, {_STRETCH}) AS title, cast(ord + 2 AS int) AS page FROM e""")
)
def toc_transcribed(spark, folder):
    """Contents texts turned into entries answer by answer, five continuations at most; what is still cut off after that gives none."""
    return contents.transcribed(contents.contents_text(_printed(spark, folder)), _next_entry, _whole)

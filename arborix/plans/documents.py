"""Queries on the document registry, on pages and chunks, on text scalars and on vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborix.operators import chunks, filters, keywords, vectors
from arborix.plans.portable import portable
from arborix.plans.registry import query
from arborix.sources.tables import conversation_pages, stored, table

# ------------------------------------------------------------------ registry
portable("latest_document", "SELECT company, year_period, doc_name, created_at FROM (SELECT *, row_number() OVER (PARTITION BY company, year_period ORDER BY created_at DESC, doc_pk DESC) AS k FROM {REGISTRY} r) x WHERE k = 1")
portable("document_lookup", "SELECT doc_pk, doc_name, company, year_period FROM {REGISTRY} r WHERE doc_pk = 7 OR doc_name = 'src3-3'")
portable("list_companies", "SELECT DISTINCT company FROM {REGISTRY} r WHERE company IS NOT NULL AND company <> ''")
portable(
    "list_documents",
    "SELECT d.doc_pk, d.doc_name, count(n.page_no) AS node_count FROM {REGISTRY} d LEFT JOIN {PAGES} n ON d.doc_pk = n.doc_pk GROUP BY d.doc_pk, d.doc_name",
)
portable(
    "doc_checksum",
    "SELECT doc_pk, sha2(coalesce(raw_json, ''), 256) AS checksum FROM {REGISTRY} r",
    "SELECT doc_pk, sha256(coalesce(raw_json, '')) AS checksum FROM {REGISTRY} r",
)
portable(
    "doc_upsert",
    """SELECT doc_name, company, year_period FROM {REGISTRY} a WHERE NOT EXISTS (SELECT 1 FROM {REGISTRY} b WHERE b.doc_pk % 10 = 3 AND b.doc_name = a.doc_name)
 UNION ALL SELECT doc_name, 'replaced' AS company, year_period FROM {REGISTRY} c WHERE doc_pk % 10 = 3""",
)
portable(
    "workflow_history",
    "SELECT user_id AS workflow_id, max(ts) AS created_at, count(*) AS event_count, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS purchases FROM {events} GROUP BY user_id",
    "SELECT user_id AS workflow_id, max(ts) AS created_at, count(*) AS event_count, cast(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS bigint) AS purchases FROM {events} GROUP BY user_id",
)
portable("workflow_metric_count", "SELECT user_id AS workflow_id, count(DISTINCT event_type) AS metric_count FROM {events} WHERE value IS NOT NULL GROUP BY user_id")

# ------------------------------------------------------------------ pages and chunks
portable(
    "page_tokens",
    r"SELECT doc_pk, page_no, cast(size(regexp_extract_all(text, '[^ ]+', 0)) AS bigint) AS token_count FROM {PAGES} p",
    "SELECT doc_pk, page_no, cast(len(regexp_extract_all(text, '[^ ]+')) AS bigint) AS token_count FROM {PAGES} p",
)
portable("page_tags", "SELECT doc_pk, page_no, concat('<physical_index_', cast(page_no AS string), '>', text, '<physical_index_', cast(page_no AS string), '>') AS tagged FROM {PAGES} p")
portable("page_batches", "SELECT doc_pk, batch_no, count(*) AS pages, min(page_no) AS first_page, max(page_no) AS last_page FROM (SELECT *, (page_no - 1) // 3 AS batch_no FROM {PAGES} p) x GROUP BY doc_pk, batch_no")
_CHUNK_SQL = """SELECT doc_id, i AS chunk_index, substring(text, cast(i * 3800 + 1 AS int), 4000) AS content
 FROM (SELECT doc_id, text, unnest(range(0, (length(text) - 1) // 3800 + 1)) AS i FROM documents WHERE trim(text) <> '' AND length(text) > 4000
 UNION ALL SELECT doc_id, text, 0 AS i FROM documents WHERE trim(text) <> '' AND length(text) <= 4000)"""


@query(f"SELECT doc_id, cast(chunk_index AS bigint) AS chunk_index, content FROM ({_CHUNK_SQL})")
def char_chunks(spark, folder):
    return chunks.char_chunks(table(spark, folder, "documents").where(F.trim("text") != ""), "doc_id", "text")


@query(f"SELECT doc_id, cast(chunk_index AS bigint) AS chunk_index, sha256(concat(source, '|', cast(doc_id AS string), '|', cast(chunk_index AS string), '|', content)) AS id FROM ({_CHUNK_SQL}) JOIN (SELECT doc_id AS d, source FROM documents) ON d = doc_id")
def chunk_ids(spark, folder):
    docs = table(spark, folder, "documents").where(F.trim("text") != "")
    made = chunks.char_chunks(docs, "doc_id", "text", keep=["source"])
    return made.select("doc_id", "chunk_index", chunks.chunk_id(F.col("source"), F.col("doc_id"), F.col("chunk_index"), F.col("content")).alias("id"))


_RUNS = """WITH RECURSIVE p AS (SELECT conv_id AS doc_pk, turn + 1 AS page_no, len(regexp_extract_all(coalesce(text, ''), '[^ ]+')) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
 most AS (SELECT doc_pk, {most} AS most FROM p GROUP BY doc_pk),
 walk AS (SELECT doc_pk, k, 0 AS chunk_no, page_no AS page_start, page_no AS page_end, n AS total, n AS last FROM p WHERE k = 1
 UNION ALL SELECT w.doc_pk, p.k, CASE WHEN total + n > most THEN chunk_no + 1 ELSE chunk_no END, CASE WHEN total + n > most THEN w.page_end ELSE page_start END, p.page_no,
  CASE WHEN total + n > most THEN last + n ELSE total + n END, n FROM walk w JOIN most m ON w.doc_pk = m.doc_pk JOIN p ON w.doc_pk = p.doc_pk AND p.k = w.k + 1)
 SELECT doc_pk, cast(chunk_no AS bigint) AS chunk_no, min(page_start) AS page_start, max(page_end) AS page_end, cast(max(total) AS bigint) AS token_count FROM walk GROUP BY doc_pk, chunk_no"""


@query(_RUNS.replace("{most}", "120"))
def token_chunks(spark, folder):
    """Runs of pages with at most 120 tokens, the last page of one repeated as the first of the next."""
    return chunks.token_chunks(conversation_pages(spark, folder), limit=120)


@query(_RUNS.replace("{most}", "CASE WHEN sum(n) <= 120 THEN 120 ELSE ceil((sum(n) / ceil(sum(n) / 120) + 120) / 2) END"))
def token_chunks_balanced(spark, folder):
    """The same with a limit lowered by document, so that the last run isn't much shorter than the others."""
    return chunks.token_chunks(conversation_pages(spark, folder), limit=120, balanced=True)


# ------------------------------------------------------------------ scalars
portable(
    "text_head_tail",
    "SELECT doc_id, CASE WHEN n <= 300 THEN t ELSE substring(t, 1, 200) END AS head, CASE WHEN n <= 300 THEN '' ELSE right(t, 100) END AS tail FROM (SELECT doc_id, trim(coalesce(text, '')) AS t, length(trim(coalesce(text, ''))) AS n FROM {documents}) x",
)
portable("source_label", "SELECT doc_pk, concat(doc_name, ' ', year_period, ', pp. ', cast(doc_pk % 9 + 1 AS string), '-', cast(doc_pk % 9 + 4 AS string)) AS label FROM {REGISTRY} r")
portable(
    "name_resolution",
    r"SELECT p_partkey, trim(regexp_replace(replace(replace(lower(trim(concat(p_name, ' / ', p_type, ' (x)'))), '(loss)', ''), '(x)', ''), '\\s*/\\s*', ' / ')) AS key, trim(substring_index(lower(concat(p_type, ' (x)')), '(', 1)) AS base FROM {part}",
    r"SELECT p_partkey, trim(regexp_replace(replace(replace(lower(trim(concat(p_name, ' / ', p_type, ' (x)'))), '(loss)', ''), '(x)', ''), '\s*/\s*', ' / ', 'g')) AS key, trim(split_part(lower(concat(p_type, ' (x)')), '(', 1)) AS base FROM {part}",
)
portable(
    "toc_clean_dots",
    r"SELECT page_id, regexp_replace(regexp_replace(concat(url, ' ....... ', cast(page_id AS string), ' . . . . . . 7'), '\\.\\.\\.\\.\\.+', ': '), '\\. \\. \\. \\. (?:\\. )+\\.?', ': ') AS cleaned FROM {pages}",
    r"SELECT page_id, regexp_replace(regexp_replace(concat(url, ' ....... ', cast(page_id AS string), ' . . . . . . 7'), '\.\.\.\.\.+', ': ', 'g'), '\. \. \. \. (?:\. )+\.?', ': ', 'g') AS cleaned FROM {pages}",
)
portable(
    "row_index_map",
    r"SELECT r.canonical_name, min(i.row_index) AS row_index FROM (SELECT DISTINCT p_name AS canonical_name FROM {part}) r JOIN (SELECT p_partkey AS row_index, trim(replace(lower(CASE p_partkey % 3 WHEN 0 THEN concat(' ', upper(p_name)) WHEN 1 THEN concat(p_name, ' (x)') ELSE p_type END), '(x)', '')) AS key FROM {part}) i ON i.key = lower(trim(r.canonical_name)) GROUP BY r.canonical_name",
)


@query(
    """SELECT name, concat('Find the exact numeric value of ''', name, '''', CASE WHEN others IS NULL THEN '' ELSE concat(' (also known as: ', others, ')') END, '. Return only the numeric figure. If the value is presented with parentheses indicating a negative amount, treat it as negative.') AS query_text
 FROM (SELECT name, string_agg(s, ', ' ORDER BY k) FILTER (WHERE r <= 6) AS others FROM (SELECT name, s, k, row_number() OVER (PARTITION BY name ORDER BY k) AS r
 FROM (SELECT p_brand AS name, min(p_partkey) AS k, arg_min(CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END, p_partkey) AS s FROM part GROUP BY p_brand, lower(p_name)) x) y GROUP BY name)"""
)
def search_query_text(spark, folder):
    """Brands as metrics, part names as their other names: each name's first spelling goes into the brand's list, not each part."""
    from arborix.functions.text import search_text

    spelt = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name"))
    names = table(spark, folder, "part").groupBy(F.col("p_brand").alias("name"), F.lower("p_name").alias("key")).agg(F.min("p_partkey").alias("k"), F.min_by(spelt, "p_partkey").alias("s"))
    listed = names.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("k", "s"))).alias("l"))
    return listed.select("name", search_text(F.col("name"), F.col("l.s")).alias("query_text"))


_ANSWER = """(SELECT event_id, CASE event_id % 5 WHEN 0 THEN concat('Revenue was ', cast(v AS string), ' million.') WHEN 1 THEN concat('(', cast(v AS string), ')') WHEN 2 THEN concat('about ', cast(v // 7 AS string), ',', '250 units')
 WHEN 3 THEN concat(cast(v AS string), ' bn') ELSE 'none' END AS answer FROM (SELECT event_id, cast(floor(coalesce(value, 0)) AS bigint) AS v FROM {events}) e)"""


@query(
    rf"""SELECT event_id, round(try_cast(replace(regexp_extract(t, '-?[\d,.]+\.?\d*'), ',', '') AS double) * scale, 2) + 0.0 AS value FROM (SELECT event_id,
 CASE WHEN regexp_matches(a, '\b(billion|bn)\b') THEN 1e9 WHEN regexp_matches(a, '\b(million|mm|mil)\b') THEN 1e6 WHEN regexp_matches(a, '\b(thousand|k)\b') THEN 1e3 ELSE 1.0 END AS scale,
 CASE WHEN regexp_matches(c, '\(\s*[\d.]+\s*\)') THEN concat('-', regexp_extract(c, '\(\s*([\d.]+)\s*\)', 1)) ELSE c END AS t
 FROM (SELECT event_id, lower(answer) AS a, regexp_replace(regexp_replace(answer, '(\d),(\d)', '\1\2', 'g'), '(\d),(\d)', '\1\2', 'g') AS c FROM {_ANSWER.replace("{events}", "events")} q) x) y"""
)
def numeric_extract(spark, folder):
    """The first number of an answer, with its scale word; brackets make it negative."""
    from arborix.functions.text import numeric_value
    from arborix.plans.portable import run

    return run(spark, folder, f"SELECT * FROM {_ANSWER} q").select("event_id", numeric_value(F.col("answer")).alias("value"))


@query("SELECT event_id, value, event_type AS kind FROM events")
def lenient_json(spark, folder):
    """Answers with fences, trailing commas and None, read as JSON where they can be."""
    from arborix.functions.text import lenient_object

    raw = F.concat(F.lit("Here:\n```json\n{\"value\": "), F.coalesce(F.col("value").cast("string"), F.lit("None")), F.lit(",\n\"kind\": \""), "event_type", F.lit("\",}\n```"))
    return table(spark, folder, "events").select("event_id", lenient_object(raw, "value double, kind string").alias("o")).select("event_id", "o.value", "o.kind")


# ------------------------------------------------------------------ vectors
portable("embedding_dims", "SELECT size(embedding) AS dimensions, count(*) AS vectors FROM {embeddings} GROUP BY size(embedding)", "SELECT cast(len(embedding) AS int) AS dimensions, count(*) AS vectors FROM {embeddings} GROUP BY len(embedding)")
_COSINE = "round(list_dot_product(a.e, q.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(q.e, q.e))), 6)"
_NEAR = "(SELECT a.vec_id, a.label, {cos} AS score FROM (SELECT vec_id, label, cast(embedding AS double[]) AS e FROM embeddings) a, (SELECT cast(embedding AS double[]) AS e FROM embeddings WHERE vec_id = 0) q)".replace("{cos}", _COSINE)


@query(f"SELECT vec_id, score FROM {_NEAR} ORDER BY score DESC, vec_id LIMIT 20")
def knn_topk(spark, folder):
    vecs = table(spark, folder, "embeddings")
    return vectors.nearest(vecs, vectors.query_vector(vecs, "vec_id", 0), "vec_id", 20).select("vec_id", "score")


@query(f"SELECT vec_id, label, score FROM {_NEAR} WHERE label = 1 ORDER BY score DESC, vec_id LIMIT 10")
def knn_filtered(spark, folder):
    vecs = table(spark, folder, "embeddings")
    return vectors.nearest(vecs.where("label = 1"), vectors.query_vector(vecs, "vec_id", 0), "vec_id", 10).select("vec_id", "label", "score")


@query(
    f"""WITH v AS (SELECT vec_id, score, row_number() OVER (ORDER BY score DESC, vec_id) AS r FROM {_NEAR} ORDER BY score DESC, vec_id LIMIT 50),
t AS (SELECT doc_id, cast((length(lower(text)) - length(replace(lower(text), 'the', ''))) // 3 AS bigint) AS hits FROM documents),
k AS (SELECT doc_id, row_number() OVER (ORDER BY hits DESC, doc_id) AS r FROM t WHERE hits > 0 ORDER BY hits DESC, doc_id LIMIT 50)
SELECT coalesce(vec_id, doc_id) AS id, round(coalesce(1.0 / (60 + v.r), 0) + coalesce(1.0 / (60 + k.r), 0), 6) AS score FROM v FULL JOIN k ON vec_id = doc_id"""
)
def hybrid_search(spark, folder):
    """Vector and keyword ranks of one query, fused by reciprocal ranks."""
    vecs = table(spark, folder, "embeddings")
    near = vectors.nearest(vecs, vectors.query_vector(vecs, "vec_id", 0), "vec_id", 50).select(F.col("vec_id").alias("id"), "score")
    lower = F.lower("text")
    hits = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), F.expr("0").alias("z"), ((F.length(lower) - F.length(F.replace(lower, F.lit("the"), F.lit("")))) / 3).cast("long").alias("score"))
    return vectors.fused(near, vectors.top(hits.where("score > 0").drop("z"), "id", 50))


# ------------------------------------------------------------------ many questions
_W = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"
_WORDS_SQL = f"""WITH size AS (SELECT doc_id AS id, len({_W}) AS n FROM documents), mean AS (SELECT count(*) AS n, avg(n) AS m FROM size),
p AS (SELECT id, word, count(*) AS times FROM (SELECT doc_id AS id, unnest({_W}) AS word FROM documents) x GROUP BY id, word),
q AS (SELECT question, word, count(*) AS weight FROM (SELECT item_id AS question, unnest({_W}) AS word FROM benchmark) x GROUP BY question, word),
df AS (SELECT word, count(*) AS df FROM p GROUP BY word),
s AS (SELECT question, id, round(sum(weight * ln(1 + (mean.n - df + 0.5) / (df + 0.5)) * times * 2.2 / (times + 1.2 * (0.25 + 0.75 * size.n / mean.m))), 6) AS score
 FROM q JOIN df USING (word) JOIN p USING (word) JOIN size USING (id) CROSS JOIN mean GROUP BY question, id),
k AS (SELECT * FROM (SELECT question, id, score, row_number() OVER (PARTITION BY question ORDER BY score DESC, id) AS rank FROM s) x WHERE rank <= 50)"""
_EACH = "round(list_dot_product(a.e, q.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(q.e, q.e))), 6)"
_EACH_SQL = f"""SELECT * FROM (SELECT question, id, score, row_number() OVER (PARTITION BY question ORDER BY score DESC, id) AS rank FROM (SELECT q.vec_id AS question, a.vec_id AS id, {_EACH} AS score
 FROM (SELECT vec_id, cast(embedding AS double[]) AS e FROM embeddings WHERE {{rows}}) a CROSS JOIN (SELECT vec_id, cast(embedding AS double[]) AS e FROM embeddings WHERE {{asked}}) q) x) y WHERE rank <= {{k}}"""


def _keywords(spark, folder):
    docs = table(spark, folder, "documents")
    return keywords.ranked(keywords.postings(docs, "doc_id", "text"), keywords.totals(docs, "text"), table(spark, folder, "benchmark"), "item_id", "text", k=50)


def _asked(spark, folder, condition):
    return table(spark, folder, "embeddings").where(condition).select(F.col("vec_id").alias("question"), "embedding")


@query(f"{_WORDS_SQL} SELECT * FROM k")
def keyword_search(spark, folder):
    """The 50 best texts for each benchmark passage by its words."""
    return _keywords(spark, folder)


@query(_EACH_SQL.replace("{rows}", "true").replace("{asked}", "vec_id % 20 = 0").replace("{k}", "10"))
def knn_each(spark, folder):
    """The ten nearest vectors of each twentieth one, exactly."""
    return vectors.nearest_to_each(table(spark, folder, "embeddings"), _asked(spark, folder, "vec_id % 20 = 0"), "vec_id", k=10, dimension=64)


@query(None)
def knn_indexed(spark, folder):
    """The same by an index of 64 cells, of which each question reads as many as find 0.95 of the neighbours of a sample."""
    rows = table(spark, folder, "embeddings").where(vectors.usable(F.col("embedding"), 64))
    centre = vectors.centres(rows, "vec_id", count=64)
    rows = stored(vectors.with_cells(rows, centre).repartitionByRange("cell", "vec_id"))
    probes = vectors.probes_for(rows, "vec_id", k=10, dimension=64, centre=centre)
    return vectors.nearest_to_each(rows, _asked(spark, folder, "vec_id % 20 = 0"), "vec_id", k=10, dimension=64, centre=centre, probes=probes)


@query(_EACH_SQL.replace("{rows}", "label >= 3 AND (label < 7 OR vec_id <> 12) AND label IS NOT NULL").replace("{asked}", "vec_id % 20 = 0").replace("{k}", "10"))
def knn_where(spark, folder):
    """The nearest vectors among those that a condition in the clients' notation leaves."""
    rows = filters.filtered(table(spark, folder, "embeddings"), "label ge 3 and (label lt 7 or vec_id ne 12) and label ne null", fields=["label", "vec_id"])
    return vectors.nearest_to_each(rows, _asked(spark, folder, "vec_id % 20 = 0"), "vec_id", k=10, dimension=64)


@query(
    f"""{_WORDS_SQL}, v AS ({_EACH_SQL.replace("{rows}", "true").replace("{asked}", "vec_id IN (SELECT item_id FROM benchmark)").replace("{k}", "50")})
SELECT * FROM (SELECT question, id, score, row_number() OVER (PARTITION BY question ORDER BY score DESC, id) AS rank FROM (SELECT question, id, round(coalesce(1.0 / (60 + v.rank), 0) + coalesce(1.0 / (60 + k.rank), 0), 6) AS score
 FROM v FULL JOIN k USING (question, id)) x) y WHERE rank <= 10"""
)
def hybrid_questions(spark, folder):
    """Benchmark passages as questions: the ten best texts of each by words and vector together."""
    asked = table(spark, folder, "benchmark").select(F.col("item_id").alias("vec_id"))
    asked = table(spark, folder, "embeddings").join(asked, "vec_id", "left_semi").select(F.col("vec_id").alias("question"), "embedding")
    near = vectors.nearest_to_each(table(spark, folder, "embeddings"), asked, "vec_id", k=50, dimension=64)
    return vectors.fused_each(near, _keywords(spark, folder), k=10)

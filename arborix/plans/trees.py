"""Queries on contents tables, section forests and searches in them."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborix.operators import forest, search, verify
from arborix.plans.portable import expand, portable, run
from arborix.plans.registry import query
from arborix.sources.tables import conversation_pages, table

# ------------------------------------------------------------------ contents tables
portable(
    "toc_parse_index",
    r"SELECT doc_pk, ord, try_cast(regexp_extract(tag, '(\\d+)', 1) AS int) AS page_number FROM (SELECT doc_pk, ord, CASE WHEN ord % 4 = 3 THEN 'none' ELSE concat('<physical_index_', cast(page AS string), '> of 9') END AS tag FROM {TOC} t) x",
    r"SELECT doc_pk, ord, try_cast(regexp_extract(tag, '(\d+)', 1) AS int) AS page_number FROM (SELECT doc_pk, ord, CASE WHEN ord % 4 = 3 THEN 'none' ELSE concat('<physical_index_', cast(page AS string), '> of 9') END AS tag FROM {TOC} t) x",
)
portable("toc_truncate", "SELECT doc_pk, ord, structure, CASE WHEN physical_index > 5 THEN NULL ELSE physical_index END AS physical_index FROM {TOC} t")
portable(
    "toc_preface",
    """SELECT doc_pk, ord, structure, title, physical_index FROM {TOC} t WHERE physical_index IS NOT NULL
 UNION ALL SELECT doc_pk, -1 AS ord, '0' AS structure, 'Preface' AS title, 1 AS physical_index FROM {TOC} u WHERE physical_index IS NOT NULL GROUP BY doc_pk HAVING min(physical_index) > 1""",
)
portable(
    "toc_matching_pairs",
    "SELECT a.doc_pk, a.ord AS toc_ord, b.ord AS found_ord, a.page, b.physical_index FROM {TOC} a JOIN {TOC} b ON a.doc_pk = b.doc_pk AND a.title = b.title AND b.physical_index >= a.page",
)
_OFFSETS = """SELECT doc_pk, page_offset FROM (SELECT doc_pk, page_offset, row_number() OVER (PARTITION BY doc_pk ORDER BY n DESC, first_ord) AS k
 FROM (SELECT doc_pk, physical_index - page AS page_offset, count(*) AS n, min(ord) AS first_ord FROM {TOC} t WHERE physical_index IS NOT NULL GROUP BY doc_pk, physical_index - page) x) y WHERE k = 1"""
portable("page_offset_mode", _OFFSETS)
portable("toc_apply_offset", f"SELECT t.doc_pk, ord, coalesce(page + page_offset, physical_index) AS physical_index FROM {{TOC}} t LEFT JOIN ({_OFFSETS}) o ON t.doc_pk = o.doc_pk")
portable(
    "toc_gap_bounds",
    """SELECT doc_pk, ord, coalesce(last_value(physical_index) IGNORE NULLS OVER (PARTITION BY doc_pk ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS low,
 coalesce(first_value(physical_index) IGNORE NULLS OVER (PARTITION BY doc_pk ORDER BY ord ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), count(*) OVER (PARTITION BY doc_pk) + 1) AS high FROM {TOC} t""",
    """SELECT doc_pk, ord, coalesce(last_value(physical_index IGNORE NULLS) OVER (PARTITION BY doc_pk ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS low,
 coalesce(first_value(physical_index IGNORE NULLS) OVER (PARTITION BY doc_pk ORDER BY ord ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), count(*) OVER (PARTITION BY doc_pk) + 1) AS high FROM {TOC} t""",
)
portable(
    "toc_pages",
    """SELECT doc_pk, page_no FROM (SELECT doc_pk, page_no, flag, coalesce(sum(CASE WHEN flag = 'no' AND seen > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_pk ORDER BY page_no), 0) AS stops
 FROM (SELECT doc_pk, page_no, CASE WHEN role = 'user' THEN 'yes' ELSE 'no' END AS flag, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_pk ORDER BY page_no) AS seen FROM {PAGES} p WHERE page_no <= 20) x) y
 WHERE flag = 'yes' AND stops = 0""",
)
portable("appear_start", "SELECT t.doc_pk, t.ord, CASE WHEN t.physical_index IS NOT NULL AND substring(p.text, 1, length(t.title)) = t.title THEN 'yes' ELSE 'no' END AS appear_start FROM {TOC} t LEFT JOIN {PAGES} p ON t.doc_pk = p.doc_pk AND t.physical_index = p.page_no")
portable("toc_locate_titles", "SELECT t.doc_pk, t.ord, min(p.page_no) AS physical_index FROM {TOC} t LEFT JOIN {PAGES} p ON t.doc_pk = p.doc_pk AND position(t.title IN p.text) > 0 GROUP BY t.doc_pk, t.ord")
_RANGES_SQL = """SELECT doc_pk, ord, structure, title, start_index, greatest(start_index, coalesce(CASE WHEN next_start = 'yes' THEN next_index - 1 ELSE next_index END, pages)) AS end_index
 FROM (SELECT doc_pk, ord, structure, title, ord + 1 AS start_index, lead(ord + 1) OVER (PARTITION BY doc_pk ORDER BY ord) AS next_index, lead(appear_start) OVER (PARTITION BY doc_pk ORDER BY ord) AS next_start,
 count(*) OVER (PARTITION BY doc_pk) AS pages FROM {TOC} t) x"""
portable("toc_page_ranges", _RANGES_SQL)


@query(
    expand(
        """SELECT c.doc_pk, c.ord, c.structure, max(p.ord) AS parent_ord FROM {TOC} c LEFT JOIN {TOC} p
 ON c.doc_pk = p.doc_pk AND p.ord < c.ord AND p.structure = CASE WHEN position('.' IN c.structure) > 0 THEN split_part(c.structure, '.', 1) END GROUP BY c.doc_pk, c.ord, c.structure"""
    ).replace("{conversations}", "conversations")
)
def toc_to_tree(spark, folder):
    return forest.parents(run(spark, folder, "SELECT doc_pk, ord, structure FROM {TOC} t"))


@query(
    expand(
        f"SELECT r.doc_pk, r.ord, string_agg(p.text, chr(10) ORDER BY p.page_no) AS node_text FROM ({_RANGES_SQL}) r JOIN {{PAGES}} p ON r.doc_pk = p.doc_pk AND p.page_no BETWEEN r.start_index AND r.end_index GROUP BY r.doc_pk, r.ord"
    ).replace("{conversations}", "conversations")
)
def node_text(spark, folder):
    return forest.texts(run(spark, folder, _RANGES_SQL), run(spark, folder, "SELECT doc_pk, page_no, text FROM {PAGES} p"))



@query(
    expand(
        f"SELECT doc_pk, ord, pages, tokens FROM (SELECT r.doc_pk, r.ord, r.end_index - r.start_index + 1 AS pages, cast(sum(len(regexp_extract_all(p.text, '[^ ]+'))) AS bigint) AS tokens FROM ({_RANGES_SQL}) r JOIN {{PAGES}} p ON r.doc_pk = p.doc_pk AND p.page_no BETWEEN r.start_index AND r.end_index GROUP BY r.doc_pk, r.ord, r.end_index, r.start_index) x WHERE pages > 1 AND tokens >= 60"
    ).replace("{conversations}", "conversations")
)
def large_nodes(spark, folder):
    """Sections of over one page and at least 60 tokens; conversations are short, real documents take ten pages and 20,000 tokens."""
    return forest.large(run(spark, folder, _RANGES_SQL), conversation_pages(spark, folder), pages_above=1, tokens_from=60)


# ------------------------------------------------------------------ forests
portable("forest_scan", "SELECT node_pk, parent_pk, child_order, depth, title FROM {NODES} n")
portable("forest_paths", "SELECT concat('o', cast(o_orderkey AS string)) AS node_pk, concat(r_name, ' > ', n_name, ' > ', c_name, ' > ', o_orderpriority) AS path FROM {PATHS} p")
portable("forest_leaves", "SELECT n.node_pk, n.depth FROM {NODES} n WHERE NOT EXISTS (SELECT 1 FROM {NODES} c WHERE c.parent_pk = n.node_pk)")
portable("leaves_with_text", "SELECT source AS parent_pk, doc_id AS leaf_pk, length(text) AS characters FROM {documents} WHERE trim(coalesce(text, '')) <> ''")
portable("subtree_stats", "SELECT root_pk, count(*) AS nodes, max(depth) AS max_depth, sum(CASE WHEN depth = 3 THEN 1 ELSE 0 END) AS leaves FROM {NODES} n GROUP BY root_pk", "SELECT root_pk, count(*) AS nodes, max(depth) AS max_depth, cast(sum(CASE WHEN depth = 3 THEN 1 ELSE 0 END) AS bigint) AS leaves FROM {NODES} n GROUP BY root_pk")
portable(
    "tree_verification",
    "SELECT root_pk, nodes, leaves, CASE WHEN nodes >= 10 AND leaves >= 3 THEN 'ok' ELSE 'degraded' END AS status FROM (SELECT root_pk, count(*) AS nodes, count(CASE WHEN depth = 3 THEN 1 END) AS leaves FROM {NODES} n GROUP BY root_pk) x",
)
def _padded(number: str) -> str:
    return f"lpad(cast({number} AS string), greatest(4, length(cast({number} AS string))), '0')"


#: Customers with their orders, the nodes of their subtree (size), their place among the nation's customers and the nodes
#: before theirs in it. Customers are summed in runs of 4096 keys first, so that no window holds a nation.
_CUSTOMERS = """(SELECT p.c_custkey, p.c_nationkey, place + row_number() OVER (PARTITION BY p.c_nationkey, p.run ORDER BY p.c_custkey) - 1 AS place,
 before + coalesce(sum(size) OVER (PARTITION BY p.c_nationkey, p.run ORDER BY p.c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
 FROM (SELECT c_custkey, c_nationkey, c_custkey // 4096 AS run, 1 + coalesce(n, 0) AS size FROM {customer} LEFT JOIN (SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey) o ON c_custkey = o_custkey) p
 JOIN (SELECT c_nationkey, run, coalesce(sum(count(*)) OVER w, 0) AS place, coalesce(sum(sum(1 + coalesce(n, 0))) OVER w, 0) AS before
  FROM (SELECT c_nationkey, c_custkey // 4096 AS run, n FROM {customer} LEFT JOIN (SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey) o ON c_custkey = o_custkey) q GROUP BY c_nationkey, run
  WINDOW w AS (PARTITION BY c_nationkey ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) r ON p.c_nationkey = r.c_nationkey AND p.run = r.run)"""
_NATIONS = """(SELECT n_nationkey, n_regionkey, row_number() OVER w - 1 AS place, row_number() OVER w + coalesce(sum(coalesce(size, 0)) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS number
 FROM {nation} LEFT JOIN (SELECT c_nationkey, sum(n) AS size FROM (SELECT c_nationkey, 1 AS n FROM {customer} UNION ALL SELECT c_nationkey, 1 FROM {orders} JOIN {customer} ON o_custkey = c_custkey) x GROUP BY c_nationkey) s ON n_nationkey = c_nationkey
 WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey))"""
_REGIONS = "(SELECT r_regionkey, row_number() OVER (ORDER BY r_regionkey) - 1 AS place FROM {region})"
_ORDERS = "(SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM {orders})"
_NUMBERED = f"""(SELECT concat('r', cast(r_regionkey AS string)) AS node_pk, concat('r', cast(r_regionkey AS string)) AS root_pk, 0 AS number FROM {{region}}
 UNION ALL SELECT concat('n', cast(n_nationkey AS string)), concat('r', cast(n_regionkey AS string)), number FROM {_NATIONS} n
 UNION ALL SELECT concat('c', cast(c_custkey AS string)), concat('r', cast(n_regionkey AS string)), number + 1 + before FROM {_CUSTOMERS} c JOIN {_NATIONS} n ON c_nationkey = n_nationkey
 UNION ALL SELECT concat('o', cast(o_orderkey AS string)), concat('r', cast(n_regionkey AS string)), number + 1 + before + k FROM {_ORDERS} o JOIN {_CUSTOMERS} c ON o_custkey = c_custkey JOIN {_NATIONS} n ON c_nationkey = n_nationkey)"""
portable(
    "tree_node_ids",
    f"SELECT node_pk, root_pk, {_padded('number')} AS node_id FROM {_NUMBERED} x",
    """SELECT node_pk, root_pk, printf('%04d', row_number() OVER (PARTITION BY r ORDER BY n NULLS FIRST, c NULLS FIRST, o NULLS FIRST) - 1) AS node_id FROM (SELECT concat('r', cast(r_regionkey AS string)) AS node_pk, concat('r', cast(r_regionkey AS string)) AS root_pk, r_regionkey AS r, NULL AS n, NULL AS c, NULL AS o FROM {region}
 UNION ALL SELECT concat('n', cast(n_nationkey AS string)), concat('r', cast(n_regionkey AS string)), n_regionkey, n_nationkey, NULL, NULL FROM {nation}
 UNION ALL SELECT concat('c', cast(c_custkey AS string)), concat('r', cast(n_regionkey AS string)), n_regionkey, n_nationkey, c_custkey, NULL FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
 UNION ALL SELECT concat('o', cast(o_orderkey AS string)), concat('r', cast(n_regionkey AS string)), n_regionkey, n_nationkey, c_custkey, o_orderkey FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey) x""",
)
portable(
    "tree_path_ids",
    f"""SELECT o_orderkey, concat({_padded('r.place')}, {_padded('n.place')}, {_padded('c.place')}, {_padded('(k - 1)')}) AS node_id
 FROM {_ORDERS} o JOIN {_CUSTOMERS} c ON o_custkey = c_custkey JOIN {_NATIONS} n ON c_nationkey = n_nationkey JOIN {_REGIONS} r ON n_regionkey = r_regionkey""",
    """SELECT o_orderkey, printf('%04d%04d%04d%04d', r, n, c, o) AS node_id FROM (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS o FROM {orders}) JOIN
 (SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS c FROM {customer}) ON o_custkey = c_custkey JOIN (SELECT n_nationkey, n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS n FROM {nation}) ON c_nationkey = n_nationkey
 JOIN (SELECT r_regionkey, row_number() OVER (ORDER BY r_regionkey) - 1 AS r FROM {region}) ON n_regionkey = r_regionkey""",
)


@query(
    expand(
        """SELECT root_pk AS doc_pk, count(*) AS nodes, count(CASE WHEN parent_pk IS NULL THEN 1 END) AS roots, count(CASE WHEN parent_pk IS NOT NULL AND NOT known THEN 1 END) AS orphans, count(CASE WHEN leaf THEN 1 END) AS leaves,
 count(CASE WHEN leaf AND trim(title) <> '' THEN 1 END) AS leaves_with_text, CASE WHEN count(CASE WHEN parent_pk IS NULL THEN 1 END) = 0 OR count(CASE WHEN parent_pk IS NOT NULL AND NOT known THEN 1 END) > 0 THEN 'error'
 WHEN count(*) >= 10 AND count(CASE WHEN leaf AND trim(title) <> '' THEN 1 END) >= 3 THEN 'ok' ELSE 'degraded' END AS status
 FROM (SELECT n.*, n.node_pk NOT IN (SELECT parent_pk FROM {NODES} c WHERE parent_pk IS NOT NULL) AS leaf, n.parent_pk IN (SELECT node_pk FROM {NODES} p) AS known FROM {NODES} n) x GROUP BY root_pk"""
    ).replace("{", "").replace("}", "")
)
def forest_report(spark, folder):
    """Regions as forests: their nodes, leaves and whether they are whole and large enough."""
    return verify.report(run(spark, folder, "SELECT root_pk AS doc_pk, node_pk, parent_pk, title AS node_text FROM {NODES} n"))


_REPLY = """(SELECT event_id, CASE event_id % 5 WHEN 0 THEN concat('{"score": ', cast(v AS string), '}') WHEN 1 THEN concat('{"score": 0.', cast(v AS string), '}') WHEN 2 THEN '{"score": true}'
 WHEN 3 THEN concat('{"score": "', cast(v AS string), '"}') ELSE 'none' END AS reply FROM (SELECT event_id, cast(floor(coalesce(value, 0)) AS bigint) AS v FROM {events}) e)"""


@query(f"SELECT event_id, CASE WHEN json_valid(reply) AND json_type(reply, '$.score') IN ('DOUBLE', 'BIGINT', 'UBIGINT') THEN least(1.0, greatest(0.0, cast(json_extract(reply, '$.score') AS double))) END AS score FROM {_REPLY.replace('{events}', 'events')} q")
def leaf_answers(spark, folder):
    """Scores read out of model replies: only numbers count, and they are brought into 0 to 1."""
    from arborix.functions.answers import leaf_score

    events = table(spark, folder, "events").select("event_id", F.floor(F.coalesce("value", F.lit(0.0))).cast("string").alias("v"))
    kind = F.col("event_id") % 5
    reply = F.when(kind == 0, F.concat(F.lit('{"score": '), "v", F.lit("}"))).when(kind == 1, F.concat(F.lit('{"score": 0.'), "v", F.lit("}"))).when(kind == 2, '{"score": true}')
    reply = reply.when(kind == 3, F.concat(F.lit('{"score": "'), "v", F.lit('"}'))).otherwise("none")
    return events.select("event_id", leaf_score(reply).alias("score"))


# ------------------------------------------------------------------ search
_LEAVES = "(SELECT c_custkey, o_orderkey, n_nationkey, r_regionkey, round((o_orderkey % 97) / 97.0, 4) AS score FROM {PATHS} p)"
_BACK = f"""(SELECT concat('r', cast(r_regionkey AS string)) AS node_pk, score FROM {_LEAVES} a UNION ALL SELECT concat('n', cast(n_nationkey AS string)), score FROM {_LEAVES} b
 UNION ALL SELECT concat('c', cast(c_custkey AS string)), score FROM {_LEAVES} c)"""
_STATE = f"(SELECT node_pk, count(*) AS visit_count, cast(sum(cast(score AS decimal(18, 4))) AS double) AS value_sum FROM {_BACK} s GROUP BY node_pk)"
_UCB = f"""(SELECT n.node_pk, n.parent_pk, n.child_order, v.visit_count, round(v.value_sum / v.visit_count + CASE WHEN n.parent_pk IS NULL THEN 0.0 ELSE 1.414 * sqrt(ln(p.visit_count) / v.visit_count) END, 6) AS ucb
 FROM {{NODES}} n JOIN {_STATE} v ON n.node_pk = v.node_pk LEFT JOIN {_STATE} p ON n.parent_pk = p.node_pk)"""
portable("mcts_ucb", f"SELECT node_pk, visit_count, ucb FROM {_UCB} u")
portable("mcts_select_child", f"SELECT parent_pk, node_pk, ucb FROM (SELECT *, row_number() OVER (PARTITION BY parent_pk ORDER BY ucb DESC, child_order, node_pk) AS k FROM {_UCB} u) x WHERE k = 1")
_TREE = """SELECT c_custkey AS doc_pk, -1 - c_custkey AS node_pk, cast(NULL AS bigint) AS parent_pk, 0 AS child_order, 1 AS start_index, 1.0D AS prior, 0.0D AS score FROM {customer}
 UNION ALL SELECT o_custkey, o_orderkey * 10, -1 - o_custkey, o_orderkey, 1, cast(o_totalprice / 500000 AS double), cast(o_totalprice / 500000 AS double) FROM {orders}
 UNION ALL SELECT o_custkey, l_orderkey * 10 + l_linenumber, l_orderkey * 10, l_linenumber, l_linenumber, cast(sum(l_quantity) / 50 AS double), cast(sum(l_extendedprice) / 105000 AS double)
   FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey GROUP BY o_custkey, l_orderkey, l_linenumber"""


def search_sql(tree: str, levels: int, iterations: int, workers: int, top: int) -> str:
    """The search written out batch by batch and level by level: the sums of all nodes after each batch are a table of their own.

    A batch's picks come one after another from the best open child, so a node's share goes to its children in order.
    """
    parts = [
        f"t AS MATERIALIZED ({tree})",
        "up0 AS MATERIALIZED (SELECT doc_pk, node_pk AS leaf, node_pk, parent_pk FROM t WHERE node_pk NOT IN (SELECT parent_pk FROM t WHERE parent_pk IS NOT NULL))",
        *(f"up{i} AS MATERIALIZED (SELECT t.doc_pk, u.leaf, t.node_pk, t.parent_pk FROM up{i - 1} u JOIN t ON t.doc_pk = u.doc_pk AND t.node_pk = u.parent_pk)" for i in range(1, levels)),
        "up AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT doc_pk, leaf, node_pk FROM up{i}" for i in range(levels)) + ")",
        """n AS MATERIALIZED (SELECT t.*, c.leaves, t.node_pk IN (SELECT leaf FROM up0) AS is_leaf, CASE WHEN t.parent_pk IS NULL AND r.roots = 1 THEN 1.0::DOUBLE ELSE least(1.0, greatest(0.0, coalesce(t.prior, 0)))::DOUBLE END AS p
 FROM t JOIN (SELECT doc_pk, node_pk, count(*) AS leaves FROM up GROUP BY ALL) c USING (doc_pk, node_pk) JOIN (SELECT doc_pk, count(*) AS roots FROM t WHERE parent_pk IS NULL GROUP BY doc_pk) r USING (doc_pk))""",
        "s0 AS MATERIALIZED (SELECT doc_pk, node_pk, 0::BIGINT AS k, 0::DECIMAL(28, 12) AS got FROM n)",
        "done0 AS MATERIALIZED (SELECT DISTINCT doc_pk, 0::BIGINT AS done FROM n)",
    ]
    for b in range(1, iterations + 1):
        last = f"(SELECT n.*, k + 3 AS visits, (3 * p + got::DOUBLE) / (k + 3) AS mean FROM n JOIN s{b - 1} USING (doc_pk, node_pk))"
        parts.append(f"w{b} AS MATERIALIZED (SELECT * FROM {last})")
        parts.append(f"f{b}_0 AS MATERIALIZED (SELECT doc_pk, NULL::BIGINT AS node_pk, NULL::BIGINT AS visits, least({workers}, {iterations} - done) AS share, false AS is_leaf FROM done{b - 1} WHERE done < {iterations})")
        for i in range(1, levels + 1):
            ranked = f"""SELECT w.doc_pk, w.node_pk, w.visits, w.is_leaf, f.share, w.leaves, coalesce(sum(w.leaves) OVER (PARTITION BY w.doc_pk, w.parent_pk
 ORDER BY w.mean + CASE WHEN f.visits IS NULL THEN 0.0 ELSE 1.414 * sqrt(ln(f.visits) / w.visits) END DESC, w.child_order, w.node_pk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
 FROM f{b}_{i - 1} f JOIN w{b} w ON w.doc_pk = f.doc_pk AND w.parent_pk IS NOT DISTINCT FROM f.node_pk WHERE NOT f.is_leaf"""
            parts.append(f"f{b}_{i} AS MATERIALIZED (SELECT doc_pk, node_pk, visits, least(leaves, share - before) AS share, is_leaf FROM ({ranked}) x WHERE before < share)")
        picks = " UNION ALL ".join(f"SELECT doc_pk, node_pk FROM f{b}_{i} WHERE is_leaf" for i in range(1, levels + 1))
        parts.append(f"p{b} AS MATERIALIZED ({picks})")
        parts.append(f"""s{b} AS MATERIALIZED (SELECT s.doc_pk, s.node_pk, s.k + coalesce(a.k, 0) AS k, (s.got + coalesce(a.got, 0))::DECIMAL(28, 12) AS got FROM s{b - 1} s LEFT JOIN
 (SELECT up.doc_pk, up.node_pk, count(*) AS k, sum(least(1.0, greatest(0.0, coalesce(t.score, 0)))::DECIMAL(28, 12)) AS got FROM p{b} JOIN up ON up.doc_pk = p{b}.doc_pk AND up.leaf = p{b}.node_pk JOIN t ON t.doc_pk = up.doc_pk AND t.node_pk = up.leaf GROUP BY ALL) a USING (doc_pk, node_pk))""")
        parts.append(f"done{b} AS MATERIALIZED (SELECT d.doc_pk, d.done + coalesce(c.k, 0) AS done FROM done{b - 1} d LEFT JOIN (SELECT doc_pk, count(*) AS k FROM p{b} GROUP BY doc_pk) c USING (doc_pk))")
    return f"""WITH {", ".join(parts)}, seen AS (SELECT n.doc_pk, n.node_pk, n.start_index, k + 3 AS visits, (3 * p + got::DOUBLE) / (k + 3) AS mean FROM n JOIN s{iterations} USING (doc_pk, node_pk) WHERE is_leaf AND k > 0)
 SELECT doc_pk, node_pk AS leaf_pk, round(round(mean, 9)::DECIMAL(30, 9), 4)::DOUBLE AS value, visits, row_number() OVER (PARTITION BY doc_pk ORDER BY mean DESC, visits DESC, start_index, node_pk) AS rank, count(*) OVER (PARTITION BY doc_pk) AS leaves_seen
 FROM seen WHERE doc_pk IS NOT NULL QUALIFY rank <= {top}"""


@query(search_sql(_TREE.replace("{", "").replace("}", "").replace("1.0D", "1.0").replace("0.0D", "0.0"), 3, 10, 3, 3))
def mcts_search(spark, folder):
    """Each customer as a document, orders as its sections, order lines below them: three best leaves after ten evaluations in batches of three."""
    return search.searched(run(spark, folder, _TREE), iterations=10, workers=3, top=3)


@query(r"SELECT conv_id AS doc_pk, turn + 1 AS page_no, regexp_extract(text, '(?s)^\s*([^.]*\.?(?:[^.]*\.)?)', 1) AS summary FROM conversations WHERE trim(coalesce(text, '')) <> ''")
def summaries(spark, folder):
    """The first two sentences of each page, as the offline summary."""
    pages = run(spark, folder, "SELECT doc_pk, page_no, text FROM {PAGES} p WHERE trim(text) <> ''")
    return pages.select("doc_pk", "page_no", F.regexp_extract("text", r"(?s)^\s*([^.]*\.?(?:[^.]*\.)?)", 1).alias("summary"))

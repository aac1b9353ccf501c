"""How the engine's shapes (registry, pages, contents tables, forests, vectors) are read out of the given tables, as SQL.

The text is plain enough for Spark and for other engines; ``{name}`` stands for a table.
"""

from __future__ import annotations

PAGES = "(SELECT conv_id AS doc_pk, turn + 1 AS page_no, role, coalesce(text, '') AS text FROM {conversations})"

REGISTRY = """(SELECT doc_id AS doc_pk, concat(source, '-', cast(doc_id AS string)) AS doc_name, source AS company,
 cast(2020 + doc_id % 5 AS string) AS year_period, doc_id AS created_at, text AS raw_json FROM {documents})"""

#: Contents entries: structure 1, 1.1, 1.2, 2, ...; a title; a logical page and, two times in three, a physical one.
TOC = """(SELECT conv_id AS doc_pk, turn AS ord,
 CASE WHEN turn % 3 = 0 THEN cast(turn // 3 + 1 AS string) ELSE concat(cast(turn // 3 + 1 AS string), '.', cast(turn % 3 AS string)) END AS structure,
 substring(coalesce(text, ''), 1, 24) AS title, turn + CASE WHEN (conv_id + turn) % 7 = 0 THEN 1 ELSE 0 END AS page,
 CASE WHEN (conv_id + turn) % 3 = 2 THEN NULL ELSE turn + 1 END AS physical_index,
 CASE WHEN role = 'user' THEN 'yes' ELSE 'no' END AS appear_start FROM {conversations})"""

#: Four levels: region, nation, customer, order. Keys carry the level; a leaf's text is a document, picked by its key.
NODES = """(SELECT concat('r', cast(r_regionkey AS string)) AS node_pk, cast(NULL AS string) AS parent_pk, r_regionkey AS child_order, 0 AS depth, r_name AS title, concat('r', cast(r_regionkey AS string)) AS root_pk FROM {region}
 UNION ALL SELECT concat('n', cast(n_nationkey AS string)), concat('r', cast(n_regionkey AS string)), n_nationkey, 1, n_name, concat('r', cast(n_regionkey AS string)) FROM {nation}
 UNION ALL SELECT concat('c', cast(c_custkey AS string)), concat('n', cast(c_nationkey AS string)), c_custkey, 2, c_name, concat('r', cast(n_regionkey AS string)) FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
 UNION ALL SELECT concat('o', cast(o_orderkey AS string)), concat('c', cast(o_custkey AS string)), o_orderkey, 3, o_orderpriority, concat('r', cast(n_regionkey AS string))
   FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey)"""

#: The path of a leaf, one row each: the hierarchy has a fixed depth, so three equi-joins replace a recursion.
PATHS = """(SELECT o_orderkey, c_custkey, n_nationkey, r_regionkey, r_name, n_name, c_name, o_orderpriority, o_totalprice
 FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey)"""

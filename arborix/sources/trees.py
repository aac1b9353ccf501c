"""Nested JSON trees: ``{doc_name | pdf_name, structure | records: [{title, start_index, end_index, nodes: [...]}]}``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborix.sources.tables import stored


def schema(depth: int) -> str:
    """The type of a forest with ``depth`` levels."""
    node = "title: string, start_index: bigint, end_index: bigint, summary: string, text: string"
    inner = f"struct<{node}>"
    for _ in range(depth - 1):
        inner = f"struct<{node}, nodes: array<{inner}>>"
    return f"doc_name string, pdf_name string, structure array<{inner}>, records array<{inner}>"


def judged(docs: DataFrame, raw: str, *, depth: int = 6) -> DataFrame:
    """``docs`` with a column ``tree_status``: ok, malformed (no tree of this kind), nameless, or deeper than ``depth``.

    With ``strict=False`` :func:`nodes` takes the rows that are ``ok``; the others can be looked at here, so one bad row stops nothing.
    """
    return _judged(docs, raw, depth).drop("_tree")


def _judged(docs: DataFrame, raw: str, depth: int) -> DataFrame:
    wanted = f"{schema(depth + 1)}, _corrupt string"
    tree = F.from_json(raw, wanted, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    parsed = docs.withColumn("_tree", tree)
    inner = F.coalesce("_tree.structure", "_tree.records")
    for _ in range(depth - 1):
        inner = F.flatten(F.transform(inner, lambda n: F.coalesce(n["nodes"], F.array())))
    deep = F.exists(inner, lambda n: F.size(F.coalesce(n["nodes"], F.array())) > 0)
    broken = F.col("_tree").isNull() | F.col("_tree._corrupt").isNotNull()
    status = F.when(broken, "malformed").when(F.coalesce("_tree.doc_name", "_tree.pdf_name").isNull(), "nameless").when(deep, "deeper").otherwise("ok")
    return parsed.withColumn("tree_status", status)


def nodes(docs: DataFrame, key: str, raw: str, *, depth: int = 6, strict: bool = True, texts: bool = False) -> DataFrame:
    """One row for each node: key, path, parent_path, depth, child_order, title, start_index, end_index; if ``texts``, summary and text.

    Paths are four digits a level, so their order is depth first. Text that is no tree of this kind, has no name or
    nests deeper than ``depth`` fails the job, as half a document would be worse than none; if not ``strict`` it gives no rows. Levels are unnested one by
    one; there is no shuffle.
    """
    if strict:
        found = docs.select(F.col(key), F.from_json(raw, schema(depth + 1), {"mode": "FAILFAST"}).alias("t"))
    else:
        found = _judged(docs, raw, depth).where("tree_status = 'ok'").select(F.col(key), F.col("_tree").alias("t"))
    parsed = found.select(
        key, F.coalesce("t.doc_name", "t.pdf_name").alias("_name"), F.coalesce("t.structure", "t.records").alias("_kids"), F.lit(None).cast("string").alias("path")
    )
    parsed = parsed.where(F.col("_name").isNotNull() | F.raise_error(F.lit("a document tree needs doc_name or pdf_name")).isNotNull())
    out, level = None, parsed.select(key, "_kids", "path")
    for d in range(depth):
        rows = level.select(key, F.col("path").alias("parent_path"), F.posexplode("_kids").alias("child_order", "n"))
        rows = rows.withColumn("path", F.concat(F.coalesce("parent_path", F.lit("")), F.lpad(F.col("child_order").cast("string"), 4, "0")))
        if d == depth - 1:
            flat = F.coalesce(F.size("n.nodes"), F.lit(0)) <= 0
            rows = rows.where(flat | F.raise_error(F.lit(f"a document tree is deeper than {depth} levels")).isNotNull())
        made = rows.select(key, "path", "parent_path", F.lit(d).alias("depth"), "child_order", "n.title", "n.start_index", "n.end_index", *(["n.summary", "n.text"] if texts else []))
        out = made if out is None else out.unionByName(made)
        level = rows.select(key, F.col("n.nodes").alias("_kids"), "path")
    return out


def canonical(raw: Column, *, depth: int = 6) -> Column:
    """A tree's JSON in one form: fields in the order of :func:`schema`, doc_name and structure whatever they were called,
    without nulls, unknown fields and empty lists of nodes. Null where the text is no tree."""
    t = F.from_json(raw, schema(depth))
    made = F.to_json(F.struct(F.coalesce(t["doc_name"], t["pdf_name"]).alias("doc_name"), F.coalesce(t["structure"], t["records"]).alias("structure")))
    return F.when(t.isNotNull(), F.regexp_replace(made, r',"nodes":\[\]', ""))  # quotes inside texts are escaped


def rebuilt(nodes: DataFrame, names: DataFrame, key: str, *, fields: tuple[str, ...] = ("title", "start_index", "end_index", "summary", "text")) -> DataFrame:
    """(key, raw_json): node rows, as :func:`nodes` gives them, folded from the deepest level up into nested JSON.

    ``names`` has ``key`` and doc_name, a row for each document; one without nodes has an empty structure. Children are in
    the order of child_order. Each level is one aggregation by parent, in which rows that wait for their children and
    children that are ready meet; rows of the levels above wait outside. A document is one value in the end, as it was
    before. Nodes whose parent is missing are in no tree.
    """
    kid = "struct<child_order: int, json: string>"
    given = [f for f in fields if f in nodes.columns]
    own = nodes.select(key, "path", "parent_path", F.col("child_order").cast("int").alias("child_order"), "depth", F.to_json(F.struct(*given)).alias("own"))
    own = stored(own)
    listed = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda k: k["json"]), ",")
    ready = None
    for level in range(own.agg(F.max("depth")).first()[0] or 0, -1, -1):
        waiting = own.where(F.col("depth") == level).select(key, "path", "parent_path", "child_order", "own", F.lit(None).cast(kid).alias("kid"))
        if ready is None:
            done = waiting.withColumn("kids", F.lit(""))
        else:
            both = waiting.unionByName(ready.select(key, F.col("parent_path").alias("path"), "kid"), allowMissingColumns=True)
            done = both.groupBy(key, "path").agg(F.max("parent_path").alias("parent_path"), F.max("child_order").alias("child_order"), F.max("own").alias("own"), listed("kid").alias("kids")).where("own is not null")
        head = F.substr("own", F.lit(1), F.length("own") - 1)
        whole = F.when(F.col("kids") == "", F.col("own")).otherwise(F.concat(head, F.when(F.col("own") == "{}", "").otherwise(","), F.lit('"nodes":['), "kids", F.lit("]}")))
        ready = done.select(key, "parent_path", F.struct("child_order", whole.alias("json")).alias("kid"))
    roots = ready.where("parent_path is null").groupBy(key).agg(listed("kid").alias("kids"))
    named = F.to_json(F.struct("doc_name"))
    text = F.concat(F.substr(named, F.lit(1), F.length(named) - 1), F.when(named == "{}", "").otherwise(","), F.lit('"structure":['), F.coalesce("kids", F.lit("")), F.lit("]}"))
    return names.select(key, "doc_name").join(roots, key, "left").select(key, text.alias("raw_json"))


def write(trees: DataFrame, path: str, raw: str) -> None:
    """Trees as text files, one JSON document a line, in parts as Spark has them."""
    trees.select(raw).write.mode("errorifexists").text(path)

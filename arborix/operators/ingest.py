"""From page lists and contents tables to verified section nodes; from marked-up pages to contents tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborix.functions.text import at_start
from arborix.operators import forest
from arborix.sources.tables import use_shared_folder


def headings(html: Column) -> Column:
    """The headings of a marked-up page in order, as array of (structure, title): ``1``, ``1.1``, ``2``, one part more for each deeper level.

    A heading belongs to the nearest one before it with a higher mark, however much deeper its own is. Null or plain
    pages give an empty array.
    """
    marks = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?is)<h[1-6][^>]*>.*?</h[1-6]\s*>"), F.lit(0))

    def numbered(state: Column, mark: Column) -> Column:
        level = F.regexp_extract(mark, r"(?i)^<h([1-6])", 1).cast("int")
        above = F.filter(state["marks"], lambda m: m < level)
        count = F.coalesce(F.try_element_at(state["path"], F.size(above) + 1), F.lit(0)) + 1
        now = F.concat(F.slice(state["path"], F.lit(1), F.size(above)), F.array(count))
        title = F.trim(F.regexp_replace(F.regexp_replace(mark, "<[^>]*>", " "), r"\s+", " "))
        entry = F.struct(F.array_join(now.cast("array<string>"), ".").alias("structure"), title.alias("title"))
        return F.struct(F.concat(state["made"], F.array(entry)).alias("made"), now.alias("path"), F.concat(above, F.array(level)).alias("marks"))

    start = F.struct(F.expr("cast(array() as array<struct<structure: string, title: string>>)").alias("made"), F.expr("cast(array() as array<int>)").alias("path"), F.expr("cast(array() as array<int>)").alias("marks"))
    return F.aggregate(marks, start, numbered, lambda s: s["made"])


def generated_toc(pages: DataFrame, key: str, html: str) -> DataFrame:
    """A contents table (doc_pk, ord, structure, title) for each marked-up page with headings, without a shuffle."""
    entries = pages.select(F.col(key).alias("doc_pk"), F.posexplode(headings(F.col(html))).alias("ord", "e"))
    return entries.select("doc_pk", "ord", "e.structure", "e.title")


def page_headings(pages: DataFrame) -> DataFrame:
    """The headings on the pages (doc_pk, page_no, text) of each document, numbered over all its pages: doc_pk, ord, structure, title, physical_index."""
    marks = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(?is)<h[1-6][^>]*>.*?</h[1-6]\s*>"), F.lit(0))
    marked = pages.select("doc_pk", "page_no", marks.alias("marks")).where(F.size("marks") > 0)
    docs = marked.groupBy("doc_pk").agg(F.array_sort(F.collect_list(F.struct("page_no", "marks"))).alias("p"))
    numbers = F.flatten(F.transform("p", lambda x: F.array_repeat(x["page_no"], F.size(x["marks"]))))
    entries = docs.select("doc_pk", numbers.alias("numbers"), F.posexplode(headings(F.array_join(F.flatten("p.marks"), ""))).alias("ord", "e"))
    return entries.select("doc_pk", "ord", "e.structure", "e.title", F.element_at("numbers", F.col("ord") + 1).cast("int").alias("physical_index"))


def located(toc: DataFrame, pages: DataFrame) -> DataFrame:
    """Contents entries (doc_pk, ord, structure, title, page, physical_index) with a physical page wherever one can be found.

    Logical pages are moved by the document's commonest difference to physical ones (of equally common ones the
    earliest), by nothing where none is known; an entry without a logical page keeps its physical one. What is still
    null goes to the first page with its title from its last placed neighbour before to the next one after it, both
    included; entries that are placed so are neighbours in turn. A blank title is on no page.
    """
    apart = toc.where("physical_index is not null and page is not null").groupBy("doc_pk", (F.col("physical_index") - F.col("page")).alias("offset")).agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))
    offsets = apart.groupBy("doc_pk").agg(F.max_by("offset", F.struct("n", -F.col("first"))).alias("offset"))
    moved = F.coalesce(F.col("page") + F.coalesce("offset", F.lit(0)), F.col("physical_index")).cast("int")
    known = _cut(toc.join(offsets, "doc_pk", "left").select("doc_pk", "ord", "structure", "title", moved.alias("physical_index")))
    order = Window.partitionBy("doc_pk").orderBy("ord")
    low = F.coalesce(F.last("physical_index", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    high = F.first("physical_index", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    total = pages.groupBy("doc_pk").agg(F.max("page_no").alias("pages"))
    gap = F.count("physical_index").over(order)  # the entries between two placed ones have the same
    lost = known.select("*", low.alias("low"), high.alias("high"), gap.alias("gap")).where("physical_index is null").join(total, "doc_pk")
    sought = lost.where("trim(title) <> ''").withColumn("page_no", F.explode(F.expr("case when low <= least(coalesce(high, pages), pages) then sequence(greatest(low, 1), least(coalesce(high, pages), pages)) end")))
    seen = sought.join(pages.select("doc_pk", "page_no", "text"), ["doc_pk", "page_no"]).where(F.contains(F.lower("text"), F.trim(F.lower("title"))))
    entry = seen.groupBy("doc_pk", "gap", "ord").agg(F.array_sort(F.collect_list(F.col("page_no").cast("int"))).alias("on"))
    gaps = entry.groupBy("doc_pk", "gap").agg(F.array_sort(F.collect_list(F.struct("ord", "on"))).alias("entries"))

    def step(state: Column, e: Column) -> Column:
        at = F.get(F.filter(e["on"], lambda n: n >= state["at"]), F.lit(0))
        made = F.concat(state["made"], F.array(F.struct(e["ord"].alias("ord"), at.alias("found"))))
        return F.struct(made.alias("made"), F.coalesce(at, state["at"]).alias("at"))

    kind = dict(toc.dtypes)["ord"]
    start = F.struct(F.expr(f"cast(array() as array<struct<ord: {kind}, found: int>>)").alias("made"), F.lit(0).alias("at"))
    found = gaps.select("doc_pk", F.explode(F.aggregate("entries", start, step, lambda s: s["made"])).alias("f")).select("doc_pk", "f.ord", "f.found")
    return known.join(found, ["doc_pk", "ord"], "left").select("doc_pk", "ord", "structure", "title", F.coalesce("physical_index", "found").alias("physical_index"))


def _ranged(toc: DataFrame, pages: DataFrame, octets: bool) -> DataFrame:
    """Placed entries and prefaces (doc_pk, ord, structure, title) with start_index and end_index."""
    total = pages.groupBy("doc_pk").agg(F.max("page_no").alias("pages"))
    placed = toc.join(total, "doc_pk").where(F.col("physical_index") <= F.col("pages"))
    first = placed.groupBy("doc_pk", "pages").agg(F.min_by("physical_index", "ord").alias("first")).where("first > 1")
    preface = first.select("doc_pk", F.lit(-1).alias("ord"), F.lit("0").alias("structure"), F.lit("Preface").alias("title"), F.lit(1).alias("physical_index"), "pages")
    entries = placed.select("doc_pk", "ord", "structure", "title", "physical_index", "pages").unionByName(preface)
    top = pages.select("doc_pk", F.col("page_no").alias("physical_index"), "text")
    marked = entries.join(top, ["doc_pk", "physical_index"], "left").withColumn("at_top", at_start(F.col("text"), F.col("title"), octets=octets)).drop("text")
    after = Window.partitionBy("doc_pk").orderBy("ord")
    end = F.coalesce(F.lead("physical_index").over(after) - F.lead("at_top").over(after).cast("int"), F.col("pages"))
    return marked.select("doc_pk", "ord", "structure", "title", F.col("physical_index").alias("start_index"), F.greatest("physical_index", end).alias("end_index"))


def ingested_whole(toc: DataFrame, pages: DataFrame, *, pages_above: int = 10, tokens_from: int = 20_000, depth: int = 3, octets: bool = False) -> DataFrame:
    """Nodes of the documents: doc_pk, node_id, parent_id, structure, title, start_index, end_index, summary, node_text.

    ``toc`` has doc_pk, ord, structure, title, page, physical_index and goes through :func:`located`; documents of
    which it places nothing take the headings on their pages instead. ``pages`` has doc_pk, page_no (from 1), text and
    token_count. Entries beyond the last page or without one go; a preface is put before a first entry that begins later
    than page one. An entry ends before the next one if that begins at the top of its page (:func:`at_start`, which gets
    ``octets``), else on the same page, the last one on the last page. Leaves are divided as in :func:`divided` and their children numbered
    with the other nodes, depth first; a child's structure is its leaf's with one part more. ``summary`` is the first
    two sentences of node_text. Documents without entries and headings have no nodes.
    """
    found = _cut(page_headings(pages))
    ranged = _cut(_ranged(_cut(routed(_cut(located(toc, pages)), found)), pages, octets))
    walked = forest.paths(ranged.join(forest.parents(ranged).select("doc_pk", "ord", "parent_ord"), ["doc_pk", "ord"]))
    walked = _cut(walked.select("doc_pk", "path", "structure", "title", "start_index", "end_index"))
    parts = divided(walked.drop("structure").withColumnRenamed("path", "structure"), pages, found, pages_above=pages_above, tokens_from=tokens_from, depth=depth)
    own = F.regexp_extract("path", r"^\d{9}(?:\.\d{9})*", 0)  # parts of divided leaves are shorter
    rows = parts.withColumnRenamed("structure", "path").withColumn("own", own).withColumn("more", F.substr("path", F.length("own") + 1))
    rows = rows.join(walked.select("doc_pk", F.col("path").alias("own"), "structure"), ["doc_pk", "own"])
    place = F.transform(F.filter(F.split("more", r"\."), lambda x: x != ""), lambda x: x.cast("int"))
    number = F.row_number().over(Window.partitionBy("doc_pk").orderBy("own", place)) - 1
    named = _cut(rows.withColumn("node_id", forest.padded(number)).withColumn("above", F.regexp_replace("path", r"\.?[^.]*$", "")))
    parent = named.select("doc_pk", F.col("path").alias("above"), F.col("node_id").alias("parent_id"))
    texts = forest.texts(named.withColumn("ord", F.col("path")), pages).withColumnRenamed("ord", "path")
    return named.join(parent, ["doc_pk", "above"], "left").join(texts, ["doc_pk", "path"], "left").select(
        "doc_pk", "node_id", "parent_id", F.concat("structure", "more").alias("structure"), "title", "start_index", "end_index", first_sentences(F.col("node_text")).alias("summary"), "node_text"
    )


def first_sentences(text: Column) -> Column:
    """The first two sentences, as the offline summary."""
    return F.regexp_extract(text, r"(?s)^\s*([^.]*\.?(?:[^.]*\.)?)", 1)


def routed(*tables: DataFrame) -> DataFrame:
    """Of several contents tables (doc_pk, ord, structure, title, physical_index) each document's entries of the first that places any of them."""
    columns = ["doc_pk", "ord", "structure", "title", "physical_index"]
    ranked = reduce(DataFrame.unionByName, [t.select(*columns, F.lit(i).alias("_route")) for i, t in enumerate(tables)])
    first = ranked.where("physical_index is not null").groupBy("doc_pk").agg(F.min("_route").alias("_route"))
    return ranked.join(first, ["doc_pk", "_route"], "left_semi").select(*columns)


def divided(nodes: DataFrame, pages: DataFrame, found: DataFrame, *, pages_above: int = 10, tokens_from: int = 20_000, depth: int = 3) -> DataFrame:
    """Nodes (doc_pk, structure, title, start_index, end_index) with large leaves divided by the headings on their pages.

    ``pages`` has doc_pk, page_no and token_count; ``found`` has doc_pk, ord, structure, title and physical_index of all
    headings. A leaf above ``depth`` that is large (:func:`forest.large`) gets the headings of the highest rank on its
    pages as children, but not a first one with its own title. A child ends before the page on which the next one
    begins, the last one with the leaf, and the leaf before its first child; none ends before it begins. Children are
    looked at again, ``depth`` times at most. Structures are unique in a document; leaves without headings stay.
    """
    for _ in range(depth):
        inner = nodes.select("doc_pk", F.regexp_replace("structure", r"\.[^.]*$", "").alias("above"), "structure").where("above <> structure").select("doc_pk", F.col("above").alias("structure")).distinct()
        leaves = nodes.join(inner, ["doc_pk", "structure"], "left_anti").where(F.size(F.split("structure", r"\.")) <= depth)
        large = forest.large(leaves.withColumn("ord", F.col("structure")), pages, pages_above=pages_above, tokens_from=tokens_from).select("doc_pk", F.col("ord").alias("structure"))
        wide = _cut(leaves.join(large, ["doc_pk", "structure"], "left_semi"))
        if wide.isEmpty():
            break
        spread = wide.select("doc_pk", F.col("structure").alias("above"), F.col("title").alias("own"), F.col("start_index").alias("start"), F.col("end_index").alias("end"), F.explode(F.sequence("start_index", "end_index")).alias("physical_index"))
        met = spread.join(found.select("doc_pk", "ord", "title", "physical_index", F.size(F.split("structure", r"\.")).alias("rank")), ["doc_pk", "physical_index"])
        leaf = Window.partitionBy("doc_pk", "above")
        order = leaf.orderBy("ord")
        named = met.withColumn("first", F.row_number().over(order) == 1).where(~(F.col("first") & (F.trim("title") == F.trim("own"))))
        top = named.withColumn("least", F.min("rank").over(leaf)).where("rank = least")
        kids = top.select(
            "doc_pk", "above", F.concat_ws(".", "above", F.row_number().over(order).cast("string")).alias("structure"), "title", F.col("physical_index").alias("start_index"),
            F.greatest("physical_index", F.coalesce(F.lead("physical_index").over(order) - 1, "end")).alias("end_index"),
        )
        begins = kids.groupBy("doc_pk", F.col("above").alias("structure")).agg(F.min("start_index").alias("_first"))
        ends = F.when(F.col("_first") > F.col("start_index"), F.col("_first") - 1).otherwise(F.col("end_index"))
        kept = nodes.join(begins, ["doc_pk", "structure"], "left").withColumn("end_index", ends).select(*nodes.columns)
        nodes = _cut(kept.unionByName(kids.select(*nodes.columns)))
    return nodes


def _cut(rows: DataFrame) -> DataFrame:
    """The rows with their lineage cut, in the shared checkpoint folder."""
    use_shared_folder(rows.sparkSession)
    return rows.checkpoint()

"""Cutting texts and page lists into overlapping chunks."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborix.operators.groups import walked

SIZE, STEP = 4000, 3800


def char_chunks(docs: DataFrame, key: str, text: str, *, size: int = SIZE, step: int = STEP, keep: list[str] | None = None) -> DataFrame:
    """A row for each stretch of ``size`` characters, begun every ``step``; texts that fit are one chunk. Runs without a shuffle."""
    length = F.length(text)
    starts = F.when(length <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.floor((length - 1) / step).cast("int")))
    return docs.select(key, *(keep or []), text, F.explode(starts).alias("_i")).select(
        key, *(keep or []), F.col("_i").cast("long").alias("chunk_index"), F.substring(F.col(text), F.col("_i") * step + 1, F.lit(size)).alias("content")
    )


def chunk_id(path: Column, title: Column, index: Column, content: Column) -> Column:
    """A chunk's id: SHA-256 of path, title, index and content."""
    return F.sha2(F.concat_ws("|", path, title.cast("string"), index.cast("string"), content), 256)


def _cut(numbers, tokens, numbers_before, tokens_before, limit, overlap, number, total) -> list[tuple]:
    """What one block adds to its document's chunks: (chunk_no, page_start, page_end, token_count).

    ``number`` and ``total`` are those of the chunk that is open where the block begins, null at a document's first page.
    """
    pages, counts, at = [*numbers_before, *numbers], [*tokens_before, *tokens], len(numbers_before)
    number, start, end, own, pieces = number or 0, None, None, 0, []
    for i in range(at, len(pages)):
        if total is None:
            total = 0
        elif total + counts[i] > limit:
            if end is not None or own:
                pieces.append((number, start, end, own))
            first = max(i - overlap, 0)
            number, start, own = number + 1, pages[first], sum(counts[first:i])
            total = own
        total, own, end = total + counts[i], own + counts[i], pages[i]
        start = end if start is None else start  # of a run from before the block, the least start holds
    return [*pieces, (number, start, end, own)]


def _passage(tokens, tokens_before, limit, overlap, opening) -> dict:
    """A block as a map from the open chunk's tokens at its first page to those after its last one.

    A chunk that comes in with t tokens ends before the first page whose ``sums`` (tokens from the block's first page on)
    is above limit - t; the open chunk then leaves with that page's ``totals``, after ``ends`` chunks have ended. Where
    no such page is, t grows by all of the block. Only pages with tokens that follow ``limit`` tokens at most can be the
    first such, so there are no more of them than a chunk has pages. At a document's start one entry holds.
    """
    counts, at = [*tokens_before, *tokens], len(tokens_before)
    sums = [0, *accumulate(counts)]

    def following(first: int, page: int) -> tuple[int, int]:
        """Tokens at the end, and chunks ended, for a chunk from ``first`` on that holds ``page``."""
        cut = bisect_right(sums, limit + sums[first], page + 2) - 1
        return (leaves[cut][0], leaves[cut][1] + 1) if cut < len(counts) else (sums[-1] - sums[first], 0)

    leaves: dict[int, tuple[int, int]] = {}
    for page in range(len(counts) - 1, at - 1, -1):
        leaves[page] = following(max(page - overlap, 0), page)
    if opening:
        total, ends = following(0, 0)
        return {"whole": sums[-1], "sums": [0], "totals": [total], "ends": [ends]}
    can = [p for p in range(at, len(counts)) if p == at or (counts[p] and sums[p] - sums[at] <= limit)]
    return {"whole": sums[-1] - sums[at], "sums": [sums[p + 1] - sums[at] for p in can], "totals": [leaves[p][0] for p in can], "ends": [leaves[p][1] + 1 for p in can]}


def _carry(doc: object, blocks: Iterator[tuple]) -> Iterator[tuple]:
    """The chunk that is open at the start of each block of a document but the first."""
    number, total = 0, None
    for _, block, limit, m in blocks:
        if total is not None:
            yield doc, block, number, total
        at = 0 if total is None else bisect_right(m["sums"], limit - total)
        if at < len(m["sums"]):
            number, total = number + m["ends"][at], m["totals"][at]
        else:
            total += m["whole"]


def token_chunks(pages: DataFrame, *, limit: int, overlap: int = 1, balanced: bool = False, block: int = 4096) -> DataFrame:
    """Runs of pages whose tokens add up to ``limit`` at most, each beginning with the last ``overlap`` pages of the one before.

    A page that alone is above the limit, or with the repeated ones, still is in a run. ``balanced`` lowers the limit of
    documents that don't fit one run, so that their last runs aren't short. Missing counts are 0; pages without number
    come first and, where others are in their run, aren't its start or end; a null doc_pk is a document; the order of
    pages with one number is that of their counts. Texts aren't read: give doc_pk, page_no, token_count.

    Where runs begin depends on all before, but a block of ``block`` page numbers can be described without knowing
    what comes before it (:func:`_passage`). Blocks are described in parallel; these descriptions, of which a document
    has one for each block, are passed through in order with two numbers of state; then all blocks are cut in parallel.
    Documents of one block skip the first two steps.
    """
    numbered = pages.select("doc_pk", "page_no", F.greatest(F.coalesce(F.col("token_count").cast("long"), F.lit(0)), F.lit(0)).alias("n"), F.floor(F.col("page_no") / block).alias("block"))
    blocks = numbered.groupBy("doc_pk", "block").agg(F.array_sort(F.collect_list(F.struct(F.col("page_no").cast("long").alias("page_no"), "n"))).alias("p"))
    last = F.slice("p", F.greatest(F.size("p") - overlap, F.lit(0)) + 1, F.lit(max(overlap, 1))) if overlap else F.slice("p", 1, 0)
    whole = F.aggregate("p", F.lit(0).cast("long"), lambda s, x: s + x["n"])
    doc = Window.partitionBy("doc_pk")
    before = F.flatten(F.collect_list("last").over(doc.orderBy("block").rowsBetween(-max(overlap, 1), -1)))
    size = F.sum("whole").over(doc)
    most = F.when(size > limit, F.ceil((size / F.ceil(size / limit) + limit) / 2)).otherwise(limit) if balanced else F.lit(limit)
    around = blocks.select(F.col("doc_pk").alias("_doc"), F.col("block").alias("_block"), F.col("block"), last.alias("last"), whole.alias("whole")).withColumn("doc_pk", F.col("_doc"))
    around = around.select(
        "_doc", "_block", F.slice(before, F.greatest(F.size(before) - overlap, F.lit(0)) + 1, F.lit(max(overlap, 1))).alias("b"), most.cast("long").alias("most"),
        (F.row_number().over(doc.orderBy("block")) == 1).alias("opening"), (F.count(F.lit(1)).over(doc) > 1).alias("several"),
    )
    blocks = blocks.join(around, F.col("doc_pk").eqNullSafe(F.col("_doc")) & F.col("block").eqNullSafe(F.col("_block"))).drop("_doc", "_block")

    passage = F.udf(lambda n, b, limit, opening: _passage(n, b, limit, overlap, opening), "whole long, sums array<long>, totals array<long>, ends array<long>", useArrow=True)
    described = blocks.where("several").select("doc_pk", "block", F.col("most").alias("most"), passage("p.n", "b.n", "most", "opening").alias("m"))
    opened = walked(described, "doc_pk", ["block"], _carry, "_doc long, _block long, number long, total long")
    opened = opened.select(F.col("_doc").cast(numbered.schema["doc_pk"].dataType).alias("_doc"), "_block", "number", "total")

    cut = F.udf(lambda p, n, bp, bn, limit, number, total: _cut(p, n, bp, bn, limit, overlap, number, total), "array<struct<chunk_no long, page_start long, page_end long, token_count long>>", useArrow=True)
    entered = blocks.join(opened, F.col("doc_pk").eqNullSafe(F.col("_doc")) & F.col("block").eqNullSafe(F.col("_block")), "left")
    pieces = entered.select("doc_pk", F.inline(cut("p.page_no", "p.n", "b.page_no", "b.n", "most", "number", "total")))
    return pieces.groupBy("doc_pk", "chunk_no").agg(F.min("page_start").alias("page_start"), F.max("page_end").alias("page_end"), F.sum("token_count").alias("token_count"))


def search_documents(chunks: DataFrame) -> DataFrame:
    """Chunks in the shape of the index: id, title, content, source_path, source_file, chunk_index, company_name, year, metadata_json.

    Content is trimmed, and a chunk without any fails the job. Missing texts are empty, a missing year or index 0; a
    chunk without id gets :func:`chunk_id`. Columns that ``chunks`` does not have count as missing.
    """

    def given(name: str, kind: str) -> Column:
        return F.col(name).cast(kind) if name in chunks.columns else F.lit(None).cast(kind)

    def text(name: str) -> Column:
        return F.coalesce(given(name, "string"), F.lit(""))

    content = F.regexp_replace(text("content"), r"(?U)^\s+|\s+$", "")
    content = F.when(content != "", content).otherwise(F.raise_error(F.lit("a chunk has no content")).cast("string"))
    index = F.coalesce(given("chunk_index", "long"), F.lit(0))
    made = chunk_id(text("source_path"), text("title"), index, content)
    return chunks.select(
        F.coalesce(F.nullif(text("id"), F.lit("")), made).alias("id"), text("title").alias("title"), content.alias("content"), text("source_path").alias("source_path"), text("source_file").alias("source_file"),
        index.alias("chunk_index"), text("company_name").alias("company_name"), F.coalesce(given("year", "int"), F.lit(0)).alias("year"), text("metadata_json").alias("metadata_json"),
    )

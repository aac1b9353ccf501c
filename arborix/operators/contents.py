"""Contents tables that a document prints: its pages found, their text put together and turned into entries by a model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborix.functions.text import lenient_object
from arborix.operators.ingest import _cut

_ENTRIES = "table_of_contents array<struct<structure: string, title: string, page: string>>"


def said(answer: Column, field: str) -> Column:
    """What a JSON answer gives for ``field``; ``no`` where it cannot be read."""
    return F.coalesce(lenient_object(answer, f"`{field}` string")[field], F.lit("no"))


def contents_pages(pages: DataFrame, *, most: int = 20) -> DataFrame:
    """(doc_pk, page_no, text) of the contents pages among the first ``most`` of each document, by ``toc_detected`` (yes or no).

    All pages up to the first ``no`` after a ``yes`` that say ``yes``; any other answer neither counts nor ends the run.
    """
    before = Window.partitionBy("doc_pk").orderBy("page_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = pages.where(F.col("page_no") <= most).withColumn("seen", F.coalesce(F.count_if(F.col("toc_detected") == "yes").over(before), F.lit(0)))
    stops = F.count_if((F.col("toc_detected") == "no") & (F.col("seen") > 0)).over(before)
    return first.withColumn("stops", stops).where("toc_detected = 'yes' and stops = 0").select("doc_pk", "page_no", "text")


def without_leaders(text: Column) -> Column:
    """Five dots or more in a row, with or without a space after each, become a colon."""
    return F.regexp_replace(F.regexp_replace(text, r"\.{5,}", ": "), r"(?:\. ){5,}\.?", ": ")


def contents_text(found: DataFrame) -> DataFrame:
    """(doc_pk, content): the contents pages of each document in their order, one after the other, leaders cleaned; some pages a document."""
    ordered = F.array_sort(F.collect_list(F.struct("page_no", F.coalesce("text", F.lit("")).alias("text"))))
    return found.groupBy("doc_pk").agg(F.array_join(ordered["text"], "").alias("content")).select("doc_pk", without_leaders(F.col("content")).alias("content"))


def transcribed(contents: DataFrame, ask: Callable[[Column, Column], Column], judge: Callable[[Column, Column], Column], *, continuations: int = 5) -> DataFrame:
    """Entries (doc_pk, ord, structure, title, page) out of contents texts (doc_pk, content), asked for piece by piece.

    ``ask`` makes a struct (answer, finished) from the text and what has been answered so far (empty at first),
    ``judge`` a JSON answer that says in ``completed`` whether that is all. A document is asked again until an answer is finished
    and the whole is complete, ``continuations`` times at most. The answers one after the other are one JSON object; where they
    cannot be read the first alone counts, and where that cannot be read either, or the text is null, there are no
    entries. A page that is no whole number is null. Only documents that are not done are asked again, and nothing is shuffled.
    """
    open_, done = contents.where("content is not null").select("doc_pk", "content", F.lit("").alias("first"), F.lit("").alias("so_far")), None
    for i in range(continuations + 1):
        told = open_.withColumn("told", ask(F.col("content"), F.col("so_far")))
        grown = told.withColumn("so_far", F.concat("so_far", F.coalesce("told.answer", F.lit(""))))
        asked = _cut(
            grown.select(
                "doc_pk", "content", (F.coalesce("told.answer", F.lit("")) if i == 0 else F.col("first")).alias("first"), "so_far",
                (F.coalesce("told.finished", F.lit(False)) & (said(judge(F.col("content"), F.col("so_far")), "completed") == "yes")).alias("done"),
            )
        )
        over = (asked if i == continuations else asked.where("done")).select("doc_pk", "first", "so_far")
        done, open_ = over if done is None else done.unionByName(over), asked.where("not done").drop("done")
        if i < continuations and open_.isEmpty():
            break
    read = F.coalesce(*[lenient_object(F.col(c), _ENTRIES)["table_of_contents"] for c in ("so_far", "first")])
    entries = done.select("doc_pk", F.posexplode(read).alias("ord", "e"))
    return entries.select("doc_pk", "ord", "e.structure", "e.title", F.trim("e.page").try_cast("int").alias("page"))

"""Figures out of documents: many questions search one forest, and their answers become facts, with what went wrong beside them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborix.functions.text import numeric_value
from arborix.operators.search import searched, shared_words


def matching(question: Column, text: Column) -> Column:
    """The offline reply: the text itself where it has all words of the question, else none; never an error."""
    return F.struct(F.when(shared_words(question, text) >= 1.0, text).alias("answer"), F.lit(None).cast("string").alias("error"))


def figures(
    nodes: DataFrame,
    questions: DataFrame,
    *,
    iterations: int = 10,
    workers: int = 3,
    prior: Callable[[Column, Column], Column] = shared_words,
    score: Callable[[Column, Column], Column] = shared_words,
    reply: Callable[[Column, Column], Column] = matching,
) -> DataFrame:
    """Per question: doc_pk, question_id, value, pages, error.

    ``nodes`` has doc_pk, node_pk, parent_pk, child_order, start_index, end_index, title and text, ``questions`` doc_pk,
    question_id and question. The forest of a document is searched for all of its questions at once and isn't copied for
    them. ``reply`` gives a struct (answer, error) for a question and the text of the best leaf; :func:`models.tried` makes one of a
    model client. The first number of the answer is the value. A question whose document isn't there, whose reply failed or
    has no number keeps its row, with a null value and the reason; other questions don't suffer from it.
    """
    found = searched(nodes, questions, iterations=iterations, workers=workers, top=1, prior=prior, score=score).select("doc_pk", "question_id", "leaf_pk")
    best = found.join(nodes.select("doc_pk", F.col("node_pk").alias("leaf_pk"), "start_index", "end_index", "text"), ["doc_pk", "leaf_pk"])
    told = questions.join(best, ["doc_pk", "question_id"], "left").withColumn("reply", reply(F.col("question"), F.coalesce("text", F.lit(""))))
    value = F.when(F.col("leaf_pk").isNotNull(), numeric_value(F.col("reply.answer")))
    error = F.when(F.col("leaf_pk").isNull(), "no document").otherwise(F.coalesce("reply.error", F.when(F.col("value").isNull(), "no figure")))
    pages = F.when(F.col("value").isNotNull(), F.concat_ws("-", F.col("start_index").cast("string"), F.col("end_index").cast("string")))
    return told.withColumn("value", value).select("doc_pk", "question_id", "value", pages.alias("pages"), error.alias("error"))

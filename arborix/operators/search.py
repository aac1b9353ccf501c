"""Budgeted search in section forests: upper confidence bounds, batches of leaves, backpropagation."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborix.operators.ancestors import lines
from arborix.operators.models import Factory, Retry, answered
from arborix.sources.tables import stored

EXPLORATION, PRIOR_VISITS = 1.414, 3


def ucb(value_sum: float, visits: int, parent_visits: int | None, exploration: float = EXPLORATION) -> float:
    """Infinite where unvisited; the mean alone for a root; else the mean and the bonus for rare visits."""
    if not visits:
        return math.inf
    mean = value_sum / visits
    return mean if parent_visits is None else mean + exploration * math.sqrt(math.log(parent_visits) / visits)


def _unit(x: float | None) -> float:
    return 0.0 if x is None or math.isnan(x) else min(1.0, max(0.0, x))


def _bounded(score: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.nanvl(score.cast("double"), F.lit(0.0)), F.lit(0.0))))


def _asking(scorer: Callable[[], Callable[[list[str]], list[float]]]) -> Callable[[Column], Column]:
    """A Column of scores that a scorer, made once in each task, gives to the texts of a batch."""

    def ask(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score = scorer()
        for part in parts:
            given = list(score([t if isinstance(t, str) else "" for t in part])) if len(part) else []
            if len(given) != len(part):
                raise ValueError(f"{len(given)} scores for {len(part)} leaves")
            yield pd.Series([_unit(x) for x in given], dtype=float)

    return F.pandas_udf(ask, "double").asNondeterministic()


SCORE = "decimal(28, 12)"


def searched(
    nodes: DataFrame,
    questions: DataFrame | None = None,
    *,
    iterations: int,
    workers: int,
    top: int,
    scorer: Callable[[], Callable[[list[str]], list[float]]] | None = None,
    prior: Callable[[Column, Column], Column] | None = None,
    score: Callable[[Column, Column], Column] | None = None,
) -> DataFrame:
    """Per document and question: its best leaves, rows (doc_pk, [question_id,] leaf_pk, value, visits, rank, leaves_seen), after ``iterations`` evaluations.

    ``nodes`` has doc_pk, node_pk, parent_pk (null: a root), child_order, start_index, prior (counts among siblings) and
    score (counts at leaves). From the roots the search goes to the child with the highest bound that still has a leaf
    which is not in the batch; up to ``workers`` leaves are taken so, then their scores are added along their paths.
    With a ``scorer`` (made once in each task) ``nodes`` has text instead of score, and the scorer is asked for the
    leaves of a batch when the search has chosen them, so the budget is one of evaluations. With ``questions`` (doc_pk,
    question_id, question) each document's forest is searched for each of its questions at once, and ``prior`` and
    ``score`` may be functions of (question, title) and (question, text).
    Nodes whose parent is missing are not reached, and a document without a root has no rows.

    All searches go on together, a batch at a time. What is kept between batches is a table of the sums that evaluations
    have added to the nodes on their paths, which the budget bounds; forests aren't copied for each question. The way
    down is one equi-join a level: a node's share of the batch goes to its children by descending bounds, to each as many
    picks as it has leaves, which is what picking leaf after leaf comes to, as sums stay the same within a batch. At most
    ``workers`` children of a node can get any, so the window drops the others before it shuffles. Where ``workers``
    reach all leaves of a forest, whole batches take them all and are added up at once. A leaf that is taken again is
    asked for again, but for those whole batches.
    """
    if min(iterations, workers, top) < 1:
        raise ValueError("a search needs at least one evaluation, one worker and one leaf to return")
    asked = questions is not None
    names = ["doc_pk", "question_id"]
    if questions is None:
        questions = nodes.select("doc_pk").distinct().select("doc_pk", F.lit(0).alias("question_id"), F.lit("").alias("question"))
    questions = questions.select(*names, "question").where("doc_pk is not null")
    if scorer is not None:
        ask = _asking(scorer)
        score = lambda question, text: ask(text)
    judged = _bounded(F.col("score")) if score is None else _bounded(score(F.col("question"), F.col("text")))
    whole = nodes
    carried = ["prior"] if prior is None else ["title"]
    nodes = stored(nodes.select("doc_pk", "node_pk", "parent_pk", "child_order", "start_index", *carried, *(["score"] if score is None else [])))
    inner = nodes.where("parent_pk is not null").select("doc_pk", F.col("parent_pk").alias("node_pk"), F.lit(True).alias("inner")).distinct()
    nodes = stored(nodes.join(inner, ["doc_pk", "node_pk"], "left").withColumn("is_leaf", F.col("inner").isNull()).drop("inner"))
    texts = (nodes if score is None else whole).select("doc_pk", "node_pk", "score" if score is None else "text")  # texts are not copied, but read for each batch
    below, high = _leaves_below(nodes)
    kids = nodes.join(below, ["doc_pk", "node_pk"], "left").withColumn("leaves", F.coalesce("leaves", F.lit(1)))
    roots = kids.where("parent_pk is null").groupBy("doc_pk").agg(F.count(F.lit(1)).alias("roots"), F.sum("leaves").alias("all"))
    kids = stored(kids.join(roots.select("doc_pk", "roots"), "doc_pk").drop("score"))
    tasks = stored(questions.join(roots.select("doc_pk", "all"), "doc_pk"))

    def added(picks: DataFrame) -> DataFrame:
        """What evaluated picks (line, times) add to the nodes of their lines, which begin at the leaf."""
        scored = picks.join(texts, ["doc_pk", "node_pk"]).select(*names, "line", "times", (judged.cast(SCORE) * F.col("times").cast("decimal(9, 0)")).cast(SCORE).alias("got"))
        return scored.select(*names, F.posexplode("line").alias("distance", "node_pk"), "times", "got").select(*names, "node_pk", (F.col("distance") == 0).alias("evaluated"), "times", "got")

    def summed(parts: DataFrame) -> DataFrame:
        return stored(parts.groupBy(*names, "node_pk").agg(F.sum("times").alias("times"), F.sum("got").cast(SCORE).alias("got"), F.max("evaluated").alias("evaluated")))

    small = F.col("all") <= workers
    few = tasks.where(small).select("doc_pk").distinct()
    short = nodes.join(few, "doc_pk", "left_semi").select("doc_pk", "node_pk", "parent_pk", "is_leaf")
    up = lines(short, short.where("is_leaf").select("doc_pk", "node_pk")).groupBy("doc_pk", "start").agg(F.array_sort(F.collect_list(F.struct("distance", "node_pk"))).getField("node_pk").alias("line"))
    ends = short.where("parent_pk is null").select("doc_pk", F.col("node_pk").alias("end"))
    up = up.withColumn("end", F.element_at("line", -1)).join(ends, ["doc_pk", "end"], "left_semi")
    times = F.floor(iterations / F.col("all"))
    state = summed(added(tasks.where(small).select(*names, "question", times.alias("times")).where("times > 0").join(up.withColumnRenamed("start", "node_pk"), "doc_pk")))

    done = 0
    while done < iterations:
        budget = min(workers, iterations - done)
        share = F.when(small, F.lit(iterations) % F.col("all") if not done else F.lit(0)).otherwise(F.lit(budget))
        empty = F.expr(f"cast(null as {kids.schema['node_pk'].dataType.simpleString()})")
        front = tasks.select(*names, "question", empty.alias("at"), F.lit(None).cast("long").alias("entered"), share.cast("long").alias("share"), F.slice(F.array(empty), 1, 0).alias("line")).where("share > 0")
        taken = [state.select(*names, "node_pk", "evaluated", "times", "got")]
        for _ in range(high + 1):
            level = stored(_down(front, kids, state, names, prior, workers))
            taken.append(added(level.where("is_leaf").select(*names, "question", F.col("at").alias("node_pk"), "line", F.lit(1).cast("long").alias("times"))))
            front = level.where("not is_leaf").drop("is_leaf")
        state = summed(reduce(DataFrame.unionByName, taken))
        done += budget

    own = prior(F.col("question"), F.col("title")) if prior else F.col("prior")
    seen = state.where("evaluated").join(tasks.select(*names, "question"), names).join(kids, ["doc_pk", "node_pk"])
    seen = seen.withColumn("visits", F.col("times") + PRIOR_VISITS).withColumn("mean", (PRIOR_VISITS * _start(own) + F.col("got").cast("double")) / F.col("visits"))
    best = Window.partitionBy(*names).orderBy(F.desc("mean"), F.desc("visits"), "start_index", "node_pk")
    number = F.count(F.lit(1)).over(Window.partitionBy(*names))
    ranked = seen.select(*names, F.col("node_pk").alias("leaf_pk"), F.round(F.round("mean", 9).cast("decimal(30, 9)"), 4).cast("double").alias("value"), "visits", F.row_number().over(best).cast("long").alias("rank"), number.alias("leaves_seen"))
    return ranked.where(F.col("rank") <= top).drop(*([] if asked else ["question_id"]))


def _start(prior: Column) -> Column:
    """A node's prior; the only root of a document has nothing to be chosen from and counts as one of prior 1."""
    return F.when(F.col("parent_pk").isNull() & (F.col("roots") == 1), 1.0).otherwise(_bounded(prior))


def _leaves_below(nodes: DataFrame) -> tuple[DataFrame, int]:
    """(doc_pk, node_pk, leaves) of the nodes that have leaves below, and the number of levels above leaves: sums that go up one level a round, and shrink with each.

    Rounds are as many as the longest line from a leaf has levels; circles end them at the number of a document's nodes.
    """
    longest = nodes.groupBy("doc_pk").count().agg(F.max("count")).first()[0] or 0
    parents = nodes.where("parent_pk is not null").select("doc_pk", "node_pk", "parent_pk")
    level, found, high = nodes.where("is_leaf").select("doc_pk", "node_pk", "parent_pk", F.lit(1).cast("long").alias("leaves")), None, 0
    for high in range(longest):
        summed = stored(level.where("parent_pk is not null").groupBy("doc_pk", F.col("parent_pk").alias("node_pk")).agg(F.sum("leaves").alias("leaves")))
        if summed.isEmpty():
            break
        found = summed if found is None else found.unionByName(summed)
        level = summed.join(parents, ["doc_pk", "node_pk"])
    if found is None:
        return nodes.where(F.lit(False)).select("doc_pk", "node_pk", F.lit(1).cast("long").alias("leaves")), 0
    return found.groupBy("doc_pk", "node_pk").agg(F.sum("leaves").alias("leaves")), high


def _down(front: DataFrame, kids: DataFrame, state: DataFrame, names: list[str], prior: Callable[[Column, Column], Column] | None, workers: int) -> DataFrame:
    """The picks one level further down."""
    below = kids.select(F.col("doc_pk").alias("_doc"), "parent_pk", "node_pk", "child_order", "leaves", "roots", "is_leaf", *(["title"] if prior else ["prior"]))
    met = front.join(below, (front["doc_pk"] == below["_doc"]) & front["at"].eqNullSafe(below["parent_pk"])).drop("_doc")
    met = met.join(state.select(*names, "node_pk", "times", "got"), [*names, "node_pk"], "left")
    visits = F.coalesce("times", F.lit(0)) + PRIOR_VISITS
    own = prior(F.col("question"), F.col("title")) if prior else F.col("prior")
    mean = (PRIOR_VISITS * _start(own) + F.coalesce(F.col("got").cast("double"), F.lit(0.0))) / visits
    bound = mean + F.when(F.col("entered").isNull(), 0.0).otherwise(EXPLORATION * F.sqrt(F.ln("entered") / visits))
    order = Window.partitionBy(*names, "at").orderBy(F.desc("bound"), "child_order", "node_pk")
    ranked = met.withColumns({"bound": bound, "seen": visits}).withColumn("place", F.row_number().over(order)).where(F.col("place") <= workers)
    before = F.coalesce(F.sum("leaves").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shared = ranked.withColumn("part", F.least(F.col("leaves"), F.col("share") - before)).where("part > 0")
    return shared.select(*names, "question", F.col("node_pk").alias("at"), F.col("seen").cast("long").alias("entered"), F.col("part").cast("long").alias("share"), F.array_prepend("line", F.col("node_pk")).alias("line"), "is_leaf")


def seeded(nodes: DataFrame) -> DataFrame:
    """Adds visits and value_sum as they are when a node's parent has been entered: PRIOR_VISITS visits of its prior, brought into 0 to 1.

    The only root of a document has nothing to be chosen from and counts as one of prior 1.
    """
    siblings = Window.partitionBy("doc_pk", "parent_pk")
    prior = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.nanvl("prior", F.lit(0.0)), F.lit(0.0))))
    alone = F.col("parent_pk").isNull() & (F.count(F.lit(1)).over(siblings) == 1)
    return nodes.withColumns({"visits": F.lit(PRIOR_VISITS).cast("long"), "value_sum": PRIOR_VISITS * F.when(alone, 1.0).otherwise(prior)})


def backpropagated(nodes: DataFrame, evaluated: DataFrame) -> DataFrame:
    """(doc_pk, node_pk, visits, value_sum): what evaluations (doc_pk, node_pk, score) add to their nodes and to all above.

    Evaluations of one node are summed first; their lines to the root come by pointer doubling, so no depth is asked for.
    """
    rows = evaluated.groupBy("doc_pk", F.col("node_pk").alias("start")).agg(F.count(F.lit(1)).alias("visits"), F.sum(F.col("score").cast("decimal(28, 10)")).alias("value_sum"))
    added = lines(nodes, rows.select("doc_pk", F.col("start").alias("node_pk"))).join(rows, ["doc_pk", "start"])
    return added.groupBy("doc_pk", "node_pk").agg(F.sum("visits").alias("visits"), F.sum("value_sum").cast("double").alias("value_sum"))


def lexical_score(question: str, text: Column) -> Column:
    """The share of the question's words that a text has, without a model: words are runs of letters and digits, case apart."""
    words = sorted({w.lower() for w in re.findall(r"\w+", question)})
    if not words:
        return F.lit(0.0)
    have = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)\w+"), F.lit(0))
    return F.size(F.array_intersect(F.array_distinct(have), F.array(*map(F.lit, words)))) / F.lit(float(len(words)))


def shared_words(question: Column, text: Column) -> Column:
    """:func:`lexical_score` for a column of questions."""
    words = lambda t: F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(t, F.lit(""))), F.lit(r"(?U)\w+"), F.lit(0)))
    asked = words(question)
    return F.when(F.size(asked) > 0, F.size(F.array_intersect(words(text), asked)) / F.size(asked)).otherwise(0.0)


def sources(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """What an answer cites, for each row of :func:`searched`: doc_pk, rank, source (node_pk, title, pages, score, visits, path), summary, text.

    ``nodes`` has doc_pk, node_pk, parent_pk, title, start_index, end_index, summary and text. ``pages`` is start-end,
    ``path`` the titles from the root to the leaf; a leaf with a blank text gives its summary instead. The lines of the
    few leaves that were found come by pointer doubling. A question_id of ``found`` is kept.
    """
    keys = ["doc_pk", *(c for c in found.columns if c == "question_id"), "rank"]
    own = nodes.select("doc_pk", F.col("node_pk").alias("leaf_pk"), "title", "start_index", "end_index", "summary", "text")
    up = lines(nodes, found.select("doc_pk", F.col("leaf_pk").alias("node_pk")).distinct()).join(nodes.select("doc_pk", "node_pk", "title"), ["doc_pk", "node_pk"])
    paths = up.groupBy("doc_pk", F.col("start").alias("leaf_pk")).agg(F.array_sort(F.collect_list(F.struct((-F.col("distance")).alias("d"), "title"))).getField("title").alias("path"))
    met = found.join(own, ["doc_pk", "leaf_pk"]).join(paths, ["doc_pk", "leaf_pk"])
    pages = F.concat_ws("-", F.col("start_index").cast("string"), F.col("end_index").cast("string"))
    source = F.struct(F.col("leaf_pk").alias("node_pk"), "title", pages.alias("pages"), F.round("value", 4).alias("score"), "visits", "path")
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)^\s+|\s+$", "")
    return met.select(*keys, source.alias("source"), F.coalesce("summary", F.lit("")).alias("summary"), F.when(text != "", text).otherwise(F.coalesce("summary", F.lit(""))).alias("text"))


def synthesized(question: Column, cited: DataFrame, factory: Factory | None = None, *, retry: Retry = Retry()) -> DataFrame:
    """One answer for each document: doc_pk, answer, sources (best first), from rows of :func:`sources`.

    A model made by ``factory`` gets the question and the path, pages, summary and text of every source; an empty answer
    is an error. Without one the answer is the first two sentences of the best source that has text.
    """
    section = F.concat(F.lit("\n\n"), F.array_join("source.path", " > "), F.lit(", pp. "), "source.pages", F.lit("\n"), "summary", F.lit("\n"), "text")
    listed = cited.withColumn("section", section).groupBy("doc_pk").agg(F.array_sort(F.collect_list(F.struct("rank", "source", "section", "text"))).alias("s"))
    if factory is None:
        full = F.filter("s.text", lambda t: t != "")
        answer = F.regexp_extract(F.coalesce(F.try_element_at(full, F.lit(1)), F.lit("")), r"(?s)^\s*([^.]*\.?(?:[^.]*\.)?)", 1)
        return listed.select("doc_pk", answer.alias("answer"), F.col("s.source").alias("sources"))
    reply = listed.select("doc_pk", "s", answered(F.concat(question, F.array_join("s.section", "")), factory, retry=retry).alias("reply"))
    text = F.regexp_replace(F.coalesce("reply", F.lit("")), r"(?U)^\s+|\s+$", "")
    return reply.select("doc_pk", F.when(text != "", text).otherwise(F.raise_error(F.lit("an answer is empty")).cast("string")).alias("answer"), F.col("s.source").alias("sources"))

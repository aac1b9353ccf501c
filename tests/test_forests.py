"""The search of all forests at once, lines by pointer doubling, and statements read out of documents."""

import random
import sys
from pathlib import Path

from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from plain_search import Forest

from arborix.operators import figures, models, search, verify
from arborix.operators.ancestors import lines

NODE = "doc_pk long, node_pk long, parent_pk long, child_order int, start_index int, prior double, score double"


def forests():
    r, rows = random.Random(4), []
    for doc in range(20):
        n = r.choice([1, 2, 3, 5, 9])
        for i in range(n):
            parent = None if i == 0 or r.random() < 0.1 else r.randrange(i // 3 + 1) if i > 1 else 0
            rows.append((doc, 100 * doc + i, None if parent is None else 100 * doc + parent, r.randrange(3), r.randrange(9), r.choice([0.25, 0.5, r.random(), 2.0, None]), r.choice([0.0, 1.0, r.random()])))
    rows += [(50, i, i - 1 if i else None, 0, 0, 0.5, 0.5) for i in range(4)]  # a chain
    rows += [(51, 1, 9, 0, 0, 1.0, 1.0), (52, 1, 2, 0, 0, 1.0, 1.0), (52, 2, 1, 0, 0, 1.0, 1.0), (52, 3, 2, 0, 0, 1.0, 1.0), (52, 4, None, 0, 0, 1.0, 0.5)]  # a lost parent, a circle
    return rows


def test_all_forests_at_once_equal_one_at_a_time(spark):
    rows = forests()
    df = spark.createDataFrame(rows, NODE)
    for how in ({"iterations": 5, "workers": 3, "top": 4},):
        got = sorted((r["doc_pk"], r["rank"], r["leaf_pk"], round(r["value"], 3), r["visits"], r["leaves_seen"]) for r in search.searched(df, **how).collect())
        want = []
        for doc in {r[0] for r in rows}:
            own = Forest([r for r in rows if r[0] == doc and (doc != 52 or r[1] == 4)])  # it would go round the circle
            want += [(doc, rank, pk, value, visits, seen) for pk, value, visits, rank, seen in (own.run(**how) if own.kids.get(None) else [])]
        assert [(g[:3], g[4:]) for g in got] == [((d, r, p), (v, s)) for d, r, p, _, v, s in sorted(want)]
        assert all(abs(g[3] - w[3]) < 0.0011 for g, w in zip(got, sorted(want)))


def test_questions_share_a_forest(spark):
    nodes = [(1, 1, None, 0, 1, "Report", ""), (1, 2, 1, 0, 1, "Income", "net sales were 5"), (1, 3, 1, 1, 2, "Debt", "net debt was 7"), (1, 4, 1, 2, 3, "Staff", "people")]
    df = spark.createDataFrame(nodes, "doc_pk long, node_pk long, parent_pk long, child_order int, start_index int, title string, text string")
    asked = spark.createDataFrame([(1, "a", "net debt"), (1, "b", "sales income"), (2, "c", "no such document")], "doc_pk long, question_id string, question string")
    how = {"iterations": 2, "workers": 2, "top": 1, "prior": search.shared_words, "score": search.shared_words}
    assert {(r["question_id"], r["leaf_pk"], r["leaves_seen"]) for r in search.searched(df, asked, **how).collect()} == {("a", 3, 2), ("b", 2, 2)}


def test_lines_of_a_long_chain_a_circle_and_a_lost_parent(spark):
    chain = [(1, i, i - 1 if i else None) for i in range(1000)]
    odd = [(2, 1, 2), (2, 2, 3), (2, 3, 1), (2, 4, 1), (3, 1, 7), (3, 2, 1)]
    nodes = spark.createDataFrame(chain + odd, "doc_pk long, node_pk long, parent_pk long")
    starts = spark.createDataFrame([(1, 999), (1, 0), (2, 4), (3, 2)], "doc_pk long, node_pk long")
    rows = lines(nodes, starts).collect()
    assert {r["node_pk"]: r["distance"] for r in rows if (r["doc_pk"], r["start"]) == (1, 999)} == {i: 999 - i for i in range(1000)}
    assert [(r["node_pk"], r["distance"]) for r in rows if (r["doc_pk"], r["start"]) == (1, 0)] == [(0, 0)]
    assert sorted((r["distance"], r["node_pk"]) for r in rows if r["doc_pk"] == 2) == [(0, 4), (1, 1), (2, 2), (3, 3)]
    assert sorted((r["distance"], r["node_pk"]) for r in rows if r["doc_pk"] == 3) == [(0, 2), (1, 1), (2, 7)]
    depth = verify.reachable(nodes.where("doc_pk = 1")).agg(F.max("depth"), F.count(F.lit(1))).first()
    assert tuple(depth) == (999, 1000) and verify.reachable(nodes.where("doc_pk > 1")).count() == 0


def test_a_failed_question_has_a_reason_and_the_others_an_answer(spark):
    nodes = [(1, 1, None, 0, 1, 9, "Report", ""), (1, 2, 1, 0, 3, 4, "Net sales", "(1,250.5) thousand for Net sales"), (1, 3, 1, 1, 5, 5, "Net debt", "none for Net debt")]
    df = spark.createDataFrame(nodes, "doc_pk long, node_pk long, parent_pk long, child_order int, start_index int, end_index int, title string, text string")
    asked = spark.createDataFrame([(1, "net sales"), (1, "net debt"), (1, "debt"), (2, "net sales")], "doc_pk long, question_id string").withColumn("question", F.col("question_id"))

    def client():
        def ask(texts):
            if any(t.startswith("debt") for t in texts):
                raise RuntimeError("no service")
            return [t.split("|")[1] for t in texts]

        return ask

    replies = {"offline": figures.matching, "model": models.tried(lambda q, t: F.concat(q, F.lit("|"), t), client, retry=models.Retry(attempts=1))}
    for kind, reply in replies.items():
        rows = {(r["doc_pk"], r["question_id"]): (r["value"], r["pages"], r["error"]) for r in figures.figures(df, asked, iterations=2, workers=2, reply=reply).collect()}
        assert rows == {
            (1, "net sales"): (-1250500.0, "3-4", None), (1, "net debt"): (None, None, "no figure"), (2, "net sales"): (None, None, "no document"),
            (1, "debt"): (None, None, "no figure" if kind == "offline" else "RuntimeError: no service"),
        }

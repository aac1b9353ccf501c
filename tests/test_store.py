import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from arborix.functions.answers import leaf_score, prior_scores
from arborix.operators import chunks, ingest, models, search, verify
from arborix.operators import statements as st
from arborix.plans.catalogue import levels
from arborix.sources import catalogue, store

NODES = "doc_name string, node_id string, title string, node_text string"


def docs(spark, *rows):
    return spark.createDataFrame(rows, "doc_name string, company string, year_period string, raw_json string")


def test_documents_replace_those_of_their_name(spark, tmp_path):
    root = f"{tmp_path}/store"
    store.init(spark, root)
    assert store.documents(spark, root).count() == 0 and store.history(spark, root).count() == 0
    store.register(docs(spark, ("a", "x", "2021", "{}"), ("b", "y", "2021", None)), spark.createDataFrame([("a", "0000", "t", "u"), ("a", "0001", "t", "u")], NODES), root)
    store.register(docs(spark, ("a", "z", "2022", "[]")), spark.createDataFrame([("a", "0000", "new", "u")], NODES), root)
    store.init(spark, root)
    assert {(r["doc_name"], r["company"], r["node_count"]) for r in store.listing(spark, root).collect()} == {("a", "z", 1), ("b", "y", 0)}
    assert [r["title"] for r in store.nodes(spark, root).collect()] == ["new"]
    key = store.document(spark, root, "a").first()["doc_pk"]
    assert store.document(spark, root, key).first()["doc_name"] == "a"
    assert {(r["company"], r["doc_name"]) for r in store.latest(spark, root).collect()} == {("z", "a"), ("y", "b")}
    assert {r["company"] for r in store.companies(spark, root).collect()} == {"y", "z"}
    with pytest.raises(LookupError):
        store.document(spark, root, "c")
    with pytest.raises(ValueError):
        store.register(docs(spark, ("a", "x", "1", None), ("a", "x", "2", None)), spark.createDataFrame([], NODES), root)


def test_workflows_and_vectors(spark, tmp_path):
    root = f"{tmp_path}/store"
    store.init(spark, root)
    facts = st.wide(spark.createDataFrame([("a", "2021", "Revenue", 5.0), ("a", "2022", "Revenue", 6.0), ("b", "2021", "Cash", 1.0)], "company string, year_period string, canonical_name string, value double"))
    store.save_workflows(st.statement(st.resolved(facts)), root, data_source="x")
    rows = {r["company"]: r for r in store.history(spark, root).collect()}
    assert rows["a"]["year_periods"] == ["2021", "2022"] and rows["a"]["metric_count"] == 26 and rows["a"]["event_count"] == 52
    assert [r["company"] for r in store.history(spark, root, "b").collect()] == ["b"]
    stored = json.loads(store.workflow(spark, root, rows["a"]["workflow_id"]).first()["statement"])
    assert stored[0]["canonical_name"] == "Revenue" and stored[0]["value"] == 5.0 and any(x["value"] is None for x in stored)
    with pytest.raises(LookupError):
        store.workflow(spark, root, 1)
    vector = lambda *rows: spark.createDataFrame(rows, "id string, content string, embedding array<float>")
    store.add_vectors(vector(("p", "old", [1.0, 0.0]), ("q", "c", [0.0, 1.0])), root, dimension=2)
    store.add_vectors(vector(("p", "new", [0.5, 0.5])), root, dimension=2)
    with pytest.raises(PySparkException):
        store.add_vectors(vector(("r", "bad", [1.0])), root, dimension=2)
    assert {(r["id"], r["content"]) for r in store.vectors(spark, root).collect()} == {("p", "new"), ("q", "c")}


def test_catalogues_are_data(spark, tmp_path):
    raw = {
        "metrics": [{"canonical_name": "A"}, {"canonical_name": "B / C", "input_type": "derived", "metric_type": "ratio", "sct_section": "Own", "derivation_code": {"formula": " A / S "}}],
        "aggregations": {"S": {"components": [{"metric": "x", "sign": 1}, {"metric": "y", "sign": -1}]}},
    }
    (tmp_path / "c.json").write_text(json.dumps(raw))
    metrics = catalogue.read(spark, f"{tmp_path}/c.json")
    assert list(metrics) == ["A", "B / C", "S", "x", "y"] and not metrics["x"].shown and metrics["S"].parts == (("x", 1), ("y", -1))
    facts = st.wide(spark.createDataFrame([("a", "2021", "A", 6.0), ("a", "2021", "x", 5.0), ("a", "2021", "y", 2.0)], "company string, year_period string, canonical_name string, value double"), metrics)
    rows = st.statement(st.resolved(facts, metrics), None, metrics).orderBy("section_rank", "row_rank").collect()
    assert [(r["canonical_name"], r["section"], r["value"]) for r in rows] == [("A", "Others", 6.0), ("B / C", "Own", 2.0)]
    assert st.serialized(st.resolved(facts, metrics), metrics).count() == 2
    with pytest.raises(ValueError):
        catalogue.from_definitions({"metrics": []})


def test_circles_come_last_with_a_warning(spark):
    metrics = catalogue.from_definitions({"metrics": [{"canonical_name": n, "input_type": "derived", "derivation_code": f} for n, f in (("P", "Q + R"), ("Q", "P * 2"))] + [{"canonical_name": "R"}]})
    with pytest.warns(UserWarning, match="circle"):
        assert levels(metrics) == [["R"], ["P"], ["Q"]]
    facts = st.wide(spark.createDataFrame([("a", "2021", "R", 6.0)], "company string, year_period string, canonical_name string, value double"), metrics)
    with pytest.warns(UserWarning):
        rows = st.long(st.resolved(facts, metrics), None, metrics).collect()
    assert {r["canonical_name"]: r["status"] for r in rows} == {"P": "partial", "Q": "partial", "R": "resolved"}


def test_forest_reports(spark):
    rows = [(1, 1, None, "r"), *[(1, i, 1, "t") for i in range(2, 11)], (2, 1, None, "  \n"), (3, 5, 4, "x"), (4, 1, None, "r"), (4, 2, 9, "x")]
    nodes = spark.createDataFrame(rows, "doc_pk long, node_pk long, parent_pk long, node_text string")
    got = {r["doc_pk"]: tuple(r)[1:] for r in verify.report(nodes).collect()}
    assert got == {1: (10, 1, 0, 9, 9, "ok"), 2: (1, 1, 0, 1, 0, "degraded"), 3: (1, 0, 1, 1, 1, "error"), 4: (2, 1, 1, 2, 2, "error")}
    assert verify.whole(nodes.where("doc_pk < 3")).count() == 11
    with pytest.raises(ValueError):
        verify.whole(nodes)
    assert verify.differences(nodes, nodes).count() == 0
    assert [r["side"] for r in verify.differences(nodes, nodes.where("doc_pk <> 2")).collect()] == ["first"]


def test_models_are_asked_in_batches_and_again(spark):
    def factory():
        seen = []

        def ask(questions):
            seen.append(questions)
            if len(seen) == 1:
                raise OSError("busy")
            assert len(questions) <= 2
            return [q.upper() for q in questions]

        return ask

    rows = spark.createDataFrame([("a",), (None,), ("b",), ("c",), ("d",)], "q string").coalesce(1)
    quick = models.Retry(attempts=2, first=0.0, jitter=0.0)
    assert [r[0] for r in rows.select(models.answered(F.col("q"), factory, size=2, retry=quick)).collect()] == ["A", None, "B", "C", "D"]
    with pytest.raises(PySparkException):
        rows.select(models.answered(F.col("q"), factory, size=2, retry=models.Retry(attempts=1))).collect()
    flat = lambda: lambda questions: [[1.0, 2.0] for _ in questions]
    assert rows.select(models.embedded(F.col("q"), flat, dimension=2).alias("e")).first()["e"] == [1.0, 2.0]
    with pytest.raises(PySparkException):
        rows.select(models.embedded(F.col("q"), flat, dimension=3, retry=quick)).collect()


def test_answers(spark):
    cases = {'{"score": 0.25}': 0.25, '{"score": 7}': 1.0, '{"score": -1}': 0.0, '{"score": true}': None, '{"score": "0.5"}': None, "{}": None, "no": None, "": None}
    rows = spark.createDataFrame([(k,) for k in cases], "a string").select("a", leaf_score(F.col("a")).alias("s")).collect()
    assert {r["a"]: r["s"] for r in rows} == cases
    answer = '[{"title": "a", "score": 0.1}, {"title": "b"}, {"title": "a", "score": 4}, {"score": 1}]'
    row = spark.createDataFrame([(answer,)], "a string").select(prior_scores(F.col("a")).alias("p")).first()
    assert row["p"] == {"a": 1.0}


def test_index_rows(spark):
    rows = chunks.search_documents(spark.createDataFrame([(" x ", "p", "2020"), ("y", None, None)], "content string, source_path string, year string")).collect()
    assert [(r["content"], r["source_path"], r["year"], r["chunk_index"], len(r["id"])) for r in rows] == [("x", "p", 2020, 0, 64), ("y", "", 0, 0, 64)]
    with pytest.raises(PySparkException):
        chunks.search_documents(spark.createDataFrame([(" \n",)], "content string")).collect()


def test_routes_and_divided_leaves(spark):
    toc = "doc_pk long, ord int, structure string, title string, physical_index int"
    first, second = spark.createDataFrame([(1, 0, "1", "a", None), (2, 0, "1", "b", 3)], toc), spark.createDataFrame([(1, 0, "1", "c", 1), (2, 0, "1", "d", 1)], toc)
    assert {(r["doc_pk"], r["title"]) for r in ingest.routed(first, second).collect()} == {(1, "c"), (2, "b")}
    pages = spark.range(1, 31).select(F.lit(1).cast("long").alias("doc_pk"), F.col("id").alias("page_no"), F.lit(10).cast("long").alias("token_count"))
    nodes = spark.createDataFrame([(1, "1", "Big", 2, 25), (1, "2", "Small", 26, 30)], "doc_pk long, structure string, title string, start_index int, end_index int")
    found = spark.createDataFrame([(1, 0, "1", "Big", 2), (1, 1, "1", "A", 3), (1, 2, "1.1", "A1", 3), (1, 3, "1.2", "A2", 9), (1, 4, "2", "B", 20), (1, 5, "3", "Other", 27)], toc)
    made = ingest.divided(nodes, pages, found, pages_above=10, tokens_from=100, depth=3).orderBy("structure").collect()
    assert [(r["structure"], r["title"], r["start_index"], r["end_index"]) for r in made] == [
        ("1", "Big", 2, 2), ("1.1", "A", 3, 19), ("1.1.1", "A1", 3, 8), ("1.1.2", "A2", 9, 19), ("1.2", "B", 20, 25), ("2", "Small", 26, 30),
    ]


def test_searches_without_a_budget_are_refused(spark):
    with pytest.raises(ValueError):
        search.searched(spark.range(1), iterations=0, workers=1, top=1)

import pytest
from pyspark.sql import functions as F

from arborix.functions.text import display, lenient_object, numeric_value, search_text
from arborix.operators import chunks, forest, models, search, verify
from arborix.sources import trees


def test_numbers_in_answers(spark):
    cases = {"Revenue was 5 million.": 5e6, "(1,234.5)": -1234.5, "none": None, "": None, "In FY22 revenue was 5": 22.0, "1,000,000": 1e6, "2 bn": 2e9, "0.125": 0.12, "(1.2.3)": None, "loss (12,34)": -1234.0, "Revenue, in 2022": None}
    rows = spark.createDataFrame([(k,) for k in cases], "a string").select("a", numeric_value(F.col("a")).alias("v")).collect()
    assert {r["a"]: r["v"] for r in rows} == cases


def test_lenient_json(spark):
    row = spark.createDataFrame([('x ```json\n{"a": None,\n "b": [1, 2,],}\n``` y',)], "t string").select(lenient_object(F.col("t"), "a int, b array<int>").alias("o")).first()["o"]
    assert row["a"] is None and row["b"] == [1, 2]


def test_chunks_cover_the_text(spark):
    text = "".join(chr(97 + i % 26) for i in range(9000))
    made = chunks.char_chunks(spark.createDataFrame([(1, text), (2, "x" * 4000)], "k long, t string"), "k", "t").orderBy("k", "chunk_index").collect()
    assert [(r["k"], r["chunk_index"], len(r["content"])) for r in made] == [(1, 0, 4000), (1, 1, 4000), (1, 2, 1400), (2, 0, 4000)]
    assert made[0]["content"] + made[1]["content"][200:] + made[2]["content"][200:] == text


def test_token_chunks_overlap(spark):
    pages = spark.createDataFrame([(1, i, 50) for i in range(1, 6)], "doc_pk long, page_no long, token_count long")
    assert [(r["page_start"], r["page_end"]) for r in chunks.token_chunks(pages, limit=120).orderBy("chunk_no").collect()] == [(1, 2), (2, 3), (3, 4), (4, 5)]


def test_parents_come_earlier_and_the_last_one_wins(spark):
    toc = spark.createDataFrame([(1, 0, "1"), (1, 1, "1.1"), (1, 2, "1"), (1, 3, "1.2"), (1, 4, "3.1"), (1, 5, "1.2.1")], "doc_pk long, ord long, structure string")
    assert [r["parent_ord"] for r in forest.parents(toc).orderBy("ord").collect()] == [None, 0, None, 2, None, 3]


NODE = "doc_pk long, node_pk long, parent_pk long, child_order long, start_index long, prior double, score double"


def found(spark, nodes, **how):
    return [tuple(r)[1:] for r in search.searched(spark.createDataFrame(nodes, NODE), **how).orderBy("doc_pk", "rank").collect()]


def test_search_takes_the_best_bounds_and_adds_scores_along_paths(spark):
    flat = [(1, 100, None, 0, 1, 1.0, 0.0), (1, 1, 100, 0, 1, 0.9, 0.2), (1, 2, 100, 1, 2, 0.8, 0.9), (1, 3, 100, 2, 3, 0.0, 0.0)]
    # a batch of two takes the two best priors, once each: (3 * 0.8 + 0.9) / 4 and (3 * 0.9 + 0.2) / 4
    assert found(spark, flat, iterations=2, workers=2, top=3) == [(2, 0.825, 4, 1, 2), (1, 0.725, 4, 2, 2)]
    rows = found(spark, flat, iterations=9, workers=2, top=3)
    assert sum(r[2] - 3 for r in rows) == 9 and rows[0][0] == 2


def test_search_descends_and_leaves_out_reserved_subtrees(spark):
    deep = [(1, 10, None, 0, 1, 0.9, 0.0), (1, 20, None, 1, 5, 0.1, 0.0), (1, 11, 10, 0, 1, 0.5, 1.0), (1, 21, 20, 0, 5, 0.5, 0.4), (1, 99, 77, 0, 1, 1.0, 1.0), (2, 30, None, 0, 1, 0.0, 7.0)]
    # both roots are tried in one batch, for the first has one leaf only; the node without its parent is not reached; a lone root is a leaf
    assert found(spark, deep, iterations=2, workers=2, top=5) == [(11, 0.625, 4, 1, 2), (21, 0.475, 4, 2, 2), (30, 1.0, 5, 1, 1)]
    assert found(spark, [(3, 1, 2, 0, 1, 1.0, 1.0)], iterations=2, workers=2, top=5) == []


def test_bounds():
    assert search.ucb(0, 0, 5) == float("inf") and search.ucb(3.0, 4, None) == 0.75


def test_display_and_search_texts(spark):
    row = spark.range(1).select(display(F.lit(1234567.5), "absolute").alias("a"), display(F.lit(-0.126), "ratio").alias("b"), display(F.lit(None).cast("double"), "margin").alias("c")).first()
    assert tuple(row) == ("1,234,568", "-0.13", "NA")
    names = F.array(*[F.lit(x) for x in ("Sales", "revenue", "SALES", "a", "b", "c", "d", "e", "f")])
    asked = spark.range(1).select(search_text(F.lit("Revenue"), names).alias("a"), search_text(F.lit("Revenue"), F.lit(None).cast("array<string>")).alias("b")).first()
    assert "'Revenue' (also known as: Sales, a, b, c, d, e). Return" in asked[0] and "'Revenue'. Return" in asked[1]


def test_a_scorer_is_asked_for_chosen_leaves_only(spark):
    nodes = [(1, 100, None, 0, 1, 1.0, ""), *[(1, i, 100, i, i, 0.9 - i / 10, "hit" if i == 2 else f"leaf {i}") for i in range(1, 6)]]
    asked = spark.sparkContext.accumulator(0)

    def scorer():
        def score(texts):
            asked.add(len(texts))
            return [1.0 if t == "hit" else 0.0 for t in texts]

        return score

    table = spark.createDataFrame(nodes, NODE.replace("score double", "text string"))
    rows = search.searched(table, iterations=2, workers=2, top=3, scorer=scorer).collect()
    assert [r["leaf_pk"] for r in rows] == [2, 1] and asked.value == 2  # three leaves are never scored
    scored = spark.createDataFrame([(*n[:6], 1.0 if n[6] == "hit" else 0.0) for n in nodes], NODE)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, search.searched(scored, iterations=2, workers=2, top=3).collect()))
    assert spark.range(1).select(search.lexical_score("Net worth, net", F.lit("NET debt"))).first()[0] == 0.5


def test_answers_cite_their_sources(spark):
    nodes = spark.createDataFrame(
        [(1, 1, None, "Report", 1, 9, None, None), (1, 2, 1, "Notes", 3, 5, "sum", " One. Two. Three."), (1, 3, 1, "Other", 6, 6, "only a summary", " ")],
        "doc_pk long, node_pk long, parent_pk long, title string, start_index int, end_index int, summary string, text string",
    )
    found = spark.createDataFrame([(1, 2, 0.98765, 4, 2), (1, 3, 1.0, 5, 1)], "doc_pk long, leaf_pk long, value double, visits long, rank long")
    cited = search.sources(found, nodes).orderBy("rank").collect()
    assert [(r["source"]["node_pk"], r["source"]["pages"], r["source"]["score"], r["source"]["path"], r["text"]) for r in cited] == [
        (3, "6-6", 1.0, ["Report", "Other"], "only a summary"), (2, "3-5", 0.9877, ["Report", "Notes"], "One. Two. Three."),
    ]
    table = search.sources(found, nodes)
    assert search.synthesized(F.lit("q"), table).first()["answer"] == "only a summary"
    told = search.synthesized(F.lit("Question?"), table, lambda: lambda texts: [t.upper() for t in texts]).first()
    assert told["answer"].startswith("QUESTION?\n\nREPORT > OTHER, PP. 6-6\nONLY A SUMMARY") and len(told["sources"]) == 2
    with pytest.raises(Exception, match="empty"):
        search.synthesized(F.lit("q"), table, lambda: lambda texts: [" "] * len(texts)).collect()


def test_seeds_and_sums_along_paths(spark):
    nodes = spark.createDataFrame([(1, 1, None, 0.1), (1, 2, 1, 7.0), (1, 3, 1, None), (1, 4, 2, 0.5), (2, 1, None, 0.25), (2, 2, None, 0.5)], "doc_pk long, node_pk long, parent_pk long, prior double")
    assert {(r["doc_pk"], r["node_pk"]): (r["visits"], r["value_sum"]) for r in search.seeded(nodes).collect()} == {
        (1, 1): (3, 3.0), (1, 2): (3, 3.0), (1, 3): (3, 0.0), (1, 4): (3, 1.5), (2, 1): (3, 0.75), (2, 2): (3, 1.5),
    }
    done = spark.createDataFrame([(1, 4, 0.25), (1, 4, 0.5), (1, 3, 1.0)], "doc_pk long, node_pk long, score double")
    assert {r["node_pk"]: (r["visits"], r["value_sum"]) for r in search.backpropagated(nodes, done).collect()} == {4: (2, 0.75), 3: (1, 1.0), 2: (2, 0.75), 1: (3, 1.75)}


def test_path_ids_and_lenient_scans(spark):
    toc = spark.createDataFrame([(1, 0, "1"), (1, 1, "1.1"), (1, 2, "2"), (1, 3, "2.1"), (1, 4, "2.2"), (1, 5, "2.2.1")], "doc_pk long, ord int, structure string")
    ids = forest.path_ids(toc.join(forest.parents(toc).select("doc_pk", "ord", "parent_ord"), ["doc_pk", "ord"])).orderBy("ord").collect()
    assert [r["node_id"] for r in ids] == ["0000", "00000000", "0001", "00010000", "00010001", "000100010000"]
    broken = spark.createDataFrame([(1, 1, None), (1, 2, 1), (1, 3, 9), (1, 4, 3), (2, 5, 6)], "doc_pk long, node_pk long, parent_pk long")
    assert {(r["node_pk"], r["depth"]) for r in verify.reachable(broken).collect()} == {(1, 0), (2, 1)}


def test_bad_trees_are_told_apart(spark):
    import json

    leaf = {"title": "b", "start_index": 2, "end_index": 3}
    rows = [(1, json.dumps({"doc_name": "d", "structure": [leaf]})), (2, "no tree"), (3, json.dumps({"records": [leaf]})), (4, json.dumps({"pdf_name": "d", "records": [{**leaf, "nodes": [{**leaf, "nodes": [leaf]}]}]})), (5, None)]
    made = trees.judged(spark.createDataFrame(rows, "k long, raw string"), "raw", depth=2)
    assert {r["k"]: r["tree_status"] for r in made.collect()} == {1: "ok", 2: "malformed", 3: "nameless", 4: "deeper", 5: "malformed"}
    assert [r["k"] for r in trees.nodes(made, "k", "raw", depth=2, strict=False).collect()] == [1]


def test_model_usage_and_errors_of_the_caller(spark):
    asked = spark.createDataFrame([("a b",), (None,), ("c",)], "q string")
    told = asked.select(models.metered(F.col("q"), lambda: lambda texts: [(t.upper(), len(t), 1) for t in texts]).alias("m")).select("m.*").collect()
    assert [tuple(r) for r in told] == [("A B", 3, 1), (None, 0, 0), ("C", 1, 1)]
    calls = []

    def wrong(texts):
        calls.append(1)
        raise TypeError("wrong argument")

    with pytest.raises(TypeError):
        models.Retry(first=0).call(wrong, ["x"])
    assert len(calls) == 1

import json

import pytest
from pyspark.sql import functions as F

from arborix.functions.text import at_start
from arborix.operators import forest, ingest
from arborix.sources import trees


def test_headings_number_their_levels(spark):
    html = "<h2>A <b>x</b></h2>t<H3 class='q'>B</H3><h3>C</h3><h2>D</h2><h1>E</h1><h4>F</h4>"
    pages = spark.createDataFrame([(1, html), (2, "plain"), (3, None)], "page_id long, html string")
    made = ingest.generated_toc(pages, "page_id", "html").orderBy("doc_pk", "ord").collect()
    assert [(r["doc_pk"], r["ord"], r["structure"], r["title"]) for r in made] == [
        (1, 0, "1", "A x"), (1, 1, "1.1", "B"), (1, 2, "1.2", "C"), (1, 3, "2", "D"), (1, 4, "3", "E"), (1, 5, "3.1", "F"),
    ]


def test_ingested_nodes(spark):
    pages = spark.createDataFrame([(1, 1, "cover"), (1, 2, " Risk and more"), (1, 3, "x"), (1, 4, "end"), (2, 1, "lonely")], "doc_pk long, page_no long, text string")
    toc = spark.createDataFrame(
        [(1, 0, "1", "Risk", 2), (1, 1, "1.1", "Credit", 3), (1, 2, "2", "Notes", 3), (1, 3, "1.2", "Late", 4), (1, 4, "3", "Gone", 9), (1, 5, "4", "None", None)],
        "doc_pk long, ord int, structure string, title string, physical_index int",
    ).withColumn("page", F.lit(None).cast("int"))
    rows = ingest.ingested_whole(toc, pages.withColumn("token_count", F.lit(1))).orderBy("node_id").collect()
    assert [(r["node_id"], r["parent_id"], r["structure"], r["start_index"], r["end_index"]) for r in rows] == [
        ("0000", None, "0", 1, 1), ("0001", None, "1", 2, 3), ("0002", "0001", "1.1", 3, 3), ("0003", "0001", "1.2", 4, 4), ("0004", None, "2", 3, 4),
    ]
    assert rows[1]["node_text"] == " Risk and more\nx"


def test_json_trees(spark, tmp_path):
    leaf = {"title": "b", "start_index": 2, "end_index": 3}
    good = json.dumps({"pdf_name": "d", "records": [{"title": "a", "start_index": 1, "end_index": 3, "nodes": [leaf, leaf]}, leaf]})
    docs = spark.createDataFrame([(1, good)], "k long, raw string")
    rows = trees.nodes(docs, "k", "raw", depth=2).orderBy("path").collect()
    assert [(r["path"], r["parent_path"], r["depth"], r["child_order"]) for r in rows] == [("0000", None, 0, 0), ("00000000", "0000", 1, 0), ("00000001", "0000", 1, 1), ("0001", None, 0, 1)]
    trees.write(docs, f"{tmp_path}/out", "raw")
    assert spark.read.text(f"{tmp_path}/out").first()[0] == good
    for bad in (json.dumps({"records": [leaf]}), "no tree"):
        with pytest.raises(Exception):
            trees.nodes(docs.withColumn("raw", F.lit(bad)), "k", "raw").collect()
    with pytest.raises(Exception, match="deeper"):
        trees.nodes(docs, "k", "raw", depth=1).collect()


def test_entries_without_a_physical_page_are_placed(spark):
    texts = {1: ["cover", "alpha", "beta then gamma", "gamma", "delta", "end"], 2: ["one", "two"], 3: ["x", "y", "z"]}
    pages = spark.createDataFrame([(d, i, t, 1) for d, ts in texts.items() for i, t in enumerate(ts, 1)], "doc_pk long, page_no long, text string, token_count long")
    toc = spark.createDataFrame(
        [
            (1, 0, "1", "Alpha", 1, 2), (1, 1, "2", "Beta", 2, None), (1, 2, "3", "Gamma", None, None), (1, 3, "4", "Beta", None, None), (1, 4, "5", "Delta", 4, 5), (1, 5, "6", " ", None, None), (1, 6, "7", "Far", 9, None),
            (2, 0, "1", "One", 1, None), (2, 1, "2", "Two", None, None),
            (3, 0, "1", "a", 1, 2), (3, 1, "2", "b", 2, 2), (3, 2, "3", "c", 2, None), (3, 3, "4", "q", None, 3),
        ],
        "doc_pk long, ord int, structure string, title string, page int, physical_index int",
    )
    rows = ingest.located(toc, pages).orderBy("doc_pk", "ord").collect()
    assert [(r["doc_pk"], r["ord"], r["physical_index"]) for r in rows] == [
        (1, 0, 2), (1, 1, 3), (1, 2, 3), (1, 3, 3), (1, 4, 5), (1, 5, None), (1, 6, 10), (2, 0, 1), (2, 1, 2), (3, 0, 2), (3, 1, 3), (3, 2, 3), (3, 3, 3),
    ]


def test_whole_ingestion_places_divides_and_routes(spark):
    marked = {2: "<h2>Big</h2> One. Two. Three.", 3: "<h3>A</h3>", 9: "<h3>B</h3>"}
    pages = spark.createDataFrame(
        [(1, i, marked.get(i, f"p{i}" + (" notes" if i == 14 else "")), 10) for i in range(1, 16)] + [(2, 1, "<h1>Only</h1>", 1), (2, 2, "<h2>Sub</h2>", 1)], "doc_pk long, page_no long, text string, token_count long"
    )
    toc = spark.createDataFrame([(1, 0, "1", "Big", 1, 2), (1, 1, "2", "Notes", None, None), (2, 0, "1", "Lost", None, None)], "doc_pk long, ord int, structure string, title string, page int, physical_index int")
    rows = ingest.ingested_whole(toc, pages, tokens_from=100).orderBy("doc_pk", "node_id").collect()
    assert [(r["doc_pk"], r["node_id"], r["parent_id"], r["structure"], r["title"], r["start_index"], r["end_index"]) for r in rows] == [
        (1, "0000", None, "0", "Preface", 1, 2), (1, "0001", None, "1", "Big", 2, 2), (1, "0002", "0001", "1.1", "A", 3, 8), (1, "0003", "0001", "1.2", "B", 9, 14), (1, "0004", None, "2", "Notes", 14, 15),
        (2, "0000", None, "1", "Only", 1, 2), (2, "0001", "0000", "1.1", "Sub", 2, 2),
    ]
    assert rows[1]["summary"] == "<h2>Big</h2> One. Two." and rows[3]["node_text"].startswith("<h3>B</h3>\np10\n")


def test_node_ids_beyond_four_digits_stay_whole(spark):
    toc = spark.range(10_001).selectExpr("1L as doc_pk", "cast(id as int) as ord", "cast(id + 1 as string) as structure", "cast(null as int) as parent_ord")
    ids = [r["node_id"] for r in forest.depth_first(toc).orderBy("ord").collect()]
    assert ids[:2] == ["0000", "0001"] and ids[-2:] == ["9999", "10000"]


def test_titles_at_page_starts(spark):
    cases = {
        ("Net  Interest Income\nrose", "net interest income"): True, ("Net Interst Income rose", "Net Interest Income"): True, ("Netinterestincome", "Net Interest Income"): True,
        ("xNet Interest Income", "Net Interest Income"): True, ("The Net Interest Income", "Net Interest Income"): False, ("Risks", "Risk"): True, ("Rise", "Risk"): False, ("Net", "Net Interest Income"): False,
        ("Bet Imterest Incame", "Net Interest Income"): False, ("a", " "): False, (None, "a"): False, ("a", None): False, ("", ""): False,
    }
    rows = spark.createDataFrame([(*k, v) for k, v in cases.items()], "text string, title string, want boolean")
    assert [r for r in rows.withColumn("got", at_start(F.col("text"), F.col("title"))).collect() if r["got"] != r["want"]] == []


def test_titles_at_page_starts_by_octets(spark):
    cases = {  # by signs, by octets
        ("Çê dans que de le ai", "dans que de le ai"): (False, False), ("Çêdansquedeleaicht", "dansquedeleaicht"): (True, False), ("edansquedeleaicht", "dansquedeleaicht"): (True, True),
        ("Résumé des", "Résume des"): (True, False), ("Résumé des", "Résumè des"): (True, True), ("Straße frei", "STRASSE FREI"): (False, False), ("Große Maße", "große\tmaße"): (True, True),
        ("ΝΟΜΟΣ ΚΑΙ", "νομοσκαι"): (True, True), ("ab\vc", "abc"): (True, False), ("漢字漢字漢字漢字", "字漢字漢字漢字漢"): (True, False), ("", ""): (False, False), (None, "a"): (False, False), ("a", None): (False, False),
    }
    rows = spark.createDataFrame(list(cases), "text string, title string")
    got = rows.select("text", "title", at_start(F.col("text"), F.col("title")), at_start(F.col("text"), F.col("title"), octets=True)).collect()
    assert {tuple(r)[:2]: tuple(r)[2:] for r in got} == cases


def test_trees_are_the_same_after_a_round_trip(spark):
    leaf = {"title": 'say "nodes":[] \\ é', "start_index": 2, "end_index": 3, "text": "line\nbreak", "nodes": []}
    deep = {"nodes": [{"title": "b", "nodes": [leaf, {**leaf, "title": "second"}]}, leaf], "title": "a", "end_index": 9, "start_index": 1, "summary": "s"}
    given = {1: {"pdf_name": "d", "records": [deep, leaf]}, 2: {"doc_name": "e", "structure": []}, 3: {"doc_name": "f", "structure": [{"title": str(i), "start_index": i} for i in range(12)]}}
    docs = spark.createDataFrame([(k, v.get("doc_name") or v.get("pdf_name"), json.dumps(v)) for k, v in given.items()], "k long, doc_name string, raw string")
    nodes = trees.nodes(docs, "k", "raw", depth=4, texts=True)

    def texts(rows):
        return {r["k"]: r["t"] for r in trees.rebuilt(rows, docs, "k").select("k", trees.canonical(F.col("raw_json"), depth=4).alias("t")).collect()}

    before = {r["k"]: r["t"] for r in docs.select("k", trees.canonical(F.col("raw"), depth=4).alias("t")).collect()}
    assert texts(nodes) == before and json.loads(before[1])["structure"][0]["nodes"][0]["nodes"][1]["title"] == "second"
    assert "nodes" not in json.loads(before[1])["structure"][1] and json.loads(before[1])["structure"][1]["title"] == leaf["title"]
    changed = texts(nodes.withColumn("end_index", F.when((F.col("k") == 1) & (F.col("depth") == 2), 4).otherwise(F.col("end_index"))))
    assert changed[1] != before[1] and changed[2] == before[2] and changed[3] == before[3]
    assert texts(nodes.where("path <> '00000000'"))[1] != before[1] and texts(nodes.limit(0))[3] == '{"doc_name":"f","structure":[]}'
    assert docs.select(trees.canonical(F.lit("no tree")).alias("t")).first()["t"] in (None, "{}")

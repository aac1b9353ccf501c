import json

from pyspark.sql import functions as F

from arborix.operators import contents


def test_pages_of_the_first_run(spark):
    says = {1: "no yes maybe yes no yes", 2: "no no", 3: "yes " * 25}
    pages = spark.createDataFrame([(d, i, f"{d}.{i} ", s) for d, line in says.items() for i, s in enumerate(line.split(), 1)], "doc_pk long, page_no long, text string, toc_detected string")
    found = contents.contents_pages(pages)
    assert sorted((r["doc_pk"], r["page_no"]) for r in found.collect()) == [(1, 2), (1, 4)] + [(3, i) for i in range(1, 21)]
    texts = {r["doc_pk"]: r["content"] for r in contents.contents_text(found).collect()}
    assert texts[1] == "1.2 1.4 " and texts[3].startswith("3.1 3.2 ") and texts[3].endswith("3.20 ")
    assert contents.contents_text(contents.contents_pages(pages.limit(0))).count() == 0


def test_answers_that_cannot_be_read_say_no(spark):
    answers = ['{"completed": "yes"}', '```json\n{"completed": "yes",}\n```', "yes", '{"other": 1}', '{"completed": None}', None]
    rows = spark.createDataFrame(list(enumerate(answers)), "i int, a string").select("i", contents.said(F.col("a"), "completed").alias("s")).orderBy("i").collect()
    assert [r["s"] for r in rows] == ["yes", "yes", "no", "no", "no", "no"]


def test_leaders(spark):
    lines = ["A ..... 3", "B .... 3", "C . . . . . . 4", "D . . . . 4", "E........5"]
    rows = spark.createDataFrame(list(enumerate(lines)), "i int, t string").select("i", contents.without_leaders(F.col("t")).alias("t")).orderBy("i").collect()
    assert [r["t"] for r in rows] == ["A :  3", "B .... 3", "C : 4", "D . . . . 4", "E: 5"]


def test_continuations(spark):
    whole = json.dumps({"table_of_contents": [{"structure": "1", "title": "A", "page": 3}, {"structure": "2", "title": "B", "page": "iv"}, {"structure": None, "title": "C", "page": None}]})
    one = json.dumps({"table_of_contents": [{"structure": "1", "title": "first", "page": " 7 "}]})
    scripts = {
        1: [whole],  # complete at once
        2: [whole[:40], whole[40:80], whole[80:]],
        3: [one, " and", " so", " it", " goes", " on", " for", " ever"],  # never complete: six answers are one unreadable text, so the first counts
        4: ["nothing"] * 9,
    }
    asked = spark.createDataFrame([(d, json.dumps(s)) for d, s in scripts.items()] + [(5, None)], "doc_pk long, content string")
    pieces = lambda content: F.from_json(content, "array<string>")
    at = lambda content, so_far: F.size(F.filter(F.sequence(F.lit(1), F.size(pieces(content))), lambda k: F.length(F.array_join(F.slice(pieces(content), F.lit(1), k), "")) <= F.length(so_far)))

    def ask(content, so_far):
        return F.struct(F.get(pieces(content), at(content, so_far)).alias("answer"), F.lit(True).alias("finished"))

    def judge(content, so_far):
        return F.when(so_far == F.array_join(pieces(content), ""), '{"completed": "yes"}').otherwise("?")

    rows = contents.transcribed(asked, ask, judge).orderBy("doc_pk", "ord").collect()
    full = [(0, "1", "A", 3), (1, "2", "B", None), (2, None, "C", None)]
    made = {d: [tuple(r)[1:] for r in rows if r["doc_pk"] == d] for d in range(1, 6)}
    assert made[1] == made[2] == full and made[3] == [(0, "1", "first", 7)] and made[4] == made[5] == []
    assert contents.transcribed(asked.limit(0), ask, judge).count() == 0


def test_an_answer_that_was_cut_off_is_not_done(spark):
    one = json.dumps({"table_of_contents": [{"structure": "1", "title": "T", "page": 1}]})
    docs = spark.createDataFrame([(1, "x")], "doc_pk long, content string")
    ask = lambda content, so_far: F.struct(F.when(so_far == "", one[:20]).otherwise(one[20:]).alias("answer"), (so_far != "").alias("finished"))
    rows = contents.transcribed(docs, ask, lambda content, so_far: F.lit('{"completed": "yes"}')).collect()
    assert [tuple(r) for r in rows] == [(1, 0, "1", "T", 1)]

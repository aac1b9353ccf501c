import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.errors import AnalysisException

from arborix.operators import filters, keywords, vectors

DOCS = "doc long, t string, rank int"


def plain_scores(docs, question):
    split = {d: re.findall(r"[^\W_]+", (t or "").lower()) for d, t, _ in docs}
    mean, n = sum(map(len, split.values())) / len(split), len(split)
    df = Counter(w for ws in split.values() for w in set(ws))
    found = {}
    for d, ws in split.items():
        times = Counter(ws)
        met = [w for w in re.findall(r"[^\W_]+", question.lower()) if times[w]]
        if met:
            found[d] = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * times[w] * 2.2 / (times[w] + 1.2 * (0.25 + 0.75 * len(ws) / mean)) for w in met)
    return sorted(((round(s, 6), -d) for d, s in found.items()), reverse=True)


def test_keyword_scores_are_those_of_a_plain_version(spark, tmp_path):
    dice = random.Random(3)
    vocabulary = ["the"] * 20 + [f"w{i}" for i in range(60)] + ["Élan", "x9"]
    docs = [(d, " ".join(dice.choice(vocabulary) for _ in range(dice.randint(1, 80))), 1) for d in range(300)] + [(300, None, 1), (301, "", 1), (302, "the " * 50_000, 1)]
    docs += [(400 + i, docs[7][1].upper(), 1) for i in range(5)]  # ties
    asked = [(1, "the w3 W4, w4"), (2, "élan"), (3, "nothing here"), (4, None), (5, docs[7][1])]
    table, questions = spark.createDataFrame(docs, DOCS), spark.createDataFrame(asked, "q long, t string")
    rows, size = keywords.postings(table, "doc", "t"), keywords.totals(table, "t")
    keywords.save_postings(rows, str(tmp_path / "p"), files=3)
    for given in (rows, spark.read.parquet(str(tmp_path / "p"))):
        got = keywords.ranked(given, size, questions, "q", "t", k=20).orderBy("question", "rank").collect()
        for q, text in asked:
            own, want = [(r["score"], -r["id"]) for r in got if r["question"] == q], plain_scores(docs, text or "")[:20]
            assert [d for _, d in own] == [d for _, d in want] and [s for s, _ in own] == pytest.approx([s for s, _ in want], abs=2e-6)
    assert keywords.ranked(keywords.postings(table.limit(0), "doc", "t"), keywords.totals(table.limit(0), "t"), questions, "q", "t", k=3).count() == 0
    assert keywords.ranked(rows, size, questions.limit(0), "q", "t", k=3).count() == 0


def test_large_questions_join_without_a_broadcast(spark, monkeypatch):
    table = spark.createDataFrame([(1, "a b", 0), (2, "b c c", 0)], DOCS)
    questions = spark.createDataFrame([(1, "c a")], "q long, t string")
    how = lambda: [tuple(r) for r in keywords.ranked(keywords.postings(table, "doc", "t"), keywords.totals(table, "t"), questions, "q", "t", k=5).orderBy("rank").collect()]
    want = how()
    monkeypatch.setattr(keywords, "BROADCAST_BYTES", 0)
    assert how() == want and len(want) == 2


def clustered(n, seed=5):
    dice = np.random.default_rng(seed)
    middles = dice.normal(size=(40, 16))
    return [(i, [float(x) for x in middles[i % 40] + 0.4 * dice.normal(size=16)]) for i in range(n)]


def plain_nearest(rows, asked, k):
    ids, m = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    q = np.array([v for _, v in asked])
    scores = np.round(m @ (q / np.linalg.norm(q, axis=1, keepdims=True)).T, 6)
    return {(a, int(ids[i])) for j, (a, _) in enumerate(asked) for i in sorted(range(len(ids)), key=lambda i: (-scores[i, j], ids[i]))[:k]}


def test_nearest_to_each_in_passes(spark, monkeypatch):
    rows = clustered(400)
    rows += [(1000 + i, rows[8][1]) for i in range(30)]  # more copies than are asked for
    odd = [(2000, None), (2001, [0.0] * 16), (2002, [1.0]), (2003, [float("nan")] * 16), (2004, [1.0] * 15 + [None])]
    asked = rows[::9]
    monkeypatch.setattr(vectors, "QUESTIONS", 10)
    monkeypatch.setattr(vectors, "WIDTH", 4)
    table, questions = spark.createDataFrame(rows + odd, "id long, embedding array<double>"), spark.createDataFrame(asked + odd, "question long, embedding array<double>")
    got = vectors.nearest_to_each(table, questions, "id", k=7, dimension=16).collect()
    assert {(r["question"], r["id"]) for r in got} == plain_nearest(rows, asked, 7)
    assert vectors.nearest_to_each(table, questions.limit(0), "id", k=7, dimension=16).count() == 0
    assert vectors.nearest_to_each(table.limit(0), questions, "id", k=7, dimension=16).count() == 0


def test_index_recall_and_rows_read(spark, tmp_path):
    rows = clustered(4000)
    asked = rows[::20]
    table, questions = spark.createDataFrame(rows, "id long, embedding array<double>"), spark.createDataFrame(asked, "question long, embedding array<double>")
    centre = vectors.centres(table, "id", count=32, sample=2000)
    vectors.save_index(vectors.with_cells(table, centre), str(tmp_path / "v"), "id", files=4)
    index = spark.read.parquet(str(tmp_path / "v"))
    assert index.count() == 4000 and index.where("cell is null").count() == 0
    got = vectors.nearest_to_each(index, questions, "id", k=10, dimension=16, centre=centre, probes=4)
    found = {(r["question"], r["id"]) for r in got.collect()}
    assert len(found & plain_nearest(rows, asked, 10)) >= 0.9 * 2000
    probes = vectors.probes_for(index, "id", k=10, dimension=16, centre=centre, recall=0.9)
    assert probes <= 4 and vectors.probes_for(index, "id", k=10, dimension=16, centre=centre, recall=1.0) >= probes
    one = vectors.nearest_to_each(index, questions.limit(1), "id", k=10, dimension=16, centre=centre, probes=1)
    assert "PushedFilters: [In(cell" in one._jdf.queryExecution().toString() or "EqualTo(cell" in one._jdf.queryExecution().toString()
    every = vectors.nearest_to_each(index, questions, "id", k=10, dimension=16, centre=centre, probes=len(centre))
    assert {(r["question"], r["id"]) for r in every.collect()} == plain_nearest(rows, asked, 10)


def test_fused_lists(spark):
    a = spark.createDataFrame([(1, 5, 1), (1, 6, 2), (2, 5, 1)], "question long, id long, rank long")
    b = spark.createDataFrame([(1, 6, 1), (3, 9, 1)], "question long, id long, rank long")
    assert sorted((r["question"], r["id"], r["score"], r["rank"]) for r in vectors.fused_each(a, b, k=1).collect()) == [(1, 6, round(1 / 61 + 1 / 62, 6), 1), (2, 5, round(1 / 61, 6), 1), (3, 9, round(1 / 61, 6), 1)]


def test_conditions_reach_the_scan_and_refuse_other_fields(spark, tmp_path):
    rows = [("O'Hara eq 1", 2020, 1, "x"), ("b\\c", 2021, 2, "y"), (None, None, 3, "z")]
    spark.createDataFrame(rows, "company_name string, year int, chunk_index int, content string").write.parquet(str(tmp_path / "i"))
    index = spark.read.parquet(str(tmp_path / "i"))
    kept = lambda c: sorted(r["chunk_index"] for r in filters.filtered(index, c).collect())
    assert kept("company_name eq 'O''Hara eq 1' and year ge 2020") == [1]
    assert kept("company_name eq 'b\\c'") == [2] and kept("not (year lt 2021)") == [2]
    assert kept("year eq null") == [3] and kept("company_name ne null or chunk_index gt 2") == [1, 2, 3]
    assert kept(None) == kept(" ") == [1, 2, 3]
    plan = filters.filtered(index, "year ge 2020 and company_name ne 'x'")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(year,2020)" in plan
    for bad in ("content eq 'x'", "password eq 1", "year eq 2020 or", "company_name eq 'open"):
        with pytest.raises((AnalysisException, ValueError)):
            filters.filtered(index, bad)

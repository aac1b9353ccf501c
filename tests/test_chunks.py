import random

import pytest

from arborix.operators import chunks

PAGES = "doc_pk long, page_no long, token_count long"


def plain(pages, limit, overlap):
    """One document, page by page."""
    made, run = [], []
    for page, n in pages:
        if run and sum(k for _, k in run) + n > limit:
            made.append(run)
            run = run[-overlap:] if overlap else []
        run = [*run, (page, n)]
    return [(i, r[0][0], r[-1][0], sum(k for _, k in r)) for i, r in enumerate([*made, run])]


@pytest.mark.parametrize("overlap", [0, 1, 3])
def test_runs_of_blocks_are_those_of_whole_documents(spark, overlap):
    dice = random.Random(overlap)
    docs = {}
    for doc in range(40):
        numbers = sorted(dice.sample(range(300), dice.randint(1, 200)))  # gaps in the numbers, so some blocks have few pages
        docs[doc] = [(p, dice.choice([0, 0, 1, 5, 30, dice.randint(0, 60), 150])) for p in numbers]
    docs[40] = [(p, 0) for p in range(100)]
    docs[41] = [(p, 500) for p in range(100)]
    rows = [(d, p, n) for d, pages in docs.items() for p, n in pages]
    dice.shuffle(rows)
    want = sorted((d, *r) for d, pages in docs.items() for r in plain(pages, 120, overlap))
    for block in (7, 64, 4096):
        got = chunks.token_chunks(spark.createDataFrame(rows, PAGES), limit=120, overlap=overlap, block=block).collect()
        assert sorted(map(tuple, got)) == want


def test_one_long_document_is_many_blocks(spark):
    from pyspark.sql import functions as F

    pages = spark.range(1_000_000).select(F.lit(1).cast("long").alias("doc_pk"), F.col("id").alias("page_no"), (F.col("id") * 7919 % 83).alias("token_count"))
    got = chunks.token_chunks(pages, limit=1000).orderBy("chunk_no")
    run, total, last, want = 0, 0, 0, []
    for page in range(1_000_000):
        n = page * 7919 % 83
        if total + n > 1000:
            want.append((1, len(want), run, page - 1, total))
            run, total = page - 1, last
        total, last = total + n, n
    assert [tuple(r) for r in got.collect()] == [*want, (1, len(want), run, 999_999, total)]


def test_balanced_limits_and_odd_rows(spark):
    even = spark.createDataFrame([(1, i, 10) for i in range(13)], PAGES)
    assert [r["token_count"] for r in chunks.token_chunks(even, limit=120).orderBy("chunk_no").collect()] == [120, 20]
    assert [r["token_count"] for r in chunks.token_chunks(even, limit=120, balanced=True).orderBy("chunk_no").collect()] == [90, 50]
    odd = spark.createDataFrame([(None, 1, 5), (None, 2, None), (2, None, 7), (2, 3, -4), (3, 1, 9), (3, 1, 9)], PAGES)
    assert sorted(map(str, map(tuple, chunks.token_chunks(odd, limit=10, overlap=0, block=2).collect()))) == sorted(map(str, [(None, 0, 1, 2, 5), (2, 0, 3, 3, 7), (3, 0, 1, 1, 9), (3, 1, 1, 1, 9)]))
    assert chunks.token_chunks(odd.limit(0), limit=10).count() == 0

import os

import duckdb
import pytest

import __spark_entry__ as entry
from arborix.plans import registry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in os.listdir(FOLDER):
        c.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{FOLDER}/{name}')")
    return c


def rounded(rows, columns):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(f"{r[i]:.6g}" if isinstance(r[i], float) else str(r[i]) for i in at) for r in rows)


@pytest.mark.parametrize("name", list(registry.SQL))
def test_same_rows_as_sql(spark, duck, name):
    got, want = registry.QUERIES[name](spark, FOLDER), duck.sql(registry.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rounded([tuple(r) for r in got.collect()], got.columns) == rounded(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n not in registry.SQL])
def test_gives_rows(spark, name):
    assert registry.QUERIES[name](spark, FOLDER).count() > 0


def test_titles_with_signs_beyond_ascii_as_in_sql(spark, tmp_path):
    texts = {0: ["Çêdans que de le ai chtion", "éçdans que de le ai chtion", "Éèdans que de le ai chtion", "êedans que de le ai chtion"], 1: ["Maß der Dinge", "aß der Dinge", "ßa der Dinge", "Maß der"], 2: ["ﬁxe Kosten", "ŉ fixe Kosten", "ΝΟΜΟΣ ΚΑΙ ΔΙΚΗ", "İıstanbul ab"], 3: ["a\vb c d e f g h", None, "", "漢字漢字漢字漢字漢"]}
    rows = [(10 * shift + d, t, "user", x) for shift in range(5) for d, some in texts.items() for t, x in enumerate(some[shift % 4:] + some[:shift % 4])]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    other = duckdb.connect()
    other.sql(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    for name in ("titles_at_start", "ingest_whole"):
        got, want = registry.QUERIES[name](spark, str(tmp_path)), other.sql(registry.SQL[name])
        assert rounded([tuple(r) for r in got.collect()], got.columns) == rounded(want.fetchall(), want.columns), name


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

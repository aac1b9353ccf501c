import pytest

from arborix.operators import statements as st
from arborix.streaming import events


def wide(spark):
    rows = [("a", "2021", "Revenue", 10.0), ("a", "2022", "Revenue", 15.0), ("b", "2021", "Revenue", 1.0)]
    return st.wide(spark.createDataFrame(rows, "company string, year_period string, canonical_name string, value double"))


def test_spread_of_known_and_unknown_years(spark):
    asked = spark.createDataFrame([("a", "2021"), ("a", "2022"), ("a", "2030"), ("zz", "2021")], "company string, year_period string")
    trees = spark.createDataFrame([("a", "2021", 12, 3), ("a", "2022", 3, 1)], "company string, year_period string, nodes int, leaves int")
    assert {(r["company"], r["year_period"]): r["tree_status"] for r in events.verified(asked, trees).collect()} == {
        ("a", "2021"): "ok", ("a", "2022"): "degraded", ("a", "2030"): "error", ("zz", "2021"): "error",
    }
    made = events.spread(asked, trees, st.resolved(wide(spark))).orderBy("company", "seq").collect()
    kinds = {c: [r["event_type"] for r in made if r["company"] == c] for c in ("a", "zz")}
    assert kinds["a"] == ["tree_verification"] * 3 + ["year_error"] + ["metric"] * 52 + ["yoy"] * 26 + ["complete"]
    assert kinds["zz"] == ["tree_verification", "year_error", "complete"]


def test_requests():
    events.request(["2021"], ["Revenue", "EBITDA"])
    for years, metrics, workers in (([], ["a", "b"], 1), (["2021"], ["a"], 1), (["2021"], ["a", "b"], 11)):
        with pytest.raises(ValueError):
            events.request(years, metrics, workers)


def test_stream_gives_the_rows_of_a_batch(spark, tmp_path):
    batch = wide(spark)
    batch.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(batch.schema).parquet(f"{tmp_path}/in")
    for _ in range(2):  # the second run finds nothing new
        events.resolved_stream(stream, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/out")
    want = st.long(st.resolved(batch))
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()

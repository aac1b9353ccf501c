import pytest
from pyspark.sql import functions as F

from arborix.functions.formula import names, parse, to_column, tokens
from arborix.operators import statements as st
from arborix.plans.catalogue import METRICS, closure, levels, needs


def computed(spark, name, given):
    row = spark.range(1).select(*[F.lit(v).cast("double").alias(f"v{st.CODE[n]}") for n, v in given.items()])
    tree = parse(METRICS[name].formula, METRICS)
    return row.select(F.round(to_column(tree, lambda n: F.col(f"v{st.CODE[n]}")), 5)).first()[0]


@pytest.mark.parametrize(
    ("name", "given", "expected"),
    [
        ("Tangible Net Worth", {"Net Worth": 69179, "Net Intangible Assets": 18261}, 50918.0),
        ("Working Capital Days", {"Receivables": 3582, "Revenue": 52444, "Inventory": 4683, "Cost of Sales": -30259, "Payables": 8896}, 75.74945),
        ("Free cashflow", {"Operating cashflow": 7972, "Capital Expenditure": -1108, "w/w Dividends": -4483}, 2381.0),
        ("NOCF / Interest", {"Operating cashflow": 7972, "Interest Expense (Net)": -354}, -22.51977),
        ("Gross Profit Margin %", {"Gross Profit": 24167, "Revenue": 60073}, 40.22939),
        ("EBITDA", {"Profit before Taxes": 10337, "Interest Expense (Net)": -486, "Depreciation": -1017, "Amortization": -455}, 8379.0),
        ("Gross Profit", {"Revenue": 59604, "Cost of Sales": -34429}, 94033.0),
        ("Net Funded Debt", {"Total Ext. Funded Debt": None, "Cash + Mkt Securities": 4571}, None),
        ("TFD / EBITDA", {"Total Ext. Funded Debt": 5, "EBITDA": 0}, None),
    ],
)
def test_formulas(spark, name, given, expected):
    assert computed(spark, name, given) == expected


def test_names_that_hold_signs_are_atoms():
    assert names(METRICS["Net Funded Debt"].formula, METRICS) == ["Total Ext. Funded Debt", "Cash + Mkt Securities"]
    assert tokens("-(w/w Dividends)", METRICS)[2] == ("name", "w/w Dividends")
    for bad in ("Revenue +", "Revenue Revenue", "(Revenue", "Revenue ? 2"):
        with pytest.raises(ValueError):
            parse(bad, METRICS)


def test_catalogue():
    assert len([m for m in METRICS.values() if m.shown]) == 26
    assert closure(["Gross Profit"]) == {"Gross Profit", "Revenue", "Cost of Sales"}
    assert len(closure(["EBITDA"])) == 7
    assert closure([]) == set() and closure(["nobody knows"]) == {"nobody knows"}
    seen = set()
    for level in levels():
        assert all(set(needs(n)) <= seen for n in level)
        seen |= set(level)
    assert seen == set(METRICS)


def facts(spark, rows):
    return st.wide(spark.createDataFrame(rows, "company string, year_period string, canonical_name string, value double"))


def test_resolution_cases(spark):
    items = [p for n in ("Equity", "Reserves") for p in needs(n)]
    rows = [("a", "2021", n, 1000.0) for n in items] + [("a", "2021", "Net Intangible Assets", 18261.0), ("a", "2021", "Overdrafts", 5.0), ("a", "2021", "Gross Profit", 7.0)]
    found = {r["canonical_name"]: r for r in st.long(st.resolved(facts(spark, rows))).collect()}
    assert (found["Reserves"]["value"], found["Reserves"]["status"]) == (4000.0, "resolved")
    assert (found["Tangible Net Worth"]["value"], found["Tangible Net Worth"]["resolution_method"]) == (-12261.0, "derived")
    assert (found["Short Term Debt"]["value"], found["Short Term Debt"]["status"]) == (5.0, "partial")
    assert (found["Long Term Debt"]["status"], found["Long Term Debt"]["resolution_method"]) == ("unresolved", "na")
    assert (found["Gross Profit"]["value"], found["Gross Profit"]["resolution_method"]) == (7.0, "direct")
    assert (found["EBITDA"]["value"], found["EBITDA"]["status"]) == (None, "partial")


def test_yearly_change(spark):
    rows = [("a", "2021", "Revenue", -50.0), ("a", "2023", "Revenue", 25.0), ("b", "2021", "Revenue", 0.0), ("b", "2022", "Revenue", 3.0)]
    table = st.with_yearly_change(st.statement(st.resolved(facts(spark, rows)), ["Revenue"]))
    assert {(r["company"], r["year_period"]): r["yoy_pct"] for r in table.collect()} == {("a", "2021"): None, ("a", "2023"): 150.0, ("b", "2021"): None, ("b", "2022"): None}


def test_events_keep_nulls_and_end_with_complete(spark):
    import json

    from arborix.streaming.events import events

    rows = [("a", "2021", "Revenue", 10.0), ("a", "2022", "Revenue", 15.0)]
    made = events(st.with_yearly_change(st.statement(st.resolved(facts(spark, rows)), ["Revenue", "Free cashflow"], details=True))).orderBy("seq").collect()
    assert [r["event_type"] for r in made] == ["metric"] * 4 + ["yoy"] * 2 + ["complete"]
    assert json.loads(made[0]["payload"]) == {"canonical_name": "Revenue", "year": "2021", "value": 10.0, "status": "resolved", "formula": None, "error": None, "source_location": None, "component_details": None}
    change = json.loads(made[4]["payload"])
    assert (change["year"], change["value"], change["status"], change["formula"]) == ("2022_YoY", 50.0, "resolved", "(2022 - 2021) / |2021| * 100")
    assert change["component_details"] == [{"component_name": "2022 value", "value": 15.0}, {"component_name": "2021 value", "value": 10.0}]
    assert (json.loads(made[5]["payload"])["value"], json.loads(made[5]["payload"])["status"]) == (None, "unresolved")
    assert json.loads(made[-1]["payload"]) == {"event_count": 4}


def test_payloads_of_derived_metrics_list_their_components(spark):
    import json

    from arborix.streaming.events import events

    rows = [("a", "2021", "Revenue", 10.0), ("a", "2021", "Cost of Sales", 4.0)]
    table = st.with_yearly_change(st.statement(st.resolved(facts(spark, rows)), ["Revenue", "Gross Profit"], details=True))
    indexed = table.withColumn("row_index", F.when(F.col("canonical_name") == "Gross Profit", F.lit(7)))
    found = {p["canonical_name"]: p for p in (json.loads(r["payload"]) for r in events(indexed).where("event_type = 'metric'").collect())}
    profit = found["Gross Profit"]
    assert (profit["value"], profit["formula"], profit["source_location"], profit["row_index"]) == (6.0, "Revenue - Cost of Sales", "a 2021", 7)
    assert profit["component_details"] == [{"component_name": n, "value": v, "source_location": "a 2021"} for n, v in (("Revenue", 10.0), ("Cost of Sales", 4.0))]
    assert "row_index" not in found["Revenue"] and found["Revenue"]["component_details"] is None


def test_names_are_looked_up_in_two_steps(spark):
    from arborix.functions import names
    from arborix.sources.catalogue import aliases, from_definitions

    raw = {
        "metrics": [{"canonical_name": "Net Worth", "synonyms": ["Book Value", "Own Funds / Equity"]}, {"canonical_name": "TFD / EBITDA"}, {"canonical_name": "Late", "synonyms": ["book value"]}],
        "aggregations": {"Equity": {"synonyms": ["Total Equity"], "components": [{"metric": "x"}]}},
        "alias_map": {"Sales": "Revenue"},
    }
    known = names.known_names(spark, from_definitions(raw))
    asked = ["  NET worth (loss)", "Own funds/Equity", "TFD/ EBITDA (x)", "Net Worth (restated)", "book value", "total equity", "nothing", "(x)", None]
    items = spark.createDataFrame([(i, n, 10 * i) for i, n in enumerate(asked)], "position int, name string, row_index int")
    got = {r["position"]: r["canonical"] for r in names.looked_up(items, known).collect()}
    assert [got[i] for i in range(9)] == ["Net Worth", "Net Worth", "TFD / EBITDA", "Net Worth", "Late", "Equity", None, None, None]
    rows = {r["canonical_key"]: r["row_index"] for r in names.row_indices(items, known).collect()}
    assert (rows["net worth"], rows["late"], rows["nothing"], rows["book value"]) == (0, 40, 60, 40)
    assert aliases(raw) == {"Sales": "Revenue"} and aliases({}) == {}

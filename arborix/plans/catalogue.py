"""The metric catalogue: what each figure is called, where it is shown and what it is made of."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

# Names, kinds, sections and formulas of the metrics that statements show or need.
SECTIONS = ["Income Statement", "Balance Sheet", "Cash Flow", "Ratios", "Others"]
#: name | how it is resolved | kind | section | shown | formula
_METRICS = """
Revenue|direct|absolute|Income Statement|yes|
Cost of Sales|direct|absolute|Income Statement|no|
Gross Profit|derived_else_direct|absolute|Income Statement|yes|Revenue - Cost of Sales
Gross Profit Margin %|derived_else_direct|margin|Income Statement|yes|(Gross Profit / Revenue) * 100
Profit before Taxes|direct|absolute|Income Statement|no|
Interest Expense (Net)|derived_else_direct|absolute|Income Statement|yes|Interest Paid - Interest Received
Interest Paid|direct|absolute|Income Statement|no|
Interest Received|direct|absolute|Income Statement|no|
Depreciation|direct|absolute|Income Statement|no|
Amortization|direct|absolute|Income Statement|no|
EBITDA|derived_else_direct|absolute|Income Statement|yes|Profit before Taxes + Interest Expense (Net) + Depreciation + Amortization
EBITDA Margin %|derived_else_direct|margin|Income Statement|yes|(EBITDA / Revenue) * 100
other Operating income|direct|absolute|Income Statement|no|
all Operating costs|direct|absolute|Income Statement|no|
Operating Profit|derived_else_direct|absolute|Income Statement|yes|Gross Profit + other Operating income - all Operating costs - Depreciation - Amortization
Operating Profit Margin %|derived_else_direct|margin|Income Statement|yes|(Operating Profit / Revenue) * 100
Income from Investments|direct|absolute|Income Statement|no|
Loss from Investments|direct|absolute|Income Statement|no|
Bank charges|direct|absolute|Income Statement|no|
Write-off of financial assets|direct|absolute|Income Statement|no|
Taxation|direct|absolute|Income Statement|no|
Extraordinary items|direct|absolute|Income Statement|no|
Net Profit|derived_else_direct|absolute|Income Statement|yes|Operating Profit + Interest Received + Income from Investments - Interest Paid - Loss from Investments - Bank charges - Write-off of financial assets - Taxation - Extraordinary items
Net Worth|derived_else_direct|absolute|Balance Sheet|yes|Equity + Reserves
Net Intangible Assets|direct|absolute|Balance Sheet|no|
Tangible Net Worth|derived|absolute|Balance Sheet|yes|Net Worth - Net Intangible Assets
Total Ext. Funded Debt|derived|absolute|Balance Sheet|yes|Short Term Debt + Long Term Debt
Cash + Mkt Securities|derived_else_direct|absolute|Balance Sheet|yes|Cash + Marketable Investments
Cash|direct|absolute|Balance Sheet|no|
Marketable Investments|direct|absolute|Balance Sheet|no|
Net Funded Debt|derived|absolute|Balance Sheet|yes|Total Ext. Funded Debt - Cash + Mkt Securities
Receivables|direct|absolute|Balance Sheet|no|
Payables|direct|absolute|Balance Sheet|no|
Inventory|direct|absolute|Balance Sheet|no|
Working Capital Days|derived|absolute|Balance Sheet|yes|(Receivables / Revenue * 365) + (Inventory / Cost of Sales * 365) - (Payables / Cost of Sales * 365)
Change in trade and other receivables|direct|absolute|Balance Sheet|no|
Change in inventory|direct|absolute|Balance Sheet|no|
Change in trade and other payables|direct|absolute|Balance Sheet|no|
Change in Working Capital|derived_else_direct|absolute|Balance Sheet|yes|Change in trade and other receivables + Change in inventory + Change in trade and other payables
Operating cashflow|direct|absolute|Cash Flow|yes|
Investing cashflow|direct|absolute|Cash Flow|yes|
Financing cashflow|direct|absolute|Cash Flow|yes|
w/w Dividends|direct|absolute|Cash Flow|yes|
Free cashflow|derived|absolute|Cash Flow|yes|Operating cashflow + Capital Expenditure + w/w Dividends
Ext. Gearing (TFD/TNW)|derived|ratio|Ratios|yes|Total Ext. Funded Debt / Tangible Net Worth
NFD / EBITDA|derived|ratio|Ratios|yes|Net Funded Debt / EBITDA
TFD / EBITDA|derived|ratio|Ratios|yes|Total Ext. Funded Debt / EBITDA
NOCF / Interest|derived|ratio|Ratios|yes|Operating cashflow / Interest Expense (Net)
Capital Expenditure|direct|absolute|Others|yes|
"""
#: Signed sums: name -> components, a minus before those that are taken off.
_SUMS = """
Equity: Ordinary Shares; Preference Shares
Reserves: Share Premium Account; Retained Earnings; Revaluation Reserves; Other Reserves; Capital Redemption Reserve; -Treasury Stock
Short Term Debt: Overdrafts; Trade Finance; Loans < 1 year - Secured; Loans < 1 year - Unsecured; Current Portion - HP/Leasing/Other; Current Portion - Long Term Debt; Current Portion - Sub Debt
Long Term Debt: Loans > 1 year - Secured; Loans > 1 year - Unsecured; HP/Leasing/Other > 1 year; Subordinated Debt
"""


@dataclass(frozen=True)
class Metric:
    name: str
    method: str
    kind: str
    section: str
    shown: bool
    formula: str = ""
    parts: tuple[tuple[str, int], ...] = ()
    synonyms: tuple[str, ...] = ()


def _read() -> dict[str, Metric]:
    found = {}
    for line in _METRICS.strip().splitlines():
        name, method, kind, section, shown, formula = line.split("|")
        found[name] = Metric(name, method, kind, section, shown == "yes", formula)
    for line in _SUMS.strip().splitlines():
        name, parts = line.split(": ", 1)
        signed = tuple((p.strip().removeprefix("-"), -1 if p.strip().startswith("-") else 1) for p in parts.split(";"))
        found[name] = Metric(name, "aggregation", "absolute", "Balance Sheet", False, parts=signed)
        for part, _ in signed:
            found.setdefault(part, Metric(part, "direct", "absolute", "Balance Sheet", False))
    return found


METRICS = _read()


def needs(name: str, metrics: dict[str, Metric] | None = None) -> list[str]:
    """Names that a metric is computed from, in the order of its formula."""
    from arborix.functions.formula import names

    metrics = METRICS if metrics is None else metrics
    metric = metrics.get(name)
    if metric is None:
        return []
    return [p for p, _ in metric.parts] if metric.parts else names(metric.formula, metrics) if metric.formula else []


def closure(wanted: list[str], metrics: dict[str, Metric] | None = None) -> set[str]:
    """The wanted names and all that they are computed from; unknown names stay."""
    found: set[str] = set()
    todo = list(wanted)
    while todo:
        name = todo.pop()
        if name not in found:
            found.add(name)
            todo += needs(name, metrics)
    return found


def levels(metrics: dict[str, Metric] | None = None) -> list[list[str]]:
    """Metrics by depth: those of one level need only earlier ones.

    Metrics that need each other in a circle come last, one a level in their order, with a warning; what one of them
    needs from a later one counts as missing.
    """
    metrics = METRICS if metrics is None else metrics
    left, done, out = list(metrics), set(), []
    while left:
        level = [n for n in left if all(p in done or p not in metrics for p in needs(n, metrics))]
        if not level:
            warnings.warn(f"metrics that need each other in a circle: {', '.join(left)}", stacklevel=2)
            level = left[:1]
        out.append(level)
        done |= set(level)
        left = [n for n in left if n not in done]
    return out

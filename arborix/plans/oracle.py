"""SQL text of the resolution plan, level by level, for engines other than Spark."""

from __future__ import annotations

from arborix.functions.formula import parse, to_sql
from arborix.operators.statements import CODE, shown
from arborix.plans.catalogue import METRICS, SECTIONS, levels, needs
from arborix.sources.tables import facts_sql


def resolved_sql(source: str | None = None) -> str:
    """CTEs up to ``resolved``, from the tables' facts or from ``source``: one row a company and year, columns v<i>, s<i>, m<i>."""
    text, last = f"WITH l0 AS ({source or facts_sql()})", "l0"
    for depth, level in enumerate(levels(), 1):
        columns = []
        for name in level:
            metric, i, parts = METRICS[name], CODE[name], [f"v{CODE[n]}" for n in needs(name)]
            some = " + ".join(f"(case when {p} is null then 0 else 1 end)" for p in parts) or "0"
            if metric.method == "direct":
                cases = [(f"f{i} is not null", f"f{i}", "resolved", "direct")]
            elif metric.method == "aggregation":
                total = " + ".join(f"coalesce({p} * {s}, 0.0)" for p, (_, s) in zip(parts, metric.parts, strict=True))
                cases = [(f"{some} = {len(parts)}", total, "resolved", "derived"), (f"{some} > 0", total, "partial", "derived"), (f"f{i} is not null", f"f{i}", "resolved", "fallback_search")]
            else:
                value = f"round({to_sql(parse(metric.formula, METRICS), lambda n: f'v{CODE[n]}')}, 5)"
                cases = [(f"f{i} is not null", f"f{i}", "resolved", "direct")] if metric.method == "derived_else_direct" else []
                cases += [(f"{some} < {len(parts)}", "cast(null as double)", "partial", "derived"), (f"{value} is not null", value, "resolved", "derived"), (f"f{i} is not null", f"f{i}", "resolved", "fallback_search")]
            for prefix, at, end in (("v", 1, "cast(null as double)"), ("s", 2, "'unresolved'"), ("m", 3, "'na'")):
                whens = " ".join(f"when {c[0]} then {c[at] if at == 1 else repr(c[at])}" for c in cases)
                columns.append(f"case {whens} else {end} end AS {prefix}{i}")
        text += f", l{depth} AS (SELECT *, {', '.join(columns)} FROM {last})"
        last = f"l{depth}"
    return f"{text}, resolved AS (SELECT * FROM {last})"


def long_sql(names: list[str] | None = None) -> str:
    rows = [f"SELECT company, year_period, '{n}' AS canonical_name, v{CODE[n]} AS value, s{CODE[n]} AS status, m{CODE[n]} AS resolution_method FROM resolved" for n in names or METRICS]
    return " UNION ALL ".join(rows)


def statement_sql(names: list[str] | None = None) -> str:
    rows = shown(names)
    order = ", ".join(f"('{n}', '{SECTIONS[s]}', {s}, {r})" for s, r, n in rows)
    return f"SELECT x.*, section, section_rank, row_rank FROM ({long_sql([n for _, _, n in rows])}) x JOIN (VALUES {order}) o(name, section, section_rank, row_rank) ON x.canonical_name = o.name"


def yearly_sql(names: list[str] | None = None) -> str:
    return f"""{resolved_sql()}, sct AS ({statement_sql(names)}),
years AS (SELECT company, year_period, row_number() OVER (PARTITION BY company ORDER BY year_period) AS year_rank FROM (SELECT DISTINCT company, year_period FROM sct)),
ranked AS (SELECT sct.*, year_rank FROM sct JOIN years USING (company, year_period)),
change AS (SELECT a.*, b.value AS prev_value, round((a.value - b.value) / nullif(abs(b.value), 0) * 100, 2) + 0.0 AS yoy_pct
  FROM ranked a LEFT JOIN ranked b ON a.company = b.company AND a.canonical_name = b.canonical_name AND a.year_rank = b.year_rank + 1)
"""

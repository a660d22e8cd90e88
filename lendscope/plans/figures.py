"""SQL of figures in filed documents, which financial and filing queries share."""

from __future__ import annotations

from lendscope.functions import numbers
from lendscope.operators import decision, filings
from lendscope.plans.inputs import sql as s

FILINGS = f"({s('filings')})"


def contains(c: str, words: list[str]) -> str:
    return "(" + " OR ".join("contains({}, '{}')".format(c, w.replace("'", "''")) for w in words) + ")"


def around(text: str, found: str, before: int, after: int) -> str:
    at = f"instr({text}, {found})"
    return f"substr({text}, greatest({at} - {before}, 1), least({at} - 1, {before}) + length({found}) + {after})"


def number_after(pieces: str, name: str, number: str = r"[0-9]+\.?[0-9]*") -> str:
    """The first number after name, of the pieces (a list) that hold it."""
    rest = f"substr(x, instr(x, '{name}') + {len(name)})"
    return f"TRY_CAST(([y FOR y IN [regexp_extract({rest}, '{number}', {1 if '(' in number else 0}) FOR x IN {pieces} IF contains(x, '{name}')] IF y <> ''])[1] AS DOUBLE)"


def percent_after(pieces: str, name: str) -> str:
    return number_after(pieces, name, "([0-9]{1,3}) *%")


def times(unit: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_full_match(lower({unit}), '{q}') THEN {t:.0f}e0" for q, t in numbers.UNITS) + " ELSE 1e0 END"


_all = lambda p, i: f"unnest(regexp_extract_all(text, '{p}', {i}))"
_found = " UNION ALL ".join(
    f"SELECT doc_id, company_id, text, '{k}' AS type, unnest(range(len(regexp_extract_all(text, '{p}', 0)))) AS place, {_all(p, 0)} AS found, lower(trim({_all(p, 1)})) AS label, TRY_CAST(replace({_all(p, 2)}, ',', '') AS DOUBLE) AS n, lower({_all(p, 3)}) AS unit FROM {FILINGS}"
    for k, p in filings.FIGURES.items()
)
_metric = "CASE " + " ".join(f"WHEN {contains('label', words)} THEN '{k}'" for k, words in filings.FIGURE_METRICS.items()) + " ELSE 'other' END"
FIGURES = f"""(SELECT doc_id, company_id, type, label, metric, value, has_unit, arg_min(context, place) AS context FROM (
  SELECT *, {_metric} AS metric, n * CASE WHEN type = 'currency' THEN {times("unit")} ELSE 1e0 END AS value, coalesce(unit, '') <> '' AS has_unit, {around("text", "found", 60, 60)} AS context
  FROM ({_found}) WHERE n IS NOT NULL) GROUP BY 1, 2, 3, 4, 5, 6, 7)"""

_named = "CASE metric " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in decision.FIGURE_NAMES.items()) + " END"
_own = lambda m, f: f"coalesce({f('', m, '')}, {f('', m, 'NOT ')})"
_max = lambda _, m, n: f"max(value) FILTER (metric = '{m}' AND {n}stated)"
_list = lambda _, m, n: f"list_sort(list(value) FILTER (metric = '{m}' AND {n}stated))"
_metrics = ", ".join(f"{_own(m, _max)} AS {m}" for m in decision.METRICS)
_series = ", ".join(f"coalesce({_own(m, _list)}, []) AS {m}_series" for m in decision.SERIES)
_part = lambda c: f"coalesce({c}, 0e0)"
_debt = f"coalesce(total_debt, CASE WHEN long_term_debt IS NOT NULL OR short_term_debt IS NOT NULL THEN {_part('long_term_debt')} + {_part('short_term_debt')} END)"
_assets = f"coalesce(current_assets, CASE WHEN {' + '.join(f'CAST({_part(c)} <> 0 AS INT)' for c in ('inventories', 'receivables', 'cash'))} >= 2 THEN {_part('inventories')} + {_part('receivables')} + {_part('cash')} END)"
FIN = f"""(SELECT * REPLACE ({_debt} AS total_debt, {_assets} AS current_assets) FROM (SELECT company_id, {_metrics}, {_series} FROM (
  SELECT company_id, metric, value, true AS stated FROM ({s("fin_lines")}) WHERE value IS NOT NULL UNION ALL
  SELECT company_id, {_named}, value, false FROM {FIGURES} WHERE has_unit AND type = 'currency' AND value > 0) WHERE metric IS NOT NULL GROUP BY 1))"""

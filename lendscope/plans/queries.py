"""Registered queries of the credit operators, with the same results told in ANSI SQL."""

from __future__ import annotations

import functools
import math

from pyspark.sql import functions as F

from lendscope.functions import numbers
from lendscope.functions.rounding import half_up_sql as r
from lendscope.operators import decision, documents, filings, graph, research, statements, verification
from lendscope.plans.figures import FIN, around, number_after
from lendscope.plans.inputs import frame
from lendscope.plans.inputs import sql as s
from lendscope.stages import spread, step, whole

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None):
    """Registers a query with its SQL. In a run (see stages) its result is a step, however many others read it."""

    def add(f):
        @functools.wraps(f)
        def of(spark, d):
            return step(d, f"query_{f.__name__}", lambda: f(spark, d))

        QUERIES[f.__name__] = of
        if oracle is not None:
            ORACLE_SQL[f.__name__] = oracle
        return of

    return add


# ---- SQL pieces -------------------------------------------------------------------------

EDGES = f"""(SELECT company_id, src, dst, CAST(CAST(sum(amount) AS DECIMAL(18, 2)) AS DOUBLE) AS total_amount, count(*) AS txn_count,
  min(txn_date) AS first_date, max(txn_date) AS last_date FROM ({s("txns")}) t WHERE src <> dst AND NOT (src = 'UNKNOWN' AND dst = 'UNKNOWN') GROUP BY 1, 2, 3)"""
MANY = EDGES.replace(s("txns"), s("graph_txns"))
DEGREES = f"(SELECT company_id, node, count(*) AS degree FROM (SELECT company_id, src AS node FROM {EDGES} UNION ALL SELECT company_id, dst FROM {EDGES}) GROUP BY 1, 2)"
FREQ = f"(SELECT company_id, e AS entity, count(*) AS freq FROM (SELECT company_id, src AS e FROM ({s('txns')}) UNION ALL SELECT company_id, dst FROM ({s('txns')})) WHERE e NOT IN ('SELF', 'UNKNOWN') GROUP BY 1, 2)"
PAIRS = f"""(SELECT o.company_id, o.src AS entity_a, o.dst AS entity_b, {r("least(o.total_amount, b.total_amount) / greatest(o.total_amount, b.total_amount)", 3)} AS ratio,
  {r("o.total_amount + b.total_amount", 2)} AS combined FROM {EDGES} o JOIN {EDGES} b ON o.company_id = b.company_id AND o.src = b.dst AND o.dst = b.src WHERE o.src < o.dst)"""
LAYERED = f"""(SELECT company_id, coalesce(pairs, 0) AS pairs, layered_score, CASE WHEN layered_score > 0.15 THEN 'HIGH' WHEN layered_score > 0.05 THEN 'MEDIUM' ELSE 'NONE' END AS severity
  FROM (SELECT t.company_id, p.pairs, {r("least(2.0 * coalesce(p.w, 0) / t.total, 1.0)", 4)} AS layered_score
    FROM (SELECT company_id, CAST(sum(CAST(total_amount AS DECIMAL(18, 2))) AS DOUBLE) AS total FROM {EDGES} GROUP BY 1) t
    LEFT JOIN (SELECT company_id, CAST(sum(CAST(ratio * combined AS DECIMAL(24, 6))) AS DOUBLE) AS w, count(*) AS pairs FROM {PAIRS} GROUP BY 1) p USING (company_id)))"""
CONCENTRATION = f"""(SELECT company_id, concentration, CASE WHEN concentration > 0.5 THEN 'HIGH' WHEN concentration > 0.35 THEN 'MEDIUM' ELSE 'NONE' END AS severity
  FROM (SELECT company_id, {r("CAST(max(freq) AS DOUBLE) / sum(freq)", 4)} AS concentration FROM {FREQ} GROUP BY 1))"""
CYCLES = f"""(WITH e AS (SELECT company_id AS g, src AS s, dst AS d, total_amount AS t FROM {MANY})
  SELECT a.g AS company_id, 2 AS length, a.s || '>' || b.s AS path, {r("a.t + b.t", 2)} AS amount FROM e a JOIN e b ON a.g = b.g AND a.d = b.s AND b.d = a.s WHERE a.s < b.s
  UNION ALL
  SELECT a.g, 3, a.s || '>' || b.s || '>' || c.s, {r("a.t + b.t + c.t", 2)} FROM e a JOIN e b ON a.g = b.g AND a.d = b.s JOIN e c ON b.g = c.g AND b.d = c.s AND c.d = a.s
    WHERE a.s < b.s AND a.s < c.s AND b.s <> c.s
  UNION ALL
  SELECT a.g, 4, a.s || '>' || b.s || '>' || c.s || '>' || d.s, {r("a.t + b.t + c.t + d.t", 2)} FROM e a JOIN e b ON a.g = b.g AND a.d = b.s JOIN e c ON b.g = c.g AND b.d = c.s
    JOIN e d ON c.g = d.g AND c.d = d.s AND d.d = a.s WHERE a.s < b.s AND a.s < c.s AND a.s < d.s AND b.s <> c.s AND b.s <> d.s AND c.s <> d.s)"""
_cycle_score = lambda edges, cycles: f"""SELECT t.company_id, coalesce(n, 0) AS cycles, {r("least(0.7e0 * least(coalesce(a, 0e0) / CASE WHEN total > 0 THEN total ELSE 1e0 END, 1e0) + 0.3e0 * least(coalesce(n, 0) * 10 / 100e0, 1e0), 1e0)", 4)} AS cycle_score
FROM (SELECT company_id, CAST(sum(CAST(total_amount AS DECIMAL(18, 2))) AS DOUBLE) AS total FROM {edges} GROUP BY 1) t
LEFT JOIN (SELECT company_id, count(*) AS n, CAST(sum(CAST(amount AS DECIMAL(18, 2))) AS DOUBLE) AS a FROM {cycles} GROUP BY 1) c USING (company_id)"""  # noqa: E731
OWN_CYCLES = f"""(SELECT a.company_id, {r("a.total_amount + b.total_amount", 2)} AS amount FROM {EDGES} a JOIN {EDGES} b ON a.company_id = b.company_id AND a.dst = b.src AND b.dst = a.src WHERE a.src < b.src)"""
BENFORD_DIGITS = f"(SELECT company_id, CAST(left(CAST(CAST(floor(amount) AS BIGINT) AS VARCHAR), 1) AS INT) AS digit, count(*) AS c FROM ({s('txns')}) WHERE amount > 1000 GROUP BY 1, 2)"
CHI = " + ".join(f"pow(coalesce(max(c) FILTER (digit = {d}), 0) - sum(c) * {math.log10(1 + 1 / d)!r}e0, 2) / (sum(c) * {math.log10(1 + 1 / d)!r}e0)" for d in range(1, 10))
BENFORD = f"""(SELECT *, {r("least(chi_square / 31.0, 1.0)", 4)} AS benford_score,
  CASE WHEN amounts < 100 THEN 'INSUFFICIENT_DATA' WHEN chi_square > 31.02 THEN 'HIGH' WHEN chi_square > 15.51 THEN 'MEDIUM' ELSE 'NONE' END AS severity
  FROM (SELECT company_id, CAST(sum(c) AS BIGINT) AS amounts, {r(f"CASE WHEN sum(c) >= 100 THEN {CHI} ELSE 0e0 END", 2)} AS chi_square FROM {BENFORD_DIGITS} GROUP BY 1))"""
SUMS = lambda name, c: f"(SELECT company_id, CAST(CAST(sum(CAST({c} AS DECIMAL(18, 2))) AS DECIMAL(18, 2)) AS DOUBLE) AS v FROM ({s(name)}) t GROUP BY 1)"
clamp = lambda x: r(f"greatest(0.0, least(100.0, {x}))", 1)
upto = lambda c, full: f"least({c} / {full}e0, 1e0)"
F_SQL = s("features")
SCORECARD = f"""(SELECT *, {r("financial_health * 0.25 + cashflow * 0.20e0 + governance * 0.15e0 + fraud_risk * 0.15e0 + sector_risk * 0.15e0 + collateral * 0.10e0", 1)} AS weighted_total FROM (SELECT company_id,
  {clamp(f"{upto('ebitda_margin', 0.2)} * 35 + {upto('pat_margin', 0.12)} * 25 + (1 - {upto('debt_to_equity', 4.0)}) * 40")} AS financial_health,
  {clamp(f"{upto('dscr', 2.0)} * 40 + {upto('interest_coverage_ratio', 3.0)} * 35 + least(greatest(revenue_growth_3yr, 0e0) / 0.15e0 + 0.5e0, 1e0) * 25")} AS cashflow,
  {clamp("100 - promoter_network_risk * 40 - litigation_severity_score * 30 - regulatory_violation_count * 3")} AS governance,
  {clamp("100 - gst_bank_mismatch_score * 40 - circular_trading_score * 35 - benford_deviation_score * 25")} AS fraud_risk,
  {clamp("(1 - sector_risk_score) * 100")} AS sector_risk, {clamp(f"{upto('collateral_coverage_ratio', 2.0)} * 100")} AS collateral FROM ({F_SQL})))"""
FIVE = f"""(SELECT company_id, {clamp("100 - promoter_network_risk * 30 - litigation_severity_score * 30 - regulatory_violation_count * 5 - news_sentiment_score * 10")} AS "character",
  {clamp(f"{upto('dscr', 2.0)} * 40 + {upto('interest_coverage_ratio', 3.0)} * 30 + {upto('ebitda_margin', 0.2)} * 30")} AS capacity,
  {clamp(f"(1 - {upto('debt_to_equity', 4.0)}) * 50 + {upto('pat_margin', 0.12)} * 30 + least(revenue_growth_3yr / 0.15e0 + 0.5e0, 1e0) * 20")} AS capital,
  {clamp(f"{upto('collateral_coverage_ratio', 2.0)} * 100")} AS collateral, {clamp("(1 - sector_risk_score) * 60 + capacity_utilization * 40")} AS conditions FROM ({F_SQL}))"""
_ALL_RULES = [(n, op, t, 0, "HARD") for n, op, t in decision.HARD_RULES] + [(*x, "POLICY") for x in decision.POLICY_RULES]
FIRED = "(" + " UNION ALL ".join(f"SELECT company_id, {i} AS ordinal, '{k}' AS kind, '{n}' AS feature, {p} AS points FROM ({F_SQL}) WHERE {n} {op} {t}e0" for i, (n, op, t, p, k) in enumerate(_ALL_RULES)) + ")"
RULES = f"""(SELECT f.company_id, coalesce(h, 0) > 0 AS hard_reject, g.reason, coalesce(h, 0) AS hard_flags, coalesce(p, 0) AS policy_flags,
  greatest(100 - coalesce(points, 0), 0) AS policy_score FROM ({F_SQL}) f LEFT JOIN (SELECT company_id, count(*) FILTER (kind = 'HARD') AS h,
  count(*) FILTER (kind = 'POLICY') AS p, CAST(sum(points) AS BIGINT) AS points, min_by(feature, ordinal) FILTER (kind = 'HARD') AS reason FROM {FIRED} GROUP BY 1) g USING (company_id))"""
SPREAD = f"""{r("(high - low) / high", 4)} AS delta, {r("least((high - low) / high / 0.5, 1.0)", 3)} AS score,
  CASE WHEN (high - low) / high > 0.35 THEN 'HIGH' WHEN (high - low) / high > 0.2 THEN 'MEDIUM' ELSE 'NONE' END AS severity"""
CONTAINS = lambda c, words: "(" + " OR ".join("contains({}, '{}')".format(c, w.replace("'", "''")) for w in words) + ")"
HITS = lambda c, words: "(" + " + ".join(f"CAST(contains({c}, '{w}') AS INT)" for w in words) + ")"
VALUES = lambda rows: "(VALUES " + ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'" for x in row) + ")" for row in rows) + ")"
ARTICLES = f"""(SELECT company_id, ordinal, url, title, snippet, {CONTAINS("low", research.LITIGATION)} AS has_litigation_signal, CASE WHEN bad > good THEN 'NEGATIVE' WHEN good > bad THEN 'POSITIVE' ELSE 'NEUTRAL' END AS sentiment
  FROM (SELECT *, {HITS("low", research.NEGATIVE)} AS bad, {HITS("low", research.POSITIVE)} AS good FROM (SELECT *, lower(title || ' ' || snippet) AS low FROM ({s("articles")}))))"""
KEPT = f"""(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY CAST(sentiment = 'NEGATIVE' AS INT) DESC, length(snippet) DESC, ordinal) AS rank
  FROM (SELECT company_id, url, ordinal, title, snippet, sentiment FROM {ARTICLES} WHERE url <> '' QUALIFY row_number() OVER (PARTITION BY company_id, url ORDER BY ordinal) = 1)) WHERE rank <= 20)"""
SEVERITY = "CASE " + " ".join(f"WHEN {CONTAINS('lower(summary)', words)} THEN '{k}'" for k, (words, _) in research.SEVERITY.items()) + " ELSE 'LOW' END"
_TYPES = ", ".join(f"{{'n': {HITS('low', w)}, 'o': {-i}, 't': '{t}'}}" for i, (t, w) in enumerate(documents.DOC_TYPES.items()))
DOC_TYPE = f"(SELECT company_id, doc_id, text, CASE WHEN b.n > 0 THEN b.t ELSE 'unknown' END AS doc_type, CAST(b.n AS BIGINT) AS hits FROM (SELECT *, list_max([{_TYPES}]) AS b FROM (SELECT *, lower(concat_ws(chr(10), text, regexp_replace(file_name, '[_.-]', ' ', 'g'))) AS low FROM ({s('named_reports')}))))"
_case_numbers = f"nullif(array_to_string(list_slice(regexp_extract_all(text, '{research.CASE_NUMBER}'), 1, 3), ', '), '')"
CASES = f"""(SELECT company_id, feed, ordinal, summary, {SEVERITY.replace("summary", "text")} AS severity FROM (
  SELECT company_id, 0 AS feed, doc_id AS ordinal, 'Legal document ' || doc_id || ': ' || coalesce({_case_numbers}, 'case reference found') AS summary, text, CAST(doc_id AS VARCHAR) AS document FROM {DOC_TYPE} WHERE doc_type = 'legal' UNION ALL
  SELECT company_id, 1, ordinal, title, snippet, NULL FROM {ARTICLES} WHERE has_litigation_signal)
  QUALIFY row_number() OVER (PARTITION BY company_id, left(summary, 60), document ORDER BY feed, ordinal) = 1)"""


# ---- transaction graph ------------------------------------------------------------------

edges = lambda spark, d, name="txns": step(d, f"edges_{name}", lambda: graph.txn_edges(frame(spark, d, name)))


@query(f"SELECT * REPLACE (CAST(first_date AS VARCHAR) AS first_date, CAST(last_date AS VARCHAR) AS last_date) FROM {EDGES}")
def txn_edges(spark, d):
    return edges(spark, d).withColumns({c: F.col(c).cast("string") for c in ("first_date", "last_date")})


@query(f"SELECT company_id, count(*) AS node_count, CAST(sum(degree) / 2 AS BIGINT) AS edge_count, {r('sum(degree) / 2 / (CAST(count(*) AS DOUBLE) * (count(*) - 1))', 4)} AS density FROM {DEGREES} GROUP BY 1")
def graph_stats(spark, d):
    return graph.graph_stats(edges(spark, d))


@query(f"SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY company_id ORDER BY degree DESC, node) AS INT) AS rank FROM {DEGREES}) WHERE rank <= 10")
def graph_top_nodes(spark, d):
    return graph.top_nodes(edges(spark, d))


@query(f"SELECT * FROM {FREQ}")
def counterparty_freq(spark, d):
    return graph.counterparty_freq(frame(spark, d, "txns"))


@query(f"SELECT company_id, entity, freq, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY freq DESC, entity) AS rank FROM {FREQ}) WHERE rank <= 10")
def counterparty_top(spark, d):
    return graph.top_counterparties(counterparty_freq(spark, d))


@query(f"SELECT DISTINCT company_id, entity FROM {FREQ}")
def counterparty_list(spark, d):
    return graph.counterparties(counterparty_freq(spark, d))


@query(f"SELECT * FROM {CONCENTRATION}")
def counterparty_concentration(spark, d):
    return graph.counterparty_concentration(graph.counterparty_freq(frame(spark, d, "txns")))


@query(f"SELECT * FROM {PAIRS}")
def layered_pairs(spark, d):
    return graph.layered_pairs(edges(spark, d))


@query(f"SELECT * FROM {LAYERED}")
def layered_score(spark, d):
    e = edges(spark, d)
    return graph.layered_score(e, graph.layered_pairs(e))


@query(f"SELECT company_id, layered_score, pairs, severity FROM {LAYERED} WHERE severity <> 'NONE' ORDER BY layered_score DESC, company_id")
def suspicious_companies(spark, d):
    e = edges(spark, d)
    scored = graph.layered_score(e, graph.layered_pairs(e)).where("severity <> 'NONE'")
    return scored.select("company_id", "layered_score", "pairs", "severity").orderBy(F.desc("layered_score"), "company_id")


@query(f"SELECT *, true AS suspicious FROM {CYCLES}")
@whole
def cycles(spark, d):
    return graph.cycles(edges(spark, d, "graph_txns"))


@query(_cycle_score(MANY, CYCLES))
@whole
def cycle_score(spark, d):
    e = edges(spark, d, "graph_txns")
    return graph.cycle_score(e, graph.cycles(e))


@query(f"""WITH t AS (SELECT *, CASE WHEN direction = 'debit' THEN dst ELSE src END AS party FROM ({s("txns")}))
SELECT company_id, party, count(*) AS round_trips, CAST(sum(amount) AS DOUBLE) AS paid_out FROM t a WHERE direction = 'debit' AND EXISTS (
  SELECT 1 FROM t b WHERE b.company_id = a.company_id AND b.party = a.party AND b.direction = 'credit' AND b.txn_date BETWEEN a.txn_date AND a.txn_date + 30) GROUP BY 1, 2""")
def round_trip(spark, d):
    return graph.round_trip(frame(spark, d, "txns"))


@query(f"SELECT * FROM {BENFORD}")
def benford(spark, d):
    return graph.benford(frame(spark, d, "txns"))


@query(f"""SELECT company_id, g.digit, {r("coalesce(c, 0) / CAST(n AS DOUBLE)", 4)} AS observed, expected FROM (SELECT company_id, sum(c) AS n FROM {BENFORD_DIGITS} GROUP BY 1) t
CROSS JOIN (VALUES {", ".join(f"({k}, {round(math.log10(1 + 1 / k), 4)}e0)" for k in range(1, 10))}) g(digit, expected) LEFT JOIN {BENFORD_DIGITS} b USING (company_id, digit)""")
def benford_distribution(spark, d):
    return graph.benford_distribution(frame(spark, d, "txns"))


SHELLS = """WITH e AS (SELECT DISTINCT c_nationkey AS company_id, upper(c_name) || ' PVT LTD' AS entity FROM customer),
n AS (SELECT DISTINCT s_nationkey AS company_id, replace(s_name, 'Supplier', 'Customer') || ' traders' AS name FROM supplier),
t AS (SELECT company_id, x AS e, unnest(list_distinct(string_split(trim(regexp_replace(regexp_replace(upper(x), '\\b(PVT|PRIVATE|LTD|LIMITED|LLP|INC|CORP)\\b\\.?', ' ', 'g'), '[^A-Z0-9]+', ' ', 'g')), ' '))) AS k
      FROM (SELECT company_id, entity AS x FROM e)),
u AS (SELECT company_id, x AS n, unnest(list_distinct(string_split(trim(regexp_replace(regexp_replace(upper(x), '\\b(PVT|PRIVATE|LTD|LIMITED|LLP|INC|CORP)\\b\\.?', ' ', 'g'), '[^A-Z0-9]+', ' ', 'g')), ' '))) AS k
      FROM (SELECT company_id, name AS x FROM n))
SELECT company_id, entity, min(name) AS matched FROM (SELECT t.company_id, t.e AS entity, u.n AS name FROM t JOIN u ON t.company_id = u.company_id AND t.k = u.k
  WHERE t.k <> '' AND upper(t.e) <> upper(u.n) GROUP BY 1, 2, 3 HAVING count(*) >= 2) GROUP BY 1, 2"""


@query(SHELLS)
def shell_entities(spark, d):
    own = frame(spark, d, "customer").selectExpr("c_nationkey AS company_id", "upper(c_name) || ' PVT LTD' AS entity")
    names = frame(spark, d, "supplier").selectExpr("s_nationkey AS company_id", "replace(s_name, 'Supplier', 'Customer') || ' traders' AS name")
    return graph.shell_entities(own, names)


SHELL_SCORE = f"(SELECT company_id, {r('least(0.15e0 * count(*), 1e0)', 4)} AS shell_score FROM ({SHELLS}) GROUP BY 1)"


@query(f"""SELECT company_id, circular_score, circular_score > 0.25 AS suspicious, circular_score > 0.8 AS hard_reject FROM (
SELECT company_id, {r("least(0.5e0 * coalesce(cycle_score, 0e0) + 0.25e0 * layered_score + 0.15e0 * coalesce(shell_score, 0e0) + 0.1e0 * coalesce(concentration, 0e0), 1e0)", 4)} AS circular_score
FROM {LAYERED} LEFT JOIN ({_cycle_score(EDGES, OWN_CYCLES)}) USING (company_id) LEFT JOIN {SHELL_SCORE} USING (company_id) LEFT JOIN {CONCENTRATION} USING (company_id))""")
@whole
def circular_composite(spark, d):
    """A company's own payments form a star about it in the given tables, so that its cycles have two nodes, though those of
    up to four are sought."""
    e = edges(spark, d)
    layered = graph.layered_score(e, graph.layered_pairs(e)).select("company_id", "layered_score")
    own = graph.cycle_score(e, graph.cycles(e)).select("company_id", "cycle_score")
    concentration = graph.counterparty_concentration(graph.counterparty_freq(frame(spark, d, "txns"))).select("company_id", "concentration")
    return graph.circular_composite(layered.select("company_id"), own, layered, graph.shell_score(shell_entities(spark, d)), concentration)


# ---- numbers and narrations -------------------------------------------------------------

_G = lambda p, i: f"regexp_extract(raw, '{p.replace(chr(39), chr(39) * 2)}', {i})"


def _amount_sql(p: str, unit: str = "''") -> str:
    u = f"lower(CASE WHEN {_G(p, 4)} <> '' THEN {_G(p, 4)} ELSE {unit} END)"
    times = "CASE " + " ".join(f"WHEN regexp_full_match({u}, '{q}') THEN {t:.0f}e0" for q, t in numbers.UNITS) + " ELSE 1e0 END"
    sign = f"CASE WHEN {_G(p, 1)} = '-' OR {_G(p, 2)} = '-' THEN -1e0 ELSE 1e0 END"
    return f"CASE WHEN {_G(p, 3)} <> '' AND NOT ({u} = '' AND regexp_matches({_G(p, 3)}, '{numbers.YEAR}')) THEN {sign} * TRY_CAST(replace({_G(p, 3)}, ',', '') AS DOUBLE) * {times} END"


@query(f"SELECT id, {_amount_sql(numbers.AMOUNT)} AS value FROM ({s('amounts')})")
def parse_amount(spark, d):
    return frame(spark, d, "amounts").select("id", numbers.parse_amount(F.col("raw")).alias("value"))


@query(f"SELECT id, {_amount_sql(numbers.WHOLE, 'context_unit')} AS value FROM ({s('amounts')})")
def parse_inr(spark, d):
    return frame(spark, d, "amounts").select("id", numbers.parse_inr(F.col("raw"), F.col("context_unit")).alias("value"))


@query(f"SELECT id, CASE WHEN regexp_matches(raw, '^\\s*\\(.+\\)\\s*$') THEN -abs({_amount_sql(numbers.AMOUNT)}) ELSE {_amount_sql(numbers.AMOUNT)} END AS value FROM ({s('amounts')})")
def parse_accounting(spark, d):
    return frame(spark, d, "amounts").select("id", numbers.parse_accounting(F.col("raw")).alias("value"))


@query(f"SELECT id, v AS value FROM (SELECT id, raw, {_amount_sql(numbers.AMOUNT)} AS v FROM ({s('amounts')})) WHERE coalesce(NOT regexp_matches(trim(raw), '^(199[0-9]|20[0-3][0-9]|2040)$') AND v >= 100, false)")
def valid_amount(spark, d):
    rows = frame(spark, d, "amounts").select("id", "raw", numbers.parse_amount(F.col("raw")).alias("value"))
    return rows.where(numbers.valid_amount(F.col("value"), F.col("raw"))).select("id", "value")


_NAME = lambda x: f"trim(regexp_replace(regexp_replace(upper(regexp_replace({x}, '[/-]\\s*[0-9]{{4,}}.*$', '')), '[^A-Z0-9 &./()-]', ' ', 'g'), ' +', ' ', 'g'))"


@query(f"SELECT txn_id, CASE WHEN length({_NAME('narration')}) >= 3 THEN {_NAME('narration')} ELSE '' END AS entity FROM ({s('narrations')})")
def normalise_entity(spark, d):
    return frame(spark, d, "narrations").select("txn_id", numbers.normalise_entity(F.col("narration")).alias("entity"))


@query(f"SELECT txn_id, CAST(amount * 20 AS DOUBLE) AS amount, amount * 20 > 1000000 AS large, contains(lower(narration), 'cash') AS cash FROM ({s('narrations')}) WHERE amount * 20 > 1000000 OR contains(lower(narration), 'cash')")
def large_cash_txns(spark, d):
    """Amounts of the given tables times 20, so that some pass a million."""
    rows = frame(spark, d, "narrations").withColumn("amount", F.col("amount") * 20)
    return statements.large_cash(rows).select("txn_id", F.col("amount").cast("double").alias("amount"), "large", "cash")


# ---- verification -----------------------------------------------------------------------


@query(f"""SELECT company_id, gst, bank, CASE WHEN k THEN {r("least(delta / 0.5, 1.0)", 3)} ELSE 0e0 END AS score,
CASE WHEN NOT k THEN 'INSUFFICIENT_DATA' WHEN delta > 0.25 THEN 'REVENUE_MISMATCH' WHEN delta > 0.15 THEN 'GST_BANK_MISMATCH' ELSE 'NONE' END AS flag,
CASE WHEN k AND delta > 0.4 THEN 'HIGH' WHEN k AND delta > 0.15 THEN 'MEDIUM' ELSE 'NONE' END AS severity
FROM (SELECT company_id, g.v AS gst, b.v AS bank, abs(g.v - b.v) / g.v AS delta, g.v IS NOT NULL AND b.v IS NOT NULL AND g.v > 0 AS k
  FROM {SUMS("gst_monthly", "turnover")} g FULL JOIN {SUMS("bank_monthly", "credits")} b USING (company_id))""")
def gst_bank_mismatch(spark, d):
    return verification.gst_bank_mismatch(frame(spark, d, "gst_monthly"), frame(spark, d, "bank_monthly"))


@query(f"""SELECT c.company_id, CAST(m.p AS INT) AS place, CAST(m.m AS INT) AS month, delta AS delta_pct,
CASE WHEN delta IS NULL THEN 'NO_DATA' WHEN abs(delta) <= 15 THEN 'OK' WHEN abs(delta) > 30 THEN 'HIGH' ELSE 'MEDIUM' END AS status
FROM (SELECT c_custkey AS company_id FROM customer) c CROSS JOIN (SELECT unnest(range(1, 13)) AS p, unnest({verification.FISCAL}) AS m) m
LEFT JOIN (SELECT company_id, month, CASE WHEN b.credits > 0 THEN {r("(g.turnover - b.credits) / b.credits * 100", 1)} END AS delta FROM ({s("gst_monthly")}) g JOIN ({s("bank_monthly")}) b USING (company_id, month)) x
  ON x.company_id = c.company_id AND x.month = m.m""")
def monthly_recon(spark, d):
    companies = frame(spark, d, "customer").select(F.col("c_custkey").alias("company_id"))
    return verification.monthly_recon(companies, frame(spark, d, "gst_monthly"), frame(spark, d, "bank_monthly"))


@query(f"""SELECT company_id, CASE WHEN o THEN {r("x", 4)} ELSE 0e0 END AS excess_ratio, CASE WHEN o THEN {r("least(x / 0.5, 1.0)", 3)} ELSE 0e0 END AS score,
CASE WHEN o AND x > 0.25 THEN 'CRITICAL' WHEN o THEN 'HIGH' ELSE 'NONE' END AS fake_itc, CASE WHEN turnover > 0 THEN {r("claimed / turnover", 4)} END AS itc_to_turnover,
CASE WHEN claimed / turnover > 0.4 THEN 'HIGH' WHEN claimed / turnover > 0.25 THEN 'MEDIUM' ELSE 'NONE' END AS high_itc
FROM (SELECT *, claimed > available AND available > 0 AS o, CASE WHEN available > 0 THEN (claimed - available) / available END AS x FROM ({s("itc")}))""")
def itc_check(spark, d):
    return verification.itc_check(frame(spark, d, "itc"))


@query(f"""SELECT company_id, {SPREAD} FROM (SELECT company_id, least(i, a) AS low, greatest(i, a) AS high FROM (
SELECT company_id, max(value) FILTER (source = 'itr' AND value > 0) AS i, max(value) FILTER (source = 'annual_report' AND value > 0) AS a FROM ({s("income")}) GROUP BY 1) WHERE i IS NOT NULL AND a IS NOT NULL)""")
def itr_check(spark, d):
    return verification.itr_check(frame(spark, d, "income"))


@query(f"""SELECT company_id, sources, highest, {SPREAD} FROM (SELECT company_id, min(value) AS low, max(value) AS high, count(*) AS sources, arg_max(source, value) AS highest
FROM ({s("income")}) WHERE value > 0 GROUP BY 1) WHERE sources >= 2""")
def three_way_recon(spark, d):
    return verification.three_way_recon(frame(spark, d, "income"))


@query(f"""SELECT *, CASE WHEN critical + high >= 2 THEN 'CRITICAL' WHEN critical + high = 1 THEN 'HIGH' WHEN medium >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS overall FROM (
SELECT company_id, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'HIGH') AS high, count(*) FILTER (severity = 'MEDIUM') AS medium
FROM (SELECT company_id, severity FROM ({ORACLE_SQL["gst_bank_mismatch"]}) UNION ALL SELECT company_id, fake_itc FROM ({ORACLE_SQL["itc_check"]}) UNION ALL SELECT company_id, high_itc FROM ({ORACLE_SQL["itc_check"]})
  UNION ALL SELECT company_id, severity FROM ({ORACLE_SQL["itr_check"]}) UNION ALL SELECT company_id, severity FROM ({ORACLE_SQL["three_way_recon"]})) GROUP BY 1)""")
def consistency_summary(spark, d):
    """Flags of the checks between GST, bank, tax credit, tax return and annual report."""
    itc = itc_check(spark, d)
    flags = [gst_bank_mismatch(spark, d).select("company_id", "severity"), itr_check(spark, d).select("company_id", "severity"), three_way_recon(spark, d).select("company_id", "severity")]
    flags += [itc.select("company_id", F.col(c).alias("severity")) for c in ("fake_itc", "high_itc")]
    out = flags[0]
    for more in flags[1:]:
        out = out.unionByName(more)
    return verification.consistency_summary(out)


# ---- features and decision --------------------------------------------------------------


def _fin(spark, d):
    """Statement lines, and amounts told with a unit in the filed documents of a company."""

    def build():
        docs = frame(spark, d, "filings")
        told = lambda: filings.figures(spread(docs, "doc_id")).where("has_unit AND type = 'currency'").join(docs.select("doc_id", "company_id"), "doc_id").select("company_id", "metric", "value")
        return decision.fin_agg(frame(spark, d, "fin_lines"), step(d, "told", told))

    return step(d, "fin", build)


@query(f"""SELECT company_id, {", ".join(decision.METRICS)}, {", ".join(f"array_to_string([CAST(CAST(x AS DECIMAL(20, 2)) AS VARCHAR) FOR x IN {m}_series], ',') AS {m}_series" for m in decision.SERIES)} FROM {FIN}""")
def fin_agg(spark, d):
    shown = lambda m: F.array_join(F.transform(f"{m}_series", lambda x: x.cast("decimal(20,2)").cast("string")), ",").alias(f"{m}_series")
    return _fin(spark, d).select("company_id", *decision.METRICS, *map(shown, decision.SERIES))


@query(f"""SELECT company_id, {r("CASE WHEN n > 0 AND f > 0 THEN pow(l / f, 1e0 / n) - 1 ELSE 0.05e0 END", 4)} AS growth FROM (
SELECT company_id, arg_min(value, period) AS f, arg_max(value, period) AS l, max(period) - min(period) AS n FROM ({s("fin_lines")}) WHERE metric = 'revenue' GROUP BY 1)""")
def cagr(spark, d):
    return decision.cagr(frame(spark, d, "fin_lines"))


_over = lambda a, b: f"CASE WHEN {a} IS NOT NULL AND {b} <> 0 THEN {r(f'{a} / {b}', 4)} ELSE 0e0 END"
RATIOS = f"""(SELECT company_id, {_over("ebitda", "revenue")} AS ebitda_margin, {_over("pat", "revenue")} AS pat_margin, {_over("total_debt", "equity")} AS debt_to_equity,
  {_over("current_assets", "current_liabilities")} AS current_ratio, {_over("coalesce(nullif(ebit, 0), ebitda)", "interest")} AS interest_coverage_ratio, CASE WHEN coalesce(interest, 0e0) + 0.1e0 * coalesce(total_debt, 0e0) > 0
  THEN {r("coalesce(cfo, ebitda, 0e0) / (coalesce(interest, 0e0) + 0.1e0 * coalesce(total_debt, 0e0))", 4)} ELSE 1.5e0 END AS dscr FROM {FIN})"""


@query(f"SELECT * FROM {RATIOS}")
def ratios(spark, d):
    return decision.ratios(_fin(spark, d))


@query(" UNION ALL ".join(f"SELECT company_id, '{c}' AS metric, {c} AS value, {b} AS higher_is_better FROM {RATIOS}" for c, b in (("ebitda_margin", "true"), ("pat_margin", "true"), ("debt_to_equity", "false"), ("current_ratio", "true"), ("interest_coverage_ratio", "true"), ("dscr", "true"))))
def ratio_table(spark, d):
    return decision.ratio_table(ratios(spark, d))


_SECTOR = "CASE company_id % 5 WHEN 0 THEN 'steel' WHEN 1 THEN 'it' WHEN 2 THEN 'pharma' WHEN 3 THEN 'toys' ELSE 'auto' END"


@query(f"""SELECT company_id, sector, benchmark, {", ".join(f"{r(f'{n} - m.{n}_m', 4)} AS {n}_gap" for n in ("dscr", "debt_to_equity", "ebitda_margin", "current_ratio"))}
FROM (SELECT *, {_SECTOR} AS sector, CASE WHEN company_id % 5 = 3 THEN 'default' ELSE {_SECTOR} END AS benchmark FROM ({F_SQL})) f
JOIN (VALUES {", ".join(f"('{n}', {a}e0, {b}e0, {c}e0, {e}e0)" for n, a, b, c, e in decision.SECTORS)}) m(k, dscr_m, debt_to_equity_m, ebitda_margin_m, current_ratio_m) ON m.k = benchmark""")
def sector_benchmarks(spark, d):
    return decision.sector_benchmarks(frame(spark, d, "features").withColumn("sector", F.expr(_SECTOR)))


@query(f"SELECT * FROM {FIRED}")
def rules_fired(spark, d):
    return decision.fired_rules(frame(spark, d, "features"))


@query(f"SELECT * FROM {RULES}")
def rules_eval(spark, d):
    return decision.rules_eval(frame(spark, d, "features"))


@query(f"SELECT * FROM {SCORECARD}")
def scorecard(spark, d):
    return decision.scorecard(frame(spark, d, "features"))


@query(f"SELECT * FROM {FIVE}")
def five_cs(spark, d):
    return decision.five_cs(frame(spark, d, "features"))


_place = "CASE " + " ".join(f"WHEN score >= {least} THEN {i}" for i, (_, least, *_) in enumerate(decision.GRADES[:-1])) + " ELSE 7 END"
_names = "[" + ", ".join(f"'{g}'" for g, *_ in decision.GRADES) + "]"
GRADED = f"""(SELECT company_id, score, {_names}[p + 1] AS raw_grade, {_names}[CASE WHEN capacity < 60 THEN least(c + 1, 7) ELSE c END + 1] AS grade
FROM (SELECT *, CASE WHEN capital < 50 THEN greatest(p, 3) WHEN capital < 65 THEN greatest(p, 1) ELSE p END AS c
  FROM (SELECT *, {_place} AS p FROM (SELECT company_id, weighted_total AS score, capital, capacity FROM {SCORECARD} JOIN {FIVE} USING (company_id)))))"""


@query(f"SELECT * FROM {GRADED}")
def grade(spark, d):
    scores = scorecard(spark, d).select("company_id", F.col("weighted_total").alias("score"))
    return decision.grade(scores.join(five_cs(spark, d).select("company_id", "capital", "capacity"), "company_id"))


VERDICT = f"""(SELECT *, CASE WHEN hard_reject THEN 'REJECT' WHEN credit_score >= 75 THEN 'APPROVE' WHEN credit_score >= 60 THEN 'CONDITIONAL_APPROVE' ELSE 'REJECT' END AS verdict,
  {r("1 / (1 + exp(-(0.5e0 - 0.055e0 * credit_score)))", 4)} AS default_probability FROM (SELECT company_id, hard_reject,
  CASE WHEN hard_reject THEN capacity ELSE {r("0.5e0 * capacity + 0.2e0 * policy_score + 0.3e0 * weighted_total", 1)} END AS credit_score
  FROM {RULES} JOIN {SCORECARD} USING (company_id) JOIN (SELECT company_id, capacity FROM {FIVE}) USING (company_id)))"""


@query(f"SELECT * FROM {VERDICT}")
def verdict(spark, d):
    """The capacity score stands in for the model's score."""
    rules = rules_eval(spark, d).select("company_id", "hard_reject", "policy_score")
    scores = scorecard(spark, d).select("company_id", "weighted_total")
    return decision.verdict(rules.join(scores, "company_id").join(five_cs(spark, d).select("company_id", F.col("capacity").alias("ml_score")), "company_id"))


@query("SELECT company_id, concat_ws(',', " + ", ".join(f"CASE WHEN {c} {op} {t}e0 THEN '{n}' END" for n, c, op, t in decision.CONDITIONS) + f") AS conditions FROM ({F_SQL}) WHERE company_id IN (SELECT company_id FROM {VERDICT} WHERE verdict <> 'REJECT')")
def conditions(spark, d):
    return decision.conditions(frame(spark, d, "features"), verdict(spark, d))


_revenue, _ebitda = "turnover_crore * exposure", "turnover_crore * ebitda_margin * least(greatest(dscr, 0.5e0), 2.5e0) * 3.5e0"
LOANS = f"""(SELECT company_id, grade, {r(_revenue, 2)} AS loan_by_revenue, {r(_ebitda, 2)} AS loan_by_ebitda, greatest({r(f"least({_revenue}, {_ebitda})", 2)}, 1e0) AS max_loan_crore, premium + 9e0 AS interest_rate
  FROM {GRADED} JOIN (VALUES {", ".join(f"('{g}', {e}e0, {p}e0)" for g, _, e, p in decision.GRADES)}) m(grade, exposure, premium) USING (grade)
  JOIN (SELECT company_id, ebitda_margin, dscr FROM ({F_SQL})) f USING (company_id) JOIN ({s("turnover")}) t USING (company_id))"""


@query(f"SELECT * FROM {LOANS}")
def loan_sizing(spark, d):
    f = frame(spark, d, "features").select("company_id", "ebitda_margin", "dscr").join(frame(spark, d, "turnover"), "company_id")
    return decision.loan_sizing(grade(spark, d).select("company_id", "grade").join(f, "company_id"))


@query(f"""SELECT company_id, {r("max_loan_crore * 0.6e0", 2)} AS working_capital, {r("max_loan_crore * 0.4e0", 2)} AS term_loan,
{r("max_loan_crore * 0.4e0 * (interest_rate / 1200) / (1 - pow(1 + interest_rate / 1200, -60))", 4)} AS emi FROM {LOANS}""")
def facility_emi(spark, d):
    return decision.facility_emi(loan_sizing(spark, d))


@query(f"""SELECT company_id, scenario, {r("dscr * m.d", 2)} AS dscr, {r("score * m.s", 1)} AS score, CASE WHEN {r("score * m.s", 1)} >= 75 THEN 'APPROVE' WHEN {r("score * m.s", 1)} >= 60 THEN 'CONDITIONAL' ELSE 'REJECT' END AS outcome
FROM (SELECT company_id, weighted_total AS score FROM {SCORECARD}) JOIN (SELECT company_id, dscr FROM ({F_SQL})) USING (company_id)
CROSS JOIN (VALUES ('base', 1e0, 1e0), ('revenue_down_20', 0.8e0, 0.88e0), ('rate_up_2', 0.88e0, 0.94e0)) m(scenario, d, s)""")
def stress_scenarios(spark, d):
    scores = scorecard(spark, d).select("company_id", F.col("weighted_total").alias("score"))
    return decision.stress_scenarios(scores.join(frame(spark, d, "features").select("company_id", "dscr"), "company_id"))


@query(f"""SELECT company_id, CAST(dscr < 1.0 OR interest_coverage_ratio < 1.2 OR debt_to_equity > 3.5 OR circular_trading_score > 0.7 OR litigation_severity_score > 0.7
OR gst_bank_mismatch_score > 0.5 OR promoter_network_risk > 0.8 AS INT) AS label FROM ({F_SQL})""")
def ml_labels(spark, d):
    return decision.ml_labels(frame(spark, d, "features"))


@query(f"""SELECT company_id, axis, value FROM (UNPIVOT (SELECT *, {r("50 * (circular_trading_score + benford_deviation_score)", 1)} AS fraud_risk
FROM {FIVE} JOIN (SELECT company_id, circular_trading_score, benford_deviation_score FROM ({F_SQL})) USING (company_id))
ON "character", capacity, capital, collateral, conditions, fraud_risk INTO NAME axis VALUE value)""")
def risk_radar(spark, d):
    return decision.risk_radar(frame(spark, d, "features"))


# ---- documents --------------------------------------------------------------------------


@query(f"SELECT doc_id, doc_type, hits FROM {DOC_TYPE}")
def doc_type(spark, d):
    return documents.doc_type(frame(spark, d, "named_reports"))


_count = lambda p: f"length(regexp_replace(text, '{p}', '', 'g'))"


@query(f"""SELECT doc_id, quality, CASE WHEN size > 200 THEN greatest(quality, 0.6e0) ELSE quality END AS confidence FROM (SELECT doc_id, size, CASE WHEN n < 100 THEN 0e0 WHEN w < 50 THEN 0.1e0 ELSE {r("0.7e0 * (a / CAST(n AS DOUBLE)) + 0.3e0 * (1 - g / CAST(n AS DOUBLE))", 4)} END AS quality
FROM (SELECT doc_id, length(text) AS n, length(trim(text)) AS size, len(regexp_extract_all(text, '[^ \\t\\r\\n]+')) AS w, len(regexp_extract_all(text, '[A-Za-z]')) AS a,
len(regexp_extract_all(text, '[^A-Za-z0-9 \\t\\r\\n.,;:''"()-]')) AS g FROM ({s("reports")})))""")
def text_quality(spark, d):
    return documents.text_quality(frame(spark, d, "reports"))


_identified = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, unnest(x) AS value, unnest(range(len(x))) AS place FROM (SELECT doc_id, regexp_extract_all(text, '{p}') AS x FROM ({s('reports')}))" for k, p in (documents.IDENTIFIERS | documents.ENTITIES).items())


@query(f"SELECT doc_id, kind, value FROM (SELECT doc_id, kind, value, min(place) AS place FROM ({_identified}) GROUP BY 1, 2, 3) QUALIFY row_number() OVER (PARTITION BY doc_id, kind ORDER BY place) <= 10")
def identifiers(spark, d):
    return documents.identifiers(frame(spark, d, "reports"))


@query(f"SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '{documents.FISCAL_YEAR}', 1))) AS fiscal_year FROM ({s('reports')})")
def fin_years(spark, d):
    return documents.fin_years(frame(spark, d, "reports"))


@query(f"""SELECT doc_id, left(x[1], 100) AS name FROM (SELECT doc_id, [y FOR y IN [regexp_replace(z, '^[ \t\r]+|[ \t\r]+$', '', 'g') FOR z IN string_split(text, chr(10))] IF y <> ''] AS x FROM ({s("reports")})) WHERE len(x) > 0""")
def probable_company(spark, d):
    return documents.probable_company(frame(spark, d, "reports"))


_FLAGS = ", ".join(f"CASE WHEN regexp_matches(low, '{p}') THEN '{k}' END" for k, p in documents.RED_FLAGS.items())


@query(f"""SELECT doc_id, flags, CASE WHEN regexp_matches(flags, 'Wilful|Insolvency|Fraud|NPA|Going concern') THEN 'HIGH' WHEN regexp_matches(flags, '(^|,)(LEGAL|CREDIT|AUDIT)') THEN 'MEDIUM' ELSE 'LOW' END AS severity
FROM (SELECT doc_id, concat_ws(',', {_FLAGS}) AS flags FROM (SELECT doc_id, lower(text) AS low FROM ({s("reports")})))""")
def red_flags(spark, d):
    return documents.red_flags(frame(spark, d, "reports"))


@query(f"SELECT company_id, least(sum({' + '.join(f'CASE WHEN {CONTAINS("l", w)} THEN {x}e0 ELSE 0e0 END' for w, x in documents.VIOLATIONS)}), 10e0) AS violations FROM (SELECT company_id, lower(text) AS l FROM ({s('reports')})) GROUP BY 1")
def audit_violations(spark, d):
    return documents.audit_violations(frame(spark, d, "reports"))


_quoted = lambda w: "'" + w.replace("'", "''") + "'"
_word = lambda words: "CASE " + " ".join(f"WHEN contains(low, {_quoted(w)}) THEN {_quoted(w)}" for w in words) + " END"
_flagged = " UNION ALL ".join(f"SELECT company_id, doc_id, '{k}' AS flag, low, {_word(w)} AS word FROM (SELECT company_id, doc_id, lower(text) AS low FROM ({s('reports')})) WHERE {CONTAINS('low', w)}" for k, w in documents.AUDIT_FLAGS.items())
FLAGS = f"""(SELECT company_id, flag, CASE WHEN flag IN {documents.GOVERNANCE_FLAGS} THEN 'governance' ELSE 'audit' END AS kind, min(doc_id) AS first_doc, CASE WHEN flag IN {documents.SEVERE_FLAGS} THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
  arg_min({around("low", "word", 60, 60)}, doc_id) AS context FROM ({_flagged}) GROUP BY 1, 2)"""


@query(f"SELECT * FROM {FLAGS}")
def doc_audit_flags(spark, d):
    return documents.doc_audit_flags(frame(spark, d, "reports"))


@query(f"SELECT company_id, CASE WHEN count(*) FILTER (kind = 'audit' AND severity = 'HIGH') > 0 THEN 'HIGH' WHEN count(*) FILTER (kind = 'audit') > 0 THEN 'MEDIUM' ELSE 'LOW' END AS doc_risk FROM {FLAGS} GROUP BY 1")
def doc_risk(spark, d):
    return documents.doc_risk(doc_audit_flags(spark, d))


_lines = "string_split(lower(text), chr(10))"
_pick = lambda names: "coalesce(" + ", ".join(number_after(_lines, n) for n in names) + ", NULL)"


@query(f"""SELECT company_id, {", ".join(f"arg_min({c}, doc_id) FILTER ({c} IS NOT NULL) AS {c}" for c in documents.RATIO_NAMES)}
FROM (SELECT company_id, doc_id, {", ".join(f"{_pick(names)} AS {c}" for c, names in documents.RATIO_NAMES.items())} FROM ({s("reports")})) GROUP BY 1""")
def text_ratios(spark, d):
    return documents.text_ratios(frame(spark, d, "reports"))


@query(f"SELECT company_id, metric, value AS median FROM (SELECT *, row_number() OVER (PARTITION BY company_id, metric ORDER BY value) AS i, count(*) OVER (PARTITION BY company_id, metric) AS n FROM ({s('fin_lines')})) WHERE i = n // 2 + 1")
def key_figures(spark, d):
    return documents.key_figures(frame(spark, d, "fin_lines"))


# ---- research ---------------------------------------------------------------------------


def _articles(spark, d):
    return research.sentiment(frame(spark, d, "articles"))


@query(f"SELECT ordinal, company_id, sentiment, has_litigation_signal FROM {ARTICLES}")
def sentiment(spark, d):
    return _articles(spark, d).select("ordinal", "company_id", "sentiment", "has_litigation_signal")


@query(f"SELECT company_id, url, ordinal, sentiment, CAST(rank AS INT) AS rank FROM {KEPT}")
def news_dedup_topk(spark, d):
    return research.news_dedup_topk(_articles(spark, d)).select("company_id", "url", "ordinal", "sentiment", "rank")


@query(f"SELECT company_id, {r('''(1 - greatest(-1e0, least(1e0, (count(*) FILTER (sentiment = 'POSITIVE') - 1.5e0 * count(*) FILTER (sentiment = 'NEGATIVE')) / count(*)))) / 2''', 4)} AS news_risk, count(*) AS articles FROM {KEPT} GROUP BY 1")
def news_score(spark, d):
    return research.news_score(research.news_dedup_topk(_articles(spark, d)))


def _cases(spark, d):
    reports = frame(spark, d, "named_reports")
    typed = reports.join(documents.doc_type(reports).select("doc_id", "doc_type"), "doc_id")
    return research.cases_union(research.legal_cases(typed), research.news_cases(_articles(spark, d)))


@query(f"SELECT company_id, feed, ordinal, summary, severity FROM {CASES}")
def cases_union(spark, d):
    return _cases(spark, d)


_weight = "CASE severity " + " ".join(f"WHEN '{k}' THEN {w}" for k, (_, w) in research.SEVERITY.items()) + " END"


@query(f"SELECT doc_id, {SEVERITY.replace('summary', 'text')} AS severity FROM ({s('reports')})")
def case_severity(spark, d):
    return frame(spark, d, "reports").select("doc_id", research.case_severity(F.col("text")).alias("severity"))


@query(f"SELECT company_id, cases, high, {r('least(w / 5, 1e0)', 4)} AS severity_score, {r('least(cases / 20e0, 1e0)', 4)} AS risk, concat_ws(',', CASE WHEN high > 0 THEN 'SIGNIFICANT_LITIGATION' END, CASE WHEN cases > 15 THEN 'LITIGATION_COUNT_HIGH' END) AS flags FROM (SELECT company_id, CAST(sum(CAST({_weight} AS DECIMAL(10, 2))) AS DOUBLE) AS w, count(*) AS cases, count(*) FILTER (severity IN ('CRITICAL', 'HIGH')) AS high FROM {CASES} GROUP BY 1)")
def litigation_score(spark, d):
    return research.litigation_score(_cases(spark, d))


DIRECTORS = f"(SELECT director, count(DISTINCT company_id) AS companies, list_sort(list(DISTINCT company_id)) AS company_ids FROM ({s('directors')}) GROUP BY 1 HAVING count(DISTINCT company_id) >= 3)"


@query(f"SELECT director, companies, array_to_string(company_ids, ',') AS company_ids FROM {DIRECTORS}")
def multi_company_directors(spark, d):
    found = research.multi_company_directors(frame(spark, d, "directors"))
    return found.withColumn("company_ids", F.array_join(F.col("company_ids").cast("array<string>"), ","))


@query(f"SELECT company_id, {r('least(0.2e0 * count(*), 0.6e0)', 2)} AS shell_network_score FROM (SELECT DISTINCT director, company_id FROM ({s('directors')})) JOIN {DIRECTORS} USING (director) GROUP BY 1")
def shell_network_score(spark, d):
    directors = frame(spark, d, "directors")
    return research.shell_network_score(directors, research.multi_company_directors(directors))


@query(f"""WITH e AS (SELECT DISTINCT director AS a, concat('C', company_id) AS b FROM ({s("directors")})), g AS (SELECT node, count(*) AS degree FROM (SELECT a AS node FROM e UNION ALL SELECT b FROM e) GROUP BY 1)
SELECT node, degree, {r("degree / CAST(greatest((SELECT count(*) FROM g) - 1, 1) AS DOUBLE)", 6)} AS centrality FROM g""")
def degree_centrality(spark, d):
    return research.degree_centrality(frame(spark, d, "directors").select(F.col("director").alias("a"), F.concat(F.lit("C"), F.col("company_id")).alias("b")))


"""Registered queries of statement tables and narrations, with the same results told in ANSI SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lendscope.functions import numbers
from lendscope.functions.rounding import half_up_sql as r
from lendscope.operators import decision, statements
from lendscope.plans.inputs import frame
from lendscope.plans.inputs import sql as s
from lendscope.plans import filing_queries  # noqa: F401  registers what these queries build on
from lendscope.plans.figures import FIGURES, FIN
from lendscope.stages import shared_place
from lendscope.plans.queries import _NAME, HITS, ORACLE_SQL, QUERIES, _amount_sql, _fin, query

quoted = lambda p: p.replace("'", "''")


def _accounting(column: str) -> str:
    a = _amount_sql(numbers.AMOUNT)
    return f"CASE WHEN regexp_matches(raw, '^\\s*\\(.+\\)\\s*$') THEN -abs({a}) ELSE {a} END".replace("raw", column)


TABLES = f"""(SELECT table_id, company_id, row_no, cells, headers FROM (SELECT *, row_number() OVER w AS n, first([CASE WHEN cells[i + 1] = '' THEN 'col_' || i ELSE cells[i + 1] END FOR i IN range(len(cells))]) OVER w AS headers
  FROM (SELECT table_id, company_id, row_no, [trim(c) FOR c IN cells] AS cells FROM ({s("raw_tables")})) WINDOW w AS (PARTITION BY table_id ORDER BY row_no)) WHERE n > 1 AND len([c FOR c IN cells IF c <> '']) > 0)"""
CELLS = f"""(SELECT table_id, company_id, row_no, cells[1] AS label, i, cells[i + 1] AS cell, headers, coalesce(headers[i + 1], 'col_' || i) AS period
  FROM (SELECT *, unnest(range(len(cells))) AS i FROM {TABLES}))"""


def _tables(spark, d):
    return statements.clean_tables(frame(spark, d, "raw_tables"))


@query(f"SELECT table_id, row_no, i, period AS header, cell FROM {CELLS}")
def src_tables(spark, d):
    cells = _tables(spark, d).select("table_id", "row_no", "headers", F.posexplode("cells").alias("i", "cell"))
    return cells.select("table_id", "row_no", F.col("i").cast("long").alias("i"), F.coalesce(F.get("headers", F.col("i")), F.concat(F.lit("col_"), F.col("i"))).alias("header"), "cell")


_noted = f"SELECT table_id, row_no, list_concat(cells, ['note \"' || row_no || '\"' || chr(10) || 'of; ' || table_id]) AS cells FROM ({s('raw_tables')})"


@query(f"""SELECT table_id, row_no, len(cells) AS width, array_to_string([trim(c) FOR c IN cells], '|') AS line FROM ({_noted})""")
def src_files(spark, d):
    """The raw tables as files of quoted cells, with a note of two lines, and read back; a file holds lines of many tables."""
    note = F.concat(F.lit('note "'), "row_no", F.lit('"\nof; '), "table_id")
    cells = frame(spark, d, "raw_tables").select("table_id", "row_no", F.array_append("cells", note).alias("cells"))
    quoted = F.transform("cells", lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"')))
    place = shared_place(spark)
    cells.select(F.concat_ws(";", F.col("table_id").cast("string"), F.col("row_no").cast("string"), quoted)).write.text(place)
    rows = statements.read_tables(spark, place, ";").select("cells", F.slice("cells", F.lit(3), F.size("cells")).alias("own"))
    return rows.select(
        F.col("cells")[0].cast("long").alias("table_id"), F.col("cells")[1].cast("int").alias("row_no"), F.size("own").cast("long").alias("width"), F.array_join("own", "|").alias("line")
    )


_scale = "CASE " + " ".join(f"WHEN regexp_matches(t, '{quoted(p)}') THEN {x:.0f}e0" for p, x in statements.SCALES) + " ELSE 1e0 END"
SCALE = f"""(SELECT table_id, {_scale} AS scale FROM (SELECT table_id, lower(string_agg(t, ' ' ORDER BY n)) AS t FROM (
  SELECT table_id, CASE WHEN n = 1 THEN array_to_string(headers, ' ') || ' ' ELSE '' END || array_to_string(cells, ' ') AS t, n
  FROM (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY row_no) AS n FROM {TABLES}) WHERE n <= 2) GROUP BY 1))"""


@query(f"SELECT * FROM {SCALE}")
def table_scale(spark, d):
    return statements.table_scale(_tables(spark, d))


_size = lambda names: "greatest(" + ", ".join(f"CASE WHEN contains(low, '{n}') THEN {len(n)} ELSE 0 END" for n in [*names, names[0]]) + ")"
_metrics = ", ".join(f"{{'n': {_size(names)}, 'o': {-i}, 'm': '{m}'}}" for i, (m, names) in enumerate(statements.METRICS.items()))
LABELS = f"""(SELECT label, CASE WHEN b.n > 0 AND NOT regexp_matches(low, '{statements.NOT_METRIC}') THEN b.m END AS metric
  FROM (SELECT label, low, list_max([{_metrics}]) AS b FROM (SELECT DISTINCT label, lower(trim(label)) AS low FROM {CELLS})))"""


@query(f"SELECT label, metric FROM {LABELS}")
def canonical_metric(spark, d):
    labels = _tables(spark, d).select(F.col("cells")[0].alias("label")).distinct()
    return labels.select("label", statements.canonical_metric(F.col("label")).alias("metric"))


LINES = f"""(SELECT table_id, company_id, metric, period, value FROM (SELECT *, max(row_no) OVER (PARTITION BY table_id, metric) AS last FROM (
  SELECT c.table_id, company_id, row_no, metric, period, ({_accounting("cell")}) * CASE WHEN regexp_matches(cell, '{statements.CELL_UNIT}') THEN 1e0 ELSE scale END AS value
  FROM {CELLS} c JOIN {LABELS} USING (label) JOIN {SCALE} USING (table_id) WHERE i > 0 AND metric IS NOT NULL) WHERE value IS NOT NULL) WHERE row_no = last)"""


@query(f"SELECT * FROM {LINES}")
def fin_lines(spark, d):
    return statements.statement_lines(_tables(spark, d))


@query(f"SELECT * FROM (SELECT table_id, row_no, label, period, {_accounting('cell')} AS value FROM {CELLS} WHERE i > 0) WHERE value IS NOT NULL")
def table_figures(spark, d):
    return statements.table_figures(_tables(spark, d))


BANK = f"(SELECT * FROM {TABLES} WHERE {HITS('lower(array_to_string(headers, chr(32)))', statements.BANK_WORDS)} >= 3)"


@query(f"SELECT table_id, count(*) AS lines FROM {BANK} GROUP BY 1")
def bank_tables(spark, d):
    return statements.bank_tables(_tables(spark, d)).groupBy("table_id").agg(F.count(F.lit(1)).alias("lines"))


ROWS = f"""(SELECT company_id, table_id, row_no, txn_date, narration, coalesce(debit, credit) AS amount, CASE WHEN debit IS NOT NULL THEN 'debit' ELSE 'credit' END AS direction
  FROM (SELECT company_id, table_id, row_no, cells[1] AS txn_date, cells[2] AS narration, CASE WHEN d > 0 THEN d END AS debit, CASE WHEN c > 0 THEN c END AS credit
    FROM (SELECT *, {_accounting("cells[3]")} AS d, {_accounting("cells[4]")} AS c FROM {BANK})) WHERE debit IS NOT NULL OR credit IS NOT NULL)"""


@query(f"SELECT * FROM {ROWS}")
def txn_rows(spark, d):
    return statements.txn_rows(statements.bank_tables(_tables(spark, d)))


_all = lambda p, i: f"regexp_extract_all(text, '{p}', {i})"
_found = lambda p, side: f"SELECT company_id, doc_id, unnest(range(len({_all(p, 1)}))) AS place, unnest({_all(p, 1)}) AS txn_date, trim(unnest({_all(p, 2)})) AS narration, TRY_CAST(replace(unnest({_all(p, 3)}), ',', '') AS DOUBLE) AS amount, {side} AS direction FROM ({s('statement_texts')})"
SIDED = f"(SELECT * REPLACE (CASE WHEN lower(direction) = 'dr' THEN 'debit' ELSE 'credit' END AS direction) FROM ({_found(statements.LINE_SIDED, 'unnest(' + _all(statements.LINE_SIDED, 4) + ')')}) WHERE amount > 0)"
_balance = f"({_found(statements.LINE_PLAIN, 'TRY_CAST(replace(unnest(' + _all(statements.LINE_PLAIN, 4) + '), chr(44), chr(32)) AS VARCHAR)')})"
PLAIN = f"""(SELECT * REPLACE (CASE WHEN b > lag(b) OVER (PARTITION BY doc_id ORDER BY place) THEN 'credit' ELSE 'debit' END AS direction) FROM (
  SELECT *, TRY_CAST(replace(direction, ' ', '') AS DOUBLE) AS b FROM {_balance}))"""
TEXTS = f"""(SELECT company_id, doc_id, txn_date, narration, amount, direction FROM (SELECT company_id, doc_id, place, txn_date, narration, amount, direction FROM {SIDED} UNION ALL SELECT company_id, doc_id, place, txn_date, narration, amount, direction FROM {PLAIN} WHERE amount > 0 AND doc_id NOT IN (SELECT doc_id FROM {SIDED}))
  QUALIFY row_number() OVER (PARTITION BY doc_id, txn_date, left(narration, 20), direction ORDER BY place) = 1)"""


@query(f"SELECT * FROM {TEXTS}")
def txn_text(spark, d):
    return statements.txn_text(frame(spark, d, "statement_texts"))


_part = lambda p: f"regexp_extract(narration, '{p}', 1)"
_clean = lambda p: f"CASE WHEN length({_NAME(_part(p))}) >= 3 THEN {_NAME(_part(p))} END"
ENTITY = f"coalesce({', '.join(map(_clean, statements.NARRATIONS))}, 'ACCT_' || nullif({_part(statements.ACCOUNT)}, ''), 'BANK_' || nullif({_part(statements.BANK_CODE)}, ''), {_clean(statements.CAPITALS)}, 'UNKNOWN')"
_ends = "CASE WHEN direction = 'debit' THEN 'SELF' ELSE entity END AS src, CASE WHEN direction = 'debit' THEN entity ELSE 'SELF' END AS dst"


@query(f"SELECT txn_id, {_ends} FROM (SELECT *, {ENTITY} AS entity FROM ({s('narrations')}))")
def txn_entities(spark, d):
    return statements.txn_entities(frame(spark, d, "narrations")).select("txn_id", "src", "dst")


_both = f"SELECT company_id, 'table' AS source, txn_date, narration, amount, direction FROM {ROWS} UNION ALL SELECT company_id, 'text', txn_date, narration, amount, direction FROM {TEXTS}"


@query(f"SELECT company_id, source, txn_date, narration, amount, direction, {_ends} FROM (SELECT *, {ENTITY} AS entity FROM ({_both}))")
def txns(spark, d):
    return statements.txns(frame(spark, d, "raw_tables"), frame(spark, d, "statement_texts"))


AMOUNTS = f"(SELECT id, {_amount_sql(numbers.AMOUNT)} AS value FROM ({s('amounts')}))"


@query(f"SELECT * FROM {AMOUNTS} WHERE value >= 1000 AND NOT (floor(value) BETWEEN 2000 AND 2029)")
def filter_amounts(spark, d):
    return statements.filter_amounts(frame(spark, d, "amounts").select("id", numbers.parse_amount(F.col("raw")).alias("value")))


@query(f"SELECT id, CAST(left(CAST(CAST(floor(value) AS BIGINT) AS VARCHAR), 1) AS INT) AS digit FROM {AMOUNTS} WHERE value >= 1")
def first_digit(spark, d):
    rows = frame(spark, d, "amounts").select("id", numbers.parse_amount(F.col("raw")).alias("value"))
    return rows.select("id", numbers.first_digit(F.col("value")).alias("digit")).where("digit IS NOT NULL")


_names = "(SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'www.' || p_name WHEN 1 THEN p_name || '!' ELSE p_name END AS name FROM part)"


@query(f"SELECT id, coalesce(NOT regexp_matches(name, '{numbers.NOISE_NAME}') AND regexp_matches(name, '{quoted(numbers.VALID_NAME)}'), false) AS valid FROM {_names}")
def valid_entity(spark, d):
    rows = frame(spark, d, "part").selectExpr("p_partkey AS id", "CASE p_partkey % 4 WHEN 0 THEN 'www.' || p_name WHEN 1 THEN p_name || '!' ELSE p_name END AS name")
    return rows.select("id", F.coalesce(numbers.valid_entity(F.col("name")), F.lit(False)).alias("valid"))


#: A bank statement's declared total, then figures, then text, by document; of filings.
_first = lambda rows: f"(SELECT company_id, arg_min(value, doc_id) AS total FROM ({rows}) WHERE value > 1000 GROUP BY 1)"
_declared = "SELECT company_id, doc_id, value FROM ({}) JOIN (SELECT doc_id, company_id FROM filed) USING (doc_id) WHERE metric = '{}'"
_told_credits = "nullif(regexp_extract(text, '" + statements.CREDITS + "', 1), '')"
TOTALS = f"""(SELECT company_id, arg_min(total, place) AS total FROM (SELECT *, 0 AS place FROM {_first(_declared.format(ORACLE_SQL["doc_financials"], "total_credits"))} UNION ALL
  SELECT *, 1 FROM {_first(f"SELECT company_id, doc_id, value FROM {FIGURES} JOIN (SELECT doc_id FROM filed WHERE doc_type = 'bank_statement') USING (doc_id) WHERE has_unit AND metric IN ('revenue', 'gst_turnover')")} UNION ALL
  SELECT *, 2 FROM {_first(f"SELECT company_id, doc_id, {_accounting('t')} AS value FROM (SELECT company_id, doc_id, {_told_credits} AS t FROM filed WHERE doc_type = 'bank_statement')")}) GROUP BY 1)"""


@query(f"""WITH filed AS (SELECT * FROM ({s("filings")})) SELECT * FROM (SELECT company_id, CASE WHEN summed > 1000 THEN summed ELSE total END AS credits FROM (SELECT company_id, CAST(CAST(sum(CAST(v AS DECIMAL(18, 2))) AS DECIMAL(20, 2)) AS DOUBLE) AS summed
FROM (SELECT company_id, {_accounting("cells[4]")} AS v FROM {BANK}) WHERE v >= 100 GROUP BY 1) FULL JOIN {TOTALS} USING (company_id)) WHERE credits IS NOT NULL""")
def bank_credits(spark, d):
    filed = frame(spark, d, "filings")
    owner = filed.select("doc_id", "company_id")
    declared = QUERIES["doc_financials"](spark, d).where("metric = 'total_credits'").join(owner, "doc_id")
    banks = filed.where("doc_type = 'bank_statement'")
    figures = QUERIES["figures"](spark, d).where("has_unit AND metric IN ('revenue', 'gst_turnover')").join(banks.select("doc_id", "company_id"), "doc_id")
    totals = [statements.first_told(x, 1000) for x in (declared, figures, statements.told_credits(banks))]
    return statements.bank_credits(statements.bank_tables(_tables(spark, d)), *totals)


_told = r"nullif(regexp_extract(text, '(?i)(?:aggregate turnover|outward supplies|total taxable value)[^\n0-9]{0,80}([0-9][0-9,.]*(?: *(?:cr|crores?|lakhs?|l)\b)?)', 1), '')"


@query(f"""WITH filed AS (SELECT * FROM ({s("filings")})) SELECT company_id, coalesce(a, total, b) AS turnover FROM (SELECT company_id, max(value) AS a FROM {LINES} WHERE metric IN ('gst_turnover', 'revenue') GROUP BY 1)
FULL JOIN (SELECT company_id, arg_min(v, doc_id) AS b FROM (SELECT company_id, doc_id, {_accounting("t")} AS v FROM (SELECT company_id, doc_id, {_told} AS t FROM ({s("statement_texts")}))) WHERE v IS NOT NULL GROUP BY 1) USING (company_id)
FULL JOIN {_first(_declared.format(ORACLE_SQL["doc_financials"], "gst_turnover")).replace("> 1000", "> 0")} USING (company_id)""")
def gst_turnover(spark, d):
    told = QUERIES["doc_financials"](spark, d).where("metric = 'gst_turnover'").join(frame(spark, d, "filings").select("doc_id", "company_id"), "doc_id")
    return statements.gst_turnover(fin_lines(spark, d), frame(spark, d, "statement_texts"), told)


@query(f"""SELECT company_id, {r("CASE WHEN n < 2 THEN 0.2e0 WHEN mean = 0 THEN 0.5e0 ELSE sd / abs(mean) END", 4)} AS cfo_volatility
FROM (SELECT company_id, stddev_samp(value) AS sd, avg(value) AS mean, count(value) AS n FROM ({s("fin_lines")}) WHERE metric = 'cfo' GROUP BY 1)""")
def cfo_volatility(spark, d):
    return decision.cfo_volatility(frame(spark, d, "fin_lines"))


_days = lambda a, b: f"CASE WHEN {a} > 0 AND {b} > 0 THEN {r(f'{a} / {b} * 365', 1)} ELSE 0e0 END"


@query(f"SELECT company_id, {_days('receivables', 'revenue')} AS debtor_days, {_days('inventories', 'coalesce(nullif(cogs, 0), revenue)')} AS inventory_days, CASE WHEN revenue > 0 THEN {r('(coalesce(current_assets, 0) - coalesce(current_liabilities, 0)) / revenue * 365', 1)} ELSE 90e0 END AS working_capital_days FROM {FIN}")
def days(spark, d):
    return decision.days(_fin(spark, d))

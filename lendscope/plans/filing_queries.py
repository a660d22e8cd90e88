"""Registered queries of filed documents and of graph marks, with the same results told in ANSI SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lendscope.functions.lexicon import read_lexicon
from lendscope.functions.rounding import half_up_sql as r
from lendscope.operators import documents, filings, graph
from lendscope.plans.figures import FIGURES, FILINGS, around, number_after, percent_after, times
from lendscope.plans.inputs import frame, sql
from lendscope.plans.queries import CONTAINS, CYCLES, MANY, VALUES, edges, query
from lendscope.stages import whole

_all = lambda p, i, t="text": f"regexp_extract_all({t}, '{p}', {i})"
_one = lambda p, i=1: f"regexp_extract(text, '{p}', {i})"
_times = times
_docs = lambda spark, d: frame(spark, d, "filings")

_marked = f"array_to_string([CASE WHEN length(trim(x)) BETWEEN 4 AND 120 AND regexp_matches(trim(x), '{filings.HEADING}') THEN chr(2) || chr(1) || trim(x) ELSE x END FOR x IN string_split(text, chr(10))], chr(10))"
_joined = rf"regexp_replace({_marked}, '(\x01[^\n]*)\n(?:[ \t\r]*\n)+', '\1' || chr(10), 'g')"
_split = rf"[b FOR b IN regexp_split_to_array({_joined}, '\x02|\n[ \t\r]*\n(?:[ \t\r]*\n)+') IF regexp_replace(b, '[ \t\r\n]', '', 'g') <> '']"
BLOCKS = f"""(SELECT doc_id, block_no, CASE WHEN starts_with(block, chr(1)) THEN split_part(substr(block, 2), chr(10), 1) ELSE '' END AS heading, replace(block, chr(1), '') AS text
  FROM (SELECT doc_id, unnest(x) AS block, CAST(unnest(range(len(x))) AS INT) AS block_no FROM (SELECT doc_id, {_split} AS x FROM {FILINGS})))"""


@query(f"SELECT * FROM {BLOCKS}")
def segment_blocks(spark, d):
    return filings.segment_blocks(_docs(spark, d)).drop("doc_type")


_kinds = " UNION ALL ".join(f"SELECT doc_id, block_no, '{k}' AS kind, unnest(x) AS value, unnest(range(len(x))) AS place FROM (SELECT doc_id, block_no, regexp_extract_all(text, '{p}') AS x FROM {BLOCKS})" for k, p in (documents.IDENTIFIERS | documents.ENTITIES).items())
IDENTIFIED = f"""(SELECT doc_id, company_id, block_no, kind, value, place FROM (SELECT doc_id, block_no, kind, value, min(place) AS place FROM ({_kinds}) GROUP BY 1, 2, 3, 4
  QUALIFY row_number() OVER (PARTITION BY doc_id, block_no, kind ORDER BY min(place)) <= 10) JOIN (SELECT doc_id, company_id FROM {FILINGS}) USING (doc_id))"""
_merged = lambda scope: f"""SELECT {scope}, kind, value, CAST(row_number() OVER (PARTITION BY {scope}, kind ORDER BY seen) AS INT) AS rank
FROM (SELECT {scope}, kind, value, min([doc_id, block_no, place]) AS seen FROM {IDENTIFIED} GROUP BY 1, 2, 3)"""  # noqa: E731


def _identified(spark, d):
    docs = _docs(spark, d)
    return documents.section_identifiers(filings.segment_blocks(docs)).join(docs.select("doc_id", "company_id"), "doc_id")


@query(_merged("doc_id"))
def document_identifiers(spark, d):
    """Of a document's sections, ten of a kind a section, in the order in which they are first seen."""
    return documents.merged_identifiers(_identified(spark, d), "doc_id")


@query(_merged("company_id"))
def company_identifiers(spark, d):
    """The same over all documents of a company."""
    return documents.merged_identifiers(_identified(spark, d), "company_id")


_head = "CASE " + " ".join(f"WHEN regexp_matches(left(low, 300), '{p}') THEN '{k}'" for p, k in filings.HEADERS) + " END"
_lexicon = VALUES([(t, s, i, p) for i, (t, s, p) in enumerate(read_lexicon("sections"))])


def classified(docs: str) -> str:
    """Sections of blocks of docs (doc_id, text, doc_type), by a join with the lexicon."""
    return f"""(WITH x AS (SELECT b.doc_id, block_no, b.text, doc_type, lower(b.text) AS low FROM {BLOCKS.replace(FILINGS, docs)} b JOIN {docs} t ON t.doc_id = b.doc_id),
  n AS (SELECT doc_id, block_no, section, count(*) AS n, min(o) AS o FROM x JOIN {_lexicon} l(kind, section, o, phrase) ON kind = doc_type AND contains(low, phrase) GROUP BY 1, 2, 3),
  b AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY doc_id, block_no ORDER BY n DESC, o) = 1)
  SELECT doc_id, block_no, text, CASE WHEN n > 0 THEN section ELSE coalesce(head, 'unclassified') END AS section,
    CASE WHEN n > 0 THEN least(0.5e0 + (n - 1) * 0.25e0, 0.95e0) WHEN head IS NOT NULL THEN 0.55e0 ELSE 0.15e0 END AS confidence
  FROM (SELECT *, {_head} AS head FROM x) LEFT JOIN b USING (doc_id, block_no))"""


CLASSIFIED = classified(FILINGS)


@query(f"SELECT doc_id, block_no, section, confidence FROM {classified('(' + sql('typed_filings') + ')')}")
def classify_sections(spark, d):
    """Documents of ten types, and of one that the lexicon lacks."""
    return filings.classify_sections(filings.segment_blocks(frame(spark, d, "typed_filings")))


AUDITED = f"""(SELECT f.doc_id, f.company_id, lower(coalesce(a.t, f.text)) AS low FROM {FILINGS} f
  LEFT JOIN (SELECT doc_id, string_agg(text, chr(10) ORDER BY block_no) AS t FROM {CLASSIFIED} WHERE section = 'auditors_report' GROUP BY 1) a USING (doc_id))"""
REMARKS = "(" + " UNION ALL ".join(f"SELECT doc_id, company_id, '{t}' AS type, {w}e0 AS weight, {around('low', f'regexp_extract(low, {chr(39)}{p}{chr(39)})', 80, 120)} AS context FROM {AUDITED} WHERE regexp_matches(low, '{p}')" for p, t, w in filings.REMARKS) + ")"


@query(f"SELECT * FROM {REMARKS}")
def audit_remarks(spark, d):
    """Of the auditor's sections where a document has them."""
    docs = _docs(spark, d)
    blocks = filings.segment_blocks(docs)
    return filings.audit_remarks(filings.audit_texts(docs, blocks, filings.classify_sections(blocks)))


@query(f"SELECT company_id, {r('least(CAST(sum(CAST(weight AS DECIMAL(6, 2))) AS DOUBLE), 1e0)', 4)} AS audit_score FROM {REMARKS} GROUP BY 1")
def audit_remark_score(spark, d):
    return filings.audit_remark_score(audit_remarks(spark, d))


@query(f"""SELECT company_id, least(sum(30 * CAST({CONTAINS("t", ["cheque return", "dishonor", "insufficient funds"])} AS INT) + 20 * CAST({CONTAINS("t", ["ecs return", "nach return"])} AS INT)
+ 20 * CAST(len(regexp_extract_all(t, 'cash withdrawal')) > 20 AS INT) + 15 * CAST(contains(t, 'end of day balance') AND contains(t, '0.00') AS INT)), 100) / 100e0 AS bank_anomaly
FROM (SELECT company_id, lower(text) AS t FROM {FILINGS} WHERE doc_type = 'bank_statement') GROUP BY 1""")
def bank_anomaly(spark, d):
    return filings.bank_anomaly(_docs(spark, d).where("doc_type = 'bank_statement'"))


@query(f"SELECT doc_id, type, label, metric, value, has_unit, context FROM {FIGURES}")
def figures(spark, d):
    return filings.figures(_docs(spark, d))


_financial = " UNION ALL ".join(f"SELECT doc_id, '{m}' AS metric, TRY_CAST(replace({_one(f'(?i)(?:{w}){filings._AMOUNT}')}, ',', '') AS DOUBLE) * {_times(_one(f'(?i)(?:{w}){filings._AMOUNT}', 2))} AS value FROM {FILINGS} WHERE doc_type = '{k}'" for k, m, w in filings.FINANCIALS)


@query(f"SELECT * FROM ({_financial}) WHERE value > 0")
def doc_financials(spark, d):
    return filings.doc_financials(_docs(spark, d))


_number = lambda p: f"TRY_CAST(nullif({_one(p)}, '') AS DOUBLE)"


@query(f"SELECT * FROM (SELECT doc_id, nullif({_one(filings.ASSESSMENT_YEAR)}, '') AS assessment_year FROM {FILINGS} WHERE doc_type = 'itr') WHERE assessment_year IS NOT NULL")
def assessment_years(spark, d):
    return filings.assessment_years(_docs(spark, d))


_lines = "string_split(lower(text), chr(10))"
_sentences = f"[z FOR z IN string_split(lower(text), '.') IF regexp_matches(z, '{filings.CUSTOMERS}')]"
_used = "coalesce(" + ", ".join(percent_after(_lines, n) for n in filings.CAPACITY_NAMES) + ")"


@query(rf"""SELECT doc_id AS company_id, coalesce(CASE WHEN debt_crore > 0 THEN {r(number_after(_lines, "collateral") + " / debt_crore", 3)} END, 1.3e0) AS collateral_coverage,
coalesce({r(_used + " / 100", 4)}, CASE WHEN {CONTAINS("lower(text)", ["low capacity", "idle"])} THEN 0.35e0 WHEN {CONTAINS("lower(text)", ["full capacity", "running well"])} THEN 0.9e0 ELSE 0.7e0 END) AS capacity_utilization,
coalesce({r(percent_after(_sentences, "customer") + " / 100", 4)}, 0.4e0) AS customer_concentration FROM {FILINGS}""")
def notes_signals(spark, d):
    """Each document stands for the notes of the company with its number."""
    return filings.notes_signals(_docs(spark, d).select(F.col("doc_id").alias("company_id"), "text", "debt_crore"))


@query(rf"""SELECT company_id, name, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY doc_id, place) AS rank FROM (
SELECT company_id, doc_id, place, regexp_replace(name, ' +', ' ', 'g') AS name FROM (SELECT company_id, doc_id, unnest(x) AS name, unnest(range(len(x))) AS place FROM (SELECT company_id, doc_id, {_all(filings.PROMOTER, 1)} AS x FROM {FILINGS}))
QUALIFY row_number() OVER (PARTITION BY company_id, regexp_replace(name, ' +', ' ', 'g') ORDER BY doc_id, place) = 1)) WHERE rank <= 5""")
def promoters(spark, d):
    return filings.promoters(_docs(spark, d))


@query(f"""SELECT company_id, name, min(din) AS din FROM (SELECT company_id, regexp_replace(n[i + 1], ' +', ' ', 'g') AS name, d[i + 1] AS din FROM (SELECT company_id, n, d, unnest(range(least(len(n), 10))) AS i
FROM (SELECT company_id, {_all(filings.HONORED, 1)} AS n, {_all(filings.DIN, 1)} AS d FROM {FILINGS}))) GROUP BY 1, 2""")
def mca_directors(spark, d):
    return filings.mca_directors(_docs(spark, d))


@query(f"SELECT DISTINCT company_id, doc_id, TRY_CAST(replace(a, ',', '') AS DOUBLE) AS amount, trim(l) AS lender FROM (SELECT company_id, doc_id, unnest({_all(filings.CHARGE, 1)}) AS a, unnest({_all(filings.CHARGE, 2)}) AS l FROM {FILINGS})")
def mca_charges(spark, d):
    return filings.mca_charges(_docs(spark, d))


@query(f"""SELECT company_id, arg_min(c, doc_id) FILTER (c IS NOT NULL) AS cin, CASE WHEN bool_or(contains(lower(text), 'struck off')) THEN 'STRUCK_OFF' WHEN bool_or(contains(lower(text), 'active')) THEN 'ACTIVE' ELSE 'UNKNOWN' END AS status
FROM (SELECT company_id, doc_id, text, nullif({_one(filings.CIN, 0)}, '') AS c FROM {FILINGS}) GROUP BY 1""")
def mca_extract(spark, d):
    return filings.mca_status(_docs(spark, d))


_tidy = lambda x: f"trim(regexp_replace({x}, ' +', ' ', 'g'))"
_up = lambda k, p, f: f"SELECT company_id, '{k}' AS kind, {f('unnest(' + _all(p, 1, 'upper(text)') + ')')} AS name FROM {FILINGS}"


@query(f"""SELECT DISTINCT * FROM ({_up("company", filings.COMPANY, lambda x: _tidy(f"regexp_replace({x}, '{filings.LEGAL_FORM}', ' ', 'g')"))} UNION ALL {_up("director", filings.DIRECTOR, _tidy)}
UNION ALL {_up("address", filings.ADDRESS, lambda x: f"left({_tidy(f'regexp_replace({x}, {chr(39)}[ ,.-]+${chr(39)}, {chr(39)}{chr(39)})')}, 60)")}) WHERE length(name) > 4""")
def doc_company_names(spark, d):
    return filings.doc_company_names(_docs(spark, d))


_shells = "(SELECT DISTINCT 0 AS company_id, concat('A', o_orderkey) AS entity FROM orders WHERE o_orderpriority LIKE '1%')"


@query(f"""WITH e AS {MANY}, n AS (SELECT company_id, node, CAST(sum(txn_count) AS BIGINT) AS txns FROM (SELECT company_id, src AS node, txn_count FROM e UNION ALL SELECT company_id, dst, txn_count FROM e) GROUP BY 1, 2),
m AS (SELECT n.*, node IN (SELECT unnest(string_split(path, '>')) FROM {CYCLES}) AS in_cycle, node IN (SELECT entity FROM {_shells}) AS is_shell FROM n) SELECT *, in_cycle OR is_shell AS suspicious FROM m""")
@whole
def txn_graph_marks(spark, d):
    e = edges(spark, d, "graph_txns")
    shells = frame(spark, d, "orders").where("o_orderpriority LIKE '1%'").selectExpr("0 AS company_id", "concat('A', o_orderkey) AS entity")
    return graph.node_marks(e, graph.cycles(e), shells)


@query(f"""WITH e AS {MANY}, c AS (SELECT string_split(path, '>') AS p FROM {CYCLES}), s AS (SELECT DISTINCT p[i + 1] AS a, p[(i + 1) % len(p) + 1] AS b FROM (SELECT p, unnest(range(len(p))) AS i FROM c))
SELECT e.company_id, e.src, e.dst, CASE WHEN s.a IS NOT NULL THEN 'cycle' WHEN b.src IS NOT NULL THEN 'layered' ELSE 'plain' END AS mark FROM e LEFT JOIN s ON e.src = s.a AND e.dst = s.b
LEFT JOIN e b ON b.company_id = e.company_id AND b.src = e.dst AND b.dst = e.src""")
@whole
def txn_graph_edge_marks(spark, d):
    e = edges(spark, d, "graph_txns")
    return graph.edge_marks(e, graph.cycles(e))

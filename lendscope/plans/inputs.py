"""Inputs of the operators, derived from the given tables by SQL that Spark and an ANSI engine read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from lendscope.functions.lexicon import read_lexicon
from lendscope.operators.statements import METRICS
from lendscope.stages import step

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: The 25 features, with the ranges that test rows take.
FEATURES = {
    "revenue_growth_3yr": (-0.1, 0.3), "ebitda_margin": (0.02, 0.35), "pat_margin": (-0.08, 0.2), "debt_to_equity": (0.1, 4.5),
    "current_ratio": (0.6, 2.6), "interest_coverage_ratio": (0.5, 6.0), "dscr": (0.7, 3.0), "working_capital_days": (20, 160),
    "debtor_days": (20, 140), "inventory_days": (10, 150), "cashflow_volatility": (0.05, 0.6), "gst_bank_mismatch_score": (0, 0.6),
    "gstr2a_3b_mismatch_score": (0, 0.5), "itr_revenue_mismatch_score": (0, 0.5), "circular_trading_score": (0, 0.9),
    "benford_deviation_score": (0, 0.8), "litigation_count": (0, 18), "litigation_severity_score": (0, 0.85),
    "news_sentiment_score": (0.1, 0.9), "promoter_network_risk": (0, 0.9), "sector_risk_score": (0.2, 0.8),
    "collateral_coverage_ratio": (0.8, 2.4), "capacity_utilization": (0.3, 0.95), "customer_concentration": (0.05, 0.7),
    "regulatory_violation_count": (0, 6),
}

#: Words that a credit file would hold; documents get some of them by their number.
_PHRASES = [
    "The auditors gave a qualified opinion and note going concern doubt.", "GSTIN 27ABCDE1234F1Z5, PAN ABCDE1234F, IFSC HDFC0001234.",
    "Cheque bounce under section 138, suit filed, NPA and overdue accounts.", "Revenue from operations of Rs. 1,250 Cr and EBITDA of Rs. 210 Cr.",
    "An award and strong growth, profit and a new contract.", "Insolvency before NCLT, CBI raid, fraud classification, downgrade.",
    "Emphasis of matter; unable to obtain sufficient audit evidence.", "Opening balance, closing balance, debit, credit, IFSC of the account statement.",
    "Steel plant with blast furnace; expansion and export orders.", "FY2022-23 and FY 2021-22; debt to equity ratio 2.4; current ratio: 1.1.",
    "Pledge of shares by the promoter; show cause notice; resignation of director.",
    "DRT No. 45/2021 and CS No 12-2020: plaintiff and defendant, wilful defaulter; interest coverage 1.3, DSCR: 0.95, debtor days 120. Mr. Ravi Kumar Rao of Acme Steel Private Limited, State Bank of India, 01-Apr-2023.",
]

_pick = "CASE doc_id % 13 " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(_PHRASES)) + " ELSE '' END"
_feature = lambda i, name, low, high: f"{low} + {round(high - low, 4)} * (((c_custkey * {7919 + 104 * i} + CAST(floor(abs(c_acctbal)) AS BIGINT) * {i + 3}) % 1000) / 1000.0e0) AS {name}"

#: Inputs that a run writes once: the payments with their orders, and sums of them.
STEPS = {"movements", "fin_lines", "bank_monthly", "gst_monthly", "itc", "directors", "turnover"}

INPUTS = {
    "movements": """
SELECT o_custkey, o_orderdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_returnflag, l_linestatus, l_extendedprice
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    "txns": """
SELECT o_custkey AS company_id, l_orderkey * 10 + l_linenumber AS txn_id, CAST(l_shipdate AS DATE) AS txn_date,
       CASE WHEN l_returnflag = 'R' THEN concat('S', l_suppkey) ELSE 'SELF' END AS src,
       CASE WHEN l_returnflag = 'R' THEN 'SELF' ELSE concat('S', l_suppkey) END AS dst,
       CASE WHEN l_returnflag = 'R' THEN 'credit' ELSE 'debit' END AS direction,
       CAST(l_extendedprice AS DECIMAL(18, 2)) AS amount
FROM {movements}""",
    "graph_txns": """
SELECT 0 AS company_id, l_orderkey * 10 + l_linenumber AS txn_id, CAST(l_shipdate AS DATE) AS txn_date,
       concat('A', l_orderkey) AS src, concat('A', (l_partkey * 31 + l_suppkey * 17) % (SELECT max(o_orderkey) FROM {orders})) AS dst, 'debit' AS direction,
       CAST(l_extendedprice AS DECIMAL(18, 2)) AS amount
FROM {lineitem}""",
    "narrations": """
SELECT l_orderkey * 10 + l_linenumber AS txn_id, o_custkey AS company_id, CASE WHEN l_returnflag = 'R' THEN 'credit' ELSE 'debit' END AS direction,
       CASE l_linenumber % 8
         WHEN 0 THEN concat('NEFT CR-HDFC0001234-', upper(s_name), ' TRADERS-REF', l_orderkey)
         WHEN 1 THEN concat('UPI/DR/', l_orderkey + 100000, '/', upper(s_name), '/PAY')
         WHEN 2 THEN concat('ACH DR ', upper(s_name), ' FINANCE LTD')
         WHEN 3 THEN concat('BY TRANSFER TO ', upper(s_name))
         WHEN 4 THEN concat('CHQ NO 00', l_orderkey, ' ', upper(s_name), ' INDUSTRIES')
         WHEN 5 THEN concat('cash withdrawal a/c ', 1000000000 + l_suppkey)
         WHEN 6 THEN concat('charges at ', 'ICIC0', 100000 + l_suppkey)
         ELSE 'misc entry' END AS narration,
       CAST(l_extendedprice AS DECIMAL(18, 2)) AS amount
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {supplier} ON l_suppkey = s_suppkey""",
    "amounts": """
SELECT l_orderkey * 10 + l_linenumber AS id, CASE l_linenumber % 3 WHEN 0 THEN 'lakh' ELSE '' END AS context_unit,
       CASE (l_orderkey + l_linenumber) % 9
         WHEN 0 THEN concat('Rs. ', n, ' Cr') WHEN 1 THEN concat('INR ', n, ' lakhs') WHEN 2 THEN concat('₹', n)
         WHEN 3 THEN concat('(', n, ')') WHEN 4 THEN concat('-', n, ' k') WHEN 5 THEN concat('sales of Rs ', n, ' crore in')
         WHEN 6 THEN concat('20', 10 + l_linenumber) WHEN 7 THEN concat('10 Ltd ', n) ELSE 'none' END AS raw
FROM (SELECT l_orderkey, l_linenumber, CAST(CAST(l_extendedprice AS DECIMAL(18, 2)) AS STRING) AS n FROM {lineitem}) t""",
    "features": "SELECT c_custkey AS company_id, " + ", ".join(_feature(i, n, *r) for i, (n, r) in enumerate(FEATURES.items())) + " FROM {customer}",
    "turnover": "SELECT o_custkey AS company_id, CAST(CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DECIMAL(18, 2)) AS DOUBLE) / 1e4 AS turnover_crore FROM {orders} GROUP BY o_custkey",
    "gst_monthly": "SELECT o_custkey AS company_id, month(o_orderdate) AS month, CAST(CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DECIMAL(18, 2)) AS DOUBLE) AS turnover FROM {orders} GROUP BY o_custkey, month(o_orderdate)",
    "bank_monthly": "SELECT o_custkey AS company_id, month(o_orderdate) AS month, CAST(CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DECIMAL(18, 2)) AS DOUBLE) AS credits FROM {movements} GROUP BY o_custkey, month(o_orderdate)",
    "itc": """
SELECT o_custkey AS company_id,
       CAST(CAST(sum(CASE WHEN l_linestatus = 'O' THEN CAST(l_extendedprice AS DECIMAL(18, 2)) ELSE 0 END) AS DECIMAL(18, 2)) AS DOUBLE) AS available,
       CAST(CAST(sum(CASE WHEN l_linestatus = 'F' THEN CAST(l_extendedprice AS DECIMAL(18, 2)) ELSE 0 END) AS DECIMAL(18, 2)) AS DOUBLE) AS claimed,
       CAST(CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2)) * 2) AS DECIMAL(18, 2)) AS DOUBLE) AS turnover
FROM {movements} GROUP BY o_custkey""",
    "income": """
SELECT o_custkey AS company_id, CASE o_orderstatus WHEN 'F' THEN 'itr' WHEN 'O' THEN 'annual_report' ELSE 'gst' END AS source,
       CAST(CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DECIMAL(18, 2)) AS DOUBLE) AS value
FROM {orders} GROUP BY 1, 2""",
    "fin_lines": f"""
SELECT o_custkey AS company_id, CASE (l_partkey + l_linenumber) % {len(METRICS) + 6} {" ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(METRICS))} ELSE 'revenue' END AS metric,
       year(o_orderdate) AS period, CAST(CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DECIMAL(18, 2)) AS DOUBLE) AS value
FROM {{movements}} GROUP BY 1, 2, 3""",
    "raw_lines": """
SELECT o_orderkey AS table_id, o_custkey AS company_id, 0 AS row_no, CASE o_orderkey % 4 WHEN 0 THEN 'Particulars (Rs in crore);;FY2023;FY2022'
  WHEN 1 THEN 'Particulars; ;FY2023;FY2022' WHEN 2 THEN 'Particulars in lakhs;Note;FY2023;FY2022' ELSE 'Date;Narration;Debit;Credit;Balance' END AS line FROM {orders}
UNION ALL
SELECT l_orderkey, o_custkey, l_linenumber, CASE WHEN l_linenumber = 5 THEN ' ; ; ; '
  WHEN l_orderkey % 4 = 3 THEN concat('01/02/2023; NEFT CR-HDFC0001234-', upper(s_name), '-REF;', CASE WHEN l_returnflag = 'R' THEN '-' ELSE n END, ';', CASE WHEN l_returnflag = 'R' THEN n ELSE '' END, ';1,000.00')
  ELSE concat(CASE l_partkey % 10 WHEN 0 THEN 'Revenue from operations' WHEN 1 THEN 'EBITDA' WHEN 2 THEN 'Finance cost' WHEN 3 THEN ' Profit after tax ' WHEN 4 THEN 'Trade receivables'
    WHEN 5 THEN '(a) Inventories' WHEN 6 THEN 'Long term borrowings' WHEN 7 THEN 'EBITDA margin' WHEN 8 THEN 'Aggregate turnover' ELSE 'Miscellany' END, ';', l_linenumber, ';',
    CASE l_partkey % 3 WHEN 0 THEN concat('(', n, ')') WHEN 1 THEN n ELSE concat(n, ' Cr') END, ';', CASE WHEN l_suppkey % 4 = 0 THEN '-' ELSE n END) END
FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, CAST(CAST(l_extendedprice AS DECIMAL(18, 2)) AS STRING) AS n FROM {lineitem}) l
  JOIN {orders} ON l_orderkey = o_orderkey JOIN {supplier} ON l_suppkey = s_suppkey""",
    "raw_tables": "SELECT table_id, company_id, row_no, split(line, ';') AS cells FROM {raw_lines}",
    "statement_texts": """
SELECT o_custkey AS company_id, o_orderkey AS doc_id, CASE o_orderkey % 3
  WHEN 0 THEN concat('01-Apr-2023 NEFT TO ', upper(c_name), ' ', n, ' Cr', chr(10), '02-Apr-2023  CHQ NO 12 ACME INDUSTRIES 1,200.50 Dr', chr(10), '02-Apr-2023  CHQ NO 12 ACME INDUSTRIES 1,300.50 Dr')
  WHEN 1 THEN concat('05/06/2023 BY TRANSFER TO ', upper(c_name), ' ', n, ' 9,000.00', chr(10), '7/6/23 cash at branch ', n, ' 100.00')
  ELSE concat('Aggregate turnover of the year: Rs. ', n, ' lakhs in all') END AS text
FROM (SELECT o_custkey, o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS STRING) AS n FROM {orders}) o JOIN {customer} ON o_custkey = c_custkey""",
    "filings": f"""
SELECT doc_id, doc_id % 97 AS company_id, CASE doc_id % 4 WHEN 0 THEN 'annual_report' WHEN 1 THEN 'gst' WHEN 2 THEN 'bank_statement' ELSE 'itr' END AS doc_type, 5.0e0 + doc_id % 50 AS debt_crore,
       concat('filing_', doc_id, '.pdf') AS file_name,
       concat('ANNUAL REPORT ', 2000 + doc_id % 24, chr(10), 'Corporate overview of ACME', doc_id % 31, ' STEEL PVT LTD, Industrial Estate Road Pune - 411001', chr(10), chr(10), chr(10), text, chr(10),
         '1.1 Balance Sheet', chr(10), chr(10), 'Revenue from operations: Rs. ', n_chars, ' Cr and EBITDA: 1', doc_id % 9, '.5 %', chr(10), 'Aggregate turnover Rs. ', n_chars, ',000 lakhs; opening balance: ', n_chars, ' total income ', n_chars, '; total credits ', n_chars, ' lakhs; assessment year 2023-24', chr(10),
         'Managing Director: Mr. Ravi Kumar', CASE doc_id % 3 WHEN 0 THEN 'an' ELSE '' END, ' DIN: 0000', 1000 + doc_id % 700, chr(10), 'Notes Forming Part', chr(10), {_pick}, chr(10), chr(10), chr(10),
         CASE doc_id % 6 WHEN 0 THEN 'Charge of Rs. 45,000 in favour of State Bank.' WHEN 1 THEN 'Collateral of 25.5 Cr; capacity use 65 % and top 5 customers give 45 %.' WHEN 2 THEN 'plant idle, struck off; cheque return, ecs return'
           WHEN 3 THEN 'full capacity, active; end of day balance 0.00' ELSE 'CIN U27100MH2001PLC123456; D/E ratio: 2.4 times' END) AS text FROM {{documents}}""",
    "typed_filings": "SELECT doc_id, company_id, text, CASE doc_id % 12 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(dict.fromkeys(t for t, *_ in read_lexicon("sections")))) + " ELSE 'unknown' END AS doc_type FROM {filings}",
    "promoters": "SELECT DISTINCT doc_id % 23 AS company_id, CASE doc_id % 5 WHEN 0 THEN 'Award Singh' WHEN 1 THEN 'Pledge Rao' WHEN 2 THEN 'Insolvency Das' WHEN 3 THEN 'Cheque Mehta' ELSE 'Steel Iyer' END AS name FROM {documents}",
    "addresses": "SELECT c_custkey AS company_id, concat('Plot ', c_custkey % 411, ',  Road no. ', c_nationkey % 3) AS address FROM {customer}",
    "lenders": "SELECT DISTINCT doc_id % 23 AS company_id, concat('Bank ', doc_id % 7) AS lender FROM {documents}",
    "ratings": "SELECT doc_id, doc_id % 23 AS company_id, doc_id % 5 AS sector, concat(text, ' now ', CASE doc_id % 6 WHEN 0 THEN 'CRISIL A+ (AA- before)' WHEN 1 THEN 'BBB, outlook stable' WHEN 2 THEN 'ICRA B' WHEN 3 THEN 'AAA; reaffirm' ELSE 'not rated' END) AS text FROM {documents}",
    "macro_items": "SELECT doc_id % 5 AS sector, CASE doc_id % 4 WHEN 0 THEN 'rates' WHEN 1 THEN 'growth' WHEN 2 THEN 'banking' ELSE 'global' END AS category, concat(text, ' ', CASE doc_id % 11 WHEN 0 THEN 'a rate hike on inflation' WHEN 1 THEN 'strong growth, a record' WHEN 2 THEN 'stress of banks' WHEN 3 THEN 'war and slowdown' ELSE '' END) AS text FROM {documents}",
    "risk_parts": "SELECT company_id, litigation_severity_score AS severity_score, CAST(floor(litigation_count / 4) AS BIGINT) AS high, company_id % 9 = 0 AS disqualified, company_id % 40 AS nodes, circular_trading_score AS shell_network_score, news_sentiment_score AS news_risk, litigation_severity_score AS litigation_risk, sector_risk_score AS sector_risk, benford_deviation_score AS macro_risk, CASE company_id % 3 WHEN 0 THEN 'DETERIORATING' ELSE 'STABLE' END AS rating_trend FROM {features}",
    "directors": "SELECT DISTINCT concat('D', l_suppkey) AS director, l_partkey % 500 AS company_id FROM {lineitem}",
    "reports": f"SELECT doc_id, doc_id % 97 AS company_id, concat(text, ' ', {_pick}) AS text FROM {{documents}}",
    "named_reports": "SELECT doc_id, company_id, text, CASE doc_id % 7 WHEN 0 THEN 'gst_return.pdf' WHEN 1 THEN 'decree-order.pdf' ELSE 'scan.pdf' END AS file_name FROM {reports}",
    "articles": f"SELECT doc_id AS ordinal, doc_id % 23 AS company_id, concat('u', doc_id % 700) AS url, {_pick} AS title, text AS snippet FROM {{documents}}",
}


def sql(name: str) -> str:
    """An input as a sub-query for an engine that knows the tables by name."""
    return re.sub(r"\{(\w+)\}", lambda m: m[1] if m[1] in TABLES else f"({sql(m[1])})", INPUTS[name])


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    def build() -> DataFrame:
        used = set(re.findall(r"\{(\w+)\}", INPUTS[name]))
        return spark.sql(INPUTS[name], **{t: frame(spark, sf_dir, t) for t in used})

    return step(sf_dir, name, build) if name in STEPS else build()

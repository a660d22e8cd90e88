import datetime as dt

from pyspark.sql import functions as F

from lendscope.functions import numbers
from lendscope.operators import decision, documents, graph, research, verification


def one(frame):
    rows = frame.collect()
    assert len(rows) == 1
    return rows[0].asDict()


def test_amounts(spark):
    cases = {"Rs. 12.5 Cr": 12.5e7, "(1,234)": -1234.0, "-5 lakhs": -5e5, "10 Ltd": 10.0, "2019": None, "3 thousand": 3000.0, "none": None, "": None}
    rows = spark.createDataFrame([(k,) for k in cases], "raw string").select("raw", numbers.parse_accounting(F.col("raw")).alias("v")).collect()
    assert {r["raw"]: r["v"] for r in rows} == cases


def test_first_digit_and_entity(spark):
    row = spark.range(1).select(numbers.first_digit(F.lit(0.5)).alias("a"), numbers.first_digit(F.lit(742.0)).alias("b"), numbers.normalise_entity(F.lit("acme  ltd-REF 12345")).alias("c")).first()
    assert (row["a"], row["b"], row["c"]) == (None, 7, "ACME LTD-REF 12345")


def edges(spark, rows):
    return spark.createDataFrame([(1, a, b, float(x), 1) for a, b, x in rows], "company_id long, src string, dst string, total_amount double, txn_count int")


def test_layered_pairs_of_the_round_trip_fixture(spark):
    e = edges(spark, [("SELF", "A", 2e7), ("A", "SELF", 1.91e7), ("SELF", "B", 1e7), ("B", "SELF", 9.8e6), ("SELF", "C", 1.5e7), ("C", "SELF", 1.48e7), ("SELF", "V", 5.55e7)])
    pairs = {r["entity_a"]: r["ratio"] for r in graph.layered_pairs(e).collect()}
    assert pairs == {"A": 0.955, "B": 0.98, "C": 0.987}


def test_cycles_are_listed_once(spark):
    e = edges(spark, [("a", "b", 1), ("b", "c", 2), ("c", "a", 3), ("b", "a", 4), ("c", "d", 5), ("d", "a", 6), ("x", "y", 9)])
    found = {(r["path"], r["length"], r["amount"]) for r in graph.cycles(e).collect()}
    assert found == {("a>b", 2, 5.0), ("a>b>c", 3, 6.0), ("a>b>c>d", 4, 14.0)}


def test_round_trip_window(spark):
    day = lambda n: dt.date(2022, 1, 1) + dt.timedelta(n)
    rows = [(1, 1, day(0), "SELF", "A", "debit", 10.0), (1, 2, day(30), "A", "SELF", "credit", 9.0), (1, 3, day(40), "SELF", "A", "debit", 5.0), (1, 4, day(80), "A", "SELF", "credit", 5.0)]
    t = spark.createDataFrame(rows, "company_id int, txn_id int, txn_date date, src string, dst string, direction string, amount double")
    assert one(graph.round_trip(t)) == {"company_id": 1, "party": "A", "round_trips": 1, "paid_out": 10.0}


def test_verification_of_the_golden_borrower(spark):
    gst, bank = spark.createDataFrame([(1, 1800.0)], "company_id int, turnover double"), spark.createDataFrame([(1, 1020.0)], "company_id int, credits double")
    row = one(verification.gst_bank_mismatch(gst, bank))
    assert (row["score"], row["flag"], row["severity"]) == (0.867, "REVENUE_MISMATCH", "HIGH")
    row = one(verification.itc_check(spark.createDataFrame([(1, 420.0, 280.0, 1800.0)], "company_id int, claimed double, available double, turnover double")))
    assert (row["excess_ratio"], row["score"], row["fake_itc"], row["high_itc"]) == (0.5, 1.0, "CRITICAL", "NONE")
    income = spark.createDataFrame([(1, "itr", 980.0), (1, "annual_report", 653.0)], "company_id int, source string, value double")
    row = one(verification.itr_check(income))
    assert (row["delta"], row["score"], row["severity"]) == (0.3337, 0.667, "MEDIUM")


GOLDEN = {
    "current_ratio": 0.8241, "interest_coverage_ratio": 0.672, "debt_to_equity": 3.4113, "gst_bank_mismatch_score": 0.867, "gstr2a_3b_mismatch_score": 1.0,
    "benford_deviation_score": 0.0, "collateral_coverage_ratio": 1.3, "capacity_utilization": 0.7, "news_sentiment_score": 0.5, "regulatory_violation_count": 0.0,
    "itr_revenue_mismatch_score": 0.667, "debtor_days": 145.3, "pat_margin": -0.1256, "circular_trading_score": 0.0, "promoter_network_risk": 0.3,
    "litigation_severity_score": 0.0, "dscr": 0.2311,
}


def test_rules_of_the_golden_borrower(spark):
    f = spark.createDataFrame([(1, *GOLDEN.values())], ["company_id", *GOLDEN])
    row = one(decision.rules_eval(f))
    assert (row["hard_reject"], row["reason"], row["policy_score"], row["policy_flags"]) == (True, "dscr", 17, 8)


def test_grade_caps(spark):
    s = spark.createDataFrame([(1, 95.0, 40.0, 90.0), (2, 95.0, 60.0, 90.0), (3, 72.0, 90.0, 55.0), (4, 10.0, 90.0, 10.0)], "company_id int, score double, capital double, capacity double")
    assert [r["grade"] for r in decision.grade(s).orderBy("company_id").collect()] == ["BBB", "AA", "BB", "D"]


def test_documents_and_news(spark):
    d = spark.createDataFrame([(1, 1, "A qualified opinion; going concern."), (2, 1, None)], "doc_id long, company_id long, text string")
    assert one(documents.audit_violations(d))["violations"] == 5.0
    assert {r["severity"] for r in documents.red_flags(d).collect()} == {"HIGH", "LOW"}
    a = spark.createDataFrame([(1, 1, "u", "fraud", "x"), (2, 1, "u", "fraud", "longer"), (3, 1, "", "award", "y")], "ordinal long, company_id long, url string, title string, snippet string")
    kept = research.news_dedup_topk(research.sentiment(a)).collect()
    assert [(r["ordinal"], r["sentiment"]) for r in kept] == [(1, "NEGATIVE")]


def test_cases_read_whole_texts_and_keep_documents_apart(spark):
    end = "and so the matter was put on file at the registry of the court, where it waits to be heard."
    rows = [(1, 1, end, "Insolvency of the debtor " + end, "a.pdf"), (1, 2, end, "A civil suit " + end, "b.pdf"), (1, 3, end, "A civil suit " + end, "b.pdf"), (1, 4, end, None, None)]
    reports = spark.createDataFrame(rows, "company_id long, ordinal long, summary string, text string, document string")
    news = reports.select("company_id", "ordinal", "summary")
    found = research.cases_union(reports, news).orderBy("ordinal").collect()
    assert [(r["feed"], r["ordinal"], r["severity"]) for r in found] == [(0, 1, "CRITICAL"), (0, 2, "MEDIUM"), (0, 4, "LOW")]
    assert [(r["ordinal"], r["severity"]) for r in research.cases_union(news).collect()] == [(1, "LOW")]


F4 = {
    "revenue": 653.0, "ebitda": 210.0, "ebit": 168.0, "interest": 250.0, "pat": -82.0, "cfo": 80.0, "long_term_debt": 700.0, "short_term_debt": 262.0, "equity": 282.0,
    "current_assets": 520.0, "current_liabilities": 631.0, "inventories": 180.0, "receivables": 260.0, "cogs": 290.0,
}


def test_ratios_of_the_golden_borrower(spark):
    lines = spark.createDataFrame([(1, m, "FY23", v) for m, v in F4.items()] + [(1, "revenue", "FY22", 600.0)], "company_id long, metric string, period string, value double")
    fin = decision.fin_agg(lines)
    row = one(decision.ratios(fin))
    assert (row["ebitda_margin"], row["pat_margin"], row["debt_to_equity"], row["current_ratio"], row["interest_coverage_ratio"], row["dscr"]) == (0.3216, -0.1256, 3.4113, 0.8241, 0.672, 0.2311)
    assert one(decision.days(fin)) == {"company_id": 1, "debtor_days": 145.3, "inventory_days": 226.6, "working_capital_days": -62.0}
    assert one(fin)["revenue_series"] == [600.0, 653.0]


def test_figures_fill_gaps_only(spark):
    lines = spark.createDataFrame([(1, "revenue", "FY23", 10.0), (1, "inventories", "FY23", 2.0), (1, "cash", "FY23", 3.0), (2, "ebit", "FY23", None)], "company_id long, metric string, period string, value double")
    told = spark.createDataFrame([(1, "revenue", 99.0), (1, "net_worth", 5.0), (1, "current_liab", 4.0), (1, "other", 1.0), (3, "total_debt", 7.0)], "company_id long, metric string, value double")
    rows = {r["company_id"]: r for r in decision.fin_agg(lines, told).collect()}
    assert rows.keys() == {1, 3} and rows[3]["total_debt"] == 7.0 and rows[3]["revenue_series"] == []
    assert (rows[1]["revenue"], rows[1]["equity"], rows[1]["current_liabilities"], rows[1]["current_assets"], rows[1]["total_debt"]) == (10.0, 5.0, 4.0, 5.0, None)


def test_missing_features_under_both_policies(spark):
    f = spark.createDataFrame([(1, *([None] * len(GOLDEN)))], "company_id int, " + ", ".join(f"{c} double" for c in GOLDEN))
    assert one(decision.rules_eval(f))["hard_reject"] and not one(decision.rules_eval(f, "skip"))["hard_reject"]


def test_ratios_told_in_texts(spark):
    d = spark.createDataFrame([(1, 2, "D/E: 9.9"), (1, 1, "Debt-to-equity ratio stands at 3.41\nDSCR 0.23; Interest coverage: 0.67\ncurrent ratio was 0.82\nReceivable days 145\nOperating cash flow 80.5"), (2, 3, None)], "company_id long, doc_id long, text string")
    row = {r["company_id"]: r for r in documents.text_ratios(d).collect()}[1]
    assert (row["debt_to_equity"], row["current_ratio"], row["interest_coverage_ratio"], row["dscr"], row["debtor_days"], row["cfo"]) == (3.41, 0.82, 0.67, 0.23, 145.0, 80.5)


def test_names_years_and_flags(spark):
    text = "  Acme Steel Limited  \nMr. Ravi Kumar met the State Bank of India on 01-Apr-2023 for FY2023 and FY 2021-22. There is doubt about ability to continue as a going concern."
    d = spark.createDataFrame([(1, 5, text), (2, 5, None)], "doc_id long, company_id long, text string")
    found = {(r["kind"], r["value"]) for r in documents.identifiers(d).collect()}
    assert {("person", "Mr. Ravi Kumar"), ("company", "Acme Steel Limited"), ("bank", "State Bank of India"), ("date", "01-Apr-2023")} <= found
    assert {r["fiscal_year"] for r in documents.fin_years(d).collect()} == {"2023", "2021-22"}
    assert one(documents.probable_company(d))["name"] == "Acme Steel Limited"
    flag = one(documents.doc_audit_flags(d))
    assert (flag["flag"], flag["severity"], flag["kind"]) == ("going_concern", "HIGH", "audit") and "going concern" in flag["context"]
    assert one(documents.doc_risk(documents.doc_audit_flags(d)))["doc_risk"] == "HIGH"


def test_gated_patterns_equal_plain_ones(spark):
    texts = ["the pledge of promoter shares", "promoter\npledge", "caro report", "carol", "companies auditor's report", "differs in reconciliation", "non-compliance with the act", "act of compliance", "fraud was classified", "npa", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "low string")
    for p in documents.RED_FLAGS.values():
        got = rows.select((documents.matches(F.col("low"), p) == F.col("low").rlike(p)).alias("same")).collect()
        assert all(r["same"] for r in got), p


def test_ratings_and_cases(spark):
    t = spark.createDataFrame([(1, 1, "CRISIL A+ and AA- and BBB+ (D) CAREFUL")], "company_id long, doc_id long, text string")
    assert [r["rating"] for r in research.rating_mentions(t).orderBy("rank").collect()] == ["CRISIL A+", "AA-", "BBB+", "D"]
    a = spark.createDataFrame([(1, 1, "u", "Award for growth", "x"), (1, 2, "v", "Talks", "NCLT admits the insolvency plea")], "company_id long, ordinal long, url string, title string, snippet string")
    d = spark.createDataFrame([(1, 7, "legal", "In DRT No. 45/2021, cbi was heard"), (1, 8, "gst", "insolvency")], "company_id long, doc_id long, doc_type string, text string")
    found = research.cases_union(research.legal_cases(d), research.news_cases(research.sentiment(a))).orderBy("feed").collect()
    assert [(r["feed"], r["ordinal"], r["severity"]) for r in found] == [(0, 7, "CRITICAL"), (1, 2, "CRITICAL")] and found[0]["summary"] == "Legal document 7: DRT No. 45/2021"
    score = one(research.litigation_score(research.cases_union(research.news_cases(research.sentiment(a)))))
    assert (score["cases"], score["flags"]) == (1, "SIGNIFICANT_LITIGATION")


def test_benford_distribution_and_counterparties(spark):
    v = spark.createDataFrame([(1, 1500.0), (1, 1600.0), (1, 9000.0), (1, 5.0)], "company_id long, amount double")
    rows = {r["digit"]: (r["observed"], r["expected"]) for r in graph.benford_distribution(v).collect()}
    assert len(rows) == 9 and rows[1] == (0.6667, 0.301) and rows[9] == (0.3333, 0.0458) and rows[5][0] == 0.0
    f = spark.createDataFrame([(1, f"e{i:02d}", 20 - i // 2) for i in range(15)], "company_id long, entity string, freq long")
    assert [r["entity"] for r in graph.top_counterparties(f).orderBy("rank").collect()] == [f"e{i:02d}" for i in range(10)]

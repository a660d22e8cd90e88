"""Statement, filing and signal operators on small tables with results worked out by hand."""

from pyspark.sql import functions as F

from lendscope.operators import filings, model, research, signals, statements, vectors
from lendscope.sources import feeds

RAW = "table_id string, company_id long, row_no int, cells array<string>"


def sheet(spark):
    rows = [
        ("t", 1, 0, ["Particulars (Rs in lakh)", "", "FY23"]), ("t", 1, 1, [" Revenue from operations ", "10", "(2.5)"]), ("t", 1, 2, ["", " ", None]),
        ("t", 1, 3, ["Interest Coverage Ratio", "3", "4"]), ("t", 1, 4, ["Total turnover", "-", "7 Cr"]), ("t", 1, 5, ["Net revenue", "none", ""]),
    ]
    return statements.clean_tables(spark.createDataFrame(rows, RAW))


def test_tables_and_lines(spark):
    t = sheet(spark)
    assert {r["row_no"] for r in t.collect()} == {1, 3, 4, 5} and t.first()["headers"] == ["Particulars (Rs in lakh)", "col_1", "FY23"]
    assert statements.table_scale(t).first()["scale"] == 1e5
    # The last line with a figure counts, and a unit of the cell beats the table's.
    assert [(r["metric"], r["period"], r["value"]) for r in statements.statement_lines(t).collect()] == [("revenue", "FY23", 7e7)]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], RAW)
    texts = spark.createDataFrame([], "company_id long, doc_id long, text string")
    assert statements.statement_lines(statements.clean_tables(empty)).count() == 0
    assert statements.txns(empty, texts).count() == 0


def test_transactions(spark):
    rows = [("b", 1, 0, ["Txn Date", "Narration", "Debit", "Credit", "Balance"]), ("b", 1, 1, ["1/4/22", "NEFT Cr - Sunrise Trading", "", "72", "1"]), ("b", 1, 2, ["2/4/22", "ACH DR ACME FINANCE LTD", "-", "-", "1"])]
    texts = [(2, 7, "01-Apr-2023 NEFT TO ACME LTD 500.00 Cr\n01-Apr-2023 NEFT TO ACME LTD 600.00 Cr\n05/06/2023 plain line 10.00 5.00"), (2, 8, "05/06/2023 plain line 10.00 5.00"), (2, 9, None)]
    out = statements.txns(spark.createDataFrame(rows, RAW), spark.createDataFrame(texts, "company_id long, doc_id long, text string")).collect()
    assert sorted((r["source"], r["amount"], r["src"], r["dst"]) for r in out) == [("table", 72.0, "UNKNOWN", "SELF"), ("text", 10.0, "SELF", "UNKNOWN"), ("text", 500.0, "ACME LTD", "SELF")]


def test_read_tables(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Particulars,FY23\n"Sales, net","1,200"\n')
    t = statements.clean_tables(statements.read_tables(spark, str(tmp_path)))
    assert t.first()["cells"] == ["Sales, net", "1,200"]
    assert statements.statement_lines(t).first()["value"] == 1200.0


def test_blocks(spark):
    text = "BALANCE SHEET\n\n\nassets and liabilities\nmore\n\n\n1.1 Related Party\nthe related parties"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    b = filings.segment_blocks(docs).orderBy("block_no").collect()
    assert [(r["heading"], r["text"].split("\n")[-1]) for r in b] == [("BALANCE SHEET", "more"), ("1.1 Related Party", "the related parties")]
    sections = filings.classify_sections(filings.segment_blocks(docs)).orderBy("block_no").collect()
    assert [(r["section"], r["confidence"]) for r in sections] == [("balance_sheet", 0.75), ("related_party", 0.75)]


def test_figures_and_remarks(spark):
    docs = spark.createDataFrame([(1, 5, "Net worth: Rs. 1,250 Cr. Margin: 12.5 % and D/E ratio: 2.4 times. Going concern; going concern."), (2, 5, None)], "doc_id long, company_id long, text string")
    found = {(r["type"], r["metric"], r["value"]) for r in filings.figures(docs).collect()}
    assert {("currency", "net_worth", 1.25e10), ("percentage", "other", 12.5)} <= found
    assert [(r["type"], r["weight"]) for r in filings.audit_remarks(docs).collect()] == [("GOING_CONCERN", 0.9)]
    assert filings.audit_remark_score(filings.audit_remarks(docs)).first()["audit_score"] == 0.9


def test_promoter_risk_of_the_fixture(spark):
    f = spark.createDataFrame([(1, 1.0, 4, True, 5, 0.0)], "company_id int, severity_score double, high int, disqualified boolean, nodes int, shell_network_score double")
    row = research.promoter_risk(f).first()
    assert (row["promoter_risk"], row["flagged"]) == (1.0, True)


def test_signals(spark):
    calm = {c: d for c, d in vectors.DEFAULTS.items()} | {"dscr": 0.9, "debt_to_equity": 3.0, "interest_coverage_ratio": 1.0, "news_sentiment_score": 0.7, "benford_deviation_score": 0.3}
    f = spark.createDataFrame([(1, *calm.values())], ["company_id", *calm])
    facts = f.withColumns({"external_cases": F.lit(3), "disclosed": F.lit(False), "negative_news": F.lit(3), "promoter_news": F.lit(0)})
    found = {(r["check"], r["kind"]) for r in signals.triangulation(facts).collect()}
    assert found == {("fraud", "CORROBORATED"), ("litigation", "DISCREPANCY"), ("distress", "CORROBORATED")}
    risk = signals.triangulation_risk(signals.triangulation(facts)).first()
    assert risk["triangulation_risk"] == 0.4
    more = facts.withColumns({"corroborated": F.lit(2), "discrepancies": F.lit(1), "macro_risk": F.lit(0.4), "rating_trend": F.lit("STABLE"), "sector_trend": F.lit("DETERIORATING")})
    warned = {(r["category"], r["severity"]) for r in signals.early_warning(more).collect()}
    assert warned == {("LEVERAGE_STRESS", "CRITICAL"), ("FRAUD_CONVERGENCE", "HIGH"), ("RATING_DETERIORATION", "MEDIUM")}
    assert signals.early_warning_score(signals.early_warning(more)).first()["early_warning_score"] == 0.42


def test_missing_features_take_defaults(spark):
    out = vectors.feature_vector(spark.createDataFrame([(1,)], "company_id long"), [spark.createDataFrame([(1, None)], "company_id long, dscr double")]).first()
    assert out["dscr"] == 1.5 and list(out.asDict())[1:] == list(vectors.DEFAULTS)


def test_feeds_round_trip(spark, tmp_path):
    (tmp_path / "feed.json").write_text('{"company_id": 1, "ordinal": 2, "title": "x", "other": 3}\n')
    row = feeds.read_articles(spark, str(tmp_path / "feed.json")).first()
    assert (row["company_id"], row["title"], row["url"]) == (1, "x", None)
    assert feeds.parse_articles(spark.createDataFrame([("no json",), (None,), ('{"company_id": 4}',)], "value string")).count() == 1
    results = spark.createDataFrame([(1, "REJECT", 40.0)], "company_id int, verdict string, score double").select("company_id", "verdict", feeds.result(decision=["score"]).alias("result"))
    feeds.write_results(results, str(tmp_path / "out"), "one")
    assert feeds.read_results(spark, str(tmp_path / "out"), "one").select("result.decision.score", "verdict").first() == (40.0, "REJECT")


def test_read_tables_with_breaks_in_quotes(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Particulars,FY23,FY22\n"Sales,\nnet","1,200"\n\n,,\nEBITDA,5,6,7\n')
    rows = statements.read_tables(spark, str(tmp_path)).orderBy("row_no").collect()
    assert [r["cells"] for r in rows] == [["Particulars", "FY23", "FY22"], ["Sales,\nnet", "1,200"], ["EBITDA", "5", "6", "7"]]


def test_balances_tell_credits(spark):
    text = "01/04/2023 opening line 10.00 100.00\n02/04/2023 money came in 50.00 150.00\n03/04/2023 money went out 20.00 130.00"
    out = statements.txn_text(spark.createDataFrame([(1, 1, text)], "company_id long, doc_id long, text string")).orderBy("txn_date").collect()
    assert [(r["amount"], r["direction"]) for r in out] == [(10.0, "debit"), (50.0, "credit"), (20.0, "debit")]


def test_totals_stand_in_for_credits(spark):
    bank = spark.createDataFrame([("t", 1, ["Credit"], ["500"])], "table_id string, company_id long, headers array<string>, cells array<string>")
    total = lambda *rows: spark.createDataFrame(list(rows), "company_id long, total double")
    got = statements.bank_credits(bank, total((2, None), (3, 7.0)), total((2, 5.0), (3, 9.0), (1, 8.0))).collect()
    assert {r["company_id"]: r["credits"] for r in got} == {1: 8.0, 2: 5.0, 3: 7.0}
    docs = spark.createDataFrame([(1, 2, "Total credits of the year: Rs 12 lakhs"), (1, 1, None)], "company_id long, doc_id long, text string")
    assert [(r["doc_id"], r["value"]) for r in statements.told_credits(docs).where("value IS NOT NULL").collect()] == [(2, 1_200_000.0)]


def test_sections_headed_without_keywords_and_audit_texts(spark):
    docs = spark.createDataFrame([(1, 5, "NOTES ON THE FINANCIAL POSITION\nnothing else"), (2, 5, "Independent Auditor of ours\nqualified opinion\n\n\nPLAIN HEADING\ngoing concern")], "doc_id long, company_id long, text string")
    blocks = filings.segment_blocks(docs)
    sections = filings.classify_sections(blocks)
    assert {(r["section"], r["confidence"]) for r in sections.where("doc_id = 1").collect()} == {("notes_to_accounts", 0.55)}
    assert {r["type"] for r in filings.audit_remarks(filings.audit_texts(docs, blocks, sections)).where("doc_id = 2").collect()} == {"QUALIFIED_OPINION"}
    found = filings.figures(spark.createDataFrame([(1, "x " * 100 + "Net worth: Rs. 5 Cr and more")], "doc_id long, text string")).first()
    assert found["has_unit"] and "Net worth: Rs. 5 Cr and more" in found["context"] and len(found["context"]) < 150


def test_split_keeps_shares_of_labels(spark):
    f = spark.range(2000).selectExpr("id AS company_id", "CAST(id % 10 = 0 AS INT) AS label")
    seen, held = model.split(f)
    n = {(k, r["label"]): r["count"] for k, part in (("seen", seen), ("held", held)) for r in part.groupBy("label").count().collect()}
    assert n["seen", 1] in range(155, 166) and n["seen", 0] in range(1430, 1451) and sum(n.values()) == 2000

"""Cross-checks of features, research and documents: signals per company and their scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendscope.functions.rounding import half_up

_DOC_FRAUD = "(benford_deviation_score > 0.25 OR circular_trading_score > 0.25 OR gst_bank_mismatch_score > 0.25)"
#: Check, then kind, severity and test in the order in which the first one that holds counts.
TRIANGULATION = {
    "fraud": [("CORROBORATED", "HIGH", f"news_sentiment_score > 0.65 AND {_DOC_FRAUD}"), ("DISCREPANCY", "MEDIUM", f"news_sentiment_score > 0.65 AND NOT {_DOC_FRAUD}")],
    "litigation": [("CORROBORATED", "HIGH", "external_cases > 2 AND disclosed"), ("DISCREPANCY", "HIGH", "external_cases > 2 AND NOT disclosed")],
    "distress": [("CORROBORATED", "HIGH", "dscr < 1.0 AND debt_to_equity > 2.5 AND negative_news >= 2")],
    "revenue": [
        ("CORROBORATED", "HIGH", "gst_bank_mismatch_score > 0.30 AND itr_revenue_mismatch_score > 0.30"),
        ("UNVERIFIED", "MEDIUM", "gst_bank_mismatch_score > 0.30 AND itr_revenue_mismatch_score <= 0.15"),
    ],
    "promoter": [("CORROBORATED", "HIGH", "promoter_network_risk > 0.5 AND promoter_news > 0")],
    "sector": [("CORROBORATED", "MEDIUM", "sector_risk_score > 0.60 AND ebitda_margin < 0.08"), ("DISCREPANCY", "HIGH", "sector_risk_score < 0.40 AND ebitda_margin < 0.05")],
}
#: Tests of the six fraud streams.
STREAMS = [
    "benford_deviation_score > 0.25", "circular_trading_score > 0.25", "gst_bank_mismatch_score > 0.25", "itr_revenue_mismatch_score > 0.25", "negative_news >= 3", "corroborated >= 2",
]
_STREAMS = "(" + " + ".join(f"CASE WHEN {x} THEN 1 ELSE 0 END" for x in STREAMS) + ")"
#: Category, then severity and test in the order in which the first one that holds counts.
WARNINGS = {
    "LEVERAGE_STRESS": [("CRITICAL", "debt_to_equity > 2.0 AND dscr < 1.25 AND interest_coverage_ratio < 1.5"), ("HIGH", "debt_to_equity > 1.5 AND revenue_growth_3yr < 0")],
    "FRAUD_CONVERGENCE": [("CRITICAL", f"{_STREAMS} >= 4"), ("HIGH", f"{_STREAMS} >= 2")],
    "MACRO_COMPOUNDING": [("HIGH", "macro_risk > 0.55 AND sector_risk_score > 0.55 AND ebitda_margin < 0.10")],
    "RATING_DETERIORATION": [("HIGH", "rating_trend = 'DETERIORATING'"), ("MEDIUM", "sector_trend = 'DETERIORATING' AND rating_trend = 'STABLE'")],
    "LIQUIDITY_RISK": [("HIGH", "working_capital_days > 180 AND current_ratio < 1.2 AND cashflow_volatility > 0.3"), ("MEDIUM", "working_capital_days > 120 AND current_ratio < 1.5")],
    "DISCLOSURE_RISK": [("HIGH", "discrepancies >= 2")],
    "CONCENTRATION_RISK": [("MEDIUM", "customer_concentration > 0.60 AND revenue_growth_3yr < 0")],
}
_FRAUD_SUM = "(circular_trading_score + benford_deviation_score + gst_bank_mismatch_score * 0.5e0 + gstr2a_3b_mismatch_score * 0.5e0)"
#: Side, point and test. Sector risk is on the scale 0 to 1, and news is a risk.
SWOT = [
    ("strength", "debt_service", "dscr >= 1.25"), ("strength", "low_leverage", "debt_to_equity < 1.5"), ("strength", "margin", "ebitda_margin >= 0.12"),
    ("strength", "no_fraud_signs", f"{_FRAUD_SUM} < 0.20"), ("strength", "clean_litigation", "litigation_count < 1"),
    ("weakness", "debt_service", "dscr < 1.25"), ("weakness", "leverage", "debt_to_equity > 2.5"), ("weakness", "margin", "ebitda_margin < 0.07"),
    ("weakness", "minor_fraud_signs", f"{_FRAUD_SUM} >= 0.20 AND {_FRAUD_SUM} < 0.40"), ("weakness", "fraud_signs", f"{_FRAUD_SUM} >= 0.40"),
    ("weakness", "litigation", "litigation_count >= 1 AND litigation_count < 3"), ("weakness", "many_cases", "litigation_count >= 3"),
    ("opportunity", "sector_outlook", "sector_risk_score < 0.40"), ("opportunity", "good_news", "news_sentiment_score < 0.35"), ("opportunity", "expansion", "ebitda_margin >= 0.15"),
    ("opportunity", "capex", "dscr >= 1.75"), ("opportunity", "growth", "revenue_growth_3yr > 0.10"),
    ("threat", "sector_headwinds", "sector_risk_score > 0.65"), ("threat", "adverse_news", "news_sentiment_score > 0.6"), ("threat", "litigation", "litigation_count >= 3"),
    ("threat", "violations", "regulatory_violation_count >= 1"), ("threat", "leverage", "debt_to_equity > 2.0"),
]


def _rows(f: DataFrame, each: list) -> DataFrame:
    """A row for each of the structs that is not null; they are dropped after the explode, so
    that the optimizer can test the array itself without evaluating it twice."""
    return f.select("company_id", F.explode(F.array(*each)).alias("x")).where("x IS NOT NULL").select("company_id", "x.*")


def swot(f: DataFrame) -> DataFrame:
    """One row for each strength, weakness, opportunity and threat of a company."""
    return _rows(f, [F.when(F.expr(t), F.struct(F.lit(side).alias("side"), F.lit(point).alias("point"))) for side, point, t in SWOT])


def triangulation(f: DataFrame) -> DataFrame:
    """f: features with external_cases, disclosed, negative_news and promoter_news. Rows: check, kind, severity."""
    each = []
    for check, choices in TRIANGULATION.items():
        out = F.lit(None)
        for kind, severity, test in reversed(choices):
            out = F.when(F.expr(test), F.struct(F.lit(check).alias("check"), F.lit(kind).alias("kind"), F.lit(severity).alias("severity"))).otherwise(out)
        each.append(out)
    return _rows(f, each)


def triangulation_risk(signals: DataFrame) -> DataFrame:
    out = signals.groupBy("company_id").agg(
        F.count_if(F.col("kind") == "CORROBORATED").alias("corroborated"), F.count_if(F.col("kind") == "DISCREPANCY").alias("discrepancies"), F.count_if(F.col("kind") == "UNVERIFIED").alias("unverified")
    )
    return out.withColumn("triangulation_risk", half_up(F.least(0.15 * F.col("corroborated") + 0.10 * F.col("discrepancies"), F.lit(0.9)), 4))


def early_warning(f: DataFrame) -> DataFrame:
    """f: triangulation's columns with corroborated, discrepancies, macro_risk, rating_trend, sector_trend. Rows: category, severity."""
    each = []
    for category, choices in WARNINGS.items():
        out = F.lit(None)
        for severity, test in reversed(choices):
            out = F.when(F.expr(test), F.struct(F.lit(category).alias("category"), F.lit(severity).alias("severity"))).otherwise(out)
        each.append(out)
    return _rows(f, each)


def early_warning_score(signals: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("severity") == s)
    out = signals.groupBy("company_id").agg(n("CRITICAL").alias("critical"), n("HIGH").alias("high"), n("MEDIUM").alias("medium"))
    score = 0.25 * F.col("critical") + 0.12 * F.col("high") + 0.05 * F.col("medium")
    return out.withColumn("early_warning_score", half_up(F.least(score, F.lit(1.0)), 4))


def promoter_news(articles: DataFrame, promoters: DataFrame) -> DataFrame:
    """Negative articles of a company whose title holds a promoter's first name; an article counts once. A company's first
    names meet its articles as one array (promoters are few, see filings.promoters), so no pairs of both are made."""
    first = promoters.select("company_id", F.lower(F.element_at(F.split("name", " "), 1)).alias("first")).where("first <> ''")
    names = first.groupBy("company_id").agg(F.collect_set("first").alias("names"))
    bad = articles.where("sentiment = 'NEGATIVE'").select("company_id", F.lower("title").alias("low"))
    hit = bad.join(names, "company_id").where(F.exists("names", lambda n: F.contains("low", n)))
    return hit.groupBy("company_id").agg(F.count(F.lit(1)).alias("promoter_news"))


def disclosure_gap(external: DataFrame, flags: DataFrame, more_than: int = 2) -> DataFrame:
    """external: company_id, cases found outside; flags: company_id of documents that tell of litigation.
    Companies with more cases than that and no such document."""
    return external.where(F.col("cases") > more_than).join(flags.select("company_id").distinct(), "company_id", "left_anti")

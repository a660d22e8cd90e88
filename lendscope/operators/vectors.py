"""The feature row of a company, and the evidence behind it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lendscope.functions.rounding import half_up

#: Features in order, with the value that stands for a missing one.
DEFAULTS = {
    "revenue_growth_3yr": 0.05, "ebitda_margin": 0.0, "pat_margin": 0.0, "debt_to_equity": 0.0, "current_ratio": 0.0, "interest_coverage_ratio": 0.0, "dscr": 1.5, "working_capital_days": 90.0,
    "debtor_days": 0.0, "inventory_days": 0.0, "cashflow_volatility": 0.2, "gst_bank_mismatch_score": 0.0, "gstr2a_3b_mismatch_score": 0.0, "itr_revenue_mismatch_score": 0.0,
    "circular_trading_score": 0.0, "benford_deviation_score": 0.0, "litigation_count": 0.0, "litigation_severity_score": 0.0, "news_sentiment_score": 0.5, "promoter_network_risk": 0.0,
    "sector_risk_score": 0.5, "collateral_coverage_ratio": 1.3, "capacity_utilization": 0.7, "customer_concentration": 0.4, "regulatory_violation_count": 0.0,
}
TEXT_FIRST = ["debt_to_equity", "current_ratio", "interest_coverage_ratio", "dscr", "debtor_days"]
#: Type of document that a feature is read from.
SOURCES = {
    "annual_report": ["revenue_growth_3yr", "ebitda_margin", "pat_margin", "debt_to_equity", "current_ratio", "interest_coverage_ratio", "working_capital_days", "debtor_days", "inventory_days", "customer_concentration", "promoter_network_risk"],
    "bank_statement": ["dscr", "cashflow_volatility", "circular_trading_score", "benford_deviation_score"], "gst": ["gst_bank_mismatch_score", "gstr2a_3b_mismatch_score"],
    "itr": ["itr_revenue_mismatch_score"], "legal": ["litigation_count", "litigation_severity_score", "regulatory_violation_count"],
}


def feature_vector(companies: DataFrame, parts: list[DataFrame], text_ratios: DataFrame | None = None) -> DataFrame:
    """companies: company_id; parts: one row a company, with some of the features. Missing values take their default;
    ratios that a text tells come first; 6 places."""
    out = companies.select("company_id")
    for part in parts:
        out = out.join(part, "company_id", "left")
    if text_ratios is not None:
        out = out.join(text_ratios.select("company_id", *[F.col(c).alias(f"text_{c}") for c in TEXT_FIRST]), "company_id", "left")
    have = set(out.columns)
    pick = lambda c: [F.col(x).cast("double") for x in (f"text_{c}", c) if x in have]
    return out.select("company_id", *[half_up(F.coalesce(*pick(c), F.lit(d)), 6).alias(c) for c, d in DEFAULTS.items()])


def display_ratios(fin: DataFrame) -> DataFrame:
    """Ratios of fin_agg's rows that their inputs allow, else null; turnover in crore."""
    over = lambda a, b: F.when(F.col(a).isNotNull() & (F.col(b) > 0), half_up(F.col(a) / F.col(b), 4))
    return fin.select(
        "company_id", half_up(F.col("revenue") / 1e7, 4).alias("turnover_crore"), over("ebitda", "revenue").alias("ebitda_margin"), over("pat", "revenue").alias("pat_margin"),
        over("total_debt", "equity").alias("debt_to_equity"), over("ebitda", "interest").alias("interest_coverage"),
    )


def evidence_edges(docs: DataFrame, sections: DataFrame, fired: DataFrame, decisions: DataFrame) -> DataFrame:
    """company_id, src, dst, relation: document to section, document to the features of its type, feature to fired rule,
    rule to decision. docs: doc_id, company_id, doc_type; sections: doc_id, section; fired: company_id, feature, kind; decisions: company_id, verdict."""
    doc = F.concat(F.lit("doc:"), F.col("doc_id"))
    held = docs.join(sections.select("doc_id", "section").distinct(), "doc_id").select("company_id", doc.alias("src"), F.concat(F.lit("section:"), F.col("section")).alias("dst"), F.lit("has_section").alias("relation"))
    table = F.create_map(*[x for k, names in SOURCES.items() for x in (F.lit(k), F.array(*map(F.lit, names)))])
    fed = docs.select("company_id", doc.alias("src"), F.explode(F.coalesce(table[F.col("doc_type")], F.array().cast("array<string>"))).alias("f"))
    fed = fed.select("company_id", "src", F.concat(F.lit("feature:"), F.col("f")).alias("dst"), F.lit("feeds").alias("relation"))
    rule = F.concat_ws(":", F.lit("rule"), F.lower("kind"), F.col("feature"))
    fires = fired.select("company_id", F.concat(F.lit("feature:"), F.col("feature")).alias("src"), rule.alias("dst"), F.lit("fires").alias("relation"))
    leads = fired.join(decisions, "company_id").select("company_id", rule.alias("src"), F.concat(F.lit("decision:"), F.col("verdict")).alias("dst"), F.lit("leads_to").alias("relation"))
    return held.unionByName(fed).unionByName(fires).unionByName(leads).distinct()


#: The part of its document that a feature is read from.
PLACES = {
    "Profit & Loss Statement": ["revenue_growth_3yr", "ebitda_margin", "pat_margin", "interest_coverage_ratio"], "Balance Sheet": ["debt_to_equity", "current_ratio", "working_capital_days", "debtor_days", "inventory_days"],
    "Cash Flow Statement": ["dscr"], "Monthly Credit Transactions": ["cashflow_volatility"], "Revenue Reconciliation": ["gst_bank_mismatch_score"], "ITC Reconciliation": ["gstr2a_3b_mismatch_score"],
    "Revenue Cross-check": ["itr_revenue_mismatch_score"], "Transaction Network Analysis": ["circular_trading_score"], "Benford Statistical Test": ["benford_deviation_score"], "Court Orders / DRT / NCLT": ["litigation_count"],
    "Litigation Impact Assessment": ["litigation_severity_score"], "Director & Group Entity Analysis": ["promoter_network_risk"], "Revenue by Customer Segment": ["customer_concentration"], "Auditor Report / CARO": ["regulatory_violation_count"],
}


#: What stands for the source of a feature that no document tells.
COMPUTED = ("Internal Computation", "Derived")


def evidence_trace(features: DataFrame, docs: DataFrame, fired: DataFrame, drivers: DataFrame, k: int = 20) -> DataFrame:
    """company_id, rank, feature, doc_type, doc_id, file_name, section, value, fired, is_top_driver: k features of a company,
    its drivers first by rank, then the others as SOURCES lists them, with the first document behind each (null without
    one). docs: company_id, doc_type, doc_id, file_name; drivers: company_id, feature, rank."""
    listed = [(t, c) for t, names in SOURCES.items() for c in names]
    listed += [(None, c) for c in DEFAULTS if c not in {c for _, c in listed}]
    rows = [F.struct(F.lit(i).alias("i"), F.lit(c).alias("feature"), F.lit(t).cast("string").alias("doc_type"), F.col(c).cast("double").alias("value")) for i, (t, c) in enumerate(listed)]
    long = features.select("company_id", F.explode(F.array(*rows)).alias("x")).select("company_id", "x.*")
    first = docs.groupBy("company_id", "doc_type").agg(F.min("doc_id").alias("doc_id"), F.min_by("file_name", "doc_id").alias("file_name"))
    keys = ["company_id", "feature"]
    hit = fired.select(keys).distinct().withColumn("fired", F.lit(True))
    top = drivers.groupBy(keys).agg(F.min("rank").alias("driver"))
    out = long.join(first, ["company_id", "doc_type"], "left").join(hit, keys, "left").join(top, keys, "left").fillna(False, ["fired"])
    out = out.where("doc_type IS NOT NULL OR driver IS NOT NULL")
    place = F.create_map(*[F.lit(x) for section, names in PLACES.items() for c in names for x in (c, section)])
    order = Window.partitionBy("company_id").orderBy(F.col("driver").asc_nulls_last(), "i")
    ranked = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    section = F.when(F.col("doc_type").isNull(), COMPUTED[1]).otherwise(F.try_element_at(place, F.col("feature")))
    return ranked.select(
        "company_id", "rank", "feature", F.coalesce("doc_type", F.lit(COMPUTED[0])).alias("doc_type"), "doc_id", "file_name", section.alias("section"),
        half_up(F.col("value"), 4).alias("value"), "fired", F.col("driver").isNotNull().alias("is_top_driver"),
    )

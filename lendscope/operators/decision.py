"""Ratios, scores, rules, grades and the decision, one row a company."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendscope.functions.rounding import half_up
from lendscope.operators.statements import METRICS

#: Feature, test, threshold, in the order in which a first reason counts.
HARD_RULES = [("circular_trading_score", ">", 0.80), ("promoter_network_risk", ">", 0.80), ("litigation_severity_score", ">", 0.75), ("dscr", "<", 1.10)]
#: Feature, test, threshold, points.
POLICY_RULES = [
    ("current_ratio", "<", 1.20, 10), ("interest_coverage_ratio", "<", 1.50, 12), ("debt_to_equity", ">", 3.00, 15),
    ("gst_bank_mismatch_score", ">", 0.30, 10), ("gstr2a_3b_mismatch_score", ">", 0.20, 8), ("benford_deviation_score", ">", 0.50, 8),
    ("collateral_coverage_ratio", "<", 1.25, 10), ("capacity_utilization", "<", 0.40, 5), ("news_sentiment_score", ">", 0.70, 7),
    ("regulatory_violation_count", ">", 3.0, 6), ("itr_revenue_mismatch_score", ">", 0.20, 10), ("debtor_days", ">", 90.0, 8), ("pat_margin", "<", 0.0, 10),
]
#: Grade, least score, share of turnover, premium over the base rate.
GRADES = [
    ("AAA", 90, 0.07, 0.0), ("AA", 80, 0.06, 0.25), ("A", 75, 0.05, 0.50), ("BBB", 70, 0.04, 1.00),
    ("BB", 65, 0.03, 1.75), ("B", 60, 0.02, 2.50), ("C", 50, 0.01, 3.50), ("D", 0, 0.00, 5.00),
]
BASE_RATE = 9.0
#: Sector, then median DSCR, debt to equity, EBITDA margin and current ratio.
SECTORS = [
    ("steel", 1.30, 2.20, 0.14, 1.25), ("textile", 1.25, 1.80, 0.12, 1.30), ("real_estate", 1.10, 2.50, 0.22, 1.10), ("it", 3.00, 0.30, 0.24, 2.50),
    ("pharma", 2.50, 0.60, 0.22, 1.80), ("nbfc", 1.50, 3.50, 0.30, 1.20), ("infrastructure", 1.20, 2.00, 0.20, 1.15), ("agri", 1.40, 1.20, 0.10, 1.40),
    ("auto", 1.60, 1.00, 0.14, 1.30), ("cement", 1.80, 1.00, 0.20, 1.20), ("fmcg", 3.50, 0.40, 0.18, 1.50), ("energy", 1.40, 2.00, 0.22, 1.20),
    ("logistics", 1.70, 1.10, 0.12, 1.25), ("chemicals", 1.80, 1.20, 0.16, 1.35), ("default", 1.40, 1.50, 0.15, 1.30),
]


def _v(name: str, missing: float = 0.0) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(missing))


def _clamped(x: Column) -> Column:
    return half_up(F.greatest(F.lit(0.0), F.least(F.lit(100.0), x)), 1)


def _share(name: str, full: float, missing: float) -> Column:
    return F.least(_v(name, missing) / full, F.lit(1.0))


#: Metrics of figures in running text, and the statement metrics that they stand for.
FIGURE_NAMES = {
    "revenue": "revenue", "ebitda": "ebitda", "pat": "pat", "gross_profit": "gross_profit", "total_debt": "total_debt", "net_worth": "equity", "current_assets": "current_assets",
    "current_liab": "current_liabilities", "cash": "cash", "gst_turnover": "gst_turnover", "itc": "itc_claimed", "capex": "cfi",
}
#: Metrics whose values are also kept as a rising series.
SERIES = ["revenue", "pat", "ebitda", "cfo"]


def fin_agg(lines: DataFrame, figures: DataFrame | None = None) -> DataFrame:
    """One column a metric (METRICS): its greatest value in lines (company_id, metric, period, value), or, where a
    company's lines have none, in figures (company_id, metric, value: amounts told with a unit). SERIES as rising
    arrays, too. Missing total debt is long and short term debt, missing current assets the sum of inventories,
    receivables and cash where two of these are known."""
    rows = lines.where("value IS NOT NULL").select("company_id", "metric", F.col("value").cast("double").alias("value"), F.lit(True).alias("stated"))
    if figures is not None:
        names = F.create_map(*[F.lit(x) for pair in FIGURE_NAMES.items() for x in pair])
        told = figures.where("value > 0").select("company_id", names[F.col("metric")].alias("metric"), F.col("value").cast("double").alias("value"), F.lit(False).alias("stated"))
        rows = rows.unionByName(told.where("metric IS NOT NULL"))
    own = lambda m, stated: F.when((F.col("metric") == m) & (F.col("stated") == stated), F.col("value"))
    wide = rows.groupBy("company_id").agg(*[F.coalesce(F.max(own(m, True)), F.max(own(m, False))).alias(m) for m in METRICS])
    # Lists are aggregated in objects and sorted, so only the lines that have them take that way.
    listed = lambda m, stated: F.sort_array(F.collect_list(own(m, stated)))
    lists = rows.where(F.col("metric").isin(list(SERIES))).groupBy(F.col("company_id").alias("of")).agg(
        *[F.when(F.size(listed(m, True)) > 0, listed(m, True)).otherwise(listed(m, False)).alias(f"{m}_series") for m in SERIES]
    )
    series = [F.coalesce(f"{m}_series", F.array().cast("array<double>")).alias(f"{m}_series") for m in SERIES]
    wide = wide.join(lists, F.col("company_id").eqNullSafe(F.col("of")), "left").select("company_id", *METRICS, *series)
    debt = F.when(F.col("long_term_debt").isNotNull() | F.col("short_term_debt").isNotNull(), F.coalesce("long_term_debt", F.lit(0.0)) + F.coalesce("short_term_debt", F.lit(0.0)))
    parts = [F.coalesce(c, F.lit(0.0)) for c in ("inventories", "receivables", "cash")]
    known = sum(((p != 0).cast("int") for p in parts), F.lit(0))
    return wide.withColumns({"total_debt": F.coalesce("total_debt", debt), "current_assets": F.coalesce("current_assets", F.when(known >= 2, parts[0] + parts[1] + parts[2]))})


def cagr(lines: DataFrame, metric: str = "revenue") -> DataFrame:
    """Growth a period from the first to the last period of a metric; 0.05 with fewer than two."""
    ends = lines.where(F.col("metric") == metric).groupBy("company_id").agg(
        F.min_by("value", "period").alias("first"), F.max_by("value", "period").alias("last"), (F.max("period") - F.min("period")).alias("n")
    )
    rate = F.pow(F.col("last") / F.col("first"), 1.0 / F.col("n")) - 1
    return ends.select("company_id", half_up(F.when((F.col("n") > 0) & (F.col("first") > 0), rate).otherwise(0.05), 4).alias("growth"))


def ratios(fin: DataFrame) -> DataFrame:
    """Margins, leverage, liquidity and coverage of fin_agg's rows; a missing or zero denominator gives 0 (DSCR 1.5).
    Interest is covered by EBIT, or EBITDA where EBIT is missing or 0."""
    over = lambda a, b: F.when(F.col(a).isNotNull() & (F.col(b) != 0), half_up(F.col(a) / F.col(b), 4)).otherwise(0.0)
    service = F.coalesce("interest", F.lit(0.0)) + 0.1 * F.coalesce("total_debt", F.lit(0.0))
    cash = F.coalesce("cfo", "ebitda", F.lit(0.0))
    earned = F.coalesce(F.nullif("ebit", F.lit(0.0)), "ebitda")
    return fin.withColumn("earned", earned).select(
        "company_id", over("ebitda", "revenue").alias("ebitda_margin"), over("pat", "revenue").alias("pat_margin"),
        over("total_debt", "equity").alias("debt_to_equity"), over("current_assets", "current_liabilities").alias("current_ratio"), over("earned", "interest").alias("interest_coverage_ratio"),
        F.when(service > 0, half_up(cash / service, 4)).otherwise(1.5).alias("dscr"),
    )


def cfo_volatility(lines: DataFrame) -> DataFrame:
    stats = lines.where("metric = 'cfo'").groupBy("company_id").agg(F.stddev_samp("value").alias("sd"), F.avg("value").alias("mean"), F.count("value").alias("n"))
    v = F.when(F.col("n") < 2, 0.2).when(F.col("mean") == 0, 0.5).otherwise(F.col("sd") / F.abs("mean"))
    return stats.select("company_id", half_up(v, 4).alias("cfo_volatility"))


def governance_score(f: DataFrame) -> DataFrame:
    """f: company_id, features, and layered_score, shell_score, shell_network_score and audit_score; missing parts are 0."""
    one = lambda c: F.least(_v(c), F.lit(1.0))
    score = (
        0.25 * one("litigation_severity_score") + 0.10 * F.least(_v("litigation_count") / 10, F.lit(1.0)) + 0.12 * one("benford_deviation_score")
        + 0.08 * one("circular_trading_score") + 0.03 * one("layered_score") + 0.02 * one("shell_score") + 0.03 * one("shell_network_score")
        + 0.10 * one("audit_score") + 0.08 * one("gst_bank_mismatch_score") + 0.07 * one("gstr2a_3b_mismatch_score")
        + 0.05 * one("itr_revenue_mismatch_score") + 0.15 * F.least(_v("regulatory_violation_count") / 10, F.lit(1.0))
    )
    out = f.select("company_id", half_up(F.least(score, F.lit(1.0)), 4).alias("governance_score"))
    return out.withColumn("character_score", half_up(100 - 100 * F.col("governance_score"), 2))


def sector_benchmarks(f: DataFrame) -> DataFrame:
    """f: company_id, sector and ratios. Differences from the sector's medians; unknown sectors take the default row."""
    names = ["dscr", "debt_to_equity", "ebitda_margin", "current_ratio"]
    table = F.broadcast(f.sparkSession.createDataFrame(SECTORS, ["known", *[f"m_{n}" for n in names]]))  # a fixed table
    known = F.when(F.col("sector").isin(*[s for s, *_ in SECTORS]), F.col("sector")).otherwise("default")
    joined = f.join(table, known == F.col("known"))
    return joined.select("company_id", "sector", F.col("known").alias("benchmark"), *[half_up(F.col(n) - F.col(f"m_{n}"), 4).alias(f"{n}_gap") for n in names])


def fired_rules(f: DataFrame, null_policy: str = "zero") -> DataFrame:
    """One row for each rule that fires: ordinal, kind, feature, points. A missing feature counts as 0, or, under
    null_policy "skip", fires no rule."""
    value = (lambda name: F.col(name).cast("double")) if null_policy == "skip" else _v
    test = lambda name, op, limit: (value(name) > limit) if op == ">" else (value(name) < limit)
    hard = [(n, op, limit, 0, "HARD") for n, op, limit in HARD_RULES]
    policy = [(*r, "POLICY") for r in POLICY_RULES]
    each = [
        F.when(test(n, op, limit), F.struct(F.lit(i).alias("ordinal"), F.lit(kind).alias("kind"), F.lit(n).alias("feature"), F.lit(points).alias("points")))
        for i, (n, op, limit, points, kind) in enumerate([*hard, *policy])
    ]
    fired = F.explode(F.filter(F.array(*each), lambda x: x.isNotNull()))
    return f.select("company_id", fired.alias("r")).select("company_id", "r.*")


def rules_eval(f: DataFrame, null_policy: str = "zero") -> DataFrame:
    """Hard rejection with its first reason, points left of 100 and rules fired, per company."""
    sums = fired_rules(f, null_policy).groupBy("company_id").agg(
        F.count_if(F.col("kind") == "HARD").alias("hard_flags"), F.count_if(F.col("kind") == "POLICY").alias("policy_flags"),
        F.sum("points").alias("points"), F.min_by("feature", F.when(F.col("kind") == "HARD", F.col("ordinal"))).alias("reason"),
    )
    joined = f.select("company_id").join(sums, "company_id", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return joined.select(
        "company_id", (n("hard_flags") > 0).alias("hard_reject"), F.when(n("hard_flags") > 0, F.col("reason")).alias("reason"), n("hard_flags").alias("hard_flags"),
        n("policy_flags").alias("policy_flags"), F.greatest(100 - n("points"), F.lit(0).cast("long")).alias("policy_score"),
    )


def scorecard(f: DataFrame) -> DataFrame:
    growth = F.least(F.greatest(_v("revenue_growth_3yr"), F.lit(0.0)) / 0.15 + 0.5, F.lit(1.0))
    parts = {
        "financial_health": _share("ebitda_margin", 0.20, 0) * 35 + _share("pat_margin", 0.12, 0) * 25 + (1 - _share("debt_to_equity", 4.0, 2)) * 40,
        "cashflow": _share("dscr", 2.0, 1) * 40 + _share("interest_coverage_ratio", 3.0, 1) * 35 + growth * 25,
        "governance": 100 - _v("promoter_network_risk", 0.3) * 40 - _v("litigation_severity_score") * 30 - _v("regulatory_violation_count") * 3,
        "fraud_risk": 100 - _v("gst_bank_mismatch_score") * 40 - _v("circular_trading_score") * 35 - _v("benford_deviation_score") * 25,
        "sector_risk": (1 - _v("sector_risk_score", 0.5)) * 100,
        "collateral": _share("collateral_coverage_ratio", 2.0, 1) * 100,
    }
    out = f.select("company_id", *[_clamped(x).alias(n) for n, x in parts.items()])
    weights = dict(zip(parts, (0.25, 0.20, 0.15, 0.15, 0.15, 0.10), strict=True))
    return out.withColumn("weighted_total", half_up(sum((F.col(n) * w for n, w in weights.items()), F.lit(0.0)), 1))


def five_cs(f: DataFrame) -> DataFrame:
    growth = F.least(_v("revenue_growth_3yr") / 0.15 + 0.5, F.lit(1.0))
    parts = {
        "character": 100 - _v("promoter_network_risk", 0.5) * 30 - _v("litigation_severity_score") * 30 - _v("regulatory_violation_count") * 5 - _v("news_sentiment_score", 0.5) * 10,
        "capacity": _share("dscr", 2.0, 1) * 40 + _share("interest_coverage_ratio", 3.0, 1) * 30 + _share("ebitda_margin", 0.20, 0) * 30,
        "capital": (1 - _share("debt_to_equity", 4.0, 2)) * 50 + _share("pat_margin", 0.12, 0) * 30 + growth * 20,
        "collateral": _share("collateral_coverage_ratio", 2.0, 1) * 100,
        "conditions": (1 - _v("sector_risk_score", 0.5)) * 60 + _v("capacity_utilization", 0.7) * 40,
    }
    return f.select("company_id", *[_clamped(x).alias(n) for n, x in parts.items()])


def grade(scores: DataFrame) -> DataFrame:
    """scores: company_id, score, capital, capacity. Weak capital caps the grade at BBB (below 50) or AA
    (below 65); capacity below 60 takes one notch."""
    place = F.lit(len(GRADES) - 1)
    for i, (_, least, *_) in reversed(list(enumerate(GRADES[:-1]))):
        place = F.when(F.col("score") >= least, i).otherwise(place)
    capped = F.when(F.col("capital") < 50, F.greatest(place, F.lit(3))).when(F.col("capital") < 65, F.greatest(place, F.lit(1))).otherwise(place)
    final = F.when(F.col("capacity") < 60, F.least(capped + 1, F.lit(len(GRADES) - 1))).otherwise(capped)
    names = F.array(*[F.lit(g) for g, *_ in GRADES])
    return scores.select("company_id", "score", F.element_at(names, place + 1).alias("raw_grade"), F.element_at(names, final + 1).alias("grade"))


def verdict(scores: DataFrame) -> DataFrame:
    """scores: company_id, hard_reject, ml_score, policy_score, weighted_total."""
    mixed = half_up(0.5 * F.col("ml_score") + 0.2 * F.col("policy_score") + 0.3 * F.col("weighted_total"), 1)
    out = scores.select("company_id", "hard_reject", F.when(F.col("hard_reject"), F.col("ml_score")).otherwise(mixed).alias("credit_score"))
    s = F.col("credit_score")
    choice = F.when(F.col("hard_reject"), "REJECT").when(s >= 75, "APPROVE").when(s >= 60, "CONDITIONAL_APPROVE").otherwise("REJECT")
    return out.select("*", choice.alias("verdict"), half_up(1 / (1 + F.exp(-(0.5 - 0.055 * s))), 4).alias("default_probability"))


#: Short name, feature, test, threshold.
CONDITIONS = [
    ("dscr_low", "dscr", "<", 1.25), ("gst_mismatch", "gst_bank_mismatch_score", ">", 0.10), ("itr_mismatch", "itr_revenue_mismatch_score", ">", 0.10),
    ("high_leverage", "debt_to_equity", ">", 2.5), ("litigation_medium", "litigation_severity_score", ">=", 0.25), ("negative_news", "news_sentiment_score", ">", 0.60),
    ("collateral_below_125", "collateral_coverage_ratio", "<", 1.25), ("capacity_low", "capacity_utilization", "<", 0.50),
    ("customer_concentration", "customer_concentration", ">", 0.40),
]


def conditions(f: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Names of the conditions that an approval carries; verdicts: company_id, verdict. Rejections have no row."""
    each = [F.when(F.expr(f"{c} {op} {limit}"), F.lit(n)) for n, c, op, limit in CONDITIONS]
    return f.join(verdicts.where("verdict <> 'REJECT'").select("company_id"), "company_id", "left_semi").select("company_id", F.array_join(F.filter(F.array(*each), lambda x: x.isNotNull()), ",").alias("conditions"))


def loan_sizing(f: DataFrame) -> DataFrame:
    """f: company_id, grade, turnover_crore, ebitda_margin, dscr."""
    table = F.broadcast(f.sparkSession.createDataFrame([(g, e, p) for g, _, e, p in GRADES], ["grade", "exposure", "premium"]))  # a fixed table
    by_revenue = F.col("turnover_crore") * F.col("exposure")
    by_ebitda = F.col("turnover_crore") * F.col("ebitda_margin") * F.least(F.greatest("dscr", F.lit(0.5)), F.lit(2.5)) * 3.5
    return f.join(table, "grade").select(
        "company_id", "grade", half_up(by_revenue, 2).alias("loan_by_revenue"), half_up(by_ebitda, 2).alias("loan_by_ebitda"),
        F.greatest(half_up(F.least(by_revenue, by_ebitda), 2), F.lit(1.0)).alias("max_loan_crore"), (F.col("premium") + BASE_RATE).alias("interest_rate"),
    )


def facility_emi(loans: DataFrame, years: int = 5) -> DataFrame:
    """loans: company_id, max_loan_crore, interest_rate. 60/40 split and the instalment of the term part."""
    r, n = F.col("interest_rate") / 1200, 12 * years
    term = F.col("max_loan_crore") * 0.4
    return loans.select(
        "company_id", half_up(F.col("max_loan_crore") * 0.6, 2).alias("working_capital"), half_up(term, 2).alias("term_loan"),
        half_up(term * r / (1 - F.pow(1 + r, F.lit(-n))), 4).alias("emi"),
    )


def fraud_bands(scores: DataFrame) -> DataFrame:
    """scores: company_id, fraud_score (0 to 100)."""
    s = F.col("fraud_score")
    band = F.when(s <= 20, "LOW").when(s <= 40, "MODERATE").when(s <= 70, "HIGH").otherwise("SEVERE")
    return scores.select("company_id", "fraud_score", band.alias("band"), half_up(100 - s, 1).alias("integrity_score"))


def stress_scenarios(scores: DataFrame) -> DataFrame:
    """scores: company_id, score, dscr. Base, revenue -20 %, rate +2 %."""
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(d).alias("d"), F.lit(s).alias("s")) for n, d, s in (("base", 1.0, 1.0), ("revenue_down_20", 0.8, 0.88), ("rate_up_2", 0.88, 0.94))]))
    out = scores.select("company_id", "score", "dscr", rows.alias("x"))
    s = half_up(F.col("score") * F.col("x.s"), 1)
    return out.select("company_id", "x.scenario", half_up(F.col("dscr") * F.col("x.d"), 2).alias("dscr"), s.alias("score"), F.when(s >= 75, "APPROVE").when(s >= 60, "CONDITIONAL").otherwise("REJECT").alias("outcome"))


def ml_labels(f: DataFrame) -> DataFrame:
    """Default label: any of seven thresholds is broken."""
    tests = "dscr < 1.0 OR interest_coverage_ratio < 1.2 OR debt_to_equity > 3.5 OR circular_trading_score > 0.7 OR litigation_severity_score > 0.7 OR gst_bank_mismatch_score > 0.5 OR promoter_network_risk > 0.8"
    return f.select("company_id", F.expr(tests).cast("int").alias("label"))


def ratio_table(r: DataFrame) -> DataFrame:
    """Wide ratios to (metric, value, higher_is_better) rows."""
    better = {"ebitda_margin": True, "pat_margin": True, "debt_to_equity": False, "current_ratio": True, "interest_coverage_ratio": True, "dscr": True}
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value"), F.lit(b).alias("higher_is_better")) for c, b in better.items()]))
    return r.select("company_id", rows.alias("x")).select("company_id", "x.*")


def risk_radar(f: DataFrame) -> DataFrame:
    """Five Cs, and fraud risk as 50 (circular + benford), as rows."""
    cs = five_cs(f).join(f.select("company_id", half_up(50 * (_v("circular_trading_score") + _v("benford_deviation_score")), 1).alias("fraud_risk")), "company_id")
    names = ["character", "capacity", "capital", "collateral", "conditions", "fraud_risk"]
    return cs.unpivot("company_id", names, "axis", "value")


def days(fin: DataFrame, receivables: str = "receivables", inventories: str = "inventories", cogs: str = "cogs", current_assets: str = "current_assets", current_liabilities: str = "current_liabilities") -> DataFrame:
    """Debtor, inventory (of costs, else of revenue) and working-capital days; without figures 0, 0 and 90."""
    over = lambda a, b: F.when((F.col(a) > 0) & (b > 0), half_up(F.col(a) / b * 365, 1)).otherwise(0.0)
    net = half_up((_v(current_assets) - _v(current_liabilities)) / F.col("revenue") * 365, 1)
    return fin.select(
        "company_id", over(receivables, F.col("revenue")).alias("debtor_days"), over(inventories, F.coalesce(F.nullif(F.col(cogs), F.lit(0.0)), F.col("revenue"))).alias("inventory_days"),
        F.when(F.col("revenue") > 0, net).otherwise(90.0).alias("working_capital_days"),
    )

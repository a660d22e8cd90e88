"""Checks of declared figures against each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendscope.functions.rounding import half_up

#: Months of a fiscal year, in order.
FISCAL = [4, 5, 6, 7, 8, 9, 10, 11, 12, 1, 2, 3]


def gst_bank_mismatch(gst: DataFrame, bank: DataFrame) -> DataFrame:
    """gst: company_id, turnover (monthly); bank: company_id, credits. Sums per company, compared."""
    total = lambda c: F.sum(F.col(c).cast("decimal(18,2)")).cast("double")
    left = gst.groupBy("company_id").agg(total("turnover").alias("gst"))
    right = bank.groupBy("company_id").agg(total("credits").alias("bank"))
    joined = left.join(right, "company_id", "full_outer")
    delta = F.abs(F.col("gst") - F.col("bank")) / F.col("gst")
    known = F.col("gst").isNotNull() & F.col("bank").isNotNull() & (F.col("gst") > 0)
    score = F.when(known, half_up(F.least(delta / 0.5, F.lit(1.0)), 3)).otherwise(0.0)
    flag = F.when(~known, "INSUFFICIENT_DATA").when(delta > 0.25, "REVENUE_MISMATCH").when(delta > 0.15, "GST_BANK_MISMATCH").otherwise("NONE")
    severity = F.when(known & (delta > 0.40), "HIGH").when(known & (delta > 0.15), "MEDIUM").otherwise("NONE")
    return joined.select("company_id", "gst", "bank", score.alias("score"), flag.alias("flag"), severity.alias("severity"))


def monthly_recon(companies: DataFrame, gst: DataFrame, bank: DataFrame) -> DataFrame:
    """Twelve rows a company, April to March; a month without both figures is NO_DATA, never made up."""
    months = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("place"), F.lit(m).alias("month")) for i, m in enumerate(FISCAL)]))
    grid = companies.select("company_id", months.alias("m")).select("company_id", "m.place", "m.month")
    joined = grid.join(gst, ["company_id", "month"], "left").join(bank, ["company_id", "month"], "left")
    ok = F.col("turnover").isNotNull() & (F.col("credits") > 0)
    delta = F.when(ok, half_up((F.col("turnover") - F.col("credits")) / F.col("credits") * 100, 1))
    status = F.when(~F.coalesce(ok, F.lit(False)), "NO_DATA").when(F.abs(delta) <= 15, "OK").when(F.abs(delta) > 30, "HIGH").otherwise("MEDIUM")
    return joined.select("company_id", "place", "month", delta.alias("delta_pct"), status.alias("status"))


def itc_check(itc: DataFrame) -> DataFrame:
    """company_id, claimed, available, turnover: excess input tax credit and its share of turnover."""
    excess = F.when(F.col("available") > 0, (F.col("claimed") - F.col("available")) / F.col("available"))
    over = (F.col("claimed") > F.col("available")) & (F.col("available") > 0)
    share = F.col("claimed") / F.col("turnover")
    return itc.select(
        "company_id",
        F.when(over, half_up(excess, 4)).otherwise(0.0).alias("excess_ratio"),
        F.when(over, half_up(F.least(excess / 0.5, F.lit(1.0)), 3)).otherwise(0.0).alias("score"),
        F.when(over & (excess > 0.25), "CRITICAL").when(over, "HIGH").otherwise("NONE").alias("fake_itc"),
        F.when(F.col("turnover") > 0, half_up(share, 4)).alias("itc_to_turnover"),
        F.when(share > 0.40, "HIGH").when(share > 0.25, "MEDIUM").otherwise("NONE").alias("high_itc"),
    )


def _spread(low, high):
    delta = (high - low) / high
    return (
        half_up(delta, 4).alias("delta"), half_up(F.least(delta / 0.5, F.lit(1.0)), 3).alias("score"),
        F.when(delta > 0.35, "HIGH").when(delta > 0.20, "MEDIUM").otherwise("NONE").alias("severity"),
    )


def itr_check(income: DataFrame) -> DataFrame:
    """income: company_id, source, value; companies with both a tax return and an annual report."""
    pick = lambda s: F.max(F.when((F.col("source") == s) & (F.col("value") > 0), F.col("value")))
    both = income.groupBy("company_id").agg(pick("itr").alias("itr"), pick("annual_report").alias("report"))
    both = both.where("itr IS NOT NULL AND report IS NOT NULL")
    return both.select("company_id", *_spread(F.least("itr", "report"), F.greatest("itr", "report")))


def three_way_recon(income: DataFrame) -> DataFrame:
    """Spread over all sources of a company's income that give a figure."""
    some = income.where("value > 0").groupBy("company_id").agg(
        F.min("value").alias("low"), F.max("value").alias("high"), F.count(F.lit(1)).alias("sources"), F.max_by("source", F.struct("value", "source")).alias("highest")
    )
    return some.where("sources >= 2").select("company_id", "sources", "highest", *_spread(F.col("low"), F.col("high")))


def consistency_summary(flags: DataFrame) -> DataFrame:
    """flags: company_id, severity. CRITICAL counts as at least HIGH."""
    count = lambda *s: F.count_if(F.col("severity").isin(*s))
    out = flags.groupBy("company_id").agg(count("CRITICAL").alias("critical"), count("HIGH").alias("high"), count("MEDIUM").alias("medium"))
    serious = F.col("critical") + F.col("high")
    return out.withColumn("overall", F.when(serious >= 2, "CRITICAL").when(serious == 1, "HIGH").when(F.col("medium") >= 2, "MEDIUM").otherwise("LOW"))

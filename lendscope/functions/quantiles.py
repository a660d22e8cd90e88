"""Exact order statistics by key, without sorting a key's values in one place.

Equal values are counted before they are shuffled. A key's range is cut at approximate quantiles; the
parts' sums tell which part holds the wanted place, and only that part's values are ranked. The cuts
decide how work is dealt, never the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts of a key's range.
PARTS = 64


def order_statistic(values: DataFrame, keys: list[str], place: Column, parts: int = PARTS) -> DataFrame:
    """keys, value, n: for each key the value at a place (from 1, by rising value) of its n values; place is told from n.
    values: keys, value; null values are none."""
    each = values.where("value IS NOT NULL").groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("times"))
    cuts = each.groupBy(*keys).agg(F.percentile_approx("value", [i / parts for i in range(1, parts)], 100 * parts).alias("cuts"))
    dealt = each.join(cuts, keys).withColumn("part", F.size(F.filter("cuts", lambda c: c < F.col("value")))).drop("cuts")
    sums = dealt.groupBy(*keys, "part").agg(F.sum("times").alias("own"))  # parts rows a key at most
    whole = Window.partitionBy(*keys)
    upto = F.sum("own").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    sums = sums.select(*keys, "part", F.sum("own").over(whole).alias("n"), (upto - F.col("own")).alias("before"), upto.alias("upto"))
    wanted = sums.withColumn("place", place).where("before < place AND place <= upto").select(*keys, "part", "n", "before", "place")
    ranks = Window.partitionBy(*keys, "part").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = dealt.join(wanted, [*keys, "part"]).withColumn("last", F.col("before") + F.sum("times").over(ranks))
    return ranked.where("place <= last AND place > last - times").select(*keys, "value", "n")


def upper_medians(values: DataFrame, keys: list[str]) -> DataFrame:
    """keys, median: the value in the middle, the greater one of two."""
    return order_statistic(values, keys, F.floor(F.col("n") / 2) + 1).select(*keys, F.col("value").alias("median"))


def medians(values: DataFrame, keys: list[str]) -> DataFrame:
    """keys, median: the value in the middle, the mean of two."""
    low = order_statistic(values, keys, F.floor((F.col("n") + 1) / 2)).select(*keys, F.col("value").alias("low"))
    return low.join(upper_medians(values, keys), keys).select(*keys, ((F.col("low") + F.col("median")) / 2).alias("median"))

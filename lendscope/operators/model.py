"""Default model: boosted trees over the 25 features, by Spark ML. Fit on all labelled rows."""

from __future__ import annotations

import math

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import SQLTransformer, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lendscope.functions.quantiles import medians
from lendscope.functions.rounding import half_up
from lendscope.operators.decision import GRADES


def preparation(f: DataFrame, features: list[str]) -> Pipeline:
    """Exact medians of f for missing values, then zero mean and unit deviation; the vector is scaled. Medians are
    worked out for features with missing values only."""
    missing = f.agg(*[F.count_if(F.isnan(c) | F.isnull(c)).alias(c) for c in features]).first()
    real = [F.struct(F.lit(c).alias("feature"), F.when(~F.isnan(c), F.col(c).cast("double")).alias("value")) for c in features if missing[c]]
    found = {} if not real else {r["feature"]: r["median"] for r in medians(f.select(F.explode(F.array(*real)).alias("x")).select("x.*"), ["feature"]).collect()}  # a row a feature
    filled = ", ".join(f"coalesce(nullif(CAST({c} AS DOUBLE), double('NaN')), {found.get(c, 0.0)!r}d) AS {c}_filled" for c in features)
    assembled = VectorAssembler(inputCols=[f"{c}_filled" for c in features], outputCol="raw")
    return Pipeline(stages=[SQLTransformer(statement=f"SELECT *, {filled} FROM __THIS__"), assembled, StandardScaler(inputCol="raw", outputCol="scaled", withMean=True, withStd=True)])


def ml_prepare(f: DataFrame, features: list[str]) -> DataFrame:
    """company_id, feature, value: the scaled features as rows."""
    ready = preparation(f, features).fit(f).transform(f).select("company_id", vector_to_array("scaled").alias("v"))
    names = F.array(*map(F.lit, features))
    rows = ready.select("company_id", F.posexplode("v").alias("i", "value"))
    return rows.select("company_id", F.get(names, F.col("i")).alias("feature"), half_up(F.col("value"), 6).alias("value"))


def split(f: DataFrame, share: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Training and test rows, that share of each label: rows of a label up to the quantile of a hash of company_id."""
    hashed = f.withColumn("drawn", F.xxhash64("company_id", F.lit(42)))
    cuts = hashed.groupBy("label").agg(F.percentile_approx("drawn", share, 100_000).alias("cut"))  # a row a label
    dealt = hashed.join(F.broadcast(cuts), "label")
    part = lambda test: dealt.where(test).select(*f.columns)
    return part("drawn <= cut"), part("drawn > cut")


def train(f: DataFrame, features: list[str], trees: int = 300, depth: int = 5, step: float = 0.06) -> PipelineModel:
    """f: the features and label."""
    trees_stage = GBTClassifier(featuresCol="scaled", labelCol="label", maxIter=trees, maxDepth=depth, stepSize=step, seed=42)
    return Pipeline(stages=[*preparation(f, features).getStages(), trees_stage]).fit(f)


def rank_auc(scores: DataFrame, parts: int = 256) -> DataFrame:
    """auc, positives, negatives of scores (score, label 0 or 1): the share of pairs of a positive and a negative in which the
    positive scores higher, ties counting half; null without both. Exact: negatives below each distinct score are
    counted within parts of the range of scores, and before them by the parts' sums, so no window takes all scores."""
    each = scores.where("score IS NOT NULL").groupBy(F.col("score").cast("double").alias("score")).agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n"))
    cuts = each.agg(F.percentile_approx("score", [i / parts for i in range(1, parts)], 100 * parts)).first()[0]  # parts values at most
    edges = F.lit(cuts or [0.0])
    dealt = each.select("score", "p", "n", F.size(F.filter(edges, lambda c: c < F.col("score"))).alias("part"))
    sums = dealt.groupBy("part").agg(F.sum("n").alias("own"))  # a row a part
    before = sums.withColumn("before", F.coalesce(F.sum("own").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("own")
    below = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = dealt.withColumn("below", below).join(F.broadcast(before), "part")
    won = F.sum((F.col("p") * (2 * (F.col("before") + F.col("below")) + F.col("n"))).cast("decimal(38,0)"))
    out = ranked.agg(won.cast("double").alias("won"), F.sum("p").alias("positives"), F.sum("n").alias("negatives"))
    pairs = 2.0 * F.col("positives") * F.col("negatives")
    return out.select(F.when(pairs > 0, half_up(F.col("won") / pairs, 6)).alias("auc"), F.coalesce("positives", F.lit(0)).alias("positives"), F.coalesce("negatives", F.lit(0)).alias("negatives"))


def prepared(model: PipelineModel, f: DataFrame) -> DataFrame:
    """company_id and v, the scaled features that the trees read."""
    return PipelineModel(model.stages[:-1]).transform(f).select("company_id", vector_to_array("scaled").alias("v"))


def evaluate(model: PipelineModel, test: DataFrame) -> DataFrame:
    """One row: auc, f1, precision, recall, accuracy at 0.5, rows."""
    scored = model.transform(test).withColumn("p", vector_to_array("probability")[1])
    auc = rank_auc(scored.select(F.col("p").alias("score"), "label")).first()["auc"]
    hit, real = F.col("p") >= 0.5, F.col("label") == 1
    n = scored.agg(F.count_if(hit & real).alias("tp"), F.count_if(hit & ~real).alias("fp"), F.count_if(~hit & real).alias("fn"), F.count(F.lit(1)).alias("rows"))
    share = lambda a, b: F.when(b > 0, half_up(a / b, 4)).otherwise(0.0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return n.select(F.lit(auc).cast("double").alias("auc"), share(2 * tp, 2 * tp + fp + fn).alias("f1"), share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(F.col("rows") - fp - fn, F.col("rows")).alias("accuracy"), "rows")


def ml_score(model: PipelineModel, f: DataFrame, copies: int = 10, noise: float = 0.005) -> DataFrame:
    """Probability of default, score 100 (1 - p), grade, and the score's band of 1.96 deviations over noisy copies. The
    noise is normal and made from a hash of company, feature and copy, so a lost task draws the same again."""
    ready, trees = prepared(model, f), model.stages[-1]
    u = lambda i, salt: (F.pmod(F.xxhash64("company_id", i, "copy", F.lit(salt)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    normal = lambda i: F.sqrt(-2 * F.log(u(i, 1))) * F.cos(2 * math.pi * u(i, 2))
    rows = ready.select("company_id", "v", F.explode(F.sequence(F.lit(0), F.lit(copies))).alias("copy"))
    moved = F.transform("v", lambda x, i: x + F.when(F.col("copy") > 0, noise * normal(i)).otherwise(0.0))
    scored = trees.transform(rows.select("company_id", "copy", array_to_vector(moved).alias("scaled"))).select("company_id", "copy", vector_to_array("probability")[1].alias("p"))
    out = scored.groupBy("company_id").agg(F.max(F.when(F.col("copy") == 0, F.col("p"))).alias("p"), F.stddev_pop(F.when(F.col("copy") > 0, 100 * (1 - F.col("p")))).alias("sd"))
    s = half_up(100 * (1 - F.col("p")), 1)
    grade = F.lit(GRADES[-1][0])
    for name, least, *_ in reversed(GRADES[:-1]):
        grade = F.when(s >= least, name).otherwise(grade)
    return out.select(
        "company_id", half_up(F.col("p"), 4).alias("default_probability"), s.alias("credit_score"), grade.alias("grade"),
        half_up(F.greatest(s - 1.96 * F.col("sd"), F.lit(0.0)), 1).alias("low"), half_up(F.least(s + 1.96 * F.col("sd"), F.lit(100.0)), 1).alias("high"),
    )

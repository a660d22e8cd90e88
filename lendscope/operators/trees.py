"""Boosted trees as a table: one row a node, scores and each row's own contributions along its paths.

A node has the feature and threshold of its split (left where the value is at most the threshold), its
children, and the value that a row which stops there would get. Along a path each split moves the value
from the node's to the child's: that step is what the split's feature contributes. Root values and all
steps of a row add up to its margin, whose logistic is the score.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lendscope.functions.rounding import half_up


def tree_table(model: GBTClassificationModel, place: str, spark) -> DataFrame:
    """tree, weight, node, value, feature, threshold, left, right, left_value, right_value of a model, which is saved in
    place; leaves have none of the last six."""
    model.write().overwrite().save(place)
    n, split = F.col("nodeData"), F.col("nodeData.split")
    inner = n["leftChild"] >= 0
    of = lambda c: F.when(inner, c)
    nodes = spark.read.parquet(f"{place}/data").select(
        F.col("treeID").alias("tree"), n["id"].alias("node"), n["prediction"].alias("value"), of(split["featureIndex"]).alias("feature"),
        of(F.get(split["leftCategoriesOrThreshold"], F.lit(0))).alias("threshold"), of(n["leftChild"]).alias("left"), of(n["rightChild"]).alias("right"),
    )
    weights = spark.read.parquet(f"{place}/treesMetadata").toDF("tree", "metadata", "weight").select("tree", "weight")
    child = lambda side: nodes.select("tree", F.col("node").alias(side), F.col("value").alias(f"{side}_value"))
    return nodes.join(child("left"), ["tree", "left"], "left").join(child("right"), ["tree", "right"], "left").join(weights, "tree")


def base_margin(trees: DataFrame) -> float:
    """What every row starts from: the weighted values of the roots."""
    return trees.where("node = 0").agg(F.sum(F.col("weight") * F.col("value"))).first()[0]


STEPS = "company_id long, feature int, impact double"
#: Rows that are walked at once.
ROWS = 1024


def steps(rows: DataFrame, trees: DataFrame, count: int, depth: int) -> DataFrame:
    """company_id, feature, impact: what each feature's splits add to a row's margin. rows: company_id, v (array of
    features), a row a company; trees: count trees of that depth at most, a table as small as the model, so that each task
    has all of it. Each task walks its own rows down all trees, so no row is multiplied by the trees or shuffled."""
    names = ["tree", "node", "value", "feature", "threshold", "left", "right", "left_value", "right_value", "weight"]
    table = trees.select(names).toPandas()  # a row a node
    size = int(table["node"].max()) + 1
    at = (table["tree"] * size + table["node"]).to_numpy()

    def dense(values, kind):
        out = np.zeros(count * size, kind)
        out[at] = values
        return out

    leaf = table["left"].isna().to_numpy()
    feature, left, right = (dense(table[c].fillna(0), np.int64) for c in ("feature", "left", "right"))
    threshold, inner = dense(table["threshold"].fillna(0.0), np.float64), dense(~leaf, bool)
    moved_left, moved_right = (dense((table["weight"] * (table[c] - table["value"])).fillna(0.0), np.float64) for c in ("left_value", "right_value"))
    roots = np.arange(count) * size

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                part = batch.slice(first, ROWS)
                vectors = part.column("v")
                v = vectors.flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                row, width = np.arange(part.num_rows)[:, None], v.shape[1]
                node = np.zeros((part.num_rows, count), np.int64)
                impact, taken = np.zeros(part.num_rows * width), np.zeros(part.num_rows * width, bool)
                for _ in range(depth):
                    here = roots + node
                    goes_left = v[row, feature[here]] <= threshold[here]
                    on, cell = inner[here], row * width + feature[here]
                    moved = np.where(goes_left, moved_left[here], moved_right[here])
                    impact += np.bincount(cell[on], weights=moved[on], minlength=len(impact))
                    taken[cell[on]] = True
                    node = np.where(on, np.where(goes_left, left[here], right[here]), node)
                of = np.flatnonzero(taken)
                yield pa.RecordBatch.from_pydict({"company_id": part.column("company_id").cast(pa.int64()).take(pa.array(of // width)), "feature": pa.array(of % width, pa.int32()), "impact": pa.array(impact[of])})

    return rows.select("company_id", "v").mapInArrow(run, STEPS)


def margins(rows: DataFrame, impacts: DataFrame, base: float) -> DataFrame:
    """company_id, margin, p (the default probability) of rows (company_id) and their steps()."""
    sums = impacts.groupBy("company_id").agg(F.sum("impact").alias("moved"))
    out = rows.select("company_id").join(sums, "company_id", "left").select("company_id", (F.lit(base) + F.coalesce("moved", F.lit(0.0))).alias("margin"))
    return out.withColumn("p", 1 / (1 + F.exp(-2 * F.col("margin"))))


def drivers(impacts: DataFrame, names: list[str], k: int = 10) -> DataFrame:
    """company_id, feature, impact, rank: the k features that move a row's margin most; above 0 they raise the risk."""
    named = impacts.select("company_id", F.get(F.array(*map(F.lit, names)), F.col("feature")).alias("feature"), half_up(F.col("impact"), 6).alias("impact"))
    order = Window.partitionBy("company_id").orderBy(F.abs("impact").desc(), "feature")
    return named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

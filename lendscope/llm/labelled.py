"""Bounded samples of labelled documents, for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendscope.llm.shared import held_out


def sample(docs: DataFrame, labels: DataFrame, label: str, most: dict[int | None, int], mod: int, remainder: int) -> DataFrame:
    """doc_id, text, label of labelled training documents, at most most[value] of each label
    value (under None: of all), those whose ids hash lowest.

    A document with several label rows takes the greatest label, an id with several texts the one
    whose hash is least, so the sample has a row an id. The chosen ids are bounded by most, so they
    are broadcast.
    """
    given = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    given = given.where(F.col("label").isin(0, 1) & ~held_out(F.col("doc_id"), mod, remainder)).groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = None
    for value, n in most.items():
        some = given if value is None else given.where(F.col("label") == value)
        some = some.orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(n)
        chosen = some if chosen is None else chosen.unionByName(some)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label")
    return found.agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("doc_id", "text", "label")

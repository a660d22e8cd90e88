"""Feeds of articles, and the sink of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ARTICLE = "company_id long, ordinal long, url string, title string, snippet string, source string, provider string"


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines in one article schema; fields that a feed lacks are null."""
    return spark.read.schema(ARTICLE).json(path)


def parse_articles(lines: DataFrame, column: str = "value") -> DataFrame:
    """The same from a column of JSON texts; what is no JSON object goes."""
    return lines.select(F.from_json(column, ARTICLE).alias("a")).where("a.company_id IS NOT NULL").select("a.*")


def result(**parts: list[str]) -> Column:
    """A nested result from columns by part."""
    return F.struct(*[F.struct(*columns).alias(name) for name, columns in parts.items()])


def write_results(results: DataFrame, path: str, batch: str, rows_in_file: int = 1_000_000) -> None:
    """The results of a batch as a partition of the table at path. What an earlier run of the batch wrote is replaced as a
    whole, other batches stay, and no file has more than that many rows."""
    rows = results.withColumn("batch", F.lit(batch))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", rows_in_file).partitionBy("batch").parquet(path)


def read_results(spark: SparkSession, path: str, batch: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("batch") == batch).drop("batch")

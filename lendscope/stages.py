"""Stage tables of a run: what several of its steps read is written once, and deleted when the run ends.

A run of many queries reads the same inputs again and again; planned as one query, each use would be
worked out anew, and a plan of fifteen feature parts takes longer to make than to run. In a run each
named step is a table in the folder that driver and executors share (spark.checkpoint.dir), which cuts
its lineage, so a lost executor costs a step's tasks and not the run.
"""

from __future__ import annotations

import contextlib
import contextvars
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession


#: Folder of the run that is going on in this context, if any.
_RUN: contextvars.ContextVar[str | None] = contextvars.ContextVar("run", default=None)


def shared_place(spark: SparkSession, of_run: bool = True) -> str:
    """A new folder in the one that driver and executors share, in that of the current run if there is one, with which it
    goes; a local session without such a setting gets one of its own."""
    if of_run and _RUN.get():
        return f"{_RUN.get()}/{uuid.uuid4().hex}"
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master) is None:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-lendscope-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/run-{uuid.uuid4().hex}"


def write(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """df dealt by key over as many tasks as run at once, in the order of key. For work that a row makes much of: tables that
    are small in bytes are otherwise one file, and so one task."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, key).sortWithinPartitions(key)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a table that was written, and with the driver's garbage the shuffle files of the jobs that are done."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    gc.collect()
    spark._jvm.System.gc()


class Stages(str):
    """The folder of a run's given tables, as a string, and the steps that it has written so far."""

    def __new__(cls, spark: SparkSession, sf_dir: str):
        return super().__new__(cls, sf_dir)

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.place = spark, shared_place(spark, of_run=False)
        self.steps: dict[str, DataFrame] = {}

    def step(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """The step's table; written when it is first asked for."""
        if name not in self.steps:
            self.steps[name] = write(build(), f"{self.place}/{name}")
        return self.steps[name]

    def result(self, df: DataFrame) -> DataFrame:
        """df as a table of its own, which stays when the run ends."""
        return write(df, shared_place(self.spark, of_run=False))

    def end(self) -> None:
        delete(self.spark, self.place)
        self.steps.clear()


@contextlib.contextmanager
def run(spark: SparkSession, sf_dir: str) -> Iterator[Stages]:
    """A run over the tables in a folder; one within another is a part of it."""
    if isinstance(sf_dir, Stages):
        yield sf_dir
        return
    stages = Stages(spark, sf_dir)
    before = _RUN.set(stages.place)
    try:
        yield stages
    finally:
        _RUN.reset(before)
        stages.end()


def step(sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """build(), as a step where sf_dir is that of a run."""
    return sf_dir.step(name, build) if isinstance(sf_dir, Stages) else build()


def whole(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A query of many parts as a run of its own: its result is written, its steps go."""

    def of(spark: SparkSession, sf_dir: str) -> DataFrame:
        if isinstance(sf_dir, Stages):
            return query(spark, sf_dir)
        with run(spark, sf_dir) as stages:
            return stages.result(query(spark, stages))

    of.__name__, of.__doc__ = query.__name__, query.__doc__
    return of

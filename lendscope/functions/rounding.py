"""Rounding that is the same arithmetic in every engine: half up, by floor."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, places: int) -> Column:
    scale = 10.0**places
    return F.floor(x.cast("double") * scale + 0.5) / scale


def half_up_sql(x: str, places: int) -> str:
    return f"(floor(({x}) * 1e{places} + 0.5) / 1e{places})"

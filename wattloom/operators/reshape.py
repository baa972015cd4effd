"""Long and wide forms."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.schema import TIMESTAMP

#: Fixed labels of the days, Monday first.
DAYS = ("Lundi", "Mardi", "Mercredi", "Jeudi", "Vendredi", "Samedi", "Dimanche")


def melt(df: DataFrame, values: Sequence[str], ts: str = TIMESTAMP) -> DataFrame:
    """(unique_id, ds, y): one row per series and time with a value."""
    return df.unpivot([ts], list(values), "unique_id", "y").where("y is not null").select("unique_id", F.col(ts).alias("ds"), "y")


def pivot_first(df: DataFrame, names: Sequence[str], name: str, value: str, order: Sequence[str], ts: str = TIMESTAMP) -> DataFrame:
    """One column per name: the first value that is not null, in the order of arrival."""
    first = F.min_by(value, F.struct(*order))
    return df.where(F.col(value).isNotNull()).groupBy(ts).pivot(name, list(names)).agg(first)


def pivot_hour_weekday(df: DataFrame, value: str, ts: str = TIMESTAMP) -> DataFrame:
    """Mean by hour of the day, one column per weekday."""
    wide = df.withColumn("__d", F.weekday(ts)).groupBy(F.hour(ts).alias("hour")).pivot("__d", list(range(7)))
    return wide.agg(F.avg(value)).toDF("hour", *DAYS)


def inner_align(frames: Sequence[DataFrame], ts: str = TIMESTAMP) -> DataFrame:
    """Series side by side on the times they all have; a time that a frame repeats is an error of its own (checked by ``assert_unique``)."""
    return reduce(lambda a, b: a.join(b, ts, "inner"), frames)


def assert_unique(df: DataFrame, ts: str = TIMESTAMP) -> DataFrame:
    """``df``, with an error at run time if a time is repeated."""
    counted = df.groupBy(ts).agg(F.count(F.lit(1)).alias("__n"), *[F.first(c).alias(c) for c in df.columns if c != ts])
    return counted.where(F.assert_true(F.col("__n") == 1, "repeated time").isNull()).select(*df.columns)

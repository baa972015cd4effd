"""Hourly means of an event stream (an extension: batch results of ``resample_mean``, kept up to date)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.schema import TIMESTAMP


def hourly_means(events: DataFrame, by: Sequence[str], value: str = "value", ts: str = "ts", late: str = "2 hours") -> DataFrame:
    """(timestamp, by, n, mean_value) per hour; an hour is final once the watermark has passed it by ``late``."""
    timed = events.withColumn("__t", F.col(ts).cast("timestamp")).withWatermark("__t", late)
    hours = timed.groupBy(F.window("__t", "1 hour").alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean_value"))
    return hours.select(F.col("w.start").cast("timestamp_ntz").alias(TIMESTAMP), *by, "n", "mean_value")

"""Forecast errors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mae(y: Column, f: Column) -> Column:
    return F.avg(F.abs(y - f))


def mse(y: Column, f: Column) -> Column:
    return F.avg((y - f) * (y - f))


def r2(y: Column, f: Column) -> Column:
    """1 - squared errors / squared distances from the mean, over rows with both; null for a constant series."""
    seen = y.isNotNull() & f.isNotNull()
    return 1 - F.try_divide(F.sum(F.when(seen, (y - f) * (y - f))), F.var_pop(F.when(seen, y)) * F.count_if(seen))


def by_source(df: DataFrame, group: str = "source", y: str = "y", f: str = "forecast") -> DataFrame:
    a, b = F.col(y), F.col(f)
    return df.groupBy(group).agg(mae(a, b).alias("mae"), mse(a, b).alias("mse"), F.sqrt(mse(a, b)).alias("rmse"), r2(a, b).alias("r2"))


def evaluate_long(df: DataFrame, models: Sequence[str], by: Sequence[str] = ("unique_id",), y: str = "y") -> DataFrame:
    """(by, metric, one column per model): mean absolute errors."""
    return df.groupBy(*by).agg(F.lit("mae").alias("metric"), *[mae(F.col(y), F.col(m)).alias(m) for m in models])


def mean_by_metric(evaluated: DataFrame, models: Sequence[str]) -> DataFrame:
    return evaluated.groupBy("metric").agg(*[F.avg(m).alias(m) for m in models])


def rank_models(scores: DataFrame, models: Sequence[str]) -> DataFrame:
    """(metric, model, score, place): least score first, ties in the order of ``models``; place 1 is the choice."""
    place = {m: i for i, m in enumerate(models)}
    long = scores.unpivot(["metric"], list(models), "model", "score")
    order = F.element_at(F.create_map(*[x for m, i in place.items() for x in (F.lit(m), F.lit(i))]), F.col("model"))
    return long.withColumn("place", F.row_number().over(Window.partitionBy("metric").orderBy("score", order)))


def half_even(c: Column | str, digits: int) -> Column:
    """Rounding for display, halves to the even digit."""
    return F.bround(c, digits)

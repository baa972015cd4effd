"""Baseline forecasts, back-tests, uncertainty bands. Series are long rows (unique_id, ds, y), hourly and without gaps."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MODELS = ("Naive", "HistoricAverage", "WindowAverage", "SeasonalNaive")
#: Relative error of a forecast at its first step and after 24 hours, per source; others take OTHER_BAND.
BANDS = {"NUCLEAR": (0.01, 0.05), "SOLAR": (0.05, 0.15), "WIND_ONSHORE": (0.04, 0.12), "BIOMASS": (0.02, 0.08), "consommation_totale": (0.02, 0.08)}
OTHER_BAND = (0.02, 0.10)


def baselines(long: DataFrame, h: int = 24, season: int = 24) -> DataFrame:
    """(unique_id, ds, step, one column per model): forecasts of the ``h`` hours after each series' end.

    Last value, mean of all, mean of the last ``season`` values, and the last season again.
    """
    series = Window.partitionBy("unique_id")
    back = F.row_number().over(series.orderBy(F.col("ds").desc()))
    ranked = long.withColumn("__back", back)
    recent = F.when(F.col("__back") <= season, F.struct(F.col("ds").alias("t"), F.col("y").alias("v")))
    facts = ranked.groupBy("unique_id").agg(
        F.max("ds").alias("last"), F.max_by("y", "ds").alias("Naive"), F.avg("y").alias("HistoricAverage"), F.avg(F.when(F.col("__back") <= season, F.col("y"))).alias("WindowAverage"),
        F.array_sort(F.collect_list(recent)).alias("tail"),
    )
    steps = facts.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(h))))
    seasonal = F.col("tail")[((F.col("step") - 1) % F.size("tail")).cast("int")]["v"]
    return steps.select("unique_id", F.expr("last + make_dt_interval(0, step)").alias("ds"), "step", "Naive", "HistoricAverage", "WindowAverage", seasonal.alias("SeasonalNaive"))


def holdout(long: DataFrame, n: int = 24) -> tuple[DataFrame, DataFrame]:
    """(train, test): the last ``n`` rows of every series are the test part."""
    marked = long.withColumn("__back", F.row_number().over(Window.partitionBy("unique_id").orderBy(F.col("ds").desc())))
    return marked.where(F.col("__back") > n).drop("__back"), marked.where(F.col("__back") <= n).drop("__back")


def rolling_origin(long: DataFrame, windows: int = 25, h: int = 24) -> DataFrame:
    """(unique_id, ds, cutoff, y, one column per model) of the last ``windows`` blocks of ``h`` hours, each forecast from all before it.

    Blocks are counted from the end. A block's models come from sums of whole blocks and a running sum over blocks, so
    a series is ranked once and refit nowhere.
    """
    series = Window.partitionBy("unique_id")
    ranked = long.withColumn("__back", F.row_number().over(series.orderBy(F.col("ds").desc())) - 1)
    ranked = ranked.withColumn("block", F.floor(F.col("__back") / h).cast("int")).withColumn("place", h - 1 - F.col("__back") % h)
    blocks = ranked.groupBy("unique_id", "block").agg(F.sum("y").alias("s"), F.count("y").alias("n"), F.max("ds").alias("end"), F.max_by("y", "ds").alias("last"), F.map_from_entries(F.collect_list(F.struct("place", "y"))).alias("values"))
    older = series.orderBy(F.col("block").desc())
    before = older.rowsBetween(Window.unboundedPreceding, -1)
    fitted = blocks.select(
        "unique_id", "block", F.lag("end").over(older).alias("cutoff"), F.lag("last").over(older).alias("Naive"), F.try_divide(F.sum("s").over(before), F.sum("n").over(before)).alias("HistoricAverage"),
        F.lag(F.try_divide("s", "n")).over(older).alias("WindowAverage"), F.lag("values").over(older).alias("season"),
    ).where(F.col("block") < windows)
    return ranked.where(F.col("block") < windows).join(fitted, ["unique_id", "block"]).select("unique_id", "ds", "cutoff", "y", "Naive", "HistoricAverage", "WindowAverage", F.element_at("season", F.col("place")).alias("SeasonalNaive"))


def forecast_bands(forecast: DataFrame, value: str = "forecast", source: str = "source", step: str = "step", bands: Mapping[str, tuple[float, float]] = BANDS, temperature: str = "temp") -> DataFrame:
    """Adds lower and upper. The relative error grows with the step (from 0) over 24 hours and goes on beyond; the
    temperature has an absolute one. A negative forecast has its bounds the other way round."""
    i = F.col(step) / 24
    share: Column = F.lit(OTHER_BAND[0]) + F.lit(OTHER_BAND[1] - OTHER_BAND[0]) * i
    for name, (base, most) in bands.items():
        share = F.when(F.col(source) == name, F.lit(base) + F.lit(most - base) * i).otherwise(share)
    reach = F.when(F.col(source) == temperature, 0.5 + 0.5 * i).otherwise(F.col(value) * share)
    return forecast.withColumn("lower", F.col(value) - reach).withColumn("upper", F.col(value) + reach)


def pad_to_horizon(forecast: DataFrame, horizon: int, value: str, by: str = "unique_id", step: str = "step") -> DataFrame:
    """(by, step, value) for steps 1 to ``horizon``: the last forecast is repeated where steps are missing at the end, later steps go."""
    last = forecast.groupBy(by).agg(F.max_by(value, step).alias("__last"))
    steps = last.withColumn(step, F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    return steps.join(forecast.select(by, step, value), [by, step], "left").select(by, step, F.coalesce(F.col(value), F.col("__last")).alias(value))

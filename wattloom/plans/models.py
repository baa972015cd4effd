"""Queries over fitted models, folds of a sequence and streams; SQL where it can express them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.operators import ml
from wattloom.operators.arima import arima_rolling_origin, auto_arima
from wattloom.operators.autoregression import fit_autoregression
from wattloom.operators.forecast import holdout, rolling_origin
from wattloom.operators.reshape import melt
from wattloom.operators.timeseries import tolerance_runs
from wattloom.plans.frames import LONG_SQL, events, hourly, hourly_raw, long, rounded
from wattloom.schema import CONSUMPTION, FEATURES, SOURCES, TIMESTAMP
from wattloom.shared import shared_folder
from wattloom.streaming.hourly import hourly_means


def _trained(spark, d) -> ml.Trained:
    return ml.train_and_select(hourly_raw(spark, d), ("linear", "tree", "extra"))


def gbt_train_select(spark, d) -> DataFrame:
    """Validation errors per family, least first (the first is kept)."""
    trained = ml.train_and_select(hourly_raw(spark, d), ("hist", "leafwise"))
    return spark.createDataFrame(sorted(trained.scores, key=lambda s: s[1]), "family string, mae double, mse double")


def one_step_score(spark, d) -> DataFrame:
    done = _trained(spark, d).score(hourly_raw(spark, d))
    return done.select(TIMESTAMP, *[F.col("prediction")[i].alias(c) for i, c in enumerate(FEATURES)])


def recursive_forecast(spark, d) -> DataFrame:
    return _trained(spark, d).forecast(hourly_raw(spark, d), 24)


def backtest_24h(spark, d) -> DataFrame:
    """Errors per column of a recursive forecast of the last day."""
    gap = F.col("actual") - F.col("forecast")
    return _trained(spark, d).backtest(hourly_raw(spark, d), 24).groupBy("column").agg(F.avg(F.abs(gap)).alias("mae"), F.avg(gap * gap).alias("mse"))


def model_zoo(spark, d) -> DataFrame:
    trained = ml.train_and_select(hourly_raw(spark, d), ("tree", "extra", "gbt", "hist", "leafwise", "linear"))
    return spark.createDataFrame(sorted(trained.scores, key=lambda s: s[1]), "family string, mae double, mse double")


def _choices(spark, found, score: str) -> DataFrame:
    return spark.createDataFrame([(str(sorted(p.items())), m) for p, m in found], f"parameters string, {score} double")


def grid_search(spark, d) -> DataFrame:
    """The whole grid over three folds, for consumption."""
    return _choices(spark, ml.grid_search(hourly(spark, d), (CONSUMPTION,)), "r2")


def guided_search(spark, d) -> DataFrame:
    """Thirty guided tries over three expanding folds."""
    space = {"maxDepth": (2, 10), "minInstancesPerNode": (1, 20), "minInfoGain": (1e-6, 1e-2, "log")}
    return _choices(spark, ml.guided_search(hourly(spark, d), CONSUMPTION, space, family="tree"), "mae")


def run_length_tolerance(spark, d) -> DataFrame:
    return rounded(tolerance_runs(long(spark, d), "y", 5.0, "ds", ["unique_id"]))


def autoregression_24h(spark, d) -> DataFrame:
    return fit_autoregression(long(spark, d), lags=12, season=24, choose=True)


def _balance_series(spark, d) -> DataFrame:
    """(unique_id, ds, y) of consumption and total production."""
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in SOURCES), F.lit(0.0))
    return melt(hourly(spark, d).withColumn("production_totale", total), (CONSUMPTION, "production_totale"))


def _named(forecasts: DataFrame, name: str) -> DataFrame:
    order = F.concat_ws(",", "p", "d", "q", "sp", "sd", "sq")
    return forecasts.select("unique_id", "ds", *[c for c in ("cutoff",) if c in forecasts.columns], "step", F.col("forecast").alias(name), order.alias(f"{name}_order"))


def arima_24h(spark, d) -> DataFrame:
    """The last day of consumption and production, forecast by ARIMA without and with a season of a day, beside its values."""
    train, test = holdout(_balance_series(spark, d))
    models = _named(auto_arima(train), "ARIMA").join(_named(auto_arima(train, season=24), "SARIMA"), ["unique_id", "ds", "step"])
    return models.join(test, ["unique_id", "ds"])


def arima_back_test(spark, d) -> DataFrame:
    """The last 25 days of consumption and production, each forecast by models refitted on all before it, and by the day before."""
    series = _balance_series(spark, d)
    keys = ["unique_id", "ds", "cutoff"]
    models = _named(arima_rolling_origin(series), "ARIMA").join(_named(arima_rolling_origin(series, season=24), "SARIMA"), [*keys, "step"])
    return models.join(rolling_origin(series).select(*keys, "y", "SeasonalNaive"), keys)


def streaming_hourly_means(spark, d) -> DataFrame:
    """The event table as a stream of files, its hourly means as a table (an extension). Each run has a folder of its own."""
    schema = events(spark, d).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d) if not d.endswith("events.parquet") else spark.readStream.schema(schema).parquet(d)
    folder = f"{shared_folder(spark)}/hourly-means-{uuid.uuid4().hex}"

    def store(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/result/{number:09d}")

    # only hours that changed are sent, and closed ones leave the state; of an hour the newest batch counts
    run = hourly_means(stream, ["event_type"]).writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    try:
        run.awaitTermination()
    finally:
        run.stop()
    newest = spark.read.parquet(f"{folder}/result/*").groupBy(TIMESTAMP, "event_type").agg(F.max_by("n", "batch").alias("n"), F.max_by("mean_value", "batch").alias("mean_value"))
    return rounded(newest, 6)


MODELS = {f.__name__: f for f in (gbt_train_select, one_step_score, recursive_forecast, backtest_24h, model_zoo, grid_search, guided_search, run_length_tolerance, autoregression_24h, arima_24h, arima_back_test, streaming_hourly_means)}

MODEL_SQL = {
    "run_length_tolerance": f"""WITH RECURSIVE {LONG_SQL},
 N AS MATERIALIZED (SELECT unique_id, y, row_number() OVER (PARTITION BY unique_id ORDER BY ds) AS rn FROM L),
 R AS (SELECT unique_id, rn, 0 AS run, y AS run_start FROM N WHERE rn = 1
       UNION ALL SELECT n.unique_id, n.rn, r.run + CAST(abs(n.y - r.run_start) > 5.0 AS INTEGER), CASE WHEN abs(n.y - r.run_start) > 5.0 THEN n.y ELSE r.run_start END FROM R r JOIN N n ON n.unique_id = r.unique_id AND n.rn = r.rn + 1)
 SELECT unique_id, run, round(any_value(run_start), 9) AS run_start, CAST(count(*) AS INTEGER) AS length FROM R GROUP BY unique_id, run""",
    "streaming_hourly_means": "SELECT date_trunc('hour', ts) AS timestamp, event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY 1, 2",
}

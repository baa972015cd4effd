"""The SQL-expressible queries, each with its SQL beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattloom.functions.metrics import by_source, evaluate_long, mean_by_metric, rank_models
from wattloom.functions.scaling import fit_min_max
from wattloom.operators import analytics as A
from wattloom.operators import forecast as FC
from wattloom.operators import ranged as R
from wattloom.operators import timeseries as TS
from wattloom.operators.knn import fit_knn
from wattloom.operators.quality import ks_statistic, null_profile
from wattloom.operators.reshape import DAYS, assert_unique, inner_align, melt, pivot_first, pivot_hour_weekday
from wattloom.plans.frames import (
    BALANCE_SQL, H_SQL, HOLD_SQL, LONG_SQL, ORDERS_SQL, RAW_SQL, SERIES, daily_orders, events, hourly, hourly_raw, interpolate_sql, long, round_sql, rounded, table,
)
from wattloom.schema import CONSUMPTION, FEATURES, SOURCES, TEMPERATURE, TIMESTAMP, select_features
from wattloom.sources.readers import parse_generation

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
FEATURE_LIST = ", ".join(FEATURES)


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


# --- scans, projections, reshaping -----------------------------------------------------------------------------------


@query("SELECT event_id, ts AS timestamp, value AS BIOMASS FROM events WHERE event_type = 'click'")
def scan_project_rename(spark, d) -> DataFrame:
    return events(spark, d).where("event_type = 'click'").select("event_id", "ts", "value").withColumnsRenamed({"ts": TIMESTAMP, "value": "BIOMASS"})


@query(f"WITH {H_SQL} SELECT timestamp, {round_sql(FEATURES)} FROM H ORDER BY timestamp DESC LIMIT 36")
def tail_36_features(spark, d) -> DataFrame:
    return rounded(select_features(TS.tail(hourly(spark, d), 36), (TIMESTAMP, *FEATURES)))


@query("SELECT date_trunc('second', ts) AS timestamp, event_type AS production_type, value FROM events")
def json_extract_union(spark, d) -> DataFrame:
    # a document holds 1,000 events at most
    part = F.floor(F.monotonically_increasing_id() / 1000).alias("part")
    rows = events(spark, d).select("event_type", part, F.struct(F.concat(F.date_format(F.expr("ts + interval 2 hours"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00")).alias("start_date"), F.col("value")).alias("v"))
    series = rows.groupBy("part", "event_type").agg(F.collect_list("v").alias("values"))
    docs = series.groupBy("part").agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("event_type").alias("production_type"), "values")).alias("actual_generations_per_production_type"))).alias("value"))
    return parse_generation(docs)


@query(f"WITH {RAW_SQL} SELECT timestamp, round(BIOMASS, 9) AS BIOMASS FROM raw WHERE timestamp BETWEEN (SELECT min(timestamp) FROM raw) AND (SELECT max(timestamp) FROM raw)")
def hourly_spine_reindex(spark, d) -> DataFrame:
    rows = events(spark, d).withColumnRenamed("ts", TIMESTAMP)
    clicks = rows.where("event_type = 'click'").groupBy(TS.trunc("hour", TIMESTAMP).alias(TIMESTAMP)).agg(F.avg("value").alias("BIOMASS"))
    return rounded(TS.reindex(clicks, TS.spine(rows)))


@query("""WITH b AS (SELECT min(o_orderdate) AS a, max(o_orderdate) AS b FROM orders),
 s AS (SELECT unnest(generate_series(a, b - INTERVAL 1 MICROSECOND, INTERVAL 180 DAY)) AS chunk_start, b FROM b)
 SELECT CAST(chunk_start AS TIMESTAMP) AS chunk_start, CAST(least(chunk_start + INTERVAL 180 DAY, b) AS TIMESTAMP) AS chunk_end FROM s""")
def date_chunks_180d(spark, d) -> DataFrame:
    lo, hi = table(spark, d, "orders").agg(F.min("o_orderdate").cast("timestamp_ntz"), F.max("o_orderdate").cast("timestamp_ntz")).first()
    return TS.date_chunks(spark, str(lo), str(hi), 180)


@query(f"WITH {RAW_SQL} SELECT CAST(i AS INTEGER) AS step, (SELECT max(timestamp) FROM raw) + to_hours(i) AS timestamp FROM range(1, 73) t(i)")
def future_timestamps_72h(spark, d) -> DataFrame:
    return TS.future_timestamps(hourly_raw(spark, d), 72)


@query(f"WITH {BALANCE_SQL} SELECT timestamp, {round_sql(('production_totale', 'deficit'))} FROM B")
def energy_deficit(spark, d) -> DataFrame:
    return rounded(A.energy_balance(hourly(spark, d)).select(TIMESTAMP, "production_totale", "deficit"))


@query(f"""WITH {BALANCE_SQL} SELECT timestamp, round(deficit / greatest({CONSUMPTION}, 1e-8) * 100, 6) AS deficit_percentage,
 CASE WHEN deficit >= 0 THEN 'surplus' ELSE 'deficit' END AS balance FROM B""")
def deficit_percentage_class(spark, d) -> DataFrame:
    return rounded(A.deficit_percentage(A.energy_balance(hourly(spark, d))).select(TIMESTAMP, "deficit_percentage", "balance"), 6)


@query(f"WITH {LONG_SQL} SELECT unique_id, ds, round(y, 9) AS y FROM L")
def melt_long(spark, d) -> DataFrame:
    return rounded(melt(hourly(spark, d), FEATURES)).orderBy("unique_id", "ds")


@query(f"WITH {LONG_SQL} SELECT unique_id, ds, round(y, 9) AS y FROM L WHERE unique_id IN ('SOLAR', '{CONSUMPTION}')")
def series_in_filter(spark, d) -> DataFrame:
    return rounded(long(spark, d).where(F.col("unique_id").isin("SOLAR", CONSUMPTION)))


@query(f"WITH {LONG_SQL} SELECT unique_id, ds, round(y, 9) AS y, row_number() OVER (PARTITION BY unique_id ORDER BY ds DESC) <= 24 AS is_tail FROM L")
def holdout_tail_per_series(spark, d) -> DataFrame:
    return rounded(TS.tail_per_series(long(spark, d), 24, ["unique_id"], "ds"))


@query("SELECT date_trunc('hour', ts) AS timestamp, " + ", ".join(f"arg_min(value, (ts, event_id)) FILTER (event_type = '{t}') AS \"{t}\"" for t in SERIES.values()) + " FROM events WHERE value IS NOT NULL GROUP BY 1")
def pivot_first_by_type(spark, d) -> DataFrame:
    rows = events(spark, d).withColumn(TIMESTAMP, TS.trunc("hour", "ts"))
    return pivot_first(rows, list(SERIES.values()), "event_type", "value", ["ts", "event_id"])


@query(f"WITH {H_SQL} SELECT CAST(hour(timestamp) AS INTEGER) AS hour, " + ", ".join(f'round(avg({CONSUMPTION}) FILTER (isodow(timestamp) = {i + 1}), 9) AS "{n}"' for i, n in enumerate(DAYS)) + " FROM H GROUP BY 1")
def pivot_hour_weekday_mean(spark, d) -> DataFrame:
    return rounded(pivot_hour_weekday(hourly(spark, d), CONSUMPTION))


@query(f"WITH {RAW_SQL} " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS n_rows, count(*) - count({c}) AS n_null FROM raw" for c in FEATURES))
def null_profile_hourly(spark, d) -> DataFrame:
    return null_profile(hourly_raw(spark, d), FEATURES)


# --- joins -----------------------------------------------------------------------------------------------------------

_SIDES = ", ".join(f"f{i} AS (SELECT h AS timestamp, avg(value) AS {c} FROM e WHERE event_type = '{t}' GROUP BY h)" for i, (c, t) in enumerate(SERIES.items()))


@query(f"WITH {RAW_SQL}, {_SIDES} SELECT timestamp, {round_sql(SERIES)} FROM f0 JOIN f1 USING (timestamp) JOIN f2 USING (timestamp) JOIN f3 USING (timestamp) JOIN f4 USING (timestamp)")
def inner_align_series(spark, d) -> DataFrame:
    rows = events(spark, d).withColumn(TIMESTAMP, TS.trunc("hour", "ts"))
    frames = [rows.where(F.col("event_type") == t).groupBy(TIMESTAMP).agg(F.avg("value").alias(c)) for c, t in SERIES.items()]
    return rounded(inner_align([assert_unique(f) for f in frames]))


@query(f"WITH {RAW_SQL} SELECT timestamp, {round_sql(FEATURES)} FROM raw")
def three_way_align(spark, d) -> DataFrame:
    raw = hourly_raw(spark, d)
    grid = TS.spine(raw)
    production, consumption, weather = raw.select(TIMESTAMP, *SOURCES), raw.select(TIMESTAMP, CONSUMPTION), raw.select(TIMESTAMP, TEMPERATURE)
    return rounded(TS.reindex(weather, TS.reindex(consumption, TS.reindex(production, grid))))


@query(f"WITH {HOLD_SQL} SELECT t.unique_id, t.ds, round(t.y, 9) AS y, round(P.Naive, 9) AS \"Naive\" FROM test t LEFT JOIN P ON t.unique_id = P.unique_id AND t.ds = P.ds")
def eval_left_merge(spark, d) -> DataFrame:
    train, test = FC.holdout(long(spark, d))
    return rounded(test.join(FC.baselines(train).select("unique_id", "ds", "Naive"), ["unique_id", "ds"], "left"))


@query(f"WITH {HOLD_SQL} SELECT t.unique_id, t.ds, round(t.y, 9) AS y, round(P.SeasonalNaive, 9) AS \"SeasonalNaive\" FROM test t JOIN P ON t.unique_id = P.unique_id AND t.ds = P.ds")
def eval_inner_merge(spark, d) -> DataFrame:
    train, test = FC.holdout(long(spark, d))
    return rounded(test.join(FC.baselines(train).select("unique_id", "ds", "SeasonalNaive"), ["unique_id", "ds"]))


# --- aggregations ----------------------------------------------------------------------------------------------------


@query(f"""WITH {BALANCE_SQL} SELECT round(avg({CONSUMPTION}), 9) AS mean_consumption, round({" + ".join(f"avg({c})" for c in SOURCES)}, 9) AS total_production,
 round(avg({TEMPERATURE}), 9) AS mean_temperature, round(avg(deficit), 9) AS mean_deficit FROM B""")
def overview_kpis(spark, d) -> DataFrame:
    return rounded(A.overview(hourly(spark, d)))


def _box_sql(prefix: str, source: str, by: str, value: str, digits: int) -> str:
    return f"""WITH {prefix}, v AS (SELECT {by}, {value} AS v FROM {source} WHERE {value} IS NOT NULL),
 q AS (SELECT {by.split(" AS ")[-1] if "," not in by else "g1, g2"}, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3 FROM v GROUP BY ALL)
 SELECT {by.split(" AS ")[-1] if "," not in by else "g1, g2"}, round(q1, {digits}) AS q1, round(median, {digits}) AS median, round(q3, {digits}) AS q3,
 round(min(v) FILTER (v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), {digits}) AS whisker_low, round(max(v) FILTER (v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), {digits}) AS whisker_high,
 count(*) FILTER (NOT v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers, count(*) AS n
 FROM v JOIN q USING ({by.split(" AS ")[-1] if "," not in by else "g1, g2"}) GROUP BY ALL"""


def _box(df: DataFrame, value: str, by, digits: int = 9) -> DataFrame:
    return rounded(A.box_statistics(df, value, by), digits)


@query(_box_sql(H_SQL, "H", "CAST(hour(timestamp) AS INTEGER) AS hour_of_day", CONSUMPTION, 9))
def box_by_hour(spark, d) -> DataFrame:
    return _box(hourly(spark, d).withColumn("hour_of_day", F.hour(TIMESTAMP)), CONSUMPTION, ["hour_of_day"])


@query(_box_sql(H_SQL, "H", "CAST(isodow(timestamp) - 1 AS INTEGER) AS day_of_week", CONSUMPTION, 9))
def box_by_weekday(spark, d) -> DataFrame:
    return _box(hourly(spark, d).withColumn("day_of_week", F.weekday(TIMESTAMP)), CONSUMPTION, ["day_of_week"])


@query(_box_sql(ORDERS_SQL, "D", "CAST(month(timestamp) AS INTEGER) AS month_of_year", "y", 4))
def box_by_month(spark, d) -> DataFrame:
    return _box(daily_orders(spark, d).withColumn("month_of_year", F.month(TIMESTAMP)), "y", ["month_of_year"], 4)


@query(_box_sql(LONG_SQL, "L", "unique_id AS g1, CAST(isodow(ds) - 1 AS INTEGER) AS g2", "y", 9))
def box_source_by_weekday(spark, d) -> DataFrame:
    return _box(long(spark, d).select(F.col("unique_id").alias("g1"), F.weekday("ds").alias("g2"), "y"), "y", ["g1", "g2"])


_SHIPPED = "S AS (SELECT l_returnflag, date_trunc('day', l_shipdate) AS timestamp, CAST(sum(l_quantity) AS DOUBLE) AS y FROM lineitem GROUP BY 1, 2)"


@query(_box_sql(_SHIPPED, "S", "l_returnflag AS g1, CAST(month(timestamp) AS INTEGER) AS g2", "y", 4))
def box_source_by_month(spark, d) -> DataFrame:
    shipped = table(spark, d, "lineitem").groupBy("l_returnflag", TS.trunc("day", "l_shipdate").alias(TIMESTAMP)).agg(F.sum("l_quantity").alias("y"))
    return _box(shipped.select(F.col("l_returnflag").alias("g1"), F.month(TIMESTAMP).alias("g2"), "y"), "y", ["g1", "g2"], 4)


_HAZEN = ", ".join(
    f"max(v) FILTER (i = floor({at})) + (max(v) FILTER (i = ceil({at})) - max(v) FILTER (i = floor({at}))) * any_value({at} - floor({at})) AS {name}"
    for name, at in ((name, f"greatest(0, least(n - 1, n * {p} - 0.5))") for name, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)))
)
_OUT = "q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)"


@query(f"""WITH v AS (SELECT event_type, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL),
 q AS (SELECT event_type, {_HAZEN} FROM v GROUP BY event_type)
 SELECT event_type, round(q1, 9) AS q1, round(median, 9) AS median, round(q3, 9) AS q3, round(min(v) FILTER (v BETWEEN {_OUT}), 9) AS whisker_low, round(max(v) FILTER (v BETWEEN {_OUT}), 9) AS whisker_high,
 count(*) FILTER (NOT v BETWEEN {_OUT}) AS outliers, count(*) AS n FROM v JOIN q USING (event_type) GROUP BY ALL""")
def box_by_event_type_hazen(spark, d) -> DataFrame:
    return rounded(A.box_statistics(events(spark, d), "value", ["event_type"], "hazen"))


_MEANS = H_SQL + ", M AS (" + " UNION ALL ".join(f"SELECT '{c}' AS source, avg({c}) AS mean_value FROM H" for c in SOURCES) + ")"


@query(f"WITH {_MEANS} SELECT source, round(mean_value, 9) AS mean_value, round(mean_value / sum(mean_value) OVER (), 9) AS share FROM M")
def production_mix_share(spark, d) -> DataFrame:
    return rounded(A.mix_share(hourly(spark, d)))


@query("SELECT strftime(l_shipdate, '%Y-%m') AS month, l_returnflag, coalesce(sum(l_quantity), 0) AS total FROM lineitem GROUP BY 1, 2")
def monthly_sum_by_source(spark, d) -> DataFrame:
    return A.sums_by_month(table(spark, d, "lineitem"), "l_quantity", ["l_returnflag"], "l_shipdate")


@query(f"WITH {RAW_SQL}, m AS (SELECT h, avg(value) AS value FROM e GROUP BY h) SELECT s.timestamp, round(value, 9) AS value FROM s LEFT JOIN m ON s.timestamp = m.h")
def hourly_resample_mean(spark, d) -> DataFrame:
    return rounded(TS.resample_mean(events(spark, d).withColumnRenamed("ts", TIMESTAMP), ["value"]))


@query(f"WITH {BALANCE_SQL} SELECT date_trunc('day', timestamp)::TIMESTAMP AS day, {', '.join(f'round(avg({c}), 9) AS {c}' for c in ('production_totale', CONSUMPTION, 'deficit'))} FROM B GROUP BY 1")
def daily_deficit_mean(spark, d) -> DataFrame:
    return rounded(A.daily_mean(A.energy_balance(hourly(spark, d)), ["production_totale", CONSUMPTION, "deficit"]))


def _histogram_sql(bins: int) -> str:
    return f"""WITH b AS (SELECT min(value) AS lo, (max(value) - min(value)) / {bins} AS w FROM events),
 n AS (SELECT CAST(least({bins - 1}, floor((value - lo) / w)) AS INTEGER) AS bin, lo, w FROM events, b WHERE value IS NOT NULL)
 SELECT bin, round(lo + bin * w, 9) AS lower, count(*) AS n FROM n GROUP BY bin, lo, w"""


@query(_histogram_sql(50))
def histogram_50(spark, d) -> DataFrame:
    return rounded(A.histogram(events(spark, d), "value", 50))


@query(_histogram_sql(30))
def histogram_30(spark, d) -> DataFrame:
    return rounded(A.histogram(events(spark, d), "value", 30))


@query(f"WITH {H_SQL} " + " UNION ALL ".join(f"SELECT '{c}' AS variable, round(corr({TEMPERATURE}, {c}), 9) AS correlation FROM H" for c in (CONSUMPTION, *SOURCES)))
def temp_correlations(spark, d) -> DataFrame:
    return rounded(A.correlations(hourly(spark, d), TEMPERATURE, (CONSUMPTION, *SOURCES)))


@query(f"WITH {H_SQL} SELECT round(regr_slope({CONSUMPTION}, {TEMPERATURE}), 8) AS slope, round(regr_intercept({CONSUMPTION}, {TEMPERATURE}), 8) AS intercept, round(regr_r2({CONSUMPTION}, {TEMPERATURE}), 8) AS r2 FROM H")
def ols_trend(spark, d) -> DataFrame:
    return rounded(A.ols(hourly(spark, d), TEMPERATURE, CONSUMPTION), 8)


@query(f"""WITH {LONG_SQL} SELECT unique_id AS "column", count(y) AS n, round(avg(y), 8) AS mean, round(stddev_samp(y), 8) AS std, round(stddev_pop(y), 8) AS std_pop, round(min(y), 8) AS min,
 round(quantile_cont(y, 0.25), 8) AS q1, round(quantile_cont(y, 0.5), 8) AS median, round(quantile_cont(y, 0.75), 8) AS q3, round(max(y), 8) AS max FROM L GROUP BY 1""")
def describe_exact(spark, d) -> DataFrame:
    return rounded(A.describe(hourly(spark, d), FEATURES), 8)


_WEEK = "T AS (SELECT * FROM H ORDER BY timestamp DESC LIMIT 168)"


@query(f"WITH {H_SQL}, {_WEEK} " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS n, round(stddev_samp({c}), 8) AS std FROM T" for c in FEATURES))
def tail_deviation_168(spark, d) -> DataFrame:
    return rounded(A.tail_deviation(hourly(spark, d), FEATURES, 168), 8)


_LAG = LONG_SQL + ", F AS (SELECT unique_id AS source, y, lag(y, 24) OVER (PARTITION BY unique_id ORDER BY ds) AS forecast FROM L)"


@query(f"""WITH {_LAG} SELECT source, round(avg(abs(y - forecast)), 8) AS mae, round(avg((y - forecast) * (y - forecast)), 8) AS mse, round(sqrt(avg((y - forecast) * (y - forecast))), 8) AS rmse,
 round(1 - sum((y - forecast) * (y - forecast)) / (var_pop(y) * count(*)), 8) AS r2 FROM F WHERE forecast IS NOT NULL GROUP BY source""")
def forecast_metrics_by_source(spark, d) -> DataFrame:
    past = F.lag("y", 24).over(Window.partitionBy("unique_id").orderBy("ds"))
    rows = long(spark, d).select(F.col("unique_id").alias("source"), "y", past.alias("forecast")).where("forecast is not null")
    return rounded(by_source(rows), 8)


@query(f"""WITH {LONG_SQL}, k AS (SELECT unique_id AS "column", y AS v, CASE WHEN ds < (SELECT min(ds) + (max(ds) - min(ds)) / 2 FROM L) THEN 1 ELSE 0 END AS a FROM L),
 t AS (SELECT "column", round(v, 6) AS v, sum(a) AS a, sum(1 - a) AS b FROM k GROUP BY 1, 2),
 c AS (SELECT "column", sum(a) OVER (PARTITION BY "column" ORDER BY v) AS ca, sum(b) OVER (PARTITION BY "column" ORDER BY v) AS cb, sum(a) OVER (PARTITION BY "column") AS na, sum(b) OVER (PARTITION BY "column") AS nb FROM t)
 SELECT "column", CAST(any_value(na) AS BIGINT) AS n_base, CAST(any_value(nb) AS BIGINT) AS n_current, round(max(abs(ca / na - cb / nb)), 9) AS d FROM c GROUP BY 1""")
def ks_drift_statistic(spark, d) -> DataFrame:
    frame = rounded(hourly(spark, d), 6)
    lo, hi = frame.agg(F.min(TIMESTAMP), F.max(TIMESTAMP)).first()
    middle = F.lit(lo + (hi - lo) / 2).cast("timestamp_ntz")
    return rounded(ks_statistic(frame.where(F.col(TIMESTAMP) < middle), frame.where(F.col(TIMESTAMP) >= middle), FEATURES))


# --- forecasts and evaluation ----------------------------------------------------------------------------------------

_EVAL = HOLD_SQL + ", EV AS (SELECT t.unique_id, 'mae' AS metric, " + ", ".join(f"avg(abs(t.y - P.{m})) AS {m}" for m in FC.MODELS) + " FROM test t JOIN P ON t.unique_id = P.unique_id AND t.ds = P.ds GROUP BY 1)"


def _evaluated(spark, d) -> DataFrame:
    train, test = FC.holdout(long(spark, d))
    return evaluate_long(test.join(FC.baselines(train), ["unique_id", "ds"]), FC.MODELS)


@query(f"WITH {_EVAL} SELECT unique_id, metric, {round_sql(FC.MODELS, 8)} FROM EV")
def evaluate_mae_long(spark, d) -> DataFrame:
    return rounded(_evaluated(spark, d), 8)


_MEAN_SCORES = _EVAL + ", SC AS (" + " UNION ALL ".join(f"SELECT 'mae' AS metric, '{m}' AS model, avg({m}) AS score, {i} AS o FROM EV" for i, m in enumerate(FC.MODELS)) + ")"


@query(f"WITH {_MEAN_SCORES} SELECT metric, model, round(score, 8) AS score, CAST(row_number() OVER (ORDER BY score, o) AS INTEGER) AS place FROM SC")
def rank_models_by_mae(spark, d) -> DataFrame:
    return rounded(rank_models(mean_by_metric(_evaluated(spark, d), FC.MODELS), FC.MODELS), 8)


@query(f"""WITH {BALANCE_SQL}, u AS (SELECT deficit AS v FROM B UNION ALL SELECT deficit * 1.1 FROM B UNION ALL SELECT deficit * 0.9 FROM B)
 SELECT round(min(v) - (max(v) - min(v)) * 0.1, 8) AS axis_low, round(max(v) + (max(v) - min(v)) * 0.1, 8) AS axis_high, round(greatest(abs(min(v)), abs(max(v))) * 1.1, 8) AS axis_symmetric FROM u""")
def axis_range_union(spark, d) -> DataFrame:
    balance = A.energy_balance(hourly(spark, d)).withColumn("upper", F.col("deficit") * 1.1).withColumn("lower", F.col("deficit") * 0.9)
    return rounded(A.axis_range([(balance, "deficit"), (balance, "upper"), (balance, "lower")]), 8)


_WINDOWS = H_SQL + """, r AS (SELECT *, row_number() OVER (ORDER BY timestamp) AS rn, count(*) OVER () AS n FROM H)"""


@query(f"""WITH {_WINDOWS} SELECT timestamp, CAST(count(*) OVER (ORDER BY timestamp ROWS BETWEEN 36 PRECEDING AND 1 PRECEDING) AS INTEGER) AS lookback,
 round(sum({CONSUMPTION}) OVER (ORDER BY timestamp ROWS BETWEEN 36 PRECEDING AND 1 PRECEDING), 6) AS sum_consumption,
 round(lag(BIOMASS, 36) OVER (ORDER BY timestamp), 9) AS first_biomass, round(lag({TEMPERATURE}, 1) OVER (ORDER BY timestamp), 9) AS last_temp, round(SOLAR, 9) AS y_solar
 FROM r QUALIFY rn > 36 AND rn <= n - 1""")
def lag_windows_36_1(spark, d) -> DataFrame:
    made = TS.lag_windows(hourly(spark, d), FEATURES, 36, 1)
    at = {c: i for i, c in enumerate(FEATURES)}
    return made.select(
        TIMESTAMP, F.size("x").alias("lookback"), F.round(F.aggregate("x", F.lit(0.0), lambda a, r: a + r[at[CONSUMPTION]]), 6).alias("sum_consumption"),
        F.round(F.col("x")[0][at["BIOMASS"]], 9).alias("first_biomass"), F.round(F.element_at("x", -1)[at[TEMPERATURE]], 9).alias("last_temp"), F.round(F.col("y")[0][at["SOLAR"]], 9).alias("y_solar"),
    )


_MULTI = f"""{_WINDOWS}, w AS (SELECT timestamp, rn, round(sum({TEMPERATURE}) OVER (ORDER BY timestamp ROWS BETWEEN 120 PRECEDING AND 1 PRECEDING), 6) AS sum_temp, n,
 list({CONSUMPTION}) OVER (ORDER BY timestamp ROWS BETWEEN CURRENT ROW AND 47 FOLLOWING) AS y FROM r)"""


def _multi(spark, d) -> DataFrame:
    made = TS.lag_windows(hourly(spark, d), FEATURES, 120, 48, target=[CONSUMPTION])
    return made.select(TIMESTAMP, F.round(F.aggregate("x", F.lit(0.0), lambda a, r: a + r[FEATURES.index(TEMPERATURE)]), 6).alias("sum_temp"), F.flatten("y").alias("y"))


@query(f"WITH {_MULTI} SELECT timestamp, sum_temp, CAST(len(y) AS INTEGER) AS horizon, round(y[1], 9) AS first_y, round(y[48], 9) AS last_y FROM w WHERE rn > 120 AND rn <= n - 48")
def direct_multi_horizon_120_48(spark, d) -> DataFrame:
    return _multi(spark, d).select(TIMESTAMP, "sum_temp", F.size("y").alias("horizon"), F.round(F.col("y")[0], 9).alias("first_y"), F.round(F.col("y")[47], 9).alias("last_y"))


@query(f"WITH {_MULTI}, k AS (SELECT timestamp, y FROM w WHERE rn > 120 AND rn <= n - 48 AND (rn - 121) % 48 = 0) SELECT timestamp, CAST(i - 1 AS INTEGER) AS step, round(y[i], 9) AS y FROM k, range(1, 49) t(i)")
def strided_blocks(spark, d) -> DataFrame:
    return rounded(TS.strided(_multi(spark, d), 48).select(TIMESTAMP, F.posexplode("y").alias("step", "y")))


@query(f"WITH {H_SQL} SELECT timestamp, {round_sql(FEATURES)} FROM H")
def interpolate_both(spark, d) -> DataFrame:
    return rounded(hourly(spark, d))


@query(f"WITH {RAW_SQL}, K AS ({interpolate_sql('raw', both=False)}) SELECT timestamp, {round_sql(FEATURES)} FROM K")
def interpolate_forward(spark, d) -> DataFrame:
    return rounded(TS.interpolate(hourly_raw(spark, d), FEATURES, both=False))


# --- every event as a row of one long series, dealt in ranges ----------------------------------------------------------

_ONE = "O AS (SELECT event_id, value, CASE WHEN event_type = 'click' THEN value END AS click, row_number() OVER (ORDER BY ts, event_id) AS timestamp FROM events)"


def _one_series(spark, d) -> DataFrame:
    return events(spark, d).select("event_id", "value", F.when(F.col("event_type") == "click", F.col("value")).alias("click"), F.struct("ts", "event_id").alias(TIMESTAMP))


@query(f"WITH {_ONE}, K AS ({interpolate_sql('O', ('click',), keep='event_id')}) SELECT event_id, round(click, 9) AS click FROM K")
def interpolate_event_series(spark, d) -> DataFrame:
    return rounded(R.interpolate(_one_series(spark, d), ["click"]).select("event_id", "click"))


@query("""WITH r AS (SELECT event_id, value, row_number() OVER w AS rn, count(*) OVER () AS n, list(value) OVER (w ROWS BETWEEN 48 PRECEDING AND 1 PRECEDING) AS x, list(value) OVER (w ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING) AS y
 FROM events WINDOW w AS (ORDER BY ts, event_id)) SELECT event_id, round(list_sum(x), 6) AS sum_before, round(x[1], 9) AS first_before, round(list_sum(y), 6) AS sum_after FROM r
 WHERE rn > 48 AND rn <= n - 12""")
def lag_windows_event_series(spark, d) -> DataFrame:
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, r: a + r[0]), 6)
    made = R.lag_windows(_one_series(spark, d), ["value"], 48, 12)
    return made.select(F.col(f"{TIMESTAMP}.event_id").alias("event_id"), total("x").alias("sum_before"), F.round(F.col("x")[0][0], 9).alias("first_before"), total("y").alias("sum_after"))


@query("""WITH t AS (SELECT event_id, value AS observed, row_number() OVER o AS rn, CASE WHEN count(value) OVER w = 25 THEN (sum(value) OVER w - 0.5 * (first_value(value) OVER w + last_value(value) OVER w)) / 24 END AS trend
 FROM events WINDOW o AS (ORDER BY ts, event_id), w AS (ORDER BY ts, event_id ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING)),
 p AS (SELECT (rn - 1) % 24 AS phase, avg(observed - trend) AS m FROM t GROUP BY 1), q AS (SELECT phase, m - (SELECT avg(m) FROM p) AS seasonal FROM p)
 SELECT event_id, round(trend, 8) AS trend, round(seasonal, 8) AS seasonal, round(observed - trend - seasonal, 8) AS resid FROM t JOIN q ON (rn - 1) % 24 = phase""")
def seasonal_decompose_event_series(spark, d) -> DataFrame:
    return rounded(R.seasonal_decompose(_one_series(spark, d), "value", 24).select(F.col(f"{TIMESTAMP}.event_id").alias("event_id"), "trend", "seasonal", "resid"), 8)


@query(f"""WITH {RAW_SQL}, r AS (SELECT timestamp, row_number() OVER (ORDER BY timestamp) AS rn, count(*) OVER () AS n FROM raw), t AS (SELECT *, n - ceil(round(0.2 * n, 9)) AS train FROM r)
 SELECT timestamp, CASE WHEN rn > train THEN 'test' WHEN rn > train - ceil(round(0.1 * train, 9)) THEN 'valid' ELSE 'train' END AS split FROM t""")
def chronological_split(spark, d) -> DataFrame:
    return TS.chronological_split(hourly_raw(spark, d).select(TIMESTAMP))


@query(f"""WITH {_WINDOWS}, w AS (SELECT timestamp, row_number() OVER (ORDER BY timestamp) AS k, count(*) OVER () AS m FROM r WHERE rn > 36 AND rn <= n - 1), t AS (SELECT *, m - ceil(round(0.2 * m, 9)) AS train FROM w)
 SELECT timestamp, CASE WHEN k > train THEN 'test' WHEN k > train - ceil(round(0.1 * train, 9)) THEN 'valid' ELSE 'train' END AS split, 36 AS lookback FROM t""")
def chronological_split_windows(spark, d) -> DataFrame:
    made = TS.lag_windows(hourly(spark, d), FEATURES, 36, 1)
    return TS.chronological_split(made).select(TIMESTAMP, "split", F.size("x").alias("lookback"))


@query("SELECT timestamp, event_id, value FROM (SELECT date_trunc('hour', ts) AS timestamp, event_id, value, row_number() OVER (PARTITION BY date_trunc('hour', ts) ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1")
def dedup_first_sorted(spark, d) -> DataFrame:
    rows = events(spark, d).withColumn(TIMESTAMP, TS.trunc("hour", "ts"))
    return TS.first_per_time(rows, ["ts", "event_id"]).select(TIMESTAMP, "event_id", "value").orderBy(TIMESTAMP)


@query(f"""WITH {H_SQL}, t AS (SELECT timestamp, {CONSUMPTION} AS observed, row_number() OVER (ORDER BY timestamp) AS rn,
 CASE WHEN count({CONSUMPTION}) OVER w = 25 THEN (sum({CONSUMPTION}) OVER w - 0.5 * (first_value({CONSUMPTION}) OVER w + last_value({CONSUMPTION}) OVER w)) / 24 END AS trend
 FROM H WINDOW w AS (ORDER BY timestamp ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING)),
 p AS (SELECT (rn - 1) % 24 AS phase, avg(observed - trend) AS m FROM t GROUP BY 1), q AS (SELECT phase, m - (SELECT avg(m) FROM p) AS seasonal FROM p)
 SELECT timestamp, {round_sql(("observed", "trend", "seasonal"), 10)}, round(observed - trend - seasonal, 10) AS resid FROM t JOIN q ON (rn - 1) % 24 = phase""")
def seasonal_decompose_24(spark, d) -> DataFrame:
    return rounded(TS.seasonal_decompose(hourly(spark, d), CONSUMPTION, 24), 10)


_BASE_ALL = LONG_SQL + """, n AS (SELECT *, row_number() OVER (PARTITION BY unique_id ORDER BY ds DESC) AS b FROM L),
 fit AS (SELECT unique_id, max(ds) AS last, arg_max(y, ds) AS Naive, avg(y) AS HistoricAverage, avg(y) FILTER (b <= 24) AS WindowAverage FROM n GROUP BY unique_id),
 P AS (SELECT f.unique_id, f.last + to_hours(CAST(25 - n.b AS BIGINT)) AS ds, CAST(25 - n.b AS INTEGER) AS step, Naive, HistoricAverage, WindowAverage, n.y AS SeasonalNaive FROM fit f JOIN n ON f.unique_id = n.unique_id AND n.b <= 24)"""
_SHARE = "CASE unique_id " + " ".join(f"WHEN '{s}' THEN {a!r} + {b - a!r} * ((step - 1) / 24.0)" for s, (a, b) in FC.BANDS.items()) + " END"


@query(f"""WITH {_BASE_ALL}, g AS (SELECT unique_id AS source, step, SeasonalNaive AS forecast, CASE WHEN unique_id = '{TEMPERATURE}' THEN 0.5 + 0.5 * ((step - 1) / 24.0) ELSE SeasonalNaive * ({_SHARE}) END AS reach FROM P)
 SELECT source, step - 1 AS step, round(forecast, 8) AS forecast, round(forecast - reach, 8) AS lower, round(forecast + reach, 8) AS upper FROM g""")
def forecast_bands(spark, d) -> DataFrame:
    made = FC.baselines(long(spark, d)).select(F.col("unique_id").alias("source"), (F.col("step") - 1).alias("step"), F.col("SeasonalNaive").alias("forecast"))
    return rounded(FC.forecast_bands(made), 8)


@query(f"WITH {_BASE_ALL} SELECT unique_id, ds, step, {round_sql(FC.MODELS, 8)} FROM P")
def baseline_forecasts_24h(spark, d) -> DataFrame:
    return rounded(FC.baselines(long(spark, d)), 8)


@query(f"""WITH {LONG_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY unique_id ORDER BY ds DESC) - 1 AS b FROM L), k AS (SELECT *, CAST(b // 24 AS INTEGER) AS block FROM n),
 g AS (SELECT unique_id, block, max(ds) AS fin, arg_max(y, ds) AS last, sum(y) AS s, count(y) AS c FROM k GROUP BY 1, 2),
 f AS (SELECT unique_id, block, lag(fin) OVER o AS cutoff, lag(last) OVER o AS Naive, sum(s) OVER q / sum(c) OVER q AS HistoricAverage, lag(s / c) OVER o AS WindowAverage FROM g
  WINDOW o AS (PARTITION BY unique_id ORDER BY block DESC), q AS (PARTITION BY unique_id ORDER BY block DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
 SELECT k.unique_id, k.ds, f.cutoff, round(k.y, 8) AS y, {", ".join(f"round(f.{m}, 8) AS {m}" for m in FC.MODELS[:3])}, round(z.y, 8) AS SeasonalNaive
 FROM k JOIN f USING (unique_id, block) LEFT JOIN k z ON z.unique_id = k.unique_id AND z.b = k.b + 24 WHERE block < 25""")
def rolling_origin_cv(spark, d) -> DataFrame:
    return rounded(FC.rolling_origin(long(spark, d)), 8)


@query(f"""WITH {_BASE_ALL}, ids AS (SELECT DISTINCT unique_id FROM P), c AS (SELECT unique_id, arg_max(SeasonalNaive, step) AS last FROM P GROUP BY 1)
 SELECT ids.unique_id, CAST(i AS INTEGER) AS step, round(coalesce(P.SeasonalNaive, c.last), 8) AS forecast FROM ids CROSS JOIN range(1, 37) t(i) JOIN c ON c.unique_id = ids.unique_id LEFT JOIN P ON P.unique_id = ids.unique_id AND P.step = i""")
def pad_to_horizon_36(spark, d) -> DataFrame:
    made = FC.baselines(long(spark, d)).select("unique_id", "step", F.col("SeasonalNaive").alias("forecast"))
    return rounded(FC.pad_to_horizon(made, 36, "forecast"), 8)


@query(f"""WITH {_MEANS}, o AS (SELECT source, mean_value, row_number() OVER (ORDER BY mean_value DESC, source) AS p FROM M WHERE source <> 'SOLAR')
 SELECT source, round(mean_value, 8) AS mean_value, 0 AS place FROM M WHERE source = 'SOLAR' UNION ALL SELECT source, round(mean_value, 8), CAST(p AS INTEGER) FROM o WHERE p <= 3""")
def top3_sources(spark, d) -> DataFrame:
    return rounded(A.top_sources(hourly(spark, d)), 8)


@query(f"WITH {H_SQL} SELECT timestamp, {round_sql(FEATURES, 2)} FROM (SELECT * FROM H ORDER BY timestamp LIMIT 10 OFFSET 20)")
def paginate(spark, d) -> DataFrame:
    return rounded(A.page(hourly(spark, d), [TIMESTAMP], 2), 2)


@query("""SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS as_text, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CAST(hour(ts) AS INTEGER) AS hour, CAST(isodow(ts) - 1 AS INTEGER) AS weekday, dayname(ts) AS day_name,
 CAST(month(ts) AS INTEGER) AS month, strftime(ts, '%Y-%m') AS period, date_trunc('second', ts) + INTERVAL 6 HOUR AS later, concat(CAST(CAST(ts AS DATE) AS VARCHAR), ' 23:00') AS day_end, round(sqrt(abs(value)), 9) AS root,
 CAST(ceil(value) AS BIGINT) AS up FROM events""")
def timestamp_scalars(spark, d) -> DataFrame:
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    return events(spark, d).select(
        "event_id", text.alias("as_text"), F.substring_index(iso, "T", 1).alias("day"), F.hour("ts").alias("hour"), F.weekday("ts").alias("weekday"), F.date_format("ts", "EEEE").alias("day_name"), F.month("ts").alias("month"),
        F.date_format("ts", "yyyy-MM").alias("period"), (F.to_timestamp_ntz(text, F.lit("yyyy-MM-dd HH:mm:ss")) + F.make_dt_interval(hours=F.lit(6))).alias("later"),
        F.concat(F.to_date(text).cast("string"), F.lit(" 23:00")).alias("day_end"), F.round(F.sqrt(F.abs("value")), 9).alias("root"), F.ceil("value").alias("up"),
    )


_BOUNDS = ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in FEATURES)


@query(f"WITH {H_SQL}, b AS (SELECT {_BOUNDS} FROM H) SELECT timestamp, " + ", ".join(f"round(({c} - lo_{c}) / (hi_{c} - lo_{c}), 8) AS {c}, round({c}, 8) AS {c}_restored" for c in FEATURES) + " FROM H, b")
def minmax_scale_inverse(spark, d) -> DataFrame:
    frame = hourly(spark, d)
    scaler = fit_min_max(frame, FEATURES)
    scaled = scaler.transform(frame)
    return rounded(scaled.select(TIMESTAMP, *FEATURES, *[scaler.restored(F.col(c), c).alias(f"{c}_restored") for c in FEATURES]), 8)


def _knn_sql() -> str:
    nans = lambda a, b: " + ".join(f"CASE WHEN {a}.{c} IS NOT NULL AND {b}.{c} IS NOT NULL THEN ({b}.{c} - {a}.{c}) * ({b}.{c} - {a}.{c}) ELSE 0 END" for c in FEATURES)
    both = " + ".join(f"CASE WHEN m.{c} IS NOT NULL AND d.{c} IS NOT NULL THEN 1 ELSE 0 END" for c in FEATURES)
    filled = [
        f"SELECT timestamp, '{c}' AS c, avg(v) AS v FROM (SELECT timestamp, v, row_number() OVER (PARTITION BY timestamp ORDER BY dist, donor) AS k FROM (SELECT m.timestamp, d.timestamp AS donor, d.{c} AS v, "
        f"sqrt(({nans('m', 'd')}) * ({len(FEATURES)}.0 / ({both}))) AS dist FROM t m, t d WHERE m.{c} IS NULL AND d.{c} IS NOT NULL AND ({both}) > 0)) WHERE k <= 3 GROUP BY timestamp"
        for c in FEATURES
    ]
    columns = ", ".join(f"round(coalesce(t.{c}, (SELECT v FROM f WHERE f.timestamp = t.timestamp AND f.c = '{c}'), (SELECT avg({c}) FROM t)), 8) AS {c}" for c in FEATURES)
    return f"WITH {RAW_SQL}, t AS (SELECT * FROM raw), f AS ({' UNION ALL '.join(filled)}) SELECT timestamp, {columns} FROM t"


@query(_knn_sql())
def knn_impute_k3(spark, d) -> DataFrame:
    frame = hourly_raw(spark, d)
    return rounded(fit_knn(frame).transform(frame), 8)

"""The frames that queries start from, over the tables of a folder, and the same in SQL.

``hourly_raw``: one row per hour from the first to the last event. The mean ``value`` of one event type stands for each
series, the mean of ``props.k`` for the temperature. ``hourly``: the same with gaps interpolated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.operators.reshape import melt
from wattloom.operators.timeseries import fill_units, interpolate, trunc
from wattloom.schema import CONSUMPTION, FEATURES, SOURCES, TEMPERATURE, TIMESTAMP

#: Event type that stands for each series.
SERIES = dict(zip((*SOURCES, CONSUMPTION), ("click", "error", "purchase", "signup", "view"), strict=True))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def hourly_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.from_json("props", "k double")["k"]
    rows = events(spark, sf_dir).select(trunc("hour", "ts").alias(TIMESTAMP), "event_type", "value", k.alias("k"))
    means = rows.groupBy(TIMESTAMP).agg(*[F.avg(F.when(F.col("event_type") == t, F.col("value"))).alias(c) for c, t in SERIES.items()], F.avg("k").alias(TEMPERATURE))
    return fill_units(means).select(TIMESTAMP, *FEATURES)


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolate(hourly_raw(spark, sf_dir), FEATURES)


def long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return melt(hourly(spark, sf_dir), FEATURES)


def daily_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(timestamp, y): order value per day; decimals keep the sum free of the order of its terms."""
    rows = table(spark, sf_dir, "orders")
    return rows.groupBy(trunc("day", "o_orderdate").alias(TIMESTAMP)).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("y"))


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Doubles rounded, so that the order of floating-point sums does not show."""
    return df.select(*[F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


# --- the same in SQL -------------------------------------------------------------------------------------------------

_AVG = ", ".join(f"avg(value) FILTER (event_type = '{t}') AS {c}" for c, t in SERIES.items())
RAW_SQL = f"""e AS (SELECT date_trunc('hour', ts) AS h, event_type, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events),
 a AS (SELECT h, {_AVG}, avg(k) AS {TEMPERATURE} FROM e GROUP BY h),
 s AS (SELECT unnest(generate_series((SELECT min(h) FROM e), (SELECT max(h) FROM e), INTERVAL 1 HOUR)) AS timestamp),
 raw AS (SELECT s.timestamp, {", ".join(FEATURES)} FROM s LEFT JOIN a ON s.timestamp = a.h)"""


def interpolate_sql(source: str, columns=FEATURES, both: bool = True, keep: str = "timestamp") -> str:
    """A SELECT with the columns of ``source`` interpolated in time."""
    back, ahead = "OVER (ORDER BY timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", "OVER (ORDER BY timestamp ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    seen = ", ".join(
        f"last_value({c} IGNORE NULLS) {back} AS pv_{c}, last_value(CASE WHEN {c} IS NOT NULL THEN rn END IGNORE NULLS) {back} AS pi_{c}, "
        f"first_value({c} IGNORE NULLS) {ahead} AS nv_{c}, first_value(CASE WHEN {c} IS NOT NULL THEN rn END IGNORE NULLS) {ahead} AS ni_{c}"
        for c in columns
    )
    lead = "nv_{c}" if both else "NULL"
    filled = ", ".join(f"coalesce({c}, CASE WHEN pv_{c} IS NULL THEN {lead.format(c=c)} WHEN nv_{c} IS NULL THEN pv_{c} ELSE pv_{c} + (nv_{c} - pv_{c}) * (rn - pi_{c}) / (ni_{c} - pi_{c}) END) AS {c}" for c in columns)
    return f"SELECT {keep}, {filled} FROM (SELECT *, {seen} FROM (SELECT *, row_number() OVER (ORDER BY timestamp) AS rn FROM {source}))"


H_SQL = f"{RAW_SQL}, H AS ({interpolate_sql('raw')})"
LONG_SQL = H_SQL + ", L AS (" + " UNION ALL ".join(f"SELECT '{c}' AS unique_id, timestamp AS ds, {c} AS y FROM H WHERE {c} IS NOT NULL" for c in FEATURES) + ")"
BALANCE_SQL = H_SQL + f", B AS (SELECT *, {' + '.join(f'coalesce({c}, 0)' for c in SOURCES)} AS production_totale, {' + '.join(f'coalesce({c}, 0)' for c in SOURCES)} - {CONSUMPTION} AS deficit FROM H)"
#: Last 24 hours of every series held out, and baselines fitted on the rest.
HOLD_SQL = LONG_SQL + """, n AS (SELECT *, row_number() OVER (PARTITION BY unique_id ORDER BY ds DESC) AS back FROM L),
 test AS (SELECT unique_id, ds, y, 25 - back AS step FROM n WHERE back <= 24), train AS (SELECT *, back - 24 AS b FROM n WHERE back > 24),
 fit AS (SELECT unique_id, max(ds) AS last, arg_max(y, ds) AS Naive, avg(y) AS HistoricAverage, avg(y) FILTER (b <= 24) AS WindowAverage FROM train GROUP BY unique_id),
 P AS (SELECT f.unique_id, f.last + to_hours(CAST(25 - t.b AS BIGINT)) AS ds, CAST(25 - t.b AS INTEGER) AS step, Naive, HistoricAverage, WindowAverage, t.y AS SeasonalNaive
       FROM fit f JOIN train t ON f.unique_id = t.unique_id AND t.b <= 24)"""
ORDERS_SQL = "D AS (SELECT date_trunc('day', o_orderdate) AS timestamp, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS y FROM orders GROUP BY 1)"


def round_sql(columns, digits: int = 9) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)

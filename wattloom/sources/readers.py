"""Readers and writers: CSV with a sniffed separator, one CSV per series, nested JSON, Parquet stores."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattloom.operators.quality import validation_gate
from wattloom.schema import CONSUMPTION_JSON, GENERATION_JSON, TIMESTAMP, missing_columns

SEPARATORS = (";", "\t", "|", ",")


def sniff_separator(spark: SparkSession, path: str) -> str:
    """The separator that the first line has most often; only that line is read."""
    head = spark.read.text(path).limit(1).collect()
    line = head[0][0] if head else ""
    best = max(SEPARATORS, key=line.count)
    return best if line.count(best) else ","


def read_series(spark: SparkSession, path: str, date_format: str = "yyyy-MM-dd HH:mm:ss", sep: str | None = None) -> DataFrame:
    """A CSV whose first column is the time and the others are numbers, as ``timestamp`` and double columns."""
    raw = spark.read.option("header", True).option("sep", sep or sniff_separator(spark, path)).csv(path)
    first, *values = raw.columns
    return raw.select(F.to_timestamp_ntz(F.col(f"`{first}`"), F.lit(date_format)).alias(TIMESTAMP), *[F.expr(f"try_cast(`{c}` AS double)").alias(c) for c in values])


def read_series_folder(spark: SparkSession, folder: str, value: str = "Production", date_format: str = "yyyy-MM-dd HH:mm:ss") -> DataFrame:
    """Every CSV of a folder as long rows (series, timestamp, value); the series is the file's stem."""
    raw = spark.read.option("header", True).option("sep", sniff_separator(spark, folder)).csv(f"{folder}/*.csv")
    first = raw.columns[0]
    return raw.select(
        F.regexp_replace(F.col("_metadata.file_name"), r"\.csv$", "").alias("series"), F.to_timestamp_ntz(F.col(f"`{first}`"), F.lit(date_format)).alias(TIMESTAMP),
        F.expr(f"try_cast(`{value}` AS double)").alias("value"),
    )


def utc(text: Column | str) -> Column:
    """ISO text with an offset as a UTC time without zone (the session zone must be UTC)."""
    return F.to_timestamp(text, "yyyy-MM-dd'T'HH:mm:ssXXX").cast("timestamp_ntz")


def parse_generation(raw: DataFrame, column: str = "value") -> DataFrame:
    """(timestamp, production_type, value) of nested generation JSON; entries without a date or a value are left out."""
    doc = raw.select(F.from_json(column, GENERATION_JSON).alias("j"))
    series = doc.select(F.inline("j.actual_generations_per_production_type"))
    rows = series.select("production_type", F.inline("values"))
    return rows.where("start_date <> '' and value is not null").select(utc("start_date").alias(TIMESTAMP), "production_type", "value")


def parse_consumption(raw: DataFrame, column: str = "value", name: str = "consommation_totale") -> DataFrame:
    """(timestamp, consumption) of nested consumption JSON: the first short-term block of each document."""
    doc = raw.select(F.from_json(column, CONSUMPTION_JSON).alias("j")).where("size(j.short_term) > 0")
    rows = doc.select(F.inline(F.col("j.short_term")[0]["values"]))
    return rows.where("start_date <> ''").select(utc("start_date").alias(TIMESTAMP), F.col("value").alias(name))


WEATHER_JSON = "data array<struct<time string, temp double, rhum double, prcp double, wspd double, pres double>>"


def parse_weather(raw: DataFrame, variable: str = "temp", column: str = "value") -> DataFrame:
    """(timestamp, variable) of hourly weather answers, whose times are UTC; the last answer that has an hour counts."""
    doc = raw.select(F.from_json(column, WEATHER_JSON).alias("j"), F.monotonically_increasing_id().alias("at")).where("j.data IS NOT NULL")
    rows = doc.select("at", F.inline("j.data")).where("time IS NOT NULL").select("at", F.col("time").try_cast("timestamp_ntz").alias(TIMESTAMP), F.col(variable).alias("v"))
    return rows.where(F.col(TIMESTAMP).isNotNull()).groupBy(TIMESTAMP).agg(F.max_by("v", "at").alias(variable))


def write_store(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The feature store: Parquet by year and month, so that time ranges prune folders."""
    df.withColumn("year", F.year(TIMESTAMP)).withColumn("month", F.month(TIMESTAMP)).write.mode(mode).partitionBy("year", "month").parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("year", "month")


def write_splits(df: DataFrame, path: str, split: str = "split", mode: str = "overwrite") -> None:
    """Train, validation and test rows of one frame, one folder each."""
    df.write.mode(mode).partitionBy(split).parquet(path)


def write_validated(base: DataFrame, current: DataFrame, path: str, schema: T.StructType, mode: str = "overwrite", **limits) -> tuple[DataFrame, bool]:
    """The result of ``validation_gate``; frames that have the columns are written, those of ``schema`` in its order, to valid/ or invalid/ and train/ or test/ below ``path``.

    Frames without the columns leave nothing, and the folder of the other outcome stays as it was.
    """
    report, passed = validation_gate(base, current, schema, **limits)
    if not any(missing_columns(df, schema.names) for df in (base, current)):
        for name, df in (("train", base), ("test", current)):
            df.select(*schema.names).write.mode(mode).parquet(f"{path}/{'valid' if passed else 'invalid'}/{name}")
    return report, passed


def write_windows(windows: DataFrame, path: str, ts: str = TIMESTAMP, mode: str = "overwrite") -> None:
    """Windows (ts, x, y) as Parquet arrays in ranges of time, so that a reader gets a span of time from few files."""
    windows.repartitionByRange(ts).sortWithinPartitions(ts).write.mode(mode).parquet(path)


def read_windows(spark: SparkSession, path: str, start: str | None = None, end: str | None = None, ts: str = TIMESTAMP) -> DataFrame:
    """Windows from ``start`` on and before ``end``; both bounds reach the scan."""
    made = spark.read.parquet(path)
    for bound, keep in ((start, lambda t, b: t >= b), (end, lambda t, b: t < b)):
        if bound is not None:
            made = made.where(keep(F.col(ts), F.lit(bound).cast("timestamp_ntz")))
    return made


def timed_records(spark: SparkSession, rows: list[Mapping], ts: str = TIMESTAMP, columns: list[str] | None = None) -> DataFrame:
    """Records of a request or a browser's store, each a mapping with a time as text, as (ts, double columns).

    Times with an offset become UTC (the session zone must be UTC), others are taken as they are; records whose time can't be read, or is missing, go. ``columns``
    are those of all records, in the order they come, unless they are given; what a record lacks is null.
    """
    names = columns or list(dict.fromkeys(c for r in rows for c in r if c != ts))
    values = [(None if r.get(ts) is None else str(r[ts]), *(None if r.get(c) is None else float(r[c]) for c in names)) for r in rows]
    raw = spark.createDataFrame(values, ", ".join(["__t string", *(f"`{c}` double" for c in names)]))
    text = F.regexp_replace("__t", " ", "T")
    offset = F.col("__t").rlike(r"(Z|[+-]\d\d:?\d\d)$")
    time = F.when(offset, text.try_cast("timestamp").cast("timestamp_ntz")).otherwise(text.try_cast("timestamp_ntz"))
    return raw.select(time.alias(ts), *[F.col(f"`{c}`") for c in names]).where(F.col(ts).isNotNull())


def records(spark: SparkSession, rows: list, columns: list[str], types: Mapping[str, str] | None = None) -> DataFrame:
    """Rows of a request (lists of numbers, oldest first) as a frame with a ``step`` column."""
    types = dict(types or {})
    schema = "step int, " + ", ".join(f"`{c}` {types.get(c, 'double')}" for c in columns)
    cast = lambda v, c: v if v is None or c in types else float(v)
    return spark.createDataFrame([(i, *(cast(v, c) for v, c in zip(r, columns, strict=True))) for i, r in enumerate(rows)], schema)

"""Ordered operators on time series.

Every operator takes ``by``: the columns of a series. Without it the frame is one series and its windows need one
task, which suits an hourly frame (8,760 rows a year); longer series take the operators of ``ranged``.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wattloom.operators.quantiles import same_keys
from wattloom.schema import TIMESTAMP


def trunc(unit: str, column: Column | str) -> Column:
    """``date_trunc`` that keeps a time without zone."""
    return F.date_trunc(unit, column).cast("timestamp_ntz")


def spine(df: DataFrame, ts: str = TIMESTAMP, unit: str = "hour", by: Sequence[str] = ()) -> DataFrame:
    """Every ``unit`` from the first to the last time of each series."""
    ends = df.groupBy(*by).agg(F.min(trunc(unit, ts)).alias("lo"), F.max(trunc(unit, ts)).alias("hi")).where("lo is not null")
    return ends.select(*by, F.explode(F.expr(f"sequence(lo, hi, interval 1 {unit})")).alias(ts))


def resample_mean(df: DataFrame, columns: Sequence[str], unit: str = "hour", ts: str = TIMESTAMP, by: Sequence[str] = ()) -> DataFrame:
    """Means per ``unit``; units without rows are there with nulls."""
    grid = spine(df, ts, unit, by)
    means = df.groupBy(*by, trunc(unit, ts).alias(ts)).agg(*[F.avg(c).alias(c) for c in columns])
    return grid.join(means, [*by, ts], "left")


def reindex(df: DataFrame, grid: DataFrame, ts: str = TIMESTAMP, by: Sequence[str] = ()) -> DataFrame:
    """``df`` on the times of ``grid``: other rows go, missing times are null."""
    return grid.join(df, [*by, ts], "left")


def between(c: str, p: Column, n: Column, rn: Column, both: bool) -> Column:
    """Column ``c`` of row ``rn``, or what lies there between the nearest known values ``p`` and ``n``, structs of value v and number i."""
    line = p["v"] + (n["v"] - p["v"]) * (rn - p["i"]) / (n["i"] - p["i"])
    return F.coalesce(F.col(c), F.when(p.isNull(), n["v"] if both else F.lit(None)).when(n.isNull(), p["v"]).otherwise(line))


def fill_units(df: DataFrame, ts: str = TIMESTAMP, unit: str = "hour", by: Sequence[str] = ()) -> DataFrame:
    """``df`` with a row of nulls for every ``unit`` that a series lacks between its first and last; one pass, where ``spine`` and a join read ``df`` twice.

    ``df`` has one row per unit at most; rows without a time go.
    """
    step = F.expr(f"interval 1 {unit}")
    following = F.lead(ts).over(Window.partitionBy(*by).orderBy(ts))
    every = df.withColumn("__t", F.sequence(F.col(ts), F.coalesce(following - step, F.col(ts)), step)).withColumn("__t", F.explode("__t"))
    own = F.col("__t") == F.col(ts)
    return every.select(*[F.col("__t").alias(c) if c == ts else F.col(c) if c in by else F.when(own, F.col(c)).alias(c) for c in df.columns])


def interpolate(df: DataFrame, columns: Sequence[str], ts: str = TIMESTAMP, both: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """Linear by row position; after the last value it is kept, and with ``both`` also carried back before the first."""
    order = Window.partitionBy(*by).orderBy(ts)
    back = order.rowsBetween(Window.unboundedPreceding, 0)
    # the same frame from the other end: one up to the last row would start anew at every row
    ahead = Window.partitionBy(*by).orderBy(F.col("__rn").desc()).rowsBetween(Window.unboundedPreceding, 0)
    known = df.withColumn("__rn", F.row_number().over(order))
    seen = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("v"), F.col("__rn").alias("i")))
    for c in columns:
        known = known.withColumn(f"__p_{c}", F.last(seen(c), True).over(back)).withColumn(f"__n_{c}", F.last(seen(c), True).over(ahead))
    return known.select(*[between(c, F.col(f"__p_{c}"), F.col(f"__n_{c}"), F.col("__rn"), both).alias(c) if c in columns else F.col(c) for c in df.columns])


def first_per_time(df: DataFrame, order: Sequence[str], ts: str = TIMESTAMP, by: Sequence[str] = ()) -> DataFrame:
    """Of rows with one time, the first that came (``order`` is the order of arrival)."""
    arrival = Window.partitionBy(*by, ts).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(arrival)).where("__rn = 1").drop("__rn")


def lag_windows(df: DataFrame, columns: Sequence[str], lookback: int = 36, horizon: int = 1, drop_last: bool = True, target: Sequence[str] | None = None, ts: str = TIMESTAMP, by: Sequence[str] = ()) -> DataFrame:
    """(ts, x, y): x holds the ``lookback`` rows before a time, y the ``horizon`` rows from it on, each an array per row.

    There are n - lookback - horizon windows, one less than fit; ``drop_last=False`` keeps that one too. ``target``
    limits the columns of y.
    """
    order = Window.partitionBy(*by).orderBy(ts)
    row = lambda names: F.array(*[F.col(c) for c in names])
    wide = df.select(
        *by, ts, F.row_number().over(order).alias("__rn"), F.count(F.lit(1)).over(Window.partitionBy(*by)).alias("__n"),
        F.collect_list(row(columns)).over(order.rowsBetween(-lookback, -1)).alias("x"), F.collect_list(row(target or columns)).over(order.rowsBetween(0, horizon - 1)).alias("y"),
    )
    return wide.where((F.col("__rn") > lookback) & (F.col("__rn") <= F.col("__n") - horizon + (0 if drop_last else 1))).drop("__rn", "__n")


def split_part(rn: Column, n: Column, test: float, valid: float) -> Column:
    """The part that row ``rn`` of ``n`` belongs to; shares round up."""
    share = lambda s, m: F.ceil(F.round(F.lit(s) * m, 9))
    train = n - share(test, n)
    return F.when(rn > train, "test").when(rn > train - share(valid, train), "valid").otherwise("train")


def chronological_split(df: DataFrame, test: float = 0.2, valid: float = 0.1, ts: str = TIMESTAMP, by: Sequence[str] = ()) -> DataFrame:
    """Adds ``split``: the last rows are the test part, the last of the others the validation part; shares round up."""
    order, whole = Window.partitionBy(*by).orderBy(ts), Window.partitionBy(*by)
    ranked = df.withColumn("__rn", F.row_number().over(order)).withColumn("__n", F.count(F.lit(1)).over(whole))
    return ranked.withColumn("split", split_part(F.col("__rn"), F.col("__n"), test, valid)).drop("__rn", "__n")


def centred_mean(value: str, period: int, order) -> Column:
    """Mean of one period around a row, half weights at both ends if it is even; null where the frame is not whole."""
    half = period // 2
    frame = order.rowsBetween(-half, half)
    ends = F.first(value).over(frame) + F.last(value).over(frame)
    total = F.sum(value).over(frame)
    trend = (total - 0.5 * ends) / period if period % 2 == 0 else total / period
    return F.when(F.count(value).over(frame) == 2 * half + 1, trend)


def with_seasons(full: DataFrame, value: str, ts: str, by: Sequence[str]) -> DataFrame:
    """(by, ts, observed, trend, seasonal, resid) from rows with ``trend`` and ``__phase``."""
    means = full.groupBy(*by, "__phase").agg(F.avg(F.col(value) - F.col("trend")).alias("__m"))
    centred = means.withColumn("seasonal", F.col("__m") - F.avg("__m").over(Window.partitionBy(*by))).drop("__m")
    joined = same_keys(full, centred, [*by, "__phase"])
    return joined.select(*by, ts, F.col(value).alias("observed"), "trend", "seasonal", (F.col(value) - F.col("trend") - F.col("seasonal")).alias("resid"))


def seasonal_decompose(df: DataFrame, value: str, period: int = 24, ts: str = TIMESTAMP, by: Sequence[str] = ()) -> DataFrame:
    """Additive: (ts, observed, trend, seasonal, resid). The trend is a centred mean of one period (half weights at both
    ends if it is even), null where the frame is not whole; a series of less than two periods is an error in the phase
    means and gives nulls."""
    order = Window.partitionBy(*by).orderBy(ts)
    full = df.withColumn("__rn", F.row_number().over(order)).withColumn("trend", centred_mean(value, period, order))
    return with_seasons(full.withColumn("__phase", (F.col("__rn") - 1) % period), value, ts, by)


def date_chunks(spark: SparkSession, start: str, end: str, days: int = 180) -> DataFrame:
    """(chunk_start, chunk_end): steps of ``days`` days from ``start``; the last one ends at ``end``."""
    steps = spark.range(1).select(F.expr(f"timestamp_ntz'{start}'").alias("a"), F.expr(f"timestamp_ntz'{end}'").alias("b"))
    starts = steps.select("b", F.explode(F.expr(f"if(a < b, sequence(a, greatest(a, b - interval 1 microsecond), interval {days} day), array())")).alias("chunk_start"))
    return starts.select("chunk_start", F.least(F.expr(f"chunk_start + interval {days} day"), F.col("b")).alias("chunk_end"))


def future_timestamps(df: DataFrame, n: int, ts: str = TIMESTAMP) -> DataFrame:
    """(step, ts): the ``n`` hours after the last time."""
    last = df.agg(F.max(ts).alias("last"))
    return last.select(F.posexplode(F.expr(f"transform(sequence(1, {n}), i -> last + make_dt_interval(0, i))")).alias("step", ts)).withColumn("step", F.col("step") + 1)


def tail(df: DataFrame, n: int, ts: str = TIMESTAMP) -> DataFrame:
    """The last ``n`` rows in time."""
    return df.orderBy(F.col(ts).desc()).limit(n)


def tail_per_series(df: DataFrame, n: int, by: Sequence[str], ts: str = TIMESTAMP) -> DataFrame:
    """Adds ``is_tail``: whether a row is one of the last ``n`` of its series."""
    order = Window.partitionBy(*by).orderBy(F.col(ts).desc())
    return df.withColumn("is_tail", F.row_number().over(order) <= n)


def strided(df: DataFrame, n: int, ts: str = TIMESTAMP, by: Sequence[str] = ()) -> DataFrame:
    """Every ``n``-th row, the first included."""
    order = Window.partitionBy(*by).orderBy(ts)
    return df.withColumn("__rn", F.row_number().over(order)).where(f"(__rn - 1) % {n} = 0").drop("__rn")


def tolerance_runs(df: DataFrame, value: str, tolerance: float = 0.01, ts: str = TIMESTAMP, by: Sequence[str] = ()) -> DataFrame:
    """(run, run_start, length): a new run begins when a value is more than ``tolerance`` from its run's first value.

    Each run depends on where the one before began, so a series is read in order by one task, which keeps its open run
    and nothing else; ``by`` spreads series over tasks. Null values are left out.
    """
    keys = list(by)
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(ts).alias("__t"), F.col(value).cast("double").alias("__v"))
    dealt = rows.repartition(*keys) if keys else rows.repartition(1)
    kinds = ", ".join(f"`{c}` {dict(df.dtypes)[c]}" for c in keys)
    names = [*keys, "run", "run_start", "length"]

    def fold(frames):
        series, run, start, length = None, 0, 0.0, 0
        for pdf in frames:
            out = []
            ids = list(zip(*(pdf[c].tolist() for c in keys), strict=True)) if keys else [()] * len(pdf)
            for now, v in zip(ids, pdf["__v"].tolist(), strict=True):
                if length and now == series and abs(v - start) <= tolerance:
                    length += 1
                    continue
                if length:
                    out.append((*series, run, start, length))
                run, series, start, length = (run + 1 if length and now == series else 0), now, v, 1
            yield pd.DataFrame(out, columns=names)
        if length:
            yield pd.DataFrame([(*series, run, start, length)], columns=names)

    return dealt.sortWithinPartitions(*keys, "__t").mapInPandas(fold, (kinds + ", " if keys else "") + "run int, run_start double, length int")

"""The ordered operators of ``timeseries`` for series that no task can hold.

Rows are dealt in ranges of (by, time). A range learns what the others hold from one row of totals per range and series: how many rows
come before it, and the last and next known values around it. Windows that look a fixed number of rows back or ahead go over blocks
of numbered rows, which bring the rows next to them along (a halo). Results are those of ``timeseries``; times must not repeat within a
series (``ts`` may be a struct that tells rows of one time apart). Null times and null keys sort first and are kept.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattloom.operators import timeseries as TS
from wattloom.operators.quantiles import same_keys
from wattloom.schema import TIMESTAMP
from wattloom.shared import cut


def numbered(df: DataFrame, ts: str = TIMESTAMP, by: Sequence[str] = (), known: Sequence[str] = ()) -> DataFrame:
    """Adds ``__rn``, the number of a row in its series from 1, ``__n``, the rows of the series, and ``__range``.

    For each column c of ``known``: ``__before_c`` and ``__after_c``, the nearest known value (v) and its number (i) in the ranges before
    and after this one.
    """
    ranged = cut(df.repartitionByRange(*by, ts).withColumn("__range", F.spark_partition_id()))
    ranged = ranged.withColumn("__in", F.row_number().over(Window.partitionBy("__range", *by).orderBy(ts)))
    seen = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col("__in").cast("long").alias("i"), F.col(c).alias("v")))
    ends = [f(seen(c)).alias(f"{name}{c}") for c in known for f, name in ((F.max, "__l_"), (F.min, "__f_"))]
    totals = ranged.groupBy("__range", *by).agg(F.count(F.lit(1)).alias("__k"), *ends)
    order = Window.partitionBy(*by).orderBy("__range")
    back, ahead = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    totals = totals.withColumn("__base", F.coalesce(F.sum("__k").over(back), F.lit(0)))
    moved = lambda s: F.when(F.col(s).isNotNull(), F.struct((F.col(s)["i"] + F.col("__base")).alias("i"), F.col(s)["v"].alias("v")))
    carried = [c for k in known for c in (F.last(moved(f"__l_{k}"), True).over(back).alias(f"__before_{k}"), F.first(moved(f"__f_{k}"), True).over(ahead).alias(f"__after_{k}"))]
    totals = totals.select("__range", *by, "__base", F.sum("__k").over(Window.partitionBy(*by)).alias("__n"), *carried)
    # without keys there is one row of totals per partition
    joined = same_keys(ranged, totals if by else F.broadcast(totals), ["__range", *by])
    return joined.withColumn("__rn", F.col("__base") + F.col("__in")).drop("__base", "__in")


def haloed(rows: DataFrame, before: int, after: int, block: int) -> tuple[DataFrame, Column]:
    """Numbered rows in blocks (``__block``), each with the ``before`` rows before it and the ``after`` rows after it; and whether a row is a block's own."""
    size = max(block, before, after, 1)
    at, place = F.floor((F.col("__rn") - 1) / size), (F.col("__rn") - 1) % size
    copies = F.array_compact(F.array(at, F.when(place >= size - before, at + 1), F.when((place < after) & (at > 0), at - 1)))
    return rows.withColumn("__block", F.explode(copies)), F.col("__block") == at


def interpolate(df: DataFrame, columns: Sequence[str], ts: str = TIMESTAMP, both: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """``timeseries.interpolate``; a gap may span any number of ranges."""
    known = numbered(df, ts, by, columns)
    order = Window.partitionBy("__range", *by).orderBy(ts)
    back = order.rowsBetween(Window.unboundedPreceding, 0)
    # the same frame from the other end: one up to the last row would start anew at every row
    ahead = Window.partitionBy("__range", *by).orderBy(F.col("__rn").desc()).rowsBetween(Window.unboundedPreceding, 0)
    seen = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col("__rn").alias("i"), F.col(c).alias("v")))
    near = {f"__p_{c}": F.coalesce(F.last(seen(c), True).over(back), F.col(f"__before_{c}")) for c in columns}
    near |= {f"__q_{c}": F.coalesce(F.last(seen(c), True).over(ahead), F.col(f"__after_{c}")) for c in columns}
    known = known.withColumns(near)
    return known.select(*[TS.between(c, F.col(f"__p_{c}"), F.col(f"__q_{c}"), F.col("__rn"), both).alias(c) if c in columns else F.col(c) for c in df.columns])


def lag_windows(df: DataFrame, columns: Sequence[str], lookback: int = 36, horizon: int = 1, drop_last: bool = True, target: Sequence[str] | None = None, ts: str = TIMESTAMP, by: Sequence[str] = (), block: int = 1 << 14) -> DataFrame:
    """``timeseries.lag_windows`` over blocks of ``block`` rows with a halo of ``lookback`` and ``horizon`` rows."""
    rows, _ = haloed(numbered(df, ts, by), lookback, horizon - 1, block)
    size = max(block, lookback, horizon - 1, 1)
    rows = rows.withColumn("__at", F.struct(F.col("__rn"), F.col("__n"), F.col(ts).alias("t")))
    made = TS.lag_windows(rows, columns, lookback, horizon, False, target, "__at", [*by, "__block"])
    rn, n = F.col("__at")["__rn"], F.col("__at")["__n"]
    whole = made.where((F.floor((rn - 1) / size) == F.col("__block")) & (rn <= n - horizon + (0 if drop_last else 1)))
    return whole.select(*by, F.col("__at")["t"].alias(ts), "x", "y")


def chronological_split(df: DataFrame, test: float = 0.2, valid: float = 0.1, ts: str = TIMESTAMP, by: Sequence[str] = ()) -> DataFrame:
    """``timeseries.chronological_split``."""
    rows = numbered(df, ts, by)
    return rows.withColumn("split", TS.split_part(F.col("__rn"), F.col("__n"), test, valid)).select(*df.columns, "split")


def strided(df: DataFrame, n: int, ts: str = TIMESTAMP, by: Sequence[str] = ()) -> DataFrame:
    """``timeseries.strided``."""
    return numbered(df, ts, by).where((F.col("__rn") - 1) % n == 0).select(*df.columns)


def seasonal_decompose(df: DataFrame, value: str, period: int = 24, ts: str = TIMESTAMP, by: Sequence[str] = (), block: int = 1 << 14) -> DataFrame:
    """``timeseries.seasonal_decompose`` over blocks with a halo of half a period; the phase means are one grouping."""
    rows, own = haloed(numbered(df, ts, by), period // 2, period // 2, block)
    full = rows.withColumn("trend", TS.centred_mean(value, period, Window.partitionBy(*by, "__block").orderBy("__rn"))).where(own)
    full = full.withColumn("__phase", (F.col("__rn") - 1) % period)
    return TS.with_seasons(full, value, ts, by)

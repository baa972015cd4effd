"""Autoregression of many series from sums of products, with its order chosen by an information criterion.

A series is never held as one group: lags come from a window over its rows, the normal equations from sums that are
combined before their shuffle, and what reaches the solver is one small matrix and the newest values per series. Every
order up to the largest is solved from the same matrix, as its equations are a leading part of it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _solved(gram: np.ndarray, order: int) -> tuple[np.ndarray, float]:
    """Coefficients and corrected Akaike criterion of one order; ``gram`` is of (1, lags, value)."""
    n, used, own = gram[0, 0], order + 1, gram[-1, -1]
    right = gram[:used, -1]
    coefficients, *_ = np.linalg.lstsq(gram[:used, :used], right, rcond=None)
    # below what the sums can resolve, an error is no better than none
    rest = max(own - float(coefficients @ right), 1e-12 * own, 1e-300)
    free = used + 1
    return coefficients, n * np.log(rest / n) + 2 * free + (2 * free * (free + 1) / (n - free - 1) if n > free + 1 else np.inf)


def _steps(gram: np.ndarray | None, tail: np.ndarray, first: float, lags: int, season: int, h: int, choose: bool) -> tuple[int, list[float]]:
    """Order and forecasts of one series from its sums and its newest values."""
    if gram is None or gram[0, 0] <= lags:
        return 0, [float(tail[-1])] * h
    tried = [(_solved(gram, p), p) for p in (range(1, lags + 1) if choose else (lags,))]
    (coefficients, _), order = min(tried, key=lambda t: (t[0][1], t[1]))
    done = list(tail)
    recent = list(tail[season:] - tail[:-season] if season else tail - first)
    for _ in range(h):
        step = float(coefficients[0] + coefficients[1:] @ np.array(recent[-1 : -order - 1 : -1]))
        recent.append(step)
        done.append(step + (done[-season] if season else first))
    return order, done[-h:]


def fit_autoregression(long: DataFrame, lags: int = 24, season: int = 0, h: int = 24, choose: bool = False) -> DataFrame:
    """(unique_id, ds, step, order, AutoRegression): least-squares autoregression per series, on seasonal differences if ``season``.

    With ``choose`` the order is the one of 1 to ``lags`` with the least corrected Akaike criterion, all fitted to the same
    rows, else ``lags``. Rows without a value or a time are left out; a series shorter than twice its lags and its season
    repeats its last value (order 0). Rows with equal times are taken in the order of their values.
    """
    rows = long.select("unique_id", "ds", F.col("y").cast("double").alias("y")).where("ds IS NOT NULL AND y IS NOT NULL AND NOT isnan(y)")
    by_time = Window.partitionBy("unique_id").orderBy("ds", "y")
    # a shift by the first value keeps the sums of a high level well conditioned
    base = F.lag("y", season).over(by_time) if season else F.first("y").over(by_time.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    moved = rows.withColumn("z", F.col("y") - base)
    lagged = moved.select("unique_id", F.array(F.lit(1.0), *[F.lag("z", k).over(by_time) for k in range(1, lags + 1)], "z").alias("x"))
    size = lags + 2

    def sums(frames):
        for pdf in frames:
            for name, group in pdf.groupby("unique_id", sort=False, dropna=False)["x"]:
                x = np.stack(group.to_list())
                yield pd.DataFrame({"unique_id": name, "cell": range(size * size), "total": (x.T @ x).ravel()})

    kind = rows.schema["unique_id"].dataType.simpleString()
    whole = lagged.where(~F.exists("x", lambda v: v.isNull()))
    cells = whole.mapInPandas(sums, f"unique_id {kind}, cell int, total double").groupBy("unique_id", "cell").agg(F.sum("total").alias("total"))
    grams = cells.groupBy("unique_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("cell", "total"))), lambda c: c["total"]).alias("gram"))
    newest = Window.partitionBy("unique_id").orderBy(F.col("ds").desc(), F.col("y").desc())
    kept = rows.withColumn("back", F.row_number().over(newest)).where(F.col("back") <= max(1, lags + season))
    tails = kept.groupBy("unique_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("back")).alias("at"), "y"))), lambda c: c["y"]).alias("tail"))
    ends = rows.groupBy("unique_id").agg(F.max("ds").alias("last"), F.min(F.struct("ds", "y"))["y"].alias("first"))
    same = lambda other: F.col("s.unique_id").eqNullSafe(F.col(f"{other}.unique_id"))
    series = ends.alias("s").join(tails.alias("t"), same("t")).join(grams.alias("g"), same("g"), "left").select("s.unique_id", "last", "first", "tail", "gram")

    def run(frames):
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                gram = None if r.gram is None else np.asarray(r.gram, float).reshape(size, size)
                order, values = _steps(gram, np.asarray(r.tail, float), r.first, lags, season, h, choose)
                times = [r.last + pd.Timedelta(hours=i) for i in range(1, h + 1)]
                yield pd.DataFrame({"unique_id": r.unique_id, "ds": times, "step": range(1, h + 1), "order": order, "AutoRegression": values})

    return series.mapInPandas(run, f"unique_id {kind}, ds timestamp_ntz, step int, order int, AutoRegression double")

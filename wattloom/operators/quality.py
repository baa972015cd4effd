"""Null profile and drift."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattloom.operators.ranks import running_sums
from wattloom.schema import missing_columns


def null_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n_rows, n_null) in one pass."""
    wide = df.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return wide.unpivot(["n_rows"], list(columns), "column", "n_null").select("column", "n_rows", "n_null")


def ks_statistic(base: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n_base, n_current, d): the two-sample Kolmogorov-Smirnov distance of every column; nulls are left out.

    Equal values are added up before the running sums, so ties are right; the sums go over ranges of values, not one task.
    """
    long = lambda df, a, b: df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x"), F.lit(a).alias("a"), F.lit(b).alias("b")).select("x.column", "x.v", "a", "b")
    both = long(base, 1, 0).unionByName(long(current, 0, 1)).where("v is not null")
    ties = both.groupBy("column", "v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    whole = ties.groupBy("column").agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    steps = running_sums(ties, ["v"], ["a", "b"], by="column").join(F.broadcast(whole), "column")
    gap = F.abs(F.try_divide("upto_a", "na") - F.try_divide("upto_b", "nb"))
    return steps.groupBy("column").agg(F.first("na").alias("n_base"), F.first("nb").alias("n_current"), F.max(gap).alias("d"))


#: Rows of a side up to which the p-value is exact.
EXACT_ROWS = 10_000


def ks_p_value(d: float | None, n: int, m: int, terms: int = 100) -> float:
    """Two-sided p-value; 1 without a distance, as of an empty side. Exact if neither side has over EXACT_ROWS rows, else asymptotic.

    Exactly, it is the share of lattice paths from (0, 0) to (n, m) that touch a point (i, j) with |i/n - j/m| >= d. The share of
    paths that don't, among all that lead to a point, follows from the two points before it, one diagonal after another.
    """
    if d is None or d <= 0:
        return 1.0
    if max(n, m) > EXACT_ROWS:
        x = d * math.sqrt(n * m / (n + m))
        return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, terms + 1))))
    least = round(d * n * m)  # distances are multiples of 1 / (n m)
    inside = np.zeros(n + 1)
    inside[0] = 1.0
    i = np.arange(n + 1)
    for s in range(1, n + m + 1):
        before = np.concatenate([[0.0], inside[:-1]])  # one step less in i
        inside = (i * before + np.maximum(s - i, 0) * inside) / s
        inside[(i > s) | (s - i > m) | (np.abs(i * m - (s - i) * n) >= least)] = 0.0
    return float(min(1.0, max(0.0, 1.0 - inside[n])))


def drift_report(base: DataFrame, current: DataFrame, columns: Sequence[str], threshold: float = 0.05) -> tuple[DataFrame, bool]:
    """(column, d, p_value, drift) and whether no column drifted. One row per column comes to the driver."""
    rows = [(r["column"], r["d"], ks_p_value(r["d"], r["n_base"], r["n_current"])) for r in ks_statistic(base, current, columns).collect()]
    report = base.sparkSession.createDataFrame([(c, d, p, p < threshold) for c, d, p in rows], "column string, d double, p_value double, drift boolean")
    return report, not any(p < threshold for _, _, p in rows)


def validation_gate(base: DataFrame, current: DataFrame, schema: T.StructType, threshold: float = 0.05, max_null_share: float = 1.0) -> tuple[DataFrame, bool]:
    """(check, column, value, passed) of everything a new frame has to pass before it is used, and whether all passed.

    ``columns`` says whether both frames have the columns of ``schema``; each number column then has a ``nulls`` row, the share of
    nulls in ``current``, and a ``drift`` row, the p-value against ``base``. Frames that fail the first check get no others; an
    empty ``current`` has no nulls and no drift.
    """
    named = schema.names
    lacking = sorted({c for df in (base, current) for c in missing_columns(df, named)})
    rows = [("columns", c, None, False) for c in lacking] or [("columns", None, None, True)]
    if not lacking:
        numbers = [f.name for f in schema if isinstance(f.dataType, T.NumericType)]
        for r in null_profile(current, numbers).collect():
            share = r["n_null"] / r["n_rows"] if r["n_rows"] else 0.0
            rows.append(("nulls", r["column"], share, share <= max_null_share))
        rows += [("drift", r["column"], r["p_value"], not r["drift"]) for r in drift_report(base, current, numbers, threshold)[0].collect()]
    return base.sparkSession.createDataFrame(rows, "check string, column string, value double, passed boolean"), all(r[3] for r in rows)

"""What the analytical pages show, as frames."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattloom.operators.quantiles import known, same_keys, selected
from wattloom.operators.timeseries import tail, trunc
from wattloom.schema import CONSUMPTION, SOURCES, TEMPERATURE, TIMESTAMP


def row_sum(columns: Sequence[str]) -> Column:
    """Sum over columns with null as zero."""
    return reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0.0)) for c in columns])


def energy_balance(df: DataFrame, sources: Sequence[str] = SOURCES, consumption: str = CONSUMPTION) -> DataFrame:
    """Adds production_totale and deficit (production less consumption: positive is a surplus)."""
    made = df.withColumn("production_totale", row_sum([c for c in sources if c in df.columns]))
    return made.withColumn("deficit", F.col("production_totale") - F.col(consumption))


def deficit_percentage(df: DataFrame, consumption: str = CONSUMPTION, strict: bool = False) -> DataFrame:
    """Adds deficit_percentage, of the consumption but at least 1e-8, and balance: surplus from 0 on, or above 0 if ``strict`` (forecasts)."""
    share = F.col("deficit") / F.greatest(F.col(consumption), F.lit(1e-8)) * 100
    surplus = F.col("deficit") > 0 if strict else F.col("deficit") >= 0
    return df.withColumn("deficit_percentage", share).withColumn("balance", F.when(surplus, "surplus").otherwise("deficit"))


def overview(df: DataFrame, sources: Sequence[str] = SOURCES) -> DataFrame:
    """Means of consumption, temperature and deficit; total production as the sum of the sources' means."""
    balance = energy_balance(df, sources)
    return balance.agg(
        F.avg(CONSUMPTION).alias("mean_consumption"), reduce(lambda a, b: a + b, [F.avg(c) for c in sources]).alias("total_production"),
        F.avg(TEMPERATURE).alias("mean_temperature"), F.avg("deficit").alias("mean_deficit"),
    )


def mix_share(df: DataFrame, sources: Sequence[str] = SOURCES) -> DataFrame:
    """(source, mean_value, share) of each source."""
    means = df.agg(*[F.avg(c).alias(c) for c in sources]).withColumn("__total", row_sum(sources))
    return means.unpivot(["__total"], list(sources), "source", "mean_value").select("source", "mean_value", (F.col("mean_value") / F.col("__total")).alias("share"))


def top_sources(df: DataFrame, sources: Sequence[str] = SOURCES, pinned: str = "SOLAR", k: int = 3) -> DataFrame:
    """(source, mean_value, place): the pinned source first, then the ``k`` largest means of the others."""
    means = mix_share(df, sources).select("source", "mean_value")
    best = means.where(F.col("source") != pinned).orderBy(F.col("mean_value").desc(), "source").limit(k)
    ranked = best.withColumn("place", F.row_number().over(Window.orderBy(F.col("mean_value").desc(), "source")))
    return means.where(F.col("source") == pinned).withColumn("place", F.lit(0)).unionByName(ranked)


def sums_by_month(df: DataFrame, value: str, by: Sequence[str], ts: str = TIMESTAMP) -> DataFrame:
    """(month yyyy-MM, by, total); a group without values sums to 0."""
    return df.groupBy(F.date_format(ts, "yyyy-MM").alias("month"), *by).agg(F.coalesce(F.sum(value), F.lit(0)).alias("total"))


def daily_mean(df: DataFrame, columns: Sequence[str], ts: str = TIMESTAMP) -> DataFrame:
    return df.groupBy(trunc("day", ts).alias("day")).agg(*[F.avg(c).alias(c) for c in columns])


def box_statistics(df: DataFrame, value: str, by: Sequence[str], method: str = "linear", task_rows: int = 1 << 20) -> DataFrame:
    """Quartiles, whiskers (the outmost values within 1.5 interquartile ranges) and outliers per group; a group may have any size (``exact_quantiles``).

    ``method``: "linear" puts quantile p at (n - 1) p, "hazen" at n p - 1/2. Nulls and NaNs are left out.
    """
    rows = known(df, value, by)
    quartiles = selected(rows, list(by), {"q1": 0.25, "median": 0.5, "q3": 0.75}, method, task_rows).drop("n")
    joined = same_keys(rows, quartiles, by)
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = (F.col("__v") >= F.col("q1") - reach) & (F.col("__v") <= F.col("q3") + reach)
    return joined.groupBy(*by, "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("__v"))).alias("whisker_low"), F.max(F.when(inside, F.col("__v"))).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"), F.count(F.lit(1)).alias("n"),
    )


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """(bin, lower, n): bins of equal width between least and largest value, the last one closed; empty bins are left out."""
    low, high = df.agg(F.min(value), F.max(value)).first()
    if low is None:
        return df.select(F.lit(0).alias("bin"), F.lit(0.0).alias("lower"), F.lit(0).cast("long").alias("n")).limit(0)
    width = (high - low) / bins or 1.0
    number = F.least(F.lit(bins - 1), F.floor((F.col(value) - F.lit(low)) / F.lit(width))).cast("int")
    return df.where(F.col(value).isNotNull()).groupBy(number.alias("bin")).agg(F.count(F.lit(1)).alias("n")).select("bin", (F.lit(low) + F.col("bin") * F.lit(width)).alias("lower"), "n")


def correlations(df: DataFrame, x: str, others: Sequence[str]) -> DataFrame:
    """(variable, correlation) of ``x`` with each of ``others``, in one pass."""
    wide = df.agg(*[F.corr(x, c).alias(c) for c in others]).withColumn("__x", F.lit(x))
    return wide.unpivot(["__x"], list(others), "variable", "correlation").drop("__x")


def ols(df: DataFrame, x: str, y: str) -> DataFrame:
    """Slope, intercept and r2 of y on x."""
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def describe(df: DataFrame, columns: Sequence[str], task_rows: int = 1 << 20) -> DataFrame:
    """(column, n, mean, std, std_pop, min, q1, median, q3, max), exact, over the long form; a column may have any size (``exact_quantiles``).

    NaNs are left out like nulls; a column without values has n 0 and nulls.
    """
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select("x.*")
    rows = known(long, "v", ["column"])
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    sums = rows.groupBy("column").agg(F.count("__v").alias("n"), F.avg("__v").alias("mean"), F.stddev_samp("__v").alias("std"), F.stddev_pop("__v").alias("std_pop"), F.min("__v").alias("min"), F.max("__v").alias("max"))
    quartiles = selected(rows, ["column"], {"q1": 0.25, "median": 0.5, "q3": 0.75}, "linear", task_rows).drop("n")
    made = names.join(sums, "column", "left").join(quartiles, "column", "left")
    return made.select("column", F.coalesce("n", F.lit(0)).alias("n"), "mean", "std", "std_pop", "min", "q1", "median", "q3", "max")


def tail_deviation(df: DataFrame, columns: Sequence[str], rows: int = 168, ts: str = TIMESTAMP) -> DataFrame:
    """(column, n, std): sample standard deviation of each column over the last ``rows`` rows in time, nulls left out."""
    wide = tail(df, rows, ts).agg(*[F.struct(F.count(c).alias("n"), F.stddev_samp(c).alias("std")).alias(c) for c in columns])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c)["n"].alias("n"), F.col(c)["std"].alias("std")) for c in columns])))


def axis_range(frames: Sequence[tuple[DataFrame, str]], padding: float = 0.1) -> DataFrame:
    """Least and largest value over several frames, both moved out by a share of their distance, and a symmetric bound. Columns of one frame share a pass."""
    columns: dict[int, tuple[DataFrame, list[str]]] = {}
    for df, c in frames:
        columns.setdefault(id(df), (df, []))[1].append(c)
    ends = [df.agg(F.array_min(F.array(*[F.min(c) for c in cs])).alias("lo"), F.array_max(F.array(*[F.max(c) for c in cs])).alias("hi")) for df, cs in columns.values()]
    found = reduce(lambda a, b: a.unionByName(b), ends).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    pad = (F.col("hi") - F.col("lo")) * padding
    return found.select((F.col("lo") - pad).alias("axis_low"), (F.col("hi") + pad).alias("axis_high"), (F.greatest(F.abs("lo"), F.abs("hi")) * (1 + padding)).alias("axis_symmetric"))


def page(df: DataFrame, order: Sequence[str], number: int, size: int = 10) -> DataFrame:
    """Rows of page ``number`` (from 0)."""
    return df.orderBy(*order).offset(number * size).limit(size)

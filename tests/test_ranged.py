from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wattloom.operators import ranged as R
from wattloom.operators import timeseries as TS

T0 = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def rows(spark):
    """Three series, one of them without a name, with gaps longer than a range, one that never has a value."""
    made = []
    for name, n in (("a", 700), (None, 90), ("z", 40)):
        for i in range(n):
            gap = name == "z" or 60 < i < 400 or i % 7 == 3 or i < 5
            made.append((name, T0 + timedelta(hours=i), None if gap else float((i * 37) % 101), float((i * i) % 53)))
    df = spark.createDataFrame(made, "k string, timestamp timestamp_ntz, v double, w double").repartition(5).cache()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small ranges stay apart
    yield df
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    df.unpersist()


def table(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("both", [True, False])
def test_interpolation_carries_over_ranges(spark, rows, both):
    assert table(R.interpolate(rows, ["v", "w"], both=both, by=["k"])) == table(TS.interpolate(rows, ["v", "w"], both=both, by=["k"]))
    one = rows.where("k = 'a'")
    assert R.numbered(one).select("__range").distinct().count() > 2
    assert table(R.interpolate(one, ["v"], both=both)) == table(TS.interpolate(one, ["v"], both=both))


@pytest.mark.parametrize("block", [1, 50, 1 << 14])
@pytest.mark.parametrize("lookback, horizon, drop", [(36, 1, True), (12, 30, True), (5, 3, False)])
def test_windows_with_halo(rows, block, lookback, horizon, drop):
    want = TS.lag_windows(rows, ["w", "v"], lookback, horizon, drop, ["w"], by=["k"])
    assert table(R.lag_windows(rows, ["w", "v"], lookback, horizon, drop, ["w"], by=["k"], block=block)) == table(want)


def test_numbers_split_and_stride(rows):
    assert table(R.chronological_split(rows, by=["k"])) == table(TS.chronological_split(rows, by=["k"]))
    assert table(R.strided(rows, 9, by=["k"])) == table(TS.strided(rows, 9, by=["k"]))
    got = R.numbered(rows, by=["k"]).groupBy("k").agg(F.count_distinct("__rn").alias("d"), F.max("__rn").alias("m"), F.max("__n").alias("n")).collect()
    assert sorted((r["d"], r["m"], r["n"]) for r in got) == [(40, 40, 40), (90, 90, 90), (700, 700, 700)]


@pytest.mark.parametrize("period, block", [(4, 30), (7, 1), (24, 1 << 14)])
def test_decomposition_with_halo(rows, period, block):
    keyed = lambda df: {(r["k"], r["timestamp"]): (r["observed"], r["trend"], r["seasonal"], r["resid"]) for r in df.collect()}
    got, want = keyed(R.seasonal_decompose(rows, "w", period, by=["k"], block=block)), keyed(TS.seasonal_decompose(rows, "w", period, by=["k"]))
    assert got.keys() == want.keys() and len(got) == 830
    for k in want:
        assert got[k] == tuple(x if x is None else pytest.approx(x, abs=1e-9) for x in want[k])


def test_empty_table(rows):
    none = rows.limit(0)
    assert R.interpolate(none, ["v"], by=["k"]).count() == R.lag_windows(none, ["v"]).count() == R.seasonal_decompose(none, "v").count() == R.strided(none, 2).count() == 0

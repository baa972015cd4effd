from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wattloom.operators import timeseries as TS
from wattloom.operators.analytics import box_statistics, energy_balance, histogram, row_sum
from wattloom.operators.reshape import melt, pivot_first

T0 = datetime(2024, 1, 1)


def series(spark, values, step=1):
    return spark.createDataFrame([(T0 + timedelta(hours=step * i), v) for i, v in enumerate(values)], "timestamp timestamp_ntz, v double")


def column(df, name="v"):
    return [r[name] for r in df.orderBy("timestamp").collect()]


def test_interpolation_edges(spark):
    rows = series(spark, [None, None, 1.0, None, None, 4.0, None])
    assert column(TS.interpolate(rows, ["v"])) == [1, 1, 1, 2, 3, 4, 4]
    assert column(TS.interpolate(rows, ["v"], both=False)) == [None, None, 1, 2, 3, 4, 4]
    assert column(TS.interpolate(series(spark, [None, None]), ["v"])) == [None, None]


def test_resample_keeps_empty_buckets(spark):
    rows = spark.createDataFrame([(datetime(2024, 1, 1, 3), 1.0), (datetime(2024, 1, 3, 4), 3.0), (datetime(2024, 1, 3, 5), 5.0)], "timestamp timestamp_ntz, v double")
    assert column(TS.resample_mean(rows, ["v"], "day")) == [1.0, None, 4.0]


@pytest.mark.parametrize("n, drop, want", [(40, True, 3), (40, False, 4), (37, True, 0), (37, False, 1), (20, True, 0)])
def test_window_counts(spark, n, drop, want):
    made = TS.lag_windows(series(spark, [float(i) for i in range(n)]), ["v"], 36, 1, drop).collect()
    assert len(made) == want
    for r in made:
        assert [x[0] for x in r["x"]] == [r["y"][0][0] - 36 + i for i in range(36)]


def test_split_rounds_up(spark):
    got = column(TS.chronological_split(series(spark, [0.0] * 10)), "split")
    assert got == ["train"] * 7 + ["valid"] + ["test"] * 2


def test_first_arrival_stays(spark):
    rows = spark.createDataFrame([(T0, 2, 20.0), (T0, 1, 10.0)], "timestamp timestamp_ntz, arrival int, v double")
    assert column(TS.first_per_time(rows, ["arrival"])) == [10.0]


def test_tolerance_runs_compare_with_the_start(spark):
    got = TS.tolerance_runs(series(spark, [0.0, 0.009, 0.018]), "v").orderBy("run").collect()
    assert [(r["run_start"], r["length"]) for r in got] == [(0.0, 2), (0.018, 1)]


def test_date_chunks_clip_the_last(spark):
    got = TS.date_chunks(spark, "2024-01-01 00:00:00", "2024-07-10 00:00:00", 180).orderBy("chunk_start").collect()
    assert [(r[1] - r[0]).days for r in got] == [180, 11]
    assert TS.date_chunks(spark, "2024-01-01 00:00:00", "2024-01-01 00:00:00").count() == 0


def test_decomposition_adds_up(spark):
    rows = series(spark, [float(i + 3 * (i % 4)) for i in range(24)])
    got = TS.seasonal_decompose(rows, "v", 4).where("trend is not null").collect()
    assert len(got) == 20 and all(abs(r["observed"] - r["trend"] - r["seasonal"] - r["resid"]) < 1e-12 for r in got)


def test_row_sum_takes_null_as_zero(spark):
    rows = spark.createDataFrame([(1.0, None), (None, None)], "a double, b double")
    assert [r[0] for r in rows.select(row_sum(["a", "b"])).collect()] == [1.0, 0.0]


def test_balance_uses_the_sources_there_are(spark):
    rows = spark.createDataFrame([(T0, 5.0, 3.0)], "timestamp timestamp_ntz, SOLAR double, consommation_totale double")
    assert energy_balance(rows).first()["deficit"] == 2.0


def test_box_methods(spark):
    rows = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, 4, 100)], "k string, v double")
    linear = box_statistics(rows, "v", ["k"]).first()
    assert (linear["q1"], linear["median"], linear["q3"], linear["whisker_high"], linear["outliers"]) == (2, 3, 4, 4, 1)
    hazen = box_statistics(rows, "v", ["k"], "hazen").first()
    assert (hazen["q1"], hazen["median"], hazen["q3"]) == (1.75, 3.0, 28.0)


def test_histogram_closes_the_last_bin(spark):
    rows = spark.createDataFrame([(float(x),) for x in range(11)], "v double")
    got = {r["bin"]: r["n"] for r in histogram(rows, "v", 5).collect()}
    assert got == {0: 2, 1: 2, 2: 2, 3: 2, 4: 3}
    assert histogram(rows.limit(0), "v", 5).count() == 0


def test_pivot_takes_the_first_value(spark):
    rows = spark.createDataFrame([(T0, "A", 1, None), (T0, "A", 2, 5.0), (T0, "A", 3, 6.0), (T0, "B", 4, 7.0)], "timestamp timestamp_ntz, n string, o int, v double")
    got = pivot_first(rows, ["A", "B"], "n", "v", ["o"]).first()
    assert (got["A"], got["B"]) == (5.0, 7.0)
    assert melt(pivot_first(rows, ["A", "B"], "n", "v", ["o"]), ["A", "B"]).count() == 2


def test_strided_and_tail(spark):
    rows = series(spark, [float(i) for i in range(10)])
    assert column(TS.strided(rows, 4)) == [0, 4, 8]
    assert column(TS.tail(rows, 2)) == [8, 9]
    assert [r["step"] for r in TS.future_timestamps(rows, 3).orderBy("step").collect()] == [1, 2, 3]
    assert TS.future_timestamps(rows, 3).agg(F.max("timestamp")).first()[0] == T0 + timedelta(hours=12)

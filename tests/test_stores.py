from datetime import datetime, timedelta

import pytest
from pyspark.sql import types as T

from wattloom.operators import timeseries as TS
from wattloom.operators.analytics import axis_range, tail_deviation
from wattloom.sources import readers as R

T0 = datetime(2024, 1, 1)
SCHEMA = T.StructType([T.StructField("timestamp", T.TimestampNTZType()), T.StructField("v", T.DoubleType())])


def frame(spark, values, start=0):
    return spark.createDataFrame([(T0 + timedelta(hours=start + i), v, "x") for i, v in enumerate(values)], "timestamp timestamp_ntz, v double, extra string")


def test_validated_copies(spark, tmp_path):
    base, far = frame(spark, [float(i % 10) for i in range(60)]), frame(spark, [100.0 + i for i in range(60)])
    assert R.write_validated(base, base, str(tmp_path), SCHEMA)[1]
    assert spark.read.parquet(f"{tmp_path}/valid/train").columns == ["timestamp", "v"] and spark.read.parquet(f"{tmp_path}/valid/test").count() == 60
    assert not (tmp_path / "invalid").exists()
    assert not R.write_validated(base, far, str(tmp_path), SCHEMA)[1]
    assert spark.read.parquet(f"{tmp_path}/invalid/test").agg({"v": "max"}).first()[0] == 159.0
    report, passed = R.write_validated(base.drop("v"), base, str(tmp_path / "none"), SCHEMA)
    assert not passed and report.first()["column"] == "v" and not (tmp_path / "none").exists()


def test_windows_round_trip_and_split(spark, tmp_path):
    rows = frame(spark, [float(i) for i in range(50)]).select("timestamp", "v")
    made = TS.lag_windows(rows, ["v"], 5, 2)
    R.write_windows(made, str(tmp_path / "w"))
    whole = R.read_windows(spark, str(tmp_path / "w"))
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, made.collect()))
    part = R.read_windows(spark, str(tmp_path / "w"), "2024-01-01 10:00:00", "2024-01-01 20:00:00")
    assert part.count() == 10 and "PushedFilters: [IsNotNull(timestamp), GreaterThanOrEqual(timestamp" in part._jdf.queryExecution().toString()
    split = {r["split"]: r["n"] for r in TS.chronological_split(whole).groupBy("split").count().withColumnRenamed("count", "n").collect()}
    assert split == {"train": 30, "valid": 4, "test": 9}


def test_split_folders(spark, tmp_path):
    R.write_splits(TS.chronological_split(frame(spark, [0.0] * 10)), str(tmp_path / "s"))
    assert {p.name: spark.read.parquet(str(p)).count() for p in (tmp_path / "s").iterdir() if p.is_dir()} == {"split=train": 7, "split=valid": 1, "split=test": 2}


def test_timed_records(spark):
    rows = [{"timestamp": "2024-01-01T02:00:00+02:00", "a": 1}, {"timestamp": "2024-01-01 05:00:00", "b": 2.5}, {"timestamp": "2024-01-01T06:30:00Z", "a": None}, {"timestamp": "never", "a": 3}, {"a": 4}, {"timestamp": "2024-01-02"}]
    got = R.timed_records(spark, rows).orderBy("timestamp").collect()
    assert [tuple(r) for r in got] == [(T0, 1.0, None), (T0 + timedelta(hours=5), None, 2.5), (datetime(2024, 1, 1, 6, 30), None, None), (datetime(2024, 1, 2), None, None)]
    assert R.timed_records(spark, [], columns=["a"]).collect() == []


def test_units_are_filled_in_one_pass(spark):
    rows = spark.createDataFrame([("a", T0, 1.0), ("a", T0 + timedelta(hours=3), 4.0), ("b", T0 + timedelta(hours=1), 2.0), (None, T0, 5.0), ("a", None, 9.0)], "k string, timestamp timestamp_ntz, v double")
    got = sorted(map(tuple, TS.fill_units(rows, by=["k"]).collect()), key=repr)
    assert got == sorted([("a", T0, 1.0), ("a", T0 + timedelta(hours=1), None), ("a", T0 + timedelta(hours=2), None), ("a", T0 + timedelta(hours=3), 4.0), ("b", T0 + timedelta(hours=1), 2.0), (None, T0, 5.0)], key=repr)
    assert TS.fill_units(rows.limit(0)).count() == 0


def test_deviation_of_the_tail_and_axis(spark):
    rows = frame(spark, [100.0, 1.0, None, 3.0])
    assert [tuple(r) for r in tail_deviation(rows, ["v"], 3).collect()] == [("v", 2, pytest.approx(2**0.5))]
    other = frame(spark, [-7.0])
    got = axis_range([(rows, "v"), (other, "v"), (rows, "v")], 0.0).first()
    assert tuple(got) == (-7.0, 100.0, 100.0)

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattloom.functions.metrics import by_source, half_even, rank_models
from wattloom.functions.scaling import fit_min_max
from wattloom.operators import forecast as FC
from wattloom.operators import ml
from wattloom.operators.autoregression import fit_autoregression
from wattloom.operators.knn import KnnImputer, KnnTable, fit_knn
from wattloom.operators.quality import drift_report, ks_p_value, ks_statistic, null_profile

T0 = datetime(2024, 1, 1)


def long(spark, n=100, ids=("a", "b")):
    return spark.createDataFrame([(k, T0 + timedelta(hours=i), float((i * 7 + j) % 24)) for j, k in enumerate(ids) for i in range(n)], "unique_id string, ds timestamp_ntz, y double")


def test_baselines(spark):
    got = {r["step"]: r for r in FC.baselines(long(spark, 48, ("a",))).collect()}
    y = [float((i * 7) % 24) for i in range(48)]
    assert len(got) == 24 and got[1]["Naive"] == y[-1] and got[1]["SeasonalNaive"] == y[24] and got[24]["SeasonalNaive"] == y[47]
    assert got[5]["WindowAverage"] == pytest.approx(np.mean(y[-24:])) and got[5]["ds"] == T0 + timedelta(hours=52)


def test_rolling_origin_matches_refits(spark):
    rows = long(spark, 100, ("a",))
    y = [r["y"] for r in rows.orderBy("ds").collect()]
    for r in FC.rolling_origin(rows, windows=3, h=24).collect():
        t = int((r["ds"] - T0).total_seconds() // 3600)
        cut = int((r["cutoff"] - T0).total_seconds() // 3600)
        assert cut < t <= cut + 24
        assert r["Naive"] == y[cut] and r["HistoricAverage"] == pytest.approx(np.mean(y[: cut + 1])) and r["SeasonalNaive"] == y[t - 24]


def test_bands_swap_for_negative_forecasts(spark):
    rows = spark.createDataFrame([("SOLAR", 0, 100.0), ("SOLAR", 24, -100.0), ("temp", 24, 10.0), ("OTHER", 0, 100.0)], "source string, step int, forecast double")
    got = [(round(r["lower"], 6), round(r["upper"], 6)) for r in FC.forecast_bands(rows).collect()]
    assert got == [(95.0, 105.0), (-85.0, -115.0), (9.0, 11.0), (98.0, 102.0)]


def test_padding(spark):
    rows = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0)], "unique_id string, step int, f double")
    assert [r["f"] for r in FC.pad_to_horizon(rows, 4, "f").orderBy("step").collect()] == [1, 2, 2, 2]
    assert [r["f"] for r in FC.pad_to_horizon(rows, 1, "f").collect()] == [1]


def test_scaler(spark):
    rows = spark.createDataFrame([(5.0, 0.0), (5.0, 10.0)], "c double, v double")
    scaler = fit_min_max(rows, ["c", "v"])
    assert [tuple(r) for r in scaler.transform(rows).collect()] == [(0.0, 0.0), (0.0, 1.0)]
    assert [tuple(r) for r in scaler.inverse(scaler.transform(rows)).collect()] == [(5.0, 0.0), (5.0, 10.0)]


def test_metrics_and_rank(spark):
    rows = spark.createDataFrame([("a", 1.0, 1.0), ("a", 3.0, 2.0), ("b", 2.0, 2.0), ("b", 2.0, 3.0)], "source string, y double, forecast double")
    got = {r["source"]: r for r in by_source(rows).collect()}
    assert got["a"]["mae"] == 0.5 and got["a"]["r2"] == 0.5 and got["b"]["r2"] is None
    scores = spark.createDataFrame([("mae", 2.0, 1.0, 1.0)], "metric string, x double, y double, z double")
    assert [r["model"] for r in rank_models(scores, ["x", "y", "z"]).orderBy("place").collect()] == ["y", "z", "x"]
    assert spark.range(1).select(half_even(F.lit(2.5), 0)).first()[0] == 2.0


def test_ks(spark):
    a = spark.createDataFrame([(float(i),) for i in range(20)], "v double")
    b = spark.createDataFrame([(float(i + 10),) for i in range(20)], "v double")
    assert ks_statistic(a, a, ["v"]).first()["d"] == 0.0 and ks_statistic(a, b, ["v"]).first()["d"] == 0.5
    report, same = drift_report(a, b, ["v"])
    assert not same and report.first()["drift"] and ks_p_value(0.0, 5, 5) == 1.0
    assert null_profile(a.unionByName(spark.createDataFrame([(None,)], "v double")), ["v"]).first()["n_null"] == 1


def test_knn_imputer():
    nan = np.nan
    donors = np.array([[1.0, 10.0], [2.0, 20.0], [3.0, 30.0], [100.0, nan]])
    imputer = KnnImputer(("a", "b"), donors, np.array([5.0, 20.0]), 2)
    assert imputer.fill(np.array([[1.4, nan], [nan, nan], [2.0, 1.0]])).tolist() == [[1.4, 15.0], [5.0, 20.0], [2.0, 1.0]]


def test_models_train_score_and_forecast(spark, tmp_path):
    rows = spark.createDataFrame([(T0 + timedelta(hours=i), float(i % 24), float(i % 12)) for i in range(240)], "timestamp timestamp_ntz, p double, c double")
    trained = ml.train_and_select(rows, ("linear", "tree"), ("p", "c"), lookback=24)
    assert min(s[1] for s in trained.scores) < 0.2
    forecast = trained.forecast(rows, 3).orderBy("step").collect()
    assert [r["timestamp"] for r in forecast] == [T0 + timedelta(hours=240 + i) for i in range(3)]
    context = rows.where(F.col("timestamp") < F.lit(T0 + timedelta(hours=239)))
    one = trained.forecast(context, 1).first()
    score = {r["timestamp"]: r["prediction"] for r in trained.score(rows).collect()}
    assert T0 + timedelta(hours=238) in score and len(score) == 240 - 24 - 1 and one["p"] == pytest.approx(23.0, abs=4)
    with pytest.raises(ValueError):
        trained.forecast(rows.limit(5), 1)
    back = trained.backtest(rows, 6).collect()
    assert len(back) == 12 and {r["step"] for r in back} == set(range(1, 7)) and all(abs(r["actual"] - r["forecast"]) < 6 for r in back)
    path = str(tmp_path / "trained")
    trained.save(spark, path)
    again = ml.load(spark, path)
    assert again.scores == trained.scores and again.test == trained.test and [tuple(r) for r in again.forecast(rows, 3).orderBy("step").collect()] == [tuple(r) for r in forecast]
    gaps = rows.withColumn("p", F.when(F.hour("timestamp") != 3, F.col("p")))
    assert [tuple(r) for r in again.score(gaps).orderBy("timestamp").limit(5).collect()] == [tuple(r) for r in trained.score(gaps).orderBy("timestamp").limit(5).collect()]


def test_test_rows_have_no_say_in_the_choice(spark):
    rng = np.random.default_rng(3)
    values = [(T0 + timedelta(hours=i), float(i % 24 + rng.normal()), float(i % 12)) for i in range(200)]
    other = [v if i < 160 else (v[0], -1000.0 * i, 5.0) for i, v in enumerate(values)]
    a, b = (ml.train_and_select(spark.createDataFrame(v, "timestamp timestamp_ntz, p double, c double"), ("tree", "linear"), ("p", "c"), lookback=12) for v in (values, other))
    assert a.scores == b.scores and a.test != b.test


def test_linear_family_is_ridge_regression(spark):
    """One-step predictions of the linear family against the closed form."""
    rng = np.random.default_rng(6)
    y = np.cumsum(rng.normal(size=150))
    rows = spark.createDataFrame([(T0 + timedelta(hours=i), float(v), float(i % 5)) for i, v in enumerate(y)], "timestamp timestamp_ntz, p double, c double")
    got = ml.train_and_select(rows, ("linear",), ("p", "c"), lookback=4, params={"linear": {"regParam": 0.0, "solver": "normal"}})
    data = np.column_stack([y, np.arange(150) % 5])
    low, high = data[:108].min(0), data[:108].max(0)  # 150 - 30 test rows - 12 validation rows
    z = (data - low) / (high - low)
    windows = lambda a, b: np.array([np.r_[1.0, z[i - 4 : i].ravel()] for i in range(a, b)])
    w, *_ = np.linalg.lstsq(windows(4, 107), z[4:107], rcond=None)
    want = windows(4, 149) @ w * (high - low) + low
    found = np.array([r["prediction"] for r in got.score(rows).orderBy("timestamp").collect()])
    assert np.allclose(found, want, atol=1e-6)
    assert got.scores[0][1] == pytest.approx(np.abs(windows(108, 120) @ w - z[108:120]).mean(), abs=1e-6) and got.test[0] == pytest.approx(np.abs(windows(120, 150) @ w - z[120:150]).mean(), abs=1e-6)


def test_searches(spark):
    rows = spark.createDataFrame([(T0 + timedelta(hours=i), float(i % 24), float(i % 7)) for i in range(150)], "timestamp timestamp_ntz, p double, c double")
    grid = {"stepSize": (0.3, 0.001), "subsamplingRate": (1.0,), "maxIter": (2, 8)}
    found = ml.grid_search(rows, ("p", "c"), grid, lookback=6, columns=("p", "c"))
    assert len(found) == 4 and found[0][0] == {"stepSize": 0.3, "subsamplingRate": 1.0, "maxIter": 8} and found[0][1] > 0.99 > found[-1][1]
    tries = ml.guided_search(rows, "p", {"maxDepth": (1, 8), "minInfoGain": (1e-6, 1e-1, "log")}, tries=7, first=3, lookback=6, family="tree", columns=("p", "c"))
    assert len(tries) == 7 and tries[0][1] <= tries[-1][1] and all(isinstance(p["maxDepth"], int) for p, _ in tries)
    gain = ml._expected_gain(np.array([[0.1], [0.9]]), np.array([0.0, 1.0]), np.array([[0.1], [0.3], [0.9]]))
    assert gain.argmax() == 1


def test_folds_and_autoregression(spark):
    assert ml.expanding_folds(8, 3) == [(2, 2, 4), (4, 4, 6), (6, 6, 8)]
    got = fit_autoregression(long(spark, 120, ("a",)), lags=4, season=24).orderBy("step").collect()
    assert len(got) == 24 and got[0]["ds"] == T0 + timedelta(hours=120)


def test_autoregression_equals_least_squares(spark):
    rng = np.random.default_rng(3)
    series = {}
    for name, start in (("a", 0.0), ("b", 1e6)):
        y = [start, start + 1.0]
        for _ in range(158):
            y.append(start + 0.6 * (y[-1] - start) - 0.3 * (y[-2] - start) + rng.normal())
        series[name] = y
    rows = [(k, T0 + timedelta(hours=i), v) for k, y in series.items() for i, v in enumerate(y)] + [("short", T0, 4.0), ("short", None, 9.0), ("a", T0, None)]
    frame = spark.createDataFrame(rows, "unique_id string, ds timestamp_ntz, y double")
    for season in (0, 24):
        got = {(r["unique_id"], r["step"]): r for r in fit_autoregression(frame, lags=3, season=season, h=5).collect()}
        assert len(got) == 15 and got["short", 5]["AutoRegression"] == 4.0 and got["short", 1]["order"] == 0
        for name, values in series.items():
            y = np.array(values)
            z = y[season:] - y[:-season] if season else y
            x = np.column_stack([np.ones(len(z) - 3), z[2:-1], z[1:-2], z[:-3]])
            coefficients, *_ = np.linalg.lstsq(x, z[3:], rcond=None)
            done, recent = list(y), list(z)
            for step in range(1, 6):
                recent.append(float(coefficients @ [1.0, *recent[-1:-4:-1]]))
                done.append(recent[-1] + (done[-season] if season else 0.0))
                assert got[name, step]["AutoRegression"] == pytest.approx(done[-1], rel=1e-9, abs=1e-4)
    chosen = {r["unique_id"]: r["order"] for r in fit_autoregression(frame, lags=6, h=1, choose=True).collect()}
    assert chosen["a"] in (2, 3) and chosen["b"] in (2, 3)
    assert fit_autoregression(frame.limit(0), lags=3).count() == 0


def test_knn_table_equals_array(spark):
    rng = np.random.default_rng(5)
    cells = rng.integers(0, 6, (160, 3)).astype(float)
    cells[rng.random((160, 3)) < 0.2] = np.nan
    cells[:3] = np.nan
    rows = [(T0 + timedelta(hours=i), *[None if np.isnan(v) else float(v) for v in r], i) for i, r in enumerate(cells)]
    frame = spark.createDataFrame(rows, "timestamp timestamp_ntz, a double, b double, c double, i int")
    array = fit_knn(frame, ("a", "b", "c"), 3)
    table = fit_knn(frame, ("a", "b", "c"), 3, max_donors=10)
    assert isinstance(array, KnnImputer) and isinstance(table, KnnTable)
    table = KnnTable(table.columns, table.donors, table.means, table.k, block=37)
    want = {r["i"]: r for r in array.transform(frame).collect()}
    got = table.transform(frame).collect()
    assert len(got) == 160 and got[0].asDict().keys() == want[0].asDict().keys()
    for r in got:
        assert [r["a"], r["b"], r["c"]] == pytest.approx([want[r["i"]][c] for c in "abc"])
    assert table.transform(frame.limit(0)).count() == 0
    empty = KnnTable(table.columns, table.donors.limit(0), table.means, 3)
    assert {r["a"] for r in empty.transform(frame.where("i < 3")).collect()} == {table.means[0]}


def test_own_families_train_save_and_load(spark, tmp_path):
    """Gaps are left to the imputer that the training fits; the library's own trees come back from a folder as they were."""
    rows = spark.createDataFrame([(T0 + timedelta(hours=i), None if i % 13 == 0 else float(i % 24), float(i % 12)) for i in range(200)], "timestamp timestamp_ntz, p double, c double")
    params = {"hist": {"trees": 3}, "leafwise": {"trees": 2, "leaves": 5}, "extra": {"trees": 4, "depth": 4}}
    for family in params:
        trained = ml.train_and_select(rows, (family,), ("p", "c"), lookback=12, params=params)
        assert math.isfinite(trained.scores[0][1]) and trained.scores[0][0] == family
        path = str(tmp_path / family)
        trained.save(spark, path)
        again = ml.load(spark, path)
        assert [tuple(r) for r in again.forecast(rows, 2).orderBy("step").collect()] == [tuple(r) for r in trained.forecast(rows, 2).orderBy("step").collect()]
        assert trained.score(rows).count() > 150

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattloom.operators.analytics import box_statistics, describe
from wattloom.operators.quantiles import exact_quantiles

WANTED = {"lo": 0.0, "q1": 0.25, "median": 0.5, "odd": 0.937, "hi": 1.0}


def groups():
    rng = np.random.default_rng(7)
    return {
        "wide": rng.normal(size=3001) * 10.0 ** rng.integers(-30, 30, 3001), "ties": rng.integers(0, 3, 2500).astype(float), "two": np.array([1.0] * 1000 + [2.0] * 1000),
        "one": np.array([4.5]), "same": np.full(2000, -3.0), "skew": np.exp(rng.normal(size=4000) * 5), "ends": np.array([-math.inf] * 300 + [0.0] * 900 + [math.inf] * 300), None: rng.random(1500),
    }


def frame(spark):
    rows = [(k, float(v)) for k, vs in groups().items() for v in vs] + [("wide", None), ("wide", math.nan), ("nothing", None)]
    return spark.createDataFrame(rows, "k string, v double").repartition(7)


def sorted_quantile(values, p, method):
    s, n = sorted(values), len(values)
    at = (n - 1) * p if method == "linear" else min(max(n * p - 0.5, 0.0), n - 1.0)
    a, b = s[math.floor(at)], s[math.ceil(at)]
    return a if a == b else a + (b - a) * (at - math.floor(at))


@pytest.mark.parametrize("method, task_rows", [("linear", 40), ("linear", 1), ("linear", 1 << 20), ("hazen", 200)])
def test_quantiles_equal_sorting(spark, method, task_rows):
    got = {r["k"]: r for r in exact_quantiles(frame(spark), "v", ["k"], WANTED, method, task_rows).collect()}
    want = groups()
    assert set(got) == set(want)
    for k, values in want.items():
        assert got[k]["n"] == len(values)
        for name, p in WANTED.items():
            assert got[k][name] == pytest.approx(sorted_quantile(values, p, method), rel=1e-9), (k, name)


def test_whole_table_empty_table_and_two_keys(spark):
    rows = spark.range(5000).select((F.col("id") % 2).alias("a"), (F.col("id") % 5).alias("b"), F.col("id").cast("double").alias("v"))
    assert exact_quantiles(rows, "v", [], {"m": 0.5}, task_rows=10).collect() == [(5000, 2499.5)]
    assert exact_quantiles(rows.limit(0), "v", ["a"], {"m": 0.5}, task_rows=10).count() == 0
    assert exact_quantiles(rows.limit(0), "v", ["a"], {"m": 0.5}, "hazen").count() == 0
    small, large = (sorted(exact_quantiles(rows, "v", ["a", "b"], {"m": 0.3}, task_rows=t).collect()) for t in (10, 1 << 20))
    assert len(small) == 10 and [r[:3] for r in small] == [r[:3] for r in large]
    assert [r["m"] for r in small] == pytest.approx([r["m"] for r in large], rel=1e-12)


def test_box_and_describe_do_not_depend_on_the_size_of_a_task(spark):
    rows = frame(spark).where("k is null or k <> 'ends'")
    few, many = ({r["k"]: r for r in box_statistics(rows, "v", ["k"], task_rows=t).collect()} for t in (20, 1 << 20))
    assert few.keys() == many.keys() and None in few
    for k in few:
        assert tuple(few[k])[1:] == pytest.approx(tuple(many[k])[1:], rel=1e-9)
    wide = rows.select("v", F.lit(None).cast("double").alias("none"))
    few, many = ({r["column"]: r for r in describe(wide, ["v", "none"], t).collect()} for t in (20, 1 << 20))
    assert few["none"]["n"] == 0 and few["none"]["q1"] is None
    assert tuple(few["v"])[1:] == pytest.approx(tuple(many["v"])[1:], rel=1e-9)

import pytest

from wattloom.operators.quality import validation_gate
from wattloom.schema import HOURLY


@pytest.fixture
def frames(spark):
    row = lambda i, shift: (f"2024-01-01 00:00:{i % 60:02d}", *[float(i % 50) + shift] * 5, None if i < 20 else float(i))
    make = lambda shift, n=200: spark.createDataFrame([row(i, shift) for i in range(n)], "timestamp string, " + ", ".join(f"{c} double" for c in HOURLY.names[1:]))
    return make


def test_a_frame_like_the_base_passes(frames):
    report, passed = validation_gate(frames(0.0), frames(0.0), HOURLY)
    rows = report.collect()
    assert passed and len(rows) == 1 + 2 * 6 and all(r["passed"] for r in rows)
    assert {r["column"]: r["value"] for r in rows if r["check"] == "nulls"}["temp"] == 0.1


def test_drift_nulls_and_lacking_columns_fail(frames):
    report, passed = validation_gate(frames(0.0), frames(30.0), HOURLY, max_null_share=0.05)
    failed = {(r["check"], r["column"]) for r in report.where("not passed").collect()}
    assert not passed and ("nulls", "temp") in failed and ("drift", "SOLAR") in failed and ("drift", "temp") not in failed
    report, passed = validation_gate(frames(0.0), frames(0.0).drop("WIND_ONSHORE", "SOLAR"), HOURLY)
    assert not passed and [(r["check"], r["column"]) for r in report.collect()] == [("columns", "SOLAR"), ("columns", "WIND_ONSHORE")]
    assert validation_gate(frames(0.0), frames(0.0).limit(0), HOURLY)[1]

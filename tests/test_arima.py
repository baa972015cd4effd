import datetime as dt

import numpy as np
import pytest

from wattloom.operators.arima import Settings, Sums, arima_rolling_origin, auto_arima, fit_sums, forecast_values, seasonal_strength, unit_root

START = dt.datetime(2024, 1, 1)


def summed(y, settings):
    sums = Sums(settings)
    sums.add(np.asarray(y, float)[::-1])
    return sums


def arma(n, ar, ma, seed, c=0.0):
    rng = np.random.default_rng(seed)
    e = rng.normal(size=n + 200)
    z = np.zeros(n + 200)
    for t in range(10, n + 200):
        z[t] = c + sum(a * z[t - i] for i, a in enumerate(ar, 1)) + e[t] + sum(b * e[t - i] for i, b in enumerate(ma, 1))
    return z[200:]


def direct(y, settings, order):
    """The two regressions over plain columns, over the rows that have all lags."""
    p, d, q, sp, sd, sq = order
    m, z = settings.season, np.asarray(y, float)
    for _ in range(sd):
        z = z[m:] - z[:-m]
    for _ in range(d):
        z = np.diff(z)
    skip = settings.lags - (len(y) - len(z))
    rows = np.arange(skip, len(z))
    on = np.column_stack([np.ones(len(rows)), *[z[rows - k] for k in range(1, settings.long + 1)]])
    long = np.linalg.lstsq(on, z[rows], rcond=None)[0]
    lagged = lambda j: z[rows - j]
    resid = lambda j: z[rows - j] - long[0] - sum(c * z[rows - j - k] for k, c in enumerate(long[1:], 1))
    ar, ma = [*range(1, p + 1), *[m * i for i in range(1, sp + 1)]], [*range(1, q + 1), *[m * i for i in range(1, sq + 1)]]
    constant = [np.ones(len(rows))] if d + sd < 2 else []
    on = np.column_stack([*constant, *[lagged(j) for j in ar], *[resid(j) for j in ma], np.zeros((len(rows), 0))])
    got = np.linalg.lstsq(on, z[rows], rcond=None)[0]
    rest = float(np.sum((z[rows] - on @ got) ** 2))
    return got, rest / len(rows)


@pytest.mark.parametrize("season,ar,ma,c", [(0, [0.7], [], 5.0), (0, [0.5], [0.4], 0.0), (0, [], [0.6], 1.0), (6, [0.6], [0.3], 2.0)])
def test_sums_give_the_two_regressions(season, ar, ma, c):
    y = arma(3000, ar, ma, 5, c)
    if season:
        y = y + np.tile([0, 3, 6, 9, 6, 3], 500)
    settings = Settings(season=season)
    found = fit_sums(sum(summed(y, settings).grams.values()), settings)
    coefficients, sigma2 = direct(y - y[-1], settings, found.order)
    mine = [*([found.constant] if found.order[1] + found.order[4] < 2 else []), *found.ar.values(), *found.ma.values()]
    np.testing.assert_allclose(mine, coefficients, rtol=1e-5, atol=1e-6)
    assert found.sigma2 == pytest.approx(sigma2, rel=1e-6)
    assert 0.9 < found.sigma2 < 1.3
    assert found.order[4] == bool(season) and found.order[1] == 0


def test_moving_average_is_recovered():
    settings = Settings(most=2)
    y = arma(20_000, [0.6], [0.5], 11)
    gram = sum(summed(y, settings).grams.values())
    found = fit_sums(gram, settings)
    assert found.order[2] >= 1
    assert found.sigma2 == pytest.approx(1, abs=0.05)


def test_tests_for_differences():
    settings = Settings(season=12)
    rng = np.random.default_rng(2)
    walk, noise = np.cumsum(rng.normal(size=4000)), rng.normal(size=4000)
    wave = 3 * np.sin(np.arange(4000) * 2 * np.pi / 12)
    gram = lambda y: sum(summed(y, settings).grams.values())
    assert unit_root(gram(walk), {0: 1.0}, 4) and not unit_root(gram(noise), {0: 1.0}, 4)
    assert seasonal_strength(gram(wave + noise), 12) > 0.64 > seasonal_strength(gram(noise), 12)
    # against the plain correlation of the value less its trailing mean
    y = wave + noise
    u = y - np.array([y[max(0, t - 11) : t + 1].mean() for t in range(len(y))])
    rows = np.arange(settings.lags, len(y))
    assert seasonal_strength(gram(y), 12) == pytest.approx(np.corrcoef(u[rows], u[rows - 12])[0, 1], abs=1e-9)


def test_pieces_merge_to_the_same_sums():
    settings = Settings(season=4, h=3, windows=5, most=2)
    y = np.random.default_rng(3).normal(size=300)[::-1] + 1000
    whole = Sums(settings)
    whole.add(y)
    for cuts in ([100, 200], [1, 2, 3, 4, 290], [40, 45, 52, 60], list(range(10, 300, 10))):
        pieces = []
        for a, b in zip([0, *cuts], [*cuts, 300], strict=True):
            piece = Sums(settings, start=a, at=a)
            piece.add(y[a:b])
            pieces.append(piece)
        first = pieces[0]
        for piece in pieces[1:]:
            first.merge(piece)
        assert first.at == 300 and set(first.grams) == set(whole.grams)
        np.testing.assert_allclose(first.head, whole.head)
        for block, gram in whole.grams.items():
            np.testing.assert_allclose(first.grams[block], gram, rtol=1e-7, atol=1e-6)


def rows_of(name, y):
    return [(name, START + dt.timedelta(hours=i), float(v)) for i, v in enumerate(y)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "unique_id string, ds timestamp_ntz, y double")


def test_back_test_equals_separate_fits(spark):
    y = 50 + arma(500, [0.7], [0.3], 8) + np.tile(4 * np.sin(np.arange(8) * np.pi / 4), 63)[:500]
    rows = rows_of("a", y) + rows_of("short", y[:20]) + rows_of("one", y[:1])
    got = arima_rolling_origin(frame(spark, rows), season=8, windows=5, h=10, most=2).toPandas()
    for back in range(50, 0, -10):
        mine = got[(got.unique_id == "a") & (got.cutoff == START + dt.timedelta(hours=499 - back))].sort_values("step")
        alone = auto_arima(frame(spark, rows_of("a", y[:-back])), season=8, h=10, most=2).toPandas().sort_values("step")
        np.testing.assert_allclose(mine.forecast, alone.forecast, rtol=1e-6)
        np.testing.assert_allclose(mine.y, y[500 - back : 510 - back])
        assert (mine[["p", "d", "q", "sp", "sd", "sq"]].to_numpy() == alone[["p", "d", "q", "sp", "sd", "sq"]].to_numpy()).all()
        assert np.abs(mine.forecast - mine.y).mean() < 4
    short = got[got.unique_id == "short"].sort_values(["cutoff", "step"])
    assert len(short) == 10 and np.allclose(short.forecast, y[9])
    assert not len(got[got.unique_id == "one"])


def test_a_series_over_many_tasks(spark):
    y = 20 + arma(900, [0.8], [0.2], 4)
    rows = rows_of("long", y) + [r for i in range(12) for r in rows_of(f"s{i:02}", y[i : i + 60])] + [("nan", START, float("nan")), ("gone", None, 1.0), (None, START, 1.0)]
    alone = auto_arima(frame(spark, rows_of("long", y)).coalesce(1), h=6, most=3).toPandas().sort_values("step")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        got = auto_arima(frame(spark, rows), h=6, most=3).toPandas()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got.groupby("unique_id").size().to_dict() == {"long": 6} | {f"s{i:02}": 6 for i in range(12)}
    np.testing.assert_allclose(got[got.unique_id == "long"].sort_values("step").forecast, alone.forecast, rtol=1e-6)
    settings = Settings(h=6, most=3)
    assert np.allclose(alone.forecast, forecast_values(fit_sums(sum(summed(y, settings).grams.values()), settings), y[::-1][: settings.lags + 1], settings, y[-1]))
    assert auto_arima(frame(spark, rows[:0])).count() == 0

import itertools
import math

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from wattloom.operators.boosting import Boost, Boosted, _Trainer, best_split, fit_boosted, to_bins


def frame(spark, x, y, parts=3):
    rows = [(i, [float(v) for v in a], [None if v is None else float(v) for v in np.atleast_1d(b)]) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "id int, x array<double>, y array<double>").repartition(parts, "id")
    return df.select("id", array_to_vector("x").alias("features"), "y")


def plain(x, y, p, leafwise):
    """The same trees by exhaustive search over rows, one split at a time."""
    n, width = x.shape
    edges = [np.unique(x[~np.isnan(x[:, f]), f])[:-1] for f in range(width)]
    start = y.mean()
    now = np.full(n, start)
    for _ in range(p.trees):
        g = now - y
        leaves = [(np.arange(n), 0)]
        gone = []

        def search(rows):
            best = None
            score = lambda r: g[r].sum() ** 2 / (len(r) + p.l2)
            for missing_left in (True, False):
                for f in range(width):
                    for e in edges[f]:
                        v = x[rows, f]
                        left = np.where(np.isnan(v), missing_left, v <= e)
                        a, b = rows[left], rows[~left]
                        if min(len(a), len(b)) >= p.least_rows:
                            gain = (score(a) + score(b) - score(rows)) / 2
                            if gain > 1e-12 and (best is None or gain > best[0] + 1e-9):
                                best = gain, a, b
            return best

        while leaves and (not leafwise or len(leaves) + len(gone) < p.leaves):
            tried = [(search(r), i) for i, (r, d) in enumerate(leaves) if leafwise or d < p.depth]
            tried = [(s, i) for s, i in tried if s]
            if not tried:
                break
            (gain, a, b), i = max(tried, key=lambda t: (t[0][0], -t[1]))
            d = leaves.pop(i)[1]
            leaves += [(a, d + 1), (b, d + 1)]
        for rows, _ in leaves:
            if len(leaves) > 1:
                now[rows] += -p.rate * g[rows].sum() / (len(rows) + p.l2)
    return now


def data(seed, n=60, missing=True):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 12, (n, 4)).astype(float) + rng.random((n, 4)) * 1e-3
    y = 3 * (x[:, 0] > 5) + x[:, 1] * 0.5 + rng.normal(size=n) * 0.3
    if missing:
        x[rng.random((n, 4)) < 0.15] = np.nan
    return x, y


def made(spark, model, df):
    return np.array([r["prediction"] for r in model.transform(df).orderBy("id").collect()])


@pytest.mark.parametrize("leaves", [0, 6])
def test_trees_equal_an_exhaustive_search(spark, leaves):
    x, y = data(1)
    p = Boost(trees=2, rate=0.5, depth=3, leaves=leaves, bins=200)
    model = fit_boosted(frame(spark, x, y), ("y",), p)
    np.testing.assert_allclose(made(spark, model, frame(spark, x, y))[:, 0], plain(x, y, p, bool(leaves)), atol=1e-9)
    if leaves:
        assert all(t.left.count(-1) and len(reached(t)) == leaves for t in model.trees[0])
    again = Boosted.loads(model.dumps())
    np.testing.assert_array_equal(again.predict(list(x[0])), model.predict(list(x[0])))


def reached(tree):
    out, todo = [], [0]
    while todo:
        n = todo.pop()
        if tree.left[n] < 0:
            out.append(n)
        else:
            todo += [tree.left[n], tree.left[n] + 1]
    return out


def test_best_split_tries_all():
    rng = np.random.default_rng(4)
    for _ in range(30):
        hist = np.stack([rng.normal(size=(3, 6)), rng.integers(0, 4, (3, 6)).astype(float)], axis=-1)
        hist[1:, 0] += hist[0].sum(0) - hist[1:].sum(1)  # all features see the same rows
        hist[..., 1] = np.abs(hist[..., 1])
        hist[1:, 0] += hist[0].sum(0) - hist[1:].sum(1)
        p = Boost(l2=0.7)
        best = -math.inf
        for f, b, side in itertools.product(range(3), range(1, 5), (True, False)):
            left = hist[f, 1 : b + 1].sum(0) + (hist[f, 0] if side else 0)
            right = hist[0].sum(0) - left
            if min(left[1], right[1]) >= 1:
                best = max(best, (left[0] ** 2 / (left[1] + 0.7) + right[0] ** 2 / (right[1] + 0.7) - hist[0].sum(0)[0] ** 2 / (hist[0].sum(0)[1] + 0.7)) / 2)
        got = best_split(hist, 0, p)
        assert (got is None and best <= 1e-12) or got.gain == pytest.approx(best)


def test_targets_together_equal_targets_alone(spark):
    x, y = data(2)
    both = np.column_stack([y, -2 * y + x[:, 2].round(0)])
    both[np.isnan(both)] = 0
    p = Boost(trees=10, depth=2, bins=16, subsample=0.8)
    model = fit_boosted(frame(spark, x, both), ("a", "b"), p)
    got = made(spark, model, frame(spark, x, both))
    assert np.mean((got[:, 0] - y) ** 2) < 0.6 * np.var(y)
    more = fit_boosted(frame(spark, x, both, parts=5), ("a", "b"), p)
    np.testing.assert_allclose(made(spark, more, frame(spark, x, both)), got, atol=1e-9)


def test_gradient_sampling_keeps_the_large_ones(spark):
    x, y = data(3, n=400, missing=False)
    p = Boost(trees=6, rate=0.3, leaves=8, bins=32, top=0.3, rest=0.2)
    df = frame(spark, x, y)
    model = fit_boosted(df, ("y",), p)
    full = fit_boosted(df, ("y",), Boost(trees=6, rate=0.3, leaves=8, bins=32))
    error = lambda m: np.mean((made(spark, m, df)[:, 0] - y) ** 2)
    assert abs(error(full) - error(model)) < 0.3 * error(full)
    trainer = _Trainer(df, model, p, 1)
    g = np.arange(1000.0)
    w = trainer._weights(np.arange(1000), g, 0, 0, [700.0])
    assert (w[700:] == 1).all() and set(w[:700]) == {0.0, 0.7 / 0.2} and abs(w.sum() - 1000) < 150


def test_nothing_to_learn(spark):
    x = np.array([[1.0, np.nan], [1.0, np.nan], [1.0, np.nan]])
    model = fit_boosted(frame(spark, x, [2.0, 2.0, 2.0]), ("y",), Boost(trees=2))
    assert model.predict([5.0, 1.0]) == [2.0]
    some = fit_boosted(frame(spark, x, [[2.0, None], [4.0, None], [6.0, 1.0]]), ("a", "b"), Boost(trees=1))
    assert some.start == [4.0, 1.0]
    empty = fit_boosted(frame(spark, x, [2.0, 2.0, 2.0]).where(F.lit(False)), ("y",), Boost(trees=2))
    assert empty.start == [0.0] and empty.trees == [[]]
    assert to_bins(np.array([[np.nan], [1.0], [2.0]]), [np.array([1.0])]).tolist() == [[0], [1], [2]]

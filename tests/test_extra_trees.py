import itertools
import math

import numpy as np
import pytest

from tests.test_boosting import frame, made
from wattloom.operators.extra_trees import Extra, ExtraTrees, choose, draw, fit_extra
from wattloom.operators.quality import EXACT_ROWS, ks_p_value


def plain(x, y, p, tree):
    """One tree grown row by row, its nodes numbered level by level."""
    out = np.empty_like(y)
    level, number = [(0, np.arange(len(x)))], 1
    for depth in range(p.depth + 1):
        below = []
        for node, rows in sorted(level, key=lambda v: v[0]):
            out[rows] = y[rows].mean(axis=0)
            if depth == p.depth or len(rows) < p.least_split:
                continue
            with np.errstate(all="ignore"):
                at = draw(np.fmin.reduce(x[rows]), np.fmax.reduce(x[rows]), p.seed, tree, node)
            error = lambda r: ((y[r] - y[r].mean(axis=0)) ** 2).sum() if len(r) else 0.0
            best = None
            for f in range(x.shape[1]):
                left = x[rows, f] <= at[f]
                a, b = rows[left], rows[~left]
                if min(len(a), len(b)) >= p.least_leaf:
                    gain = error(rows) - error(a) - error(b)
                    if gain > 1e-12 and (best is None or gain > best[0] + 1e-9):
                        best = gain, a, b
            if best:
                below.append((node, best[1], best[2]))
        level = []
        for _, a, b in below:
            level += [(number, a), (number + 1, b)]
            number += 2
    return out


def test_equals_a_plain_recomputation(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(90, 5))
    x[:, 3] = 1.0
    y = np.column_stack([2 * x[:, 0] + rng.normal(size=90) * 0.1, np.where(x[:, 1] > 0, 3.0, -1.0)])
    x[rng.random((90, 5)) < 0.1] = np.nan
    p = Extra(trees=3, depth=4, least_split=5, least_leaf=2)
    df = frame(spark, x, y)
    model = fit_extra(df, ("a", "b"), p)
    got = made(spark, model, df)
    np.testing.assert_allclose(got, sum(plain(x, y, p, t) for t in range(3)) / 3, atol=1e-9)
    np.testing.assert_allclose(made(spark, fit_extra(frame(spark, x, y, parts=7), ("a", "b"), p), df), got, atol=1e-9)
    assert np.mean((got - y) ** 2) < 0.5 * np.var(y, axis=0).mean()
    np.testing.assert_allclose(ExtraTrees.loads(model.dumps()).predict(list(x[0])), got[0])
    full = fit_extra(df, ("a", "b"), Extra(trees=1, depth=30))
    assert np.mean((made(spark, full, df) - y) ** 2) < 1e-3


def test_nothing_to_learn(spark):
    df = frame(spark, [[1.0], [1.0]], [[2.0], [4.0]])
    assert fit_extra(df, ("y",), Extra(trees=2)).predict([9.0]) == [3.0]
    assert math.isnan(fit_extra(df.where("false"), ("y",), Extra(trees=1)).predict([9.0])[0])
    assert choose(np.array([[0.0, 0.0]]), np.array([4.0, 1.0]), 1) is None


@pytest.mark.parametrize("n,m", [(1, 1), (2, 3), (4, 4), (5, 8), (7, 6), (8, 8)])
def test_exact_ks_p_value_equals_enumeration(n, m):
    distances = []
    for picked in itertools.combinations(range(n + m), n):
        i = j = 0
        most = 0
        chosen = set(picked)
        for k in range(n + m):
            i, j = (i + 1, j) if k in chosen else (i, j + 1)
            most = max(most, abs(i * m - j * n))
        distances.append(most)
    for d in sorted(set(distances)):
        assert ks_p_value(d / (n * m), n, m) == pytest.approx(sum(v >= d for v in distances) / len(distances), abs=1e-12)


def test_exact_p_value_nears_the_asymptotic_one():
    assert ks_p_value(0.03, EXACT_ROWS, EXACT_ROWS - 7) == pytest.approx(ks_p_value(0.03, EXACT_ROWS + 1, EXACT_ROWS - 7), rel=0.05)

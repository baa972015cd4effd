import math

import numpy as np
import pytest

from wattloom.llm.embedding_dedup import embedding_dedup, fit_quantiser


def brute(rows, cosine=0.93):
    usable = lambda i, v, l: i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)
    ok = [usable(*r) for r in rows]
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if k else None for (_, v, _), k in zip(rows, ok, strict=True)]
    links = [[j for j in range(len(rows)) if j != i and ok[i] and ok[j] and rows[i][2] == rows[j][2] and unit[i] @ unit[j] >= cosine] for i in range(len(rows))]
    component = [r[0] for r in rows]
    changed = True
    while changed:
        changed = False
        for i, near in enumerate(links):
            for j in near:
                if component[j] < component[i]:
                    component[i], changed = component[j], True
    return sorted(((r[0], len(k), c, r[0] is not None and r[0] == c) for r, k, c in zip(rows, links, component, strict=True)), key=str)


@pytest.mark.parametrize("tile, lists", [(512, None), (7, 5), (16, 1)])
def test_matches_brute_force(spark, tile, lists):
    rng = np.random.default_rng(tile)
    centre = rng.normal(size=(6, 16))
    rows = [(int(i), (centre[i % 6] + rng.normal(size=16) * (0.02 + 0.4 * (i % 4 == 0))).astype(np.float32).tolist(), int(i % 2)) for i in rng.permutation(160)]
    rows += [(500, rows[0][1], rows[0][2]), (501, [2 * x for x in rows[0][1]], rows[0][2]), (502, None, 1), (503, [0.0] * 16, 1), (504, [math.nan] * 16, 1), (505, [None] * 16, 1), (506, rows[0][1], None), (507, [math.inf] * 16, 1), (None, rows[0][1], rows[0][2])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, n string").repartition(3)
    got = sorted(map(tuple, embedding_dedup(df, tile=tile, lists=lists).collect()), key=str)
    assert got == brute(rows)


@pytest.mark.parametrize("few_first, fitted", [(True, 16), (False, 1)])
def test_every_length_is_searched(spark, few_first, fitted):
    rng = np.random.default_rng(2)
    made = lambda start, n, d: [(start + i, (c + rng.normal(size=d) * 0.02).tolist(), 1) for i, c in enumerate(np.repeat(rng.normal(size=(4, d)), n // 4, axis=0))]
    few, many = made(0 if few_first else 500, 12, 5), made(100, 60, 16)
    few.append((900, few[0][1], 1))
    df = spark.createDataFrame(few + many if few_first else many + few, "vec_id long, embedding array<float>, label int").coalesce(1)
    as_float = lambda rows: [(i, np.array(v, np.float32).astype(float).tolist(), k) for i, v, k in rows]
    got = sorted(map(tuple, embedding_dedup(df, fitted_lengths=fitted, tile=7).collect()), key=str)
    assert got == sorted(brute(as_float(few)) + brute(as_float(many)), key=str) and all(r[1] for r in got)


def test_no_rows(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding_dedup(df).count() == 0
    none = spark.createDataFrame([(1, None, 1)], df.schema)
    assert [tuple(r) for r in embedding_dedup(none).collect()] == [(1, 0, 1, True)]


def test_probes_reach_every_neighbour():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(800, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    model = fit_quantiser(x[:400], 12)
    own = model.nearest(x)
    probes = model.probes(x, own, 0.9, 12)
    close = ((x[:, None] - x[None]) ** 2).sum(-1) <= 0.81
    assert all(own[j] in probes[i] for i, j in zip(*np.nonzero(close), strict=True))
    assert (probes[:, 0] == own).all() and (model.probes(x, own, 0.9, 3).shape == (800, 3))
    codes, missed = model.encode(x, own)
    rebuilt = model.centres[own] + np.concatenate([model.books[j][codes[:, j]] for j in range(model.books.shape[0])], axis=1)
    assert np.allclose(np.linalg.norm(x - rebuilt, axis=1), missed)


def test_large_and_small_components(spark):
    rows = [(1, [1e200, 1e200], 1), (2, [2e200, 2e200], 1), (3, [5e-324, 0.0], 1), (4, [1.0, 0.0], 1), (5, [1.7e308, 0.0], 1), (6, [1e200, -1e200], 1)]
    got = sorted(map(tuple, embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()))
    assert got == [(1, 1, 1, True), (2, 1, 1, False), (3, 2, 3, True), (4, 2, 3, False), (5, 2, 3, False), (6, 0, 6, True)]


def test_recall_of_few_probes_near_the_threshold(spark):
    """Pairs at cosines of 0.93 to 0.95, 40 lists and 4 probes: the links found are at least 0.97 of all, and none is wrong."""
    rng = np.random.default_rng(8)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    base = unit(rng.normal(size=(1500, 64)))
    away = rng.normal(size=base.shape)
    away = unit(away - (away * base).sum(1, keepdims=True) * base)
    cosine = rng.uniform(0.931, 0.95, (len(base), 1))
    x = np.concatenate([base, cosine * base + np.sqrt(1 - cosine**2) * away])
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup(df, lists=40).collect()}
    want = (x @ x.T >= 0.93).sum(axis=1) - 1
    assert all(got[i] <= want[i] for i in range(len(x))) and sum(got.values()) >= 0.97 * want.sum()
    print("recall", sum(got.values()) / want.sum())

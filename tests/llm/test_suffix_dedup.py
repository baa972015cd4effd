import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from wattloom.llm import suffix_dedup as S
from wattloom.llm.suffix_dedup import remove_repeats


def brute(texts, width):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + width] for r in raw for i in range(len(r) - width + 1))
    out = []
    for r in raw:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - width + 1):
            if seen[r[i : i + width]] > 1:
                gone[i : i + width] = True
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((len(r), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(r, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abcdé \n\0") for _ in range(n))
    shared = [word(rng.randrange(10, 90)) for _ in range(6)]
    texts = ["".join(rng.choice(shared) if rng.random() < 0.3 else word(rng.randrange(0, 40)) for _ in range(rng.randrange(0, 6))) for _ in range(80)]
    return [*texts, texts[3], None, "", "ab" * 300, "abcabcabc" * 40, "z" * 39, "z" * 40, word(3000)]


@pytest.mark.parametrize("settings", [
    {"batch_bytes": 200, "hold": 100}, {"most_strips": 1, "longest": 16}, {"most_windows": 10, "grams": (8,)}, {"grams": (40,)},
])
def test_matches_brute_force(spark, settings):
    texts = corpus(len(settings))
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, h string").repartition(3)
    got = S.remove_repeats(df, 40, **({"grams": (8, 16)} | settings)).orderBy("doc_id").collect()
    assert [(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got] == brute(texts, 40)
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] and sum(b - a for a, b in r["spans"]) == r["n_removed"] for r in got)


def test_repeated_rows_and_ids(spark):
    rng = random.Random(9)
    a, b = ("".join(rng.choice("abcdefgh") for _ in range(120)) for _ in range(2))
    rows = [(1, a), (1, a), (2, b), (2, b[::-1]), (None, b)]
    got = S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 40, grams=(8, 16)).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in got if r["doc_id"]) == [(1, 120), (1, 120), (2, 0), (2, 120)]
    assert [r["n_removed"] for r in got if r["doc_id"] is None] == [120]
    assert S.remove_repeats(spark.createDataFrame([], "doc_id long, text string"), 40).count() == 0


def test_levels_grow_geometrically():
    data = bytes(np.random.default_rng(0).integers(97, 123, 5000, np.uint8))
    found = set()
    family = S.SuffixFamily(40, lambda refs: found.update(refs.tolist()))
    for k in range(0, 4900, 100):
        family.add(data, np.arange(k, min(k + 100, 4961)), np.arange(k, min(k + 100, 4961)))
        sizes = list(map(len, family.levels))
        assert all(a > 2 * b - 1 or a > b for a, b in zip(sizes, sizes[1:], strict=False)) and len(sizes) <= 8
    assert not found and len(family) == 4900
    family.add(data, np.arange(10, 20), np.arange(10_000, 10_010))
    assert found == {*range(10, 20), *range(10_000, 10_010)}


def test_a_suffix_array_orders_window_starts():
    rng = np.random.default_rng(4)
    data = rng.choice(np.frombuffer(b"ab\0\xff", np.uint8), 3000)
    data = np.concatenate([data, data[500:1500], np.frombuffer(b"xy" * 200, np.uint8)])
    for width in (3, 5, 8, 37, 64):
        for starts in (np.arange(len(data) - width + 1), np.arange(0, len(data) - width, 50)):
            order, same = S.suffix_order(data, starts, width)
            got = [data[a : a + width].tobytes() for a in starts[order]]
            assert got == sorted(got) and same.tolist() == [False, *(a == b for a, b in zip(got, got[1:], strict=False))]


def test_a_merge_scan_tells_rank_and_shared_prefix():
    rng = np.random.default_rng(5)
    raw = rng.integers(97, 100, 2008, np.uint8)
    raw[1000:1300] = raw[200:500]

    def level(starts, width):
        order, same = S.suffix_order(raw, starts, width)
        return S.SuffixLevel(raw, starts[order[~same]], starts[order[~same]], width)

    for width in (6, 24, 61):
        a, b = level(np.arange(0, 900), width), level(np.arange(900, 1900), width)
        rank, shared = a.merge_scan(b)
        mine = [raw[i : i + width].tobytes() for i in a.starts]
        for r, n, i in zip(rank, shared, b.starts, strict=True):
            key = raw[i : i + width].tobytes()
            assert r == sum(m < key for m in mine) and (n >= width) == (key in mine)
        rest = b.only(shared < width)
        both = a.merged(rest)
        keys = [both.data[i : i + width].tobytes() for i in both.starts]
        assert keys == sorted(keys) and len(set(keys)) == len(a) + len(rest) and sorted(both.refs) == sorted([*a.refs, *rest.refs])


def test_rows_without_an_id_send_their_strips_once(spark):
    """Many rows of one text give what as many ids give, and no more pieces than one row."""
    rng = random.Random(8)
    text = "".join(chr(rng.randrange(97, 123)) for _ in range(3000))
    rows = [(None, text)] * 300 + [(5, text[500:1700] + "x" * 50)] * 2 + [(6, "alone" * 10)]
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), width=400).collect()
    assert len(got) == len(rows)
    assert all(r["n_removed"] == 3000 for r in got if r["doc_id"] is None)
    assert [r["n_removed"] for r in got if r["doc_id"] == 5] == [1250, 1250] and [r["n_removed"] for r in got if r["doc_id"] == 6] == [0]

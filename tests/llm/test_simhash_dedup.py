import random

import numpy as np
import pytest
import xxhash

from wattloom.llm.simhash_dedup import _link_runs, block_masks, fingerprint, hamming_links, near_copies, near_prints, simhash_dedup


def plain(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if hashes and 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", " \t\n", "one", "One two three", "a b c d", "a b c d e", "É é Ä " * 7, "x\u00a0y z " * 5, "word " * 70_000])
def test_fingerprint(text):
    assert fingerprint(text) % 2**64 == plain(text)


def test_every_close_pair_shares_a_key():
    rng = random.Random(0)
    for n in (5, 6, 7, 8):
        masks = block_masks(4, n)
        for _ in range(200):
            a = rng.getrandbits(64)
            b = a ^ sum(1 << k for k in rng.sample(range(64), 4))
            assert any(a & m == b & m for m in masks)


def components(fps, radius):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


@pytest.mark.parametrize("n_blocks, run_limit", [(6, 100_000), (5, 4)])
def test_links_join_what_is_close(spark, n_blocks, run_limit):
    rng = random.Random(n_blocks)
    fps = [rng.getrandbits(64) for _ in range(60)]
    fps += [f ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(1, 6))) for f in fps[:20] for _ in range(3)]
    fps = list(dict.fromkeys(fps))
    nodes = spark.createDataFrame([(f - 2**64 if f >> 63 else f, i) for i, f in enumerate(fps)], "fp long, node long")
    links = [(r["a"], r["b"]) for r in hamming_links(nodes, 4, n_blocks, run_limit).collect()]
    assert all((fps[a] ^ fps[b]).bit_count() <= 4 for a, b in links)
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    assert [root(i) for i in range(len(fps))] == components(fps, 4)


def test_runs_go_on_over_batches():
    import pyarrow as pa

    fps = np.array([1, 3, 7, 7 << 40, 5, 9], np.int64)
    batch = lambda a, b: pa.RecordBatch.from_arrays([pa.array(x[a:b], pa.int64()) for x in (np.ones(6, np.int64), np.array([0, 0, 0, 0, 0, 2]), fps, np.arange(6))], names=["mask", "key", "fp", "node"])
    for cuts in ([(0, 6)], [(0, 1), (1, 3), (3, 6)], [(k, k + 1) for k in range(6)]):
        found = set()
        for out in _link_runs(2, 100)(batch(a, b) for a, b in cuts):
            found |= {n for r in out.to_pylist() for n in (r["a"], r["b"])}
        assert found == {0, 1, 2, 4}


def test_documents(spark):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(5, base), (3, base), (9, base + " tail"), (7, "other words here and more"), (8, None), (2, " "), (None, base), (None, "alone it is here now"), (7, "other words here and more")]
    df = spark.createDataFrame([(i, t, "c", 1) for i, t in rows], "doc_id long, text string, fp string, node int")
    got = simhash_dedup(df).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    near = (plain(base) ^ plain(base + " tail")).bit_count() <= 4
    assert by_id[5]["component_id"] == by_id[3]["component_id"] == 3 and (by_id[9]["component_id"] == 3) == near
    assert by_id[8]["component_id"] == by_id[2]["component_id"] == 2 and by_id[8]["fingerprint"] == "0" * 16
    assert sorted((r["component_id"] for r in got if r["doc_id"] is None), key=str) == [3, None]
    assert simhash_dedup(df.limit(0)).count() == 0


def near_groups(prints, radius=6, far=50):
    """The least index reachable over near links, by a loop over all pairs of ``near_prints``."""
    bits = [[x % 2**64 for x in p] for p in prints]
    close = lambda p, q: min((p[k] ^ q[k]).bit_count() for k in (0, 1)) <= radius and sum((p[k] ^ q[k]).bit_count() for k in range(2, 6)) <= far
    group = list(range(len(bits)))
    for i in range(len(bits)):
        for j in range(i):
            if group[i] != group[j] and close(bits[i], bits[j]):
                a, b = sorted((group[i], group[j]))
                group = [a if g == b else g for g in group]
    return group


def edited(rng, text, edits):
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("run_limit", [100_000, 3])
def test_near_copies_match_all_pairs(spark, run_limit):
    rng = random.Random(5)
    fresh = lambda n: " ".join(rng.choice(["the", "of", "and"]) if k % 3 == 0 else f"w{rng.randrange(3000)}" for k in range(n))
    texts = [fresh(rng.randrange(3, 300)) for _ in range(40)]
    texts += [edited(rng, t, rng.randrange(1, 8)) for t in texts[:15] for _ in range(2)]
    texts += ["one", "one", "two", "a b c d", "a b c d e", "", " ", None, " ".join(["###"] * 70), " ".join(["###"] * 90)]
    got = {r["doc_id"]: r["component_id"] for r in near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), run_limit=run_limit).collect()}
    want = near_groups([near_prints(t) for t in texts])
    assert [got[i] for i in range(len(texts))] == want and len(set(want)) < len(texts) - 15


def test_near_copies_find_edited_texts_and_leave_others(spark):
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(150)) for _ in range(60)]
    pairs = [edited(rng, t, 3) for t in texts]  # 15 of some 146 shingles change: a similarity of about 0.8
    grams = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    similar = [len(grams(a) & grams(b)) / len(grams(a) | grams(b)) >= 0.8 for a, b in zip(texts, pairs, strict=True)]
    got = {r["doc_id"]: r["component_id"] for r in near_copies(spark.createDataFrame(list(enumerate(texts + pairs)), "doc_id long, text string")).collect()}
    assert np.mean([got[i + 60] == i for i in range(60) if similar[i]]) >= 0.9 and sum(similar) > 30
    assert [got[i] for i in range(60)] == list(range(60))


def test_near_copies_of_odd_rows(spark):
    long = "river stone walks under the hill " * 200_000
    rows = [(4, "a b c d e f", "x"), (2, "a b c d e f", "x"), (2, "other words are in here", "x"), (None, "a b c d e f", "x"), (None, "alone it is here now", "x"), (7, None, "x"), (6, "", "x"), (9, long, "x"), (8, long, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, f0 string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in near_copies(df).collect()), key=str)
    assert got == sorted([(4, 2), (2, 2), (2, 2), (None, 2), (None, None), (7, 6), (6, 6), (9, 8), (8, 8)], key=str)
    assert near_copies(df.limit(0)).count() == 0


def test_ids_of_any_size(spark):
    """Ids beyond 2^62, negative ids and rows without one: components are named by the least id, or by none."""
    base, other = " ".join(f"w{i}" for i in range(300)), "quite another text of a few words"
    rows = [(2**62 + 5, base), (2**63 - 1, base), (None, base), (-(2**63), other), (2**62, other), (None, "without any id at all")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for found in (simhash_dedup(df), near_copies(df)):
        got = [(r["doc_id"], r["component_id"]) for r in found.collect()]
        assert sorted(r for r in got if r[0] is not None) == [(-(2**63), -(2**63)), (2**62, -(2**63)), (2**62 + 5, 2**62 + 5), (2**63 - 1, 2**62 + 5)]
        assert sorted((c for i, c in got if i is None), key=str) == [2**62 + 5, None]

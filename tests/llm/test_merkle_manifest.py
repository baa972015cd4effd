import hashlib
import random
import zlib
from collections import Counter

import pytest

from wattloom.llm.merkle_manifest import Parents, digest, fold, level_sizes, manifest, tampered_text, verified

H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    out = ""
    for v in row:
        text = None if v is None else str(v)
        out += "-" if text is None else f"{len(text.encode())}:{text}"
    return H(out)


def tree(leaves):
    """Top and, for each leaf, its siblings level by level, with where it stands among them."""
    levels = [list(leaves)]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    proofs = []
    for i in range(len(leaves)):
        steps = []
        for level in levels[:-1]:
            run = level[i // 8 * 8 : i // 8 * 8 + 8]
            steps.append((i % 8, run[: i % 8] + run[i % 8 + 1 :]))
            i //= 8
        proofs.append(steps)
    return levels[-1][0], proofs


def brute(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    none_first = lambda v: (v is not None, v.encode() if isinstance(v, str) else v if v is not None else 0)
    langs = sorted({r[2] for r in rows}, key=none_first)
    trees = {}
    for lang in langs:
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (none_first(r[0]), leaf(r)))
        trees[lang] = own, *tree([leaf(r) for r in own])
    root, ups = tree([trees[lang][1] for lang in langs])
    out = Counter()
    for lang, up in zip(langs, ups, strict=True):
        own, top, proofs = trees[lang]
        for r, proof in zip(own, proofs, strict=True):
            proof = proof + up
            text = r[4]
            if text is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            folded = leaf((*r[:4], text))
            for place, others in proof:
                folded = H(*others[:place], folded, *others[place:])
            out[r[0], leaf(r), top, root, H(*[d for _, others in proof for d in others]), folded, folded == root] += 1
    return out


def check(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, index int, value string").repartition(parts)
    got = verified(manifest(df, tampered_text())).collect()
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert Counter(tuple(r[n] for n in names) for r in got) == brute(rows)


def test_nulls_repeats_and_one_leaf(spark):
    rng = random.Random(2)
    rows = [(i, "s", rng.choice(["en", "en", "de", "é"]), 3, rng.choice(["Abc", "abc", "", "Ünï X"])) for i in range(90)]
    rows += [(None, None, None, None, None), (None, "s", "en", 1, "A"), (4, "s", "en", 3, "Abc"), (4, "s", "en", 3, "Abc"), (-5, "", "", 0, "Q"), (2**62, "s", "en", 3, "Z" * 5000)]
    check(spark, rows)
    check(spark, [(1, "s", "en", 1, "One")])
    check(spark, [(3, "s", "en", 1, "One"), (3, "s", None, 1, "One")])


@pytest.mark.parametrize("n", [8, 9, 64, 65, 513, 1300])
def test_sizes_around_full_levels(spark, n):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        check(spark, [(i, "s", "hot", 1, f"T{i}") for i in range(n)] + [(i, "s", f"l{i}", 1, "T") for i in range(n % 11)])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string")
    found = manifest(df, tampered_text())
    assert found.root is None and verified(found).count() == 0 and found.subroots.count() == 0


def test_events_in_any_order_and_any_split():
    rng = random.Random(4)
    for n in (1, 2, 8, 9, 70, 511, 512):
        leaves = [H(str(i)) for i in range(n)]
        events = [(0, i, v) for i, v in enumerate(leaves)]
        rng.shuffle(events)
        parts = [Parents(level_sizes(n)) for _ in range(3)]
        for e in events:
            rng.choice(parts).add(*e)
        assert parts[0].merge(parts[1]).merge(parts[2]).top == tree(leaves)[0]
        assert not parts[0].pending
    assert digest(["a", "b"]) == H("ab")


def test_proof_of_each_document(spark):
    rows = [(i, "s", "en" if i % 4 else "de", 1, f"Text {i}") for i in range(40)]
    found = manifest(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string"))
    assert found.proofs.where(fold(found.proofs.leaf, found.proofs.proof) != found.root).count() == 0
    assert {r["lang"] for r in found.subroots.collect()} == {"en", "de"}
    assert all(len(p["others"]) % 64 == 0 for r in found.proofs.collect() for p in r["proof"])

import hashlib
import random

import pytest

from wattloom.llm.exact_dedup import PatriciaTrie, exact_dedup


def check(spark, rows, **settings):
    df = spark.createDataFrame(rows, "doc_id long, text string, h string, text_sha256 int, owner string").repartition(3)
    got = exact_dedup(df, **settings).collect()
    smallest = settings.get("keep") == "smallest"
    groups = {}
    for r in rows:
        groups.setdefault(r[1] or "", []).append(r[0])
    assert len(got) == len(rows)
    kept = {}
    for r in got:
        text = next(t for t in groups if hashlib.sha256(t.encode()).hexdigest() == r["text_sha256"])
        ids = [i for i in groups[text] if i is not None]
        want = (min if smallest else max)(ids) if ids else None
        assert (r["keep_id"], r["group_size"]) == (want, len(groups[text]))
        kept[text] = kept.get(text, 0) + r["kept"]
        assert not r["kept"] or r["doc_id"] == want
    assert all(kept[t] == 1 for t in groups)


def test_groups_nulls_and_repeats(spark):
    rows = [(1, "a", "x", 1, ""), (2, "a", "x", 1, ""), (3, None, None, None, None), (4, "", "", 0, ""), (5, "b", "x", 1, ""), (5, "b", "x", 1, ""), (None, "a", "", 1, ""), (None, "z", "", 1, ""), (6, "a" * 200_000, "", 1, ""), (7, "a" * 200_000, "", 1, "")]
    check(spark, rows)
    check(spark, rows, keep="smallest")
    assert exact_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_hot_group_over_many_partitions(spark):
    rows = [(i, "hot" if i % 3 else f"text {i}", "", 0, "") for i in range(900)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        check(spark, rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_hot_group_of_one_id(spark):
    """Rows that repeat one id and text, or have no id, lie in many partitions; one row of each text stays."""
    rows = [(7, "hot", "", 0, "")] * 500 + [(None, "cold", "", 0, "")] * 500 + [(i, f"text {i}", "", 0, "") for i in range(100)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        check(spark, rows)
        check(spark, rows, keep="smallest", memory=300)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("memory", [1 << 30, 4000, 600])
def test_trie_spills_and_finds_all(memory, tmp_path):
    rng = random.Random(memory)
    keys = ["same prefix ".encode() * rng.randrange(3) + bytes(rng.randrange(97, 100) for _ in range(rng.randrange(30))) for _ in range(600)]
    trie = PatriciaTrie(memory, str(tmp_path))
    owners = [(False, rng.randrange(50), i) for i in range(len(keys))]
    terms = [trie.insert(k, owner) for k, owner in zip(keys, owners, strict=True)]
    assert memory > 1 << 20 or -1 in terms
    for owner, term in trie.settle():
        terms[owner[2]] = term
    by_key = {}
    for k, t in zip(keys, terms, strict=True):
        assert t >= 0 and by_key.setdefault(k, t) == t
    for k, t in by_key.items():
        mine = [o for o, other in zip(owners, keys, strict=True) if other == k]
        assert trie.terms[t] == [min(mine), len(mine)]

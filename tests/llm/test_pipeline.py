import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline as C
from tests.llm.test_simhash_dedup import near_groups
from tests.llm.test_source_mix import targets
from wattloom.llm import quality_model as Q
from wattloom.llm import queries
from wattloom.llm.simhash_dedup import near_prints


def test_stages_keep_the_columns(spark, tmp_path):
    text = lambda i: " ".join(f"the word{i * 37 + k} of and river{k % 5}" for k in range(60))
    rows = [(i, text(i), "en", f"s{i % 3}", len(text(i)), "extra") for i in range(40)]
    rows += [(100, text(1), "en", "s0", 1, "x"), (101, text(2) + " tail", "en", None, 1, "x"), (102, " ".join(["JUNK###"] * 200), "en", "s1", 1, "x"), (103, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, __n string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    seen = docs
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, seen, str(tmp_path)).cache()
        assert out.columns == docs.columns, name
        assert {r["doc_id"] for r in out.collect()} <= {r["doc_id"] for r in seen.collect()}
        seen = out
    kept = {r["doc_id"] for r in seen.collect()}
    assert 102 not in kept and 103 not in kept and 1 not in kept
    result = C.run(spark, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in result) == sorted(r["doc_id"] for r in seen.collect()) and all(r["n_tokens"] > 0 for r in result)
    assert [n for n, _ in C.STAGES] == ["quality", "exact_dedup", "near_dedup", "source_mix", "byte_bpe"]


def test_repeated_rows_and_rows_without_an_id(spark):
    text = lambda i: " ".join(f"the word{i * 37 + k} of and river{k % 5}" for k in range(60))
    near = text(3) + " tail"
    rows = [(1, text(1)), (1, text(1)), (None, text(2)), (None, text(2)), (3, text(3)), (3, near), (None, near), (4, text(4)), (5, text(4)), (4, text(6)), (None, text(7)), (None, text(7) + " tail")]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, source string").repartition(3)
    ids = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    exact = C.exact(spark, docs, "")
    assert ids(exact) == sorted([(1, text(1)), (None, text(2)), (3, text(3)), (3, near), (5, text(4)), (4, text(6)), (None, text(7)), (None, text(7) + " tail")], key=str)
    kept = ids(C.near(spark, exact, ""))
    assert len(kept) == 6 and sum(r[0] == 3 for r in kept) == 1 and {r[0] for r in kept} == {1, 3, 4, 5, None}
    words = lambda df: sum(len(r["text"].split()) for r in df.collect())
    many = spark.createDataFrame([(i % 2 or None, "w " * (50 + i), "ab"[i % 2]) for i in range(200)], "doc_id long, text string, source string")
    assert abs(words(C.mix(spark, many, "")) - 1.5 * words(many)) <= 2 * 250


def test_registered_names():
    names = set(queries.queries())
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))
    assert set(queries.oracle_sql()) <= names


def test_matches_a_plain_recomputation(spark, tmp_path):
    """The stages over a small table, against loops over all rows and all pairs."""
    tokenizers, tiktoken = pytest.importorskip("public_tokenizers"), pytest.importorskip("tiktoken")
    rng = random.Random(12)
    pool = "the of and to a river stone cloud walks under green hills while nobody looks for rain in it was by on".split() + [f"name{i}" for i in range(60)]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randrange(20, 150))) for _ in range(150)]
    texts += [t.replace("river", "stream", 1) for t in texts[:20]] + texts[20:40] + [" ".join(["###"] * 80)] * 4 + ["", None]
    rows = [(int(i), t, rng.choice(["a", "a", "b", None])) for i, t in zip(rng.sample(range(1000), len(texts)), texts, strict=True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    docs.write.parquet(str(tmp_path / "documents.parquet"))

    model = Q.fit_quality(docs)
    w, bias = np.array(model.weights[:-1]), model.weights[-1]
    good = lambda t: bool(t) and 1 / (1 + np.exp(-(Q.features(t.encode(), Q.statistics(t.encode()), model.dims).astype(float) @ w + bias))) >= 0.5
    left = [r for r in rows if good(r[1])]
    best = {}
    for r in left:
        best[r[1]] = max(best.get(r[1], -1), r[0])
    left = [r for r in left if best[r[1]] == r[0]]
    left.sort()
    group = near_groups([near_prints(r[1]) for r in left])
    left = [r for i, r in enumerate(left) if group[i] == i]

    stages, seen = dict(C.STAGES), docs
    for name in ("quality", "exact_dedup", "near_dedup"):
        seen = stages[name](spark, seen, "").cache()
    assert sorted(map(tuple, seen.collect()), key=str) == sorted(left, key=str) and len(left) < len(rows) - 25

    result = C.run(spark, str(tmp_path)).collect()
    ranks = {__import__("base64").b64decode(a): int(b) for a, b in map(bytes.split, open(tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    coder = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    by = {r[0]: r for r in left}
    size = {i: len(r[1].split()) for i, r in by.items()}
    sizes, taken = defaultdict(int), defaultdict(int)
    for i, r in by.items():
        sizes[r[2]] += size[i]
    for r in result:
        ids = coder.encode(by[r["doc_id"]][1], disallowed_special=())
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(by[r["doc_id"]][1].encode()).hexdigest()
        taken[by[r["doc_id"]][2]] += size[r["doc_id"]]
    assert max(Counter(r["doc_id"] for r in result).values()) <= 2
    for source, target in targets(sizes).items():
        assert abs(taken[source] - target) <= 200  # a row of the longest kind


def test_an_empty_table_and_a_very_long_text(spark, tmp_path):
    text = " ".join(f"the word{k * 37} of and river{k % 5}" for k in range(60))
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], kinds).write.parquet(str(tmp_path / "empty" / "documents.parquet"))
    assert C.run(spark, str(tmp_path / "empty")).count() == 0
    long = " ".join(f"{text} {i}" for i in range(1500))
    assert len(long) > 2_000_000
    spark.createDataFrame([(1, text, "en", "a", 1), (2, long, "en", "b", 1), (3, long, "en", "b", 1), (4, "", None, None, None)], kinds).write.parquet(str(tmp_path / "long" / "documents.parquet"))
    assert {r["doc_id"] for r in C.run(spark, str(tmp_path / "long")).collect()} <= {1, 3}

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from wattloom.llm.sequence_packing import WordIds, configurations, pack_documents, packed_sequences, plan_packing

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


def library_ids(texts):
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]


def test_ids_are_the_library_s():
    rng = random.Random(3)
    alphabet = "aA eéÉ'sS tT.,!<|>endoftext|12½²µß×÷ ́̀ 　日本ΣσςİıﬁЖ\n\t\x0b\x1f«»…’'re'LL"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += ["<|endoftext|> a<|startoftext|>b", "I'LL it'S", "", " ", "été", "é x"]
    flat, ends = WordIds(PATH).of_texts(pa.array(texts))
    assert [a.tolist() for a in np.split(flat, ends[:-1])] == library_ids(texts)


def sequences_of(moves, counts, capacity):
    items, sequences = Counter(), defaultdict(list)
    for m in moves:
        assert m.start == items[m.length]
        items[m.length] += m.count
        for i in range(m.count):
            sequences[m.first + i // m.each].append((m.offset + i % m.each * m.length, m.length))
    assert items == Counter({n: c for n, c in counts.items() if c})
    for inside in sequences.values():
        at = 0
        for offset, length in sorted(inside):
            assert offset == at
            at += length
        assert at <= capacity
    return sequences


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_all(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 64, 300])
    counts = dict(Counter(rng.choice([rng.randint(1, capacity), rng.randint(1, capacity // 4), capacity, capacity // 2 + 1]) for _ in range(rng.choice([1, 30, 2000]))))
    sequences = sequences_of(plan_packing(counts, capacity, groups=rng.choice([3, 64])), counts, capacity)
    assert set(sequences) == set(range(len(sequences)))
    least = -(-sum(n * c for n, c in counts.items()) // capacity)
    alone = sum(c for n, c in counts.items() if 2 * n > capacity)
    assert len(sequences) <= 1.25 * max(least, alone) + 1
    assert plan_packing({}, capacity) == []


def test_plan_is_as_short_for_many_items():
    rng = random.Random(9)
    counts = dict(Counter(min(4096, int(rng.lognormvariate(6.4, 1))) or 1 for _ in range(20_000)))
    few, many = plan_packing(counts, 4096), plan_packing({n: c * 100_000 for n, c in counts.items()}, 4096)
    assert len(many) < 3 * len(few)
    bins = max(m.first + (m.count - 1) // m.each for m in many) + 1
    assert bins <= 1.002 * sum(n * c for n, c in counts.items()) * 100_000 / 4096


def test_configurations_cut_stock():
    """The textbook case: thirds and halves fit without waste, so the optimum is the volume."""
    found = configurations(np.array([6, 4, 3]), np.array([30.0, 60.0, 40.0]), 12)
    assert all(config @ [6, 4, 3] <= 12 for config, _ in found)
    assert abs(sum(x for _, x in found) - (30 / 2 + 60 / 3 + 40 / 4)) < 1e-6


def test_pack(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["alpha", "Beta's", "x1,", "gamma."]) for _ in range(rng.randrange(40))) for _ in range(150)]
    rows = [(i, t, -1) for i, t in enumerate(texts)] + [(None, None, 0), (None, "", 0), (7, "twice", 0), (7, "twice", 0), (8, "long " * 500, 0), (9, " \n", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length int").repartition(3)
    got = pack_documents(df, capacity=64, with_ids=True).cache()
    want = Counter()
    for (doc, _, _), ids in zip(rows, library_ids([t or "" for _, t, _ in rows]), strict=True):
        ids = [*ids, 1]
        for piece, start in enumerate(range(0, len(ids), 64)):
            part = ids[start : start + 64]
            want[doc, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), tuple(part)] += 1
    out = got.collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], tuple(r["ids"])) for r in out) == want
    places = defaultdict(list)
    for r in out:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for inside in places.values():
        inside.sort()
        assert [o for o, _ in inside] == [sum(n for _, n in inside[:i]) for i in range(len(inside))]
        assert sum(n for _, n in inside) <= 64
    assert len(places) <= -(-sum(r["length"] for r in out) // 64) + 3
    whole = {r["sequence_id"]: r["ids"] for r in packed_sequences(got).collect()}
    for r in out:
        assert whole[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == list(r["ids"])
    assert pack_documents(df.limit(0)).count() == 0


def test_very_long_text_in_runs(spark):
    from wattloom.llm.sequence_packing import token_pieces

    text = "One two, three's été! " * 3000
    df = spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")
    whole = sorted(token_pieces(df).collect())
    assert sorted(token_pieces(df, slice_bytes=1000).collect()) == whole
    assert sum(r["length"] for r in whole if r["doc_id"] == 1) == len(library_ids([text])[0]) + 1

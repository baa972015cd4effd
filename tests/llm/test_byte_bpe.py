import base64
import hashlib
import random

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")

from wattloom.llm import byte_bpe as B  # noqa: E402

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(3)
    alphabet = "etaoin shrdlu \n\t'.,1234567890ABCé漢😀\u00a0\x00"
    made = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 80))) for _ in range(300)]
    return ["", "a", "<|endoftext|>", "a" * 700, " " * 900, "ab" * 2000, "0123456789" * 60, "don't they'll", "é" * 400, *made, "x" * 100_000, " ".join(made) * 3]


def test_matches_the_library(reference):
    some = texts()
    ids, ends = B.ByteBpe(PATH, P.PATTERN, max_pieces=50).encode(some)
    for text, part in zip(some, np.split(ids, ends[:-1]), strict=True):
        assert part.tolist() == reference.encode_ordinary(text)


def test_long_and_short_paths_agree():
    codec = B.codec(PATH, P.PATTERN)
    rng = random.Random(5)
    for _ in range(60):
        piece = bytes(rng.choice(b"etaoinshrdlu") for _ in range(rng.randrange(2, 200)))
        rows = codec.byte_ids[np.frombuffer(piece, np.uint8)].reshape(1, -1)
        assert codec.merge_rows(rows)[0].tolist() == codec.merge_long(piece)


def test_frames(spark, reference):
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "no id"), (9_000, None), (1, "a")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, ids string").repartition(3)
    want = {(i, t): (len(e := reference.encode_ordinary(t or "")), hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows}
    assert sorted((r["doc_id"], *tuple(r)[1:]) for r in B.round_trip(df).collect() if r["doc_id"] is not None) == sorted((i, *want[i, t]) for i, t in rows if i is not None)
    encoded = B.encode(df)
    back = {r["doc_id"]: bytes(r["content"]) for r in B.decode(encoded).collect()}
    assert back[9_000] == b"" and back[5] == ("ab" * 2000).encode() and encoded.count() == len(rows)
    assert B.round_trip(df.limit(0)).count() == 0

import math
import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from wattloom.llm import quality_model as Q

#: The thresholds were set while looking at smaller tables, so those would not be held out.
FOLDER = "/root/testdata/sf0.1"


def test_labels_come_from_counts():
    good, bad = Q.pattern((Q.GOOD,) * len(Q.LABELLERS)), Q.pattern((Q.BAD, Q.GOOD, Q.BAD) + (Q.GOOD,) * (len(Q.LABELLERS) - 3))
    model = Q.fit_labels({good: 900, bad: 100})
    assert model.posterior(Q.unpattern(good)) > 0.95 and model.posterior(Q.unpattern(bad)) < 0.1
    assert Q.unpattern(Q.pattern((0, 1, 2) * 3 + (1,))) == (0, 1, 2) * 3 + (1,)
    assert model.posterior((Q.NONE,) * len(Q.LABELLERS)) == pytest.approx(model.prior) and 0.85 < model.prior < 0.95
    assert Q.fit_labels({}).posterior((Q.GOOD,) * len(Q.LABELLERS)) == 0.5


def documents():
    rng = random.Random(0)
    words = "the of and to a river stone cloud walks under green hills while nobody looks for rain in it".split()
    clean = [" ".join(rng.choice(words) + rng.choice(["", "", str(rng.randrange(40)) and "ing"]) for _ in range(rng.randrange(10, 200))) + "." for _ in range(300)]
    junk = [" ".join(w + rng.choice(["###", "$$$", "%%%"]) for w in c.split()) for c in clean[:25]] + [" ".join(["spam"] * 90) for _ in range(15)] + [c.upper().replace(" ", "!! ") for c in clean[25:45]]
    return clean, junk


def test_keeps_clean_and_rejects_junk(spark):
    clean, junk = documents()
    rows = [(i, t, "x", 1) for i, t in enumerate(clean + junk)] + [(9_000, None, "", 0), (9_001, "", "", 0), (9_002, clean[0] * 400, "", 0), (0, clean[0], "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string, kept int")
    model = Q.fit_quality(df)
    got = Q.score_quality(df, model).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r["kept"] for r in got}
    assert sum(by[i] for i in range(len(clean))) >= 0.99 * len(clean) and sum(by[len(clean) + i] for i in range(len(junk))) <= 0.1 * len(junk)
    assert not by[9_000] and not by[9_001]
    kept = Q.quality_filter(df, model)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in got if r["kept"])
    empty = df.limit(0)
    assert Q.score_quality(empty, Q.fit_quality(empty)).count() == 0


def test_expectation_maximisation_document_by_document():
    """The counts of vote patterns say the same as a pass over single documents, in plain Python."""
    rng = random.Random(4)
    m, truth = len(Q.LABELLERS), [rng.random() < 0.8 for _ in range(400)]
    votes = [tuple(Q.NONE if rng.random() < 0.2 else int(t == (rng.random() < 0.7 + 0.02 * k)) for k in range(m)) for t in truth]
    model = Q.fit_labels(Counter(map(Q.pattern, votes)))
    belief = [{0: 0.95, 1: 0.4}.get(v.count(Q.BAD), 0.05) for v in votes]
    for _ in range(100):
        prior = min(1 - 1e-3, max(1e-3, sum(belief) / len(belief)))
        rate = {}
        for c in (Q.BAD, Q.GOOD):
            for k in range(m):
                mine = [0.5 + sum((b if c else 1 - b) for b, v in zip(belief, votes, strict=True) if v[k] == x) for x in (Q.BAD, Q.GOOD)]
                rate[c, k] = [x / sum(mine) for x in mine]
        belief = []
        for v in votes:
            odds = math.log(prior / (1 - prior)) + sum(math.log(rate[Q.GOOD, k][x] / rate[Q.BAD, k][x]) for k, x in enumerate(v) if x != Q.NONE)
            belief.append(1 / (1 + math.exp(-odds)))
    assert model.prior == pytest.approx(prior, abs=1e-5) and all(model.posterior(v) == pytest.approx(b, abs=1e-4) for v, b in zip(votes, belief, strict=True))


def test_scores_from_plain_features(spark):
    """Hashed trigrams and bins, counted one by one, give the scores of the operator."""
    clean, junk = documents()
    texts = clean[:30] + junk[:10] + ["ab", "é漢", None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    model = Q.fit_quality(df, dims=256)
    for r in Q.score_quality(df, model).collect():
        raw = (texts[r["doc_id"]] or "").encode()
        s, x = Q.statistics(raw), [0.0] * 256
        counts = Counter(((a * 0x9E3779B1 + b * 0x85EBCA77 + c * 0xC2B2AE3D) % 2**32 >> 8) % 256 for a, b, c in zip(raw, raw[1:], raw[2:], strict=False))
        norm = math.sqrt(sum(math.log1p(n) ** 2 for n in counts.values())) or 1.0
        for k, n in counts.items():
            x[k] += math.log1p(n) / norm
        for name in Q.STATS:
            place = min(12, int(math.log2(1 + s[name]))) if name == "words" else min(20, int(s[name] * (1 if name == "mean_length" else 10)))
            x[zlib.crc32(f"{name}={place}".encode()) % 256] += 0.5
        want = 1 / (1 + math.exp(-(np.dot(x, model.weights[:-1]) + model.weights[-1]))) if s["words"] else 0.0
        assert r["score"] == pytest.approx(want, abs=1e-4)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    rows = Q.score_quality(docs, Q.fit_quality(docs)).join(labels, "doc_id").selectExpr("quality", "int(kept) as k").groupBy("quality").avg("k").collect()
    kept = {r["quality"]: r["avg(k)"] for r in rows}
    assert kept[1] >= 0.99 and kept[0] <= 0.05

import random
import re
import textwrap

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattloom.llm import license_scan as L

PROSE = ["The river rose over the fields that spring.", "Versions of the story differ by town.", "No person was granted entry.", "La licence du chien est perdue.", "All rights reserved."]


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.createDataFrame([(50 * i, " ".join(PROSE[k % 5] for k in range(i, i + 3)) + "\nline two") for i in range(60)], "doc_id long, text string")
    return L.fit_licenses(docs)


def test_families_and_unknown(spark, model):
    rows = [(i, f"Some prose here.\n{t}\nmore of it") for i, (_, t) in enumerate(L.TEMPLATES)]
    rows += [(100 + i, p) for i, p in enumerate(PROSE)] + [(200, None), (201, ""), (202, "x " * 100_000 + "\nReleased under the MIT License."), (203, "Released under the MIT License.\nLicensed under CC BY-NC 4.0.\nReleased under the MIT License."), (0, rows[0][1])]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, licenses string")
    got = L.digest_licenses(L.scan_licenses(df, model)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    right = sum(by[i]["families"] == f for i, (f, _) in enumerate(L.TEMPLATES))
    assert right >= 0.9 * len(L.TEMPLATES)
    assert all(by[100 + i]["families"] == "" for i in range(len(PROSE))) and by[200]["n_predicted"] == by[201]["n_predicted"] == 0
    assert by[202]["places"] == "0.1:mit" and by[203]["families"] == "cc-by-nc,mit" and by[203]["n_confirmed"] == 3


def test_held_out_copies(spark, model):
    changed = [("mit", "released under the mit license"), ("apache-2.0", "This file is licensed under the Apache License, Version 2.0"), ("gpl", "licensed under the GNU General Public License version 3 or later"), ("cc-by-nc", "This text is licensed under CC BY-NC 4.0")]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(changed)], "doc_id long, text string")
    assert [r["families"] for r in L.digest_licenses(L.scan_licenses(df, model)).orderBy("doc_id").collect()] == [f for f, _ in changed]
    assert L.scan_licenses(df.limit(0), model).count() == 0


def test_fits_on_an_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert L.fit_licenses(empty, copies=3).families[0] == L.UNKNOWN


def plain(model, text):
    """Probability, family and similarity of a paragraph in plain Python."""
    words = [w for w in re.split("[^a-z0-9]+", text.lower()) if w]
    g = set(words) | {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}
    scores = np.array(model.bias) + sum((np.array(model.weights[k]) for k, v in enumerate(model.vocabulary) if v in g), np.zeros(len(model.families)))
    p = np.exp(scores - scores.max())
    p /= p.sum()
    family = model.families[int(p.argmax())] if p.max() >= model.threshold else L.UNKNOWN
    shares = [len(g & set(L._grams(t))) / max(1, min(len(set(L._grams(t))), max(2 * len(words) - 1, 5))) for f, t in model.templates if f == family]
    return float(p.max()), family, max(shares, default=0.0)


def test_scores_match_plain_python(spark, model):
    rng = random.Random(1)
    pool = [w for _, t in L.TEMPLATES for w in t.split()] + ["river", "Über", "licence", "x1"]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randrange(1, 40))) for _ in range(120)] + [t for _, t in L.TEMPLATES] + ["", " "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.select("i", model.judge(model.grams(F.col("t")), 0.6).alias("j")).orderBy("i").collect()
    for r, t in zip(got, texts, strict=True):
        p, family, share = plain(model, t)
        assert r["j"]["family"] == family and r["j"]["probability"] == pytest.approx(p) and r["j"]["similarity"] == pytest.approx(share) and r["j"]["confirmed"] == (family != L.UNKNOWN and share >= 0.6)


WRAPPED = [(f, t) for f, t in L.TEMPLATES if len(t) > 60]
UNSEEN = [
    ("mit", "This software is distributed under the terms of the MIT License."), ("mit", "License: MIT License, see the file for the full text."), ("apache-2.0", "The code is made available under the Apache License 2.0."),
    ("apache-2.0", "You may obtain this file under the Apache License, Version 2.0, or ask the owner."), ("gpl", "You can use it under the GNU General Public License, version 2 or any later version."), ("gpl", "Published under the terms of the GNU General Public License."),
    ("lgpl", "Covered by the GNU Lesser General Public License, version 3."), ("cc-by", "The text is available under a Creative Commons Attribution 4.0 International License."), ("cc-by-sa", "Content is under the Creative Commons Attribution-ShareAlike 4.0 International License unless noted."),
    ("cc-by-nc", "Photos: Creative Commons Attribution-NonCommercial 4.0."), ("mpl-2.0", "Subject to the Mozilla Public License, v. 2.0."), ("bsd", "Distributed under a BSD 3-Clause License."),
]


def test_recall_of_wrapped_and_unseen_wordings(spark, model):
    wrap = lambda t, width, mark: "\n".join(mark + line for line in textwrap.wrap(t, width))
    rows = [(f, "Intro.\n\n" + wrap(t, width, mark) + "\n\nMore prose here.") for f, t in WRAPPED for width, mark in ((30, ""), (45, "# "), (60, " * "))]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)] + [(1000 + i, t) for i, (_, t) in enumerate(UNSEEN)], "doc_id long, text string")
    got = {r["doc_id"]: r["families"] for r in L.digest_licenses(L.scan_licenses(df, model)).collect()}
    wrapped = sum(got[i] == f for i, (f, _) in enumerate(rows)) / len(rows)
    unseen = sum(got[1000 + i] == f for i, (f, _) in enumerate(UNSEEN)) / len(UNSEEN)
    print("wrapped", wrapped, "unseen", unseen, [(f, got[1000 + i]) for i, (f, _) in enumerate(UNSEEN) if got[1000 + i] != f])
    assert wrapped >= 0.9 and unseen >= 0.75


def test_fit_is_repeatable_and_keeps_hard_lines(spark):
    docs = spark.createDataFrame([(i, "\n".join([f"Line {i} of prose.", "The dog licence costs five pounds.", f"Permission was refused in case {i}."])) for i in range(300)] + [(None, None)], "doc_id long, text string")
    a, b = (L.fit_licenses(df, copies=2, sample_rows=100) for df in (docs, docs.repartition(5)))
    assert a == b
    lines = {r["line"] for r in L._other_lines(docs, L.TEMPLATES, 100, 0.4).collect()}
    assert "The dog licence costs five pounds." in lines and any(x.startswith("Permission") for x in lines)

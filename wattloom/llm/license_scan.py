"""License scans by a trained paragraph classifier.

Paragraphs end at blank lines; their lines may be wrapped anywhere. A paragraph is judged as a whole and line by line,
as a notice may be a single line among others. The word uni- and bigrams that occur in a license template are sparse
features of a multinomial logistic regression with a class for everything else; it is trained on the templates, on
copies of them with words left out, and on bounded samples of corpus lines, plain ones and ones that speak of licenses.
The least probability that counts is calibrated on lines kept out of training. A prediction is confirmed if the
paragraph and a template of that family share enough of their grams.

Scoring is row-local DataFrame code without a shuffle, and texts without a feature word are settled by one set
comparison. A gram finds its weights by its hash, in a table of slots with one feature or none, seldom more.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import cut

#: Fixed texts: usual notices of license families.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("mit", "Released under the MIT License."),
    ("mit", "This project is licensed under the MIT License."),
    ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction.'),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("bsd", "Released under the BSD 3-Clause License."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation."),
    ("lgpl", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0 Universal."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
)
#: Fixed texts of no family.
OTHERS = (
    "All rights reserved.", "See the terms of use for details.", "You need a license to drive a car.", "The software is distributed to all members.",
    "This work is based on an earlier version.", "Version 2.0 of the program was released in May.", "The public library is free for any person.",
    "A copy of this file was made without permission.", "Use of this service is subject to our terms.", "Licensed electricians only.", "The commons is open to the public.",
)
#: Fixed words that say nothing on their own.
STOP = frozenset("a al an and are as at be by de der die do el en for from he i in is it la le of on or s t that the this to und v was we with you your all any not no our".split())
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
UNKNOWN = "unknown"


def _grams(text: str) -> list[str]:
    """The grams of a template, as ``grams`` makes them of a column."""
    words = [w for w in re.split("[^a-z0-9]+", text.lower()) if w]
    return list(dict.fromkeys(words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]))


def words(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, _UPPER, _LOWER), "[^a-z0-9]+"), lambda w: w != "")


def grams(text: Column, known: Sequence[str]) -> Column:
    """struct<g, n>: the distinct uni- and bigrams of ``text`` that consist of ``known`` words, and the number of all its grams, repeats counted."""
    mine = F.transform(words(text), lambda x: F.when(x.isin(*known), x).otherwise(""))

    def make(w):
        pairs = F.zip_with(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.when((a != "") & (b != ""), F.concat_ws(" ", a, b)).otherwise(""))
        return F.struct(F.filter(F.array_distinct(F.concat(w, pairs)), lambda x: x != "").alias("g"), F.greatest(2 * F.size(w) - 1, F.lit(0)).alias("n"))

    return F.transform(F.array(mine), make)[0]


def _literal(values, kind: str = "array<string>") -> Column:
    """A constant of any size as one expression, which Spark folds into a literal."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def _slot(gram: Column, slots: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(7), gram), F.lit(slots)).cast("int")


def _template_words(templates) -> list[str]:
    return sorted({w for _, t in templates for g in _grams(t) for w in g.split()})


def similarity(templates, g: Column, family: Column | None = None) -> Column:
    """Largest share of a template's grams, or of as many as the paragraph ``g`` (struct<g, n>) has if these are fewer, that both have; 0 without a template of the family."""
    own = _literal([{"family": f, "g": _grams(t)} for f, t in templates], "array<struct<family:string,g:array<string>>>")
    shared = lambda t: F.size(F.array_intersect(t["g"], g["g"])) / F.greatest(F.lit(1), F.least(F.size(t["g"]), F.greatest(g["n"], F.lit(5))))
    return F.coalesce(F.array_max(F.transform(own if family is None else F.filter(own, lambda t: t["family"] == family), shared)), F.lit(0.0))


@dataclass(frozen=True)
class LicenseModel:
    """weights: one row per feature of ``vocabulary``, one number per family; bias alike. threshold: least probability that counts.

    slots: for every slot the numbers of its features in ``vocabulary``, seldom more than one; a gram's slot is its hash.
    """

    families: tuple[str, ...]
    vocabulary: tuple[str, ...]
    weights: tuple[tuple[float, ...], ...]
    bias: tuple[float, ...]
    threshold: float
    templates: tuple[tuple[str, str], ...]
    slots: tuple[tuple[int, ...], ...]

    def _cues(self) -> list[str]:
        return sorted({w for g in self.vocabulary for w in g.split()} - STOP)

    def may_have(self, text: Column) -> Column:
        """False only for texts without any feature word: nothing but the bias speaks for them."""
        return F.coalesce(F.arrays_overlap(words(text), _literal(self._cues())), F.lit(False))

    def _best(self, g: Column) -> Column:
        """struct<probability, family> of the most probable class for the grams ``g`` (struct<g, n>)."""
        table = _literal([[{"g": self.vocabulary[k], "w": self.weights[k]} for k in some] for some in self.slots], "array<array<struct<g:string,w:array<double>>>>")
        rows = F.flatten(F.transform(g["g"], lambda x: F.transform(F.filter(F.element_at(table, _slot(x, len(self.slots)) + 1), lambda f: f["g"] == x), lambda f: f["w"])))
        scores = F.aggregate(rows, _literal(self.bias, "array<double>"), lambda a, r: F.zip_with(a, r, lambda x, y: x + y))
        exps = F.transform(F.array(scores), lambda s: F.transform(s, lambda x: F.exp(x - F.array_max(s))))
        shares = F.transform(exps, lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y)))
        return F.transform(shares, lambda p: F.struct(F.array_max(p).alias("probability"), F.element_at(_literal(self.families), F.array_position(p, F.array_max(p)).cast("int")).alias("family")))[0]

    def _similarity(self, g: Column, family: Column) -> Column:
        return similarity(self.templates, g, family)

    def grams(self, text: Column) -> Column:
        return grams(text, _template_words(self.templates))

    def judge(self, g: Column, confirm: float) -> Column:
        """struct<probability, family, similarity, confirmed> of a paragraph's grams."""
        steps = F.transform(F.array(g), lambda x: F.struct(x.alias("g"), self._best(x).alias("b")))
        known = lambda s: F.when(s["b"]["probability"] >= self.threshold, s["b"]["family"]).otherwise(UNKNOWN)
        named = F.transform(steps, lambda s: F.struct(s["b"]["probability"].alias("probability"), known(s).alias("family"), self._similarity(s["g"], known(s)).alias("similarity")))
        return F.transform(named, lambda n: F.struct(n["probability"].alias("probability"), n["family"].alias("family"), n["similarity"].alias("similarity"), ((n["family"] != UNKNOWN) & (n["similarity"] >= confirm)).alias("confirmed")))[0]


def _dropped(text: Column, copy: Column) -> Column:
    """``text`` without about every sixth word, another choice for each copy."""
    parts = F.split(text, " ")
    return F.when(copy == 0, text).otherwise(F.array_join(F.filter(parts, lambda w, i: F.pmod(F.xxhash64(w, i, copy), F.lit(6)) != 0), " "))


def _slots(docs: DataFrame, vocabulary: tuple[str, ...]) -> tuple[tuple[int, ...], ...]:
    """The features dealt over four times as many slots."""
    features, table = docs.sparkSession.createDataFrame([(k, g) for k, g in enumerate(vocabulary)], "k int, g string"), [()] * (4 * len(vocabulary))
    for r in features.select("k", _slot(F.col("g"), len(table)).alias("s")).orderBy("k").collect():
        table[r["s"]] += (r["k"],)
    return tuple(table)


def _other_lines(docs: DataFrame, templates, sample_rows: int, unlike: float) -> DataFrame:
    """(line): ``sample_rows`` corpus lines, and as many that speak of licenses but are no notice; the least of a hash over all lines of all texts, so a rerun finds the same.

    Only lines whose hash is low enough for about twice that many are sorted, so what meets in one task doesn't grow with the table.
    """
    text = docs.select(F.col("doc_id").cast("string").alias("id"), F.col("text").cast("string").alias("text"))
    lines = text.select("id", F.posexplode(F.split("text", "\n")).alias("i", "line")).where("trim(line) <> ''")
    lines = lines.withColumn("rank", F.xxhash64(F.lit(23), "id", "i", "line"))
    speaks = F.lower("line").rlike("licen|copyright|permission|redistribut|warrant")
    n_plain, n_hard = lines.agg(F.count_if(~speaks), F.count_if(speaks)).first()

    def low(condition: Column, n: int) -> DataFrame:
        chosen = lines.where(condition)
        return chosen.where(F.col("rank") < F.lit(-(2**63) + 2**65 * sample_rows // n)) if n > 2 * sample_rows else chosen

    least = lambda df: df.orderBy("rank", "id", "i").limit(sample_rows).select("line")
    hard = low(speaks, n_hard).withColumn("g", grams(F.col("line"), _template_words(templates))).where(similarity(templates, F.col("g")) < unlike)
    return least(low(~speaks, n_plain)).unionByName(least(hard))


def fit_licenses(docs: DataFrame, templates=TEMPLATES, others=OTHERS, copies: int = 12, sample_rows: int = 2000, error: float = 0.01, unlike: float = 0.4) -> LicenseModel:
    """Trains on templates, their copies, ``others``, at most ``sample_rows`` plain corpus lines and as many that speak of licenses and share less than ``unlike`` with every template.

    Every fourth row is kept out of training; the threshold is the probability of a family that no more than
    ``error`` of the kept-out lines of no family reach, at least one half and 0.9 at most.
    """
    spark = docs.sparkSession
    families = (UNKNOWN, *sorted({f for f, _ in templates}))
    vocabulary = tuple(sorted({g for _, t in templates for g in _grams(t) if any(w not in STOP and len(w) > 1 for w in g.split())}))
    slots = _slots(docs, vocabulary)
    fixed = spark.createDataFrame([(families.index(f), t) for f, t in templates] + [(0, t) for t in others], "label int, line string")
    made = fixed.select("label", F.explode(F.sequence(F.lit(0), F.lit(copies))).alias("copy"), "line").select("label", _dropped(F.col("line"), F.col("copy")).alias("line"))
    rows = made.unionByName(_other_lines(docs, templates, sample_rows, unlike).select(F.lit(0).alias("label"), "line")).withColumn("g", grams(F.col("line"), _template_words(templates)))
    vector = array_to_vector(F.transform(_literal(vocabulary), lambda v: F.when(F.array_contains(F.col("g.g"), v), 1.0).otherwise(0.0)))
    rows = cut(rows.select(F.col("label").cast("double").alias("label"), "g", vector.alias("features"), (F.pmod(F.xxhash64("line"), F.lit(4)) == 0).alias("held")).coalesce(4))
    fitted = LogisticRegression(family="multinomial", regParam=0.003, elasticNetParam=0.2, maxIter=60).fit(rows.where("not held").select("label", "features"))
    matrix, bias = fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray()
    full = [[float(matrix[k][j]) if k < len(bias) else 0.0 for k in range(len(families))] for j in range(len(vocabulary))]
    free = LicenseModel(families, vocabulary, tuple(map(tuple, full)), tuple(float(bias[k]) if k < len(bias) else -9.0 for k in range(len(families))), 0.0, tuple(templates), slots)
    best = free._best(F.col("g"))
    wrong = F.when(best["family"] == UNKNOWN, 0.0).otherwise(best["probability"])
    limit = rows.where("held and label = 0").agg(F.percentile(wrong, F.lit(1 - error)).alias("p")).first()["p"]
    return replace(free, threshold=min(0.9, max(0.5, limit or 0.0)))


def scan_licenses(docs: DataFrame, model: LicenseModel | None = None, confirm: float = 0.6) -> DataFrame:
    """One row per row of ``docs``: doc_id, licenses array<struct<paragraph, line, family, probability, similarity, confirmed>>.

    ``licenses`` has the lines that the classifier gives a family (paragraph and line in it, both from 0), and the
    paragraphs of several lines that it confirms as a whole (line is null) for a family that no line of theirs is confirmed
    for. A null or empty text has none. Texts are read whole; other columns are not read; repeated rows get the same
    result; an empty table gives no rows.
    """
    model = model or fit_licenses(docs)
    text = F.col("text").cast("string")

    def units(x):
        lines = F.split(x["p"], "\n")
        each = F.transform(lines, lambda line, j: F.struct(x["i"].alias("i"), j.alias("j"), model.grams(line).alias("g")))
        whole = F.array(F.struct(x["i"].alias("i"), F.lit(None).cast("int").alias("j"), model.grams(x["p"]).alias("g")))
        return F.filter(F.when(F.size(lines) > 1, F.concat(each, whole)).otherwise(each), lambda u: F.size(u["g"]["g"]) > 0)

    paragraphs = F.transform(F.split(text, "\n[ \t\r]*\n"), lambda p, i: F.struct(i.alias("i"), p.alias("p")))
    rows = docs.select("doc_id", F.when(model.may_have(text), F.flatten(F.transform(paragraphs, units))).alias("units"))

    def judged(x):
        return F.transform(
            F.array(model.judge(x["g"], confirm)),
            lambda j: F.struct(x["i"].alias("paragraph"), x["j"].alias("line"), j["family"].alias("family"), j["probability"].alias("probability"), j["similarity"].alias("similarity"), j["confirmed"].alias("confirmed")),
        )[0]

    named = rows.select("doc_id", F.filter(F.transform("units", judged), lambda y: y["family"] != UNKNOWN).alias("y"))
    known = lambda y: F.exists("y", lambda z: z["line"].isNotNull() & z["confirmed"] & (z["paragraph"] == y["paragraph"]) & (z["family"] == y["family"]))
    found = F.filter("y", lambda y: y["line"].isNotNull() | (y["confirmed"] & ~known(y)))
    return named.select("doc_id", F.coalesce(found, F.array().cast("array<struct<paragraph:int,line:int,family:string,probability:double,similarity:double,confirmed:boolean>>")).alias("licenses"))


def digest_licenses(found: DataFrame) -> DataFrame:
    """doc_id, families (confirmed, sorted, comma-joined), n_predicted, n_confirmed, places (paragraph.line:family of the confirmed, or paragraph:family)."""
    sure = F.filter("licenses", lambda x: x["confirmed"])
    place = lambda x: F.concat(F.concat_ws(".", x["paragraph"].cast("string"), x["line"].cast("string")), F.lit(":"), x["family"])
    return found.select(
        "doc_id", F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda x: x["family"]))), ",").alias("families"),
        F.size("licenses").cast("long").alias("n_predicted"), F.size(sure).cast("long").alias("n_confirmed"), F.array_join(F.transform(sure, place), ",").alias("places"),
    )

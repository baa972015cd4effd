"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every document. Expectation-maximisation over the counts
of vote patterns of all documents (a table of at most 3 ** labellers rows, whatever the input) estimates how each
labeller votes on good and on bad documents. The posteriors of a bounded sample then train a logistic scorer over
hashed features, and the scorer judges every document.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GOOD, BAD, NONE = 1, 0, 2
#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    "the of and to a in is it that for with on as by this be are was at an or from der die und das den von zu mit ein eine "
    "ist im auf des dem für sich nicht le la les de des et un une que en du est pour dans qui sur au par avec el los las "
    "y por con una para no se lo al".encode().split()
)
STATS = ("words", "symbols", "upper", "repeats", "pipes", "distinct", "stops", "mean_length", "marks", "same_lines", "noise")
LABELLERS = ("symbols", "upper", "repeats", "pipes", "distinct", "stops", "mean_length", "marks", "same_lines", "noise")


def _classes() -> np.ndarray:
    kind = np.zeros(256, np.uint8)
    kind[ord("a") : ord("z") + 1], kind[ord("A") : ord("Z") + 1] = 1, 2
    for c in b"#$%&*~^=<>{}[]\\_@+":
        kind[c] = 3
    kind[ord("!")] = kind[ord("?")] = 4
    kind[ord("|")] = 5
    return kind


def statistics(raw: bytes) -> dict[str, float]:
    """What the labellers look at; all zero for a text without words."""

    words = raw.split()
    n = len(words)
    if not n:
        return dict.fromkeys(STATS, 0.0)
    kinds = np.bincount(_KIND[np.frombuffer(raw, np.uint8)], minlength=6)
    lines = raw.split(b"\n")
    return {
        "words": n, "symbols": kinds[3] / n, "upper": kinds[2] / max(1, kinds[1] + kinds[2]), "repeats": sum(map(bytes.__eq__, words, words[1:])) / n,
        "pipes": kinds[5] / n, "distinct": len(set(words)) / n, "stops": sum(map(STOP_WORDS.__contains__, words)) / n,
        "mean_length": sum(map(len, words)) / n, "marks": kinds[4] / n, "same_lines": 1 - len(set(lines)) / len(lines),
        "noise": (kinds[3] + kinds[4] + kinds[5]) / n,
    }


_KIND = _classes()


def votes(s: dict[str, float]) -> tuple[int, ...]:
    """One vote per labeller of LABELLERS."""
    n = s["words"]
    say = lambda bad, good: BAD if bad else GOOD if good else NONE
    if not n:
        return (BAD,) * len(LABELLERS)
    return (
        say(s["symbols"] > 0.5, s["symbols"] < 0.1),
        say(n >= 8 and s["upper"] > 0.5, s["upper"] < 0.15),
        say(n >= 8 and s["repeats"] > 0.25, s["repeats"] < 0.08),
        say(n >= 8 and s["pipes"] > 0.15, s["pipes"] < 0.02),
        say(n >= 40 and s["distinct"] < 0.25, s["distinct"] > 0.45),
        say(n >= 40 and s["stops"] < 0.01, s["stops"] > 0.08),
        say(s["mean_length"] > 14 or s["mean_length"] < 2, 3 < s["mean_length"] < 9),
        say(n >= 8 and s["marks"] > 0.8, s["marks"] < 0.2),
        say(s["same_lines"] > 0.6, s["same_lines"] < 0.3),
        say(n >= 5 and s["noise"] > 0.3, s["noise"] < 0.1),
    )


def pattern(v: tuple[int, ...]) -> int:
    code = 0
    for x in v:
        code = code * 3 + x
    return code


def unpattern(code: int, n: int = len(LABELLERS)) -> tuple[int, ...]:
    out = []
    for _ in range(n):
        code, x = divmod(code, 3)
        out.append(x)
    return tuple(reversed(out))


@dataclass(frozen=True)
class LabelModel:
    """prior: share of good documents. rates[class][labeller][vote]: how a labeller votes on a class when it votes."""

    prior: float
    rates: list

    def posterior(self, v: tuple[int, ...]) -> float:
        """Probability of good given the votes."""

        odds = math.log(self.prior) - math.log1p(-self.prior)
        for k, x in enumerate(v):
            if x != NONE:
                odds += math.log(self.rates[GOOD][k][x]) - math.log(self.rates[BAD][k][x])
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, odds))))


def fit_labels(counts: dict[int, int], rounds: int = 100) -> LabelModel:
    """Expectation-maximisation over pattern counts. It starts from how many labellers object to a pattern."""

    m = len(LABELLERS)
    if not counts:
        return LabelModel(0.5, [[[0.5, 0.5]] * m] * 2)
    table = np.array([unpattern(c) for c in counts])
    weight = np.array(list(counts.values()), float)
    bad = (table == BAD).sum(axis=1)
    good = np.where(bad == 0, 0.95, np.where(bad == 1, 0.4, 0.05))
    for _ in range(rounds):
        prior = float(np.clip((weight * good).sum() / weight.sum(), 1e-3, 1 - 1e-3))
        rates = []
        for belief in (1 - good, good):
            w = weight * belief
            counts_by = np.array([[(w * (table[:, k] == x)).sum() for x in (BAD, GOOD)] for k in range(m)]) + 0.5
            rates.append(counts_by / counts_by.sum(axis=1, keepdims=True))
        odds = np.log(prior / (1 - prior)) + sum(np.r_[np.log(rates[GOOD][k] / rates[BAD][k]), 0.0][table[:, k]] for k in range(m))
        new = 1 / (1 + np.exp(-np.clip(odds, -60, 60)))
        if np.abs(new - good).max() < 1e-9:
            break
        good = new
    return LabelModel(prior, [r.tolist() for r in rates])


def features(raw: bytes, s: dict[str, float], dims: int):
    """Hashed byte trigrams (log counts, scaled to unit length) and hashed bins of the statistics."""
    out = np.zeros(dims, np.float32)
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    if len(b) >= 3:
        h = (b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77) + b[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(8)
        counts = np.log1p(np.bincount(h % np.uint32(dims), minlength=dims)).astype(np.float32)
        out += counts / np.linalg.norm(counts)
    for name in STATS:
        bin_ = int(min(12, np.log2(1 + s[name]))) if name == "words" else int(min(20, 10 * s[name])) if name != "mean_length" else int(min(20, s[name]))
        out[zlib.crc32(f"{name}={bin_}".encode()) % dims] += 0.5
    return out


def fit_scorer(x, y, rounds: int = 300, rate: float = 0.05, penalty: float = 1e-5):
    """Weights (the last is the bias) of a logistic regression on soft labels, by full-batch Adam."""

    w = np.zeros(x.shape[1] + 1, np.float64)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w[:-1].astype(np.float32) + w[-1], -30, 30)))
        e = (p - y) / len(y)
        g = np.r_[x.T @ e.astype(np.float32) + penalty * w[:-1], e.sum()]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


@dataclass(frozen=True)
class QualityModel:
    labels: LabelModel
    weights: list
    dims: int


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def fit_quality(docs: DataFrame, dims: int = 2048, sample_rows: int = 4000) -> QualityModel:
    """Label model from the votes on all documents; scorer from about ``sample_rows`` of them, chosen by a hash of doc_id.

    ``sample_rows`` bounds what reaches the driver: 2 * sample_rows vectors of ``dims`` half-precision numbers at most.
    """

    def vote(batches):

        for batch in batches:
            column = batch.column(0)
            codes = [pattern(votes(statistics((column[i].as_py() or "").encode()))) for i in range(len(column))]
            yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int32())], names=["code"])

    def vectors(batches):

        for batch in batches:
            codes, out = [], []
            for text in batch.column(0):
                raw = (text.as_py() or "").encode()
                s = statistics(raw)
                codes.append(pattern(votes(s)))
                out.append(features(raw, s, dims).astype(np.float16).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int32()), pa.array(out, pa.binary())], names=["code", "x"])

    rows = _rows(docs)
    counts = {r["code"]: r["count"] for r in rows.select("text").mapInArrow(vote, "code int").groupBy("code").count().collect()}
    labels = fit_labels(counts)
    total = sum(counts.values())
    if not total:
        return QualityModel(labels, [0.0] * (dims + 1), dims)
    share = min(1.0, sample_rows / total)
    chosen = rows.where(F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1_000_000)) < int(share * 1_000_000) + 1).select("text")
    got = chosen.mapInArrow(vectors, "code int, x binary").limit(2 * sample_rows).collect()
    if not got:
        return QualityModel(labels, [0.0] * (dims + 1), dims)
    x = np.stack([np.frombuffer(r["x"], np.float16) for r in got]).astype(np.float32)
    y = np.array([labels.posterior(unpattern(r["code"])) for r in got])
    return QualityModel(labels, fit_scorer(x, y).tolist(), dims)


def score_quality(docs: DataFrame, model: QualityModel, threshold: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: doc_id, score (probability of good), posterior (of the label model), kept.

    A null text counts as empty; a text without words is rejected. Other columns are not read; repeated rows get the
    same result; an empty table gives no rows.
    """

    def run(batches):

        w, bias = np.array(model.weights[:-1], np.float32), model.weights[-1]
        for batch in batches:
            score, posterior, kept = [], [], []
            for text in batch.column(1):
                raw = (text.as_py() or "").encode()
                s = statistics(raw)
                p = float(1 / (1 + np.exp(-np.clip(features(raw, s, model.dims) @ w + bias, -30, 30))))
                p = p if s["words"] else 0.0
                score.append(p)
                posterior.append(model.labels.posterior(votes(s)))
                kept.append(p >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), pa.array(posterior, pa.float64()), pa.array(kept, pa.bool_())], names=["doc_id", "score", "posterior", "kept"])

    return _rows(docs).mapInArrow(run, "doc_id long, score double, posterior double, kept boolean")


def quality_filter(docs: DataFrame, model: QualityModel | None = None, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with all their columns."""
    model = model or fit_quality(docs)

    @F.pandas_udf("boolean")
    def good(texts: pd.Series) -> pd.Series:

        w, bias = np.array(model.weights[:-1], np.float32), model.weights[-1]
        out = []
        for text in texts:
            raw = (text or "").encode()
            s = statistics(raw)
            out.append(bool(s["words"]) and float(1 / (1 + np.exp(-np.clip(features(raw, s, model.dims) @ w + bias, -30, 30)))) >= threshold)
        return pd.Series(out, dtype="bool")

    return docs.where(good(F.col("text").cast("string")))

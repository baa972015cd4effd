"""Extremely randomised trees (Geurts, Ernst and Wehenkel, 2006) for several targets at once.

A node draws one threshold for each feature, evenly between the least and the largest value that its rows have, and takes the one that
lowers the squared error of all targets together most. All trees grow a level in the same two passes over the rows: one
for the ranges of their nodes, one for the sums left of the thresholds drawn from them. Tasks merge their sums by
(tree, node); the driver sees a row per node. Draws are a hash of (seed, tree, node, feature), so the trees do not
depend on how rows are dealt.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.operators.boosting import _CELLS, _matrix, _uniform
from wattloom.shared import cut


@dataclass(frozen=True)
class Extra:
    trees: int = 50
    depth: int = 8
    least_split: int = 2
    least_leaf: int = 1
    seed: int = 42


@dataclass
class RandomTree:
    """Nodes by number; a leaf has left -1. Values up to the threshold go left, larger and missing ones right."""

    feature: list[int] = field(default_factory=lambda: [0])
    threshold: list[float] = field(default_factory=lambda: [0.0])
    left: list[int] = field(default_factory=lambda: [-1])
    value: list[list[float]] = field(default_factory=lambda: [[]])

    def route(self, x: np.ndarray) -> np.ndarray:
        feature, threshold, left = np.array(self.feature), np.array(self.threshold), np.array(self.left)
        node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        while len(rows := rows[left[node[rows]] >= 0]):
            now = node[rows]
            node[rows] = left[now] + ~(x[rows, feature[now]] <= threshold[now])
        return node


def draw(low: np.ndarray, high: np.ndarray, seed: int, tree: int, node: int) -> np.ndarray:
    """A threshold for each feature, NaN where all values are alike or missing."""
    at = low + _uniform(np.arange(len(low)), seed, tree, node) * (high - low)
    return np.where(low < high, np.minimum(at, np.nextafter(high, -np.inf)), np.nan)


def choose(sums: np.ndarray, total: np.ndarray, least_leaf: int) -> tuple[int, float] | None:
    """(feature, what the squared error falls by) of the best threshold; ``sums`` has (rows, sum of each target) left of each, ``total`` of the node."""
    n = sums[:, 0]
    rest = total - sums
    known = (n >= least_leaf) & (rest[:, 0] >= least_leaf)
    fall = lambda s: (s[:, 1:] ** 2).sum(axis=1) / np.maximum(s[:, 0], 1)
    gain = np.where(known, fall(sums) + fall(rest) - (total[1:] ** 2).sum() / max(total[0], 1), -np.inf)
    best = int(gain.argmax())
    return (best, float(gain[best])) if np.isfinite(gain[best]) and gain[best] > 1e-12 else None


@dataclass
class ExtraTrees:
    columns: tuple[str, ...]
    trees: list[RandomTree]

    def values(self, x: np.ndarray) -> np.ndarray:
        return sum(np.array(t.value)[t.route(x)] for t in self.trees) / len(self.trees)

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``prediction``: an array in the order of the columns."""

        def run(batches):
            for batch in batches:
                column = batch.column("__x")
                made = self.values(_matrix(column, len(column[0]))) if len(column) else []
                kept = [n for n in batch.schema.names if n != "__x"]
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(list(made), pa.list_(pa.float64()))], names=[*kept, "prediction"])

        kept = [c for c in df.columns if c != "features"]
        schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept)
        return df.select(*kept, vector_to_array("features").alias("__x")).mapInArrow(run, f"{schema}, prediction array<double>")

    def predict(self, features: Sequence[float]) -> list[float]:
        return self.values(np.array([features], float))[0].tolist()

    def dumps(self) -> str:
        return json.dumps({"columns": self.columns, "trees": [asdict(t) for t in self.trees]})

    @classmethod
    def loads(cls, text: str) -> ExtraTrees:
        about = json.loads(text)
        return cls(tuple(about["columns"]), [RandomTree(**t) for t in about["trees"]])


_SCHEMA = "tree int, node int, low array<double>, high array<double>, sums array<double>"


def _rows(found: dict[tuple[int, int], tuple]) -> pa.RecordBatch:
    lists = pa.list_(pa.float64())
    columns = [pa.array([k[i] for k in found], pa.int32()) for i in range(2)] + [pa.array([np.ravel(v[i]) if v[i] is not None else None for v in found.values()], lists) for i in range(3)]
    return pa.RecordBatch.from_arrays(columns, names=["tree", "node", "low", "high", "sums"])


def _merge(batches):
    """Sums of (tree, node) over the tasks: least of ``low``, largest of ``high``, sum of ``sums``."""
    held: dict[tuple[int, int], tuple] = {}
    for batch in batches:
        for r in batch.to_pylist():
            key, now = (r["tree"], r["node"]), [None if r[n] is None else np.array(r[n]) for n in ("low", "high", "sums")]
            if key in held and now[0] is not None:
                now[:2] = np.fmin(held[key][0], now[0]), np.fmax(held[key][1], now[1])
            if key in held:
                now[2] = held[key][2] + now[2]
            held[key] = tuple(now)
    yield _rows(held)


def fit_extra(train: DataFrame, columns: Sequence[str], settings: Extra = Extra()) -> ExtraTrees:  # noqa: B008  frozen
    """Trees on ``features`` (a vector; NaN is missing) for all targets of the array ``y`` at once; rows with a target that is null or NaN are left out.

    A table without rows gives trees that say NaN.
    """
    p, targets = settings, len(columns)
    rows = train.select(vector_to_array("features").alias("x"), "y").where(~F.exists("y", lambda v: v.isNull() | F.isnan(v.cast("double"))))
    facts = rows.agg(F.max(F.size("x")), F.count(F.lit(1))).first()
    width, tasks = facts[0] or 0, 1 + facts[1] * (facts[0] or 0) // _CELLS
    state = cut(rows.select("x", F.col("y").cast("array<double>").alias("y")).coalesce(tasks))
    trees = [RandomTree(value=[[float("nan")] * targets]) for _ in range(p.trees)]

    def passed(work: Callable) -> list:
        """A pass over the rows; ``work`` gets (x, y, leaf of each row) of every tree and what it has held."""

        def run(batches):
            held: dict[tuple[int, int], tuple] = {}
            for batch in batches:
                x, y = _matrix(batch.column("x"), width), _matrix(batch.column("y"), targets)
                for t, tree in enumerate(trees):
                    node = tree.route(x)
                    for n in wanted[t]:
                        mine = np.flatnonzero(node == n)
                        if len(mine):
                            held[t, n] = work(t, n, x[mine], y[mine], held.get((t, n)))
            yield _rows(held)

        made = state.mapInArrow(run, _SCHEMA)
        made = made.repartition("tree", "node") if tasks > 1 else made.coalesce(1)
        # a row for each node of the level, in an order that numbers new nodes alike however rows are dealt
        return sorted(made.mapInArrow(_merge, _SCHEMA).collect(), key=lambda r: (r["tree"], r["node"]))

    def ranges(t, n, x, y, held):
        with np.errstate(all="ignore"):
            low, high = np.fmin.reduce(x, axis=0), np.fmax.reduce(x, axis=0)
        sums = np.r_[len(y), y.sum(axis=0)]
        return (low, high, sums) if held is None else (np.fmin(held[0], low), np.fmax(held[1], high), held[2] + sums)

    wanted: list[list[int]] = [[0] for _ in trees] if facts[1] else [[] for _ in trees]
    for level in range(p.depth + 1):
        if not any(wanted):
            break
        drawn: dict[tuple[int, int], np.ndarray] = {}
        totals = {}
        for r in passed(ranges):
            t, n, total = r["tree"], r["node"], np.array(r["sums"])
            trees[t].value[n] = (total[1:] / total[0]).tolist()
            at = draw(np.array(r["low"]), np.array(r["high"]), p.seed, t, n)
            if level < p.depth and total[0] >= p.least_split and not np.isnan(at).all():
                drawn[t, n], totals[t, n] = at, total
        wanted = [[n for (tree, n) in drawn if tree == t] for t in range(p.trees)]
        if not drawn:
            break

        def lefts(t, n, x, y, held, drawn=drawn):
            left = (x <= drawn[t, n]).astype(float)
            sums = np.column_stack([left.sum(axis=0), left.T @ y])
            return None, None, sums if held is None else held[2] + sums

        split: list[list[int]] = [[] for _ in trees]
        for r in passed(lefts):
            t, n = r["tree"], r["node"]
            found = choose(np.array(r["sums"]).reshape(width, targets + 1), totals[t, n], p.least_leaf)
            if found:
                tree = trees[t]
                tree.feature[n], tree.threshold[n], tree.left[n] = found[0], float(drawn[t, n][found[0]]), len(tree.left)
                for _ in range(2):
                    split[t].append(len(tree.left))
                    tree.feature.append(0)
                    tree.threshold.append(0.0)
                    tree.left.append(-1)
                    tree.value.append([])
        wanted = split
    return ExtraTrees(tuple(columns), trees)

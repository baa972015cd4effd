"""Gradient boosting on histograms, for several targets at once.

Values become bins between quantiles that a mergeable sketch finds (rows weigh alike, as the squared error has a second derivative of one
everywhere); what is missing has a bin of its own and goes to the side that gains more. A pass adds up gradients and second
derivatives by node, feature and bin within each task, merges the sums by (target, node, block of features), and finds
the best split of a block where its sums are; the driver sees one row per block. Only the smaller of two new nodes is counted,
the larger is its parent less the smaller. All targets grow their trees in the same passes. Trees grow level by level, or best leaf
first: then a pass prepares the children of all leaves that may be next, and splits are taken from a queue as long as what
they need is known, which gives the trees of one split at a time in fewer passes.

Row-wise state is a byte per feature and the predictions so far, written out every few trees.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.shared import cut

_BLOCK = 32  # features whose sums travel together
_CELLS = 16 << 20  # feature values that a task counts in a pass, about
_FLUSH = 8  # trees between two writes of the predictions


@dataclass(frozen=True)
class Boost:
    """Settings. ``leaves`` grows best leaf first; ``top`` and ``rest`` keep the rows of the largest gradients and a share of the others, weighted up."""

    trees: int = 50
    rate: float = 0.1
    depth: int = 4
    leaves: int = 0
    bins: int = 64
    l2: float = 1.0
    least_gain: float = 0.0
    least_rows: float = 1.0
    subsample: float = 1.0
    top: float = 0.0
    rest: float = 0.0
    seed: int = 7


@dataclass
class Tree:
    """Nodes by number; a leaf has left -1. Bins up to ``cut`` go left, the missing bin 0 where ``missing_left`` says."""

    feature: list[int] = field(default_factory=lambda: [0])
    cut: list[int] = field(default_factory=lambda: [0])
    missing_left: list[bool] = field(default_factory=lambda: [True])
    left: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, s: Split) -> int:
        """Makes two children; the right one's number is the left one's and one."""
        self.feature[node], self.cut[node], self.missing_left[node], self.left[node] = s.feature, s.cut, s.missing_left, len(self.left)
        for _ in range(2):
            for name, empty in (("feature", 0), ("cut", 0), ("missing_left", True), ("left", -1), ("value", 0.0)):
                getattr(self, name).append(empty)
        return self.left[node]

    def route(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        feature, at, missing, left = np.array(self.feature), np.array(self.cut), np.array(self.missing_left), np.array(self.left)
        node, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while len(rows := rows[left[node[rows]] >= 0]):
            now = node[rows]
            b = bins[rows, feature[now]]
            goes_left = np.where(b == 0, missing[now], b <= at[now])
            node[rows] = left[now] + ~goes_left
        return node


@dataclass(frozen=True)
class Split:
    gain: float
    feature: int
    cut: int
    missing_left: bool
    sums: tuple[float, float, float, float]  # gradient and second derivative, left and right

    def value(self, side: int, p: Boost) -> float:
        return -p.rate * self.sums[2 * side] / (self.sums[2 * side + 1] + p.l2)


def best_split(hist: np.ndarray, first: int, p: Boost) -> Split | None:
    """The split of largest gain over a histogram (feature, bin, (gradient, second derivative)); of equal ones the first."""
    total, missing, known = hist[:1].sum(axis=1, keepdims=True), hist[:, :1], hist[:, 1:].cumsum(axis=1)[:, :-1]
    if not known.shape[1]:
        return None
    score = lambda s: s[..., 0] ** 2 / (s[..., 1] + p.l2)
    found = None
    for missing_left in (True, False):
        left = known + missing if missing_left else known
        right = total - left
        gain = (score(left) + score(right) - score(total)) / 2
        gain = np.where((left[..., 1] < p.least_rows) | (right[..., 1] < p.least_rows), -np.inf, gain)
        f, b = np.unravel_index(int(gain.argmax()), gain.shape)
        if gain[f, b] > p.least_gain + 1e-12 and (found is None or gain[f, b] > found.gain + 1e-12):
            found = Split(float(gain[f, b]), first + int(f), int(b) + 1, missing_left, (*left[f, b].tolist(), *right[f, b].tolist()))
    return found


def _uniform(ids: np.ndarray, *salt: int) -> np.ndarray:
    """A number in [0, 1) for each id, the same whatever task the row is in."""
    with np.errstate(over="ignore"):
        x = ids.astype(np.uint64)
        for s in salt:
            x = (x + np.uint64((s + 1) * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(29)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(11)).astype(float) / 2.0**53


def to_bins(x: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    """Bin 0 for what is missing, else 1 and how many edges are below the value."""
    out = np.empty(x.shape, np.uint8)
    for f, e in enumerate(edges):
        out[:, f] = np.where(np.isnan(x[:, f]), 0, 1 + np.searchsorted(e, x[:, f]))
    return out


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), float).reshape(-1, width) if len(column) else np.empty((0, width))


@dataclass
class Boosted:
    """Boosted trees for ``columns``: start values, edges of the bins, and a list of trees for each target."""

    columns: tuple[str, ...]
    start: list[float]
    edges: list[np.ndarray]
    trees: list[list[Tree]]

    def values(self, bins: np.ndarray, first: int = 0) -> np.ndarray:
        out = np.zeros((len(bins), len(self.columns)))
        for c, own in enumerate(self.trees):
            for tree in own[first:]:
                out[:, c] += np.array(tree.value)[tree.route(bins)]
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``prediction``: an array in the order of the columns."""

        def run(batches):
            for batch in batches:
                x = _matrix(batch.column("__x"), len(self.edges))
                made = self.values(to_bins(x, self.edges)) + self.start
                kept = [n for n in batch.schema.names if n != "__x"]
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(list(made), pa.list_(pa.float64()))], names=[*kept, "prediction"])

        kept = [c for c in df.columns if c != "features"]
        schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept)
        return df.select(*kept, vector_to_array("features").alias("__x")).mapInArrow(run, f"{schema}, prediction array<double>")

    def predict(self, features: Sequence[float]) -> list[float]:
        return (self.values(to_bins(np.array([features], float), self.edges))[0] + self.start).tolist()

    def dumps(self) -> str:
        return json.dumps({"columns": self.columns, "start": self.start, "edges": [e.tolist() for e in self.edges], "trees": [[asdict(t) for t in own] for own in self.trees]})

    @classmethod
    def loads(cls, text: str) -> Boosted:
        about = json.loads(text)
        return cls(tuple(about["columns"]), about["start"], [np.array(e) for e in about["edges"]], [[Tree(**t) for t in own] for own in about["trees"]])


def quantile_edges(df: DataFrame, width: int, bins: int) -> list[np.ndarray]:
    """Edges of at most ``bins`` bins for each feature of ``x``, from a quantile sketch that tasks merge; a feature of few values has an edge at each but the last."""
    shares = [i / bins for i in range(1, bins + 1)]
    values = df.select(F.posexplode("x").alias("f", "v")).where("v IS NOT NULL AND NOT isnan(v)")
    found = {r["f"]: r["e"] for r in values.groupBy("f").agg(F.percentile_approx("v", shares, 100 * bins).alias("e")).collect()}
    return [np.unique(found.get(f, []))[:-1] for f in range(width)]


_SUMS = {"target": pa.int32(), "node": pa.int32(), "block": pa.int32(), "role": pa.string(), "sums": pa.binary()}
_SUMS_SQL = "target int, node int, block int, role string, sums binary"
_FOUND = {"gain": pa.float64(), "feature": pa.int32(), "cut": pa.int32(), "missing_left": pa.bool_(), "gl": pa.float64(), "hl": pa.float64(), "gr": pa.float64(), "hr": pa.float64()}
_FOUND_SQL = "gain double, feature int, cut int, missing_left boolean, gl double, hl double, gr double, hr double"


def _batch(rows: list[dict], types: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in types.items()], names=list(types))


class _Trainer:
    def __init__(self, state: DataFrame, model: Boosted, p: Boost, tasks: int):
        self.state, self.model, self.p, self.flushed, self.tasks = state, model, p, 0, tasks
        self.width, self.bins = len(model.edges), 1 + max((len(e) + 1 for e in model.edges), default=1)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"state": None}  # tasks get the trees only

    def _rows(self, batches) -> Iterator[tuple]:
        """(batch, bins, gradients) with the trees since the last write applied."""
        for batch in batches:
            bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(-1, self.width)
            now = _matrix(batch.column("now"), len(self.model.columns)) + self.model.values(bins, self.flushed)
            yield batch, bins, now

    def _weights(self, ids: np.ndarray, gradient: np.ndarray, target: int, tree: int, limits: list[float] | None) -> np.ndarray:
        p = self.p
        if limits is not None:
            u = _uniform(ids, p.seed, tree, target)
            return np.where(np.abs(gradient) >= limits[target], 1.0, np.where(u < p.rest / (1 - p.top), (1 - p.top) / p.rest, 0.0))
        return np.ones(len(ids)) if p.subsample >= 1 else (_uniform(ids, p.seed, tree, target) < p.subsample).astype(float)

    def _count(self, grown: list[Tree], wanted: list[dict[int, tuple[int, int]]], tree: int, limits):
        """Sums of this task's rows for the nodes ``wanted`` (node -> (number that its sums go by, its first child, or -1 for itself))."""

        def run(batches):
            held: dict[tuple[int, int], np.ndarray] = {}
            for batch, bins, now in self._rows(batches):
                y, ids = _matrix(batch.column("y"), len(grown)), np.asarray(batch.column("id"))
                flat = np.arange(self.width) * self.bins + bins
                for c, (own, want) in enumerate(zip(grown, wanted, strict=True)):
                    if not want:
                        continue
                    gradient = now[:, c] - y[:, c]
                    weight = self._weights(ids, gradient, c, tree, limits)
                    node = own.route(bins)
                    for n in want:
                        rows = np.flatnonzero((node == n) & (weight > 0) & ~np.isnan(gradient))
                        at = flat[rows].ravel()
                        sums = [np.bincount(at, np.repeat(v[rows], self.width), self.width * self.bins) for v in (gradient * weight, weight)]
                        held[c, n] = held.get((c, n), 0) + np.stack(sums, axis=-1)
            for c, want in enumerate(wanted):
                for n, (by, _) in want.items():
                    sums = held.get((c, n), np.zeros((self.width * self.bins, 2))).reshape(self.width, self.bins, 2)
                    rows = [{"target": c, "node": by, "block": b, "role": str(n), "sums": np.ascontiguousarray(sums[b * _BLOCK : (b + 1) * _BLOCK]).tobytes()} for b in range(-(-self.width // _BLOCK))]
                    yield _batch(rows, _SUMS)

        return run

    def _merge(self, children: dict[tuple[int, int], tuple[int, int]]):
        """Merged sums of nodes with their best split; ``children`` of (target, parent) is (counted child, other child)."""
        bins, p = self.bins, self.p

        def run(batches):
            held: dict[tuple, np.ndarray] = {}
            for batch in batches:
                for r in batch.to_pylist():
                    key = (r["target"], r["node"], r["block"], r["role"] == "parent")
                    held[key] = held.get(key, 0) + np.frombuffer(r["sums"]).reshape(-1, bins, 2)
            out = []
            for (target, node, block, is_parent), sums in held.items():
                if is_parent:
                    continue
                both = [(node, sums)]
                if (target, node) in children:
                    small, large = children[target, node]
                    both = [(small, sums), (large, held[target, node, block, True] - sums)]
                for n, own in both:
                    s = best_split(own, block * _BLOCK, p)
                    found = dict(zip(("gl", "hl", "gr", "hr"), s.sums, strict=True), gain=s.gain, feature=s.feature, cut=s.cut, missing_left=s.missing_left) if s else {}
                    out.append({"target": target, "node": n, "block": block, "role": "parent", "sums": own.tobytes(), **found})
            yield _batch(out, _SUMS | _FOUND)

        return run

    def grow(self, tree: int) -> None:
        """One more tree for every target."""
        p, targets = self.p, range(len(self.model.columns))
        limits = self._limits() if p.top else None
        grown = [Tree() for _ in targets]  # with children that are prepared but perhaps not taken
        final: list[dict[int, bool]] = [{} for _ in targets]  # nodes that are split
        known: list[dict[int, Split | None]] = [{} for _ in targets]
        done: list[DataFrame] = []

        def look(wanted, children) -> None:
            """A pass over the rows: best splits of new nodes."""
            made = self.state.mapInArrow(self._count(grown, wanted, tree, limits), _SUMS_SQL)
            if children:
                keys = [c * 10**6 + n for c, n in children]
                old = reduce(DataFrame.unionByName, [d.select("target", "node", "block", "role", "sums") for d in done])
                made = made.unionByName(old.where((F.col("target") * 10**6 + F.col("node")).isin(keys)))
            dealt = made.repartition("target", "node", "block") if self.tasks > 1 else made.coalesce(1)
            made = cut(dealt.mapInArrow(self._merge(children), f"{_SUMS_SQL}, {_FOUND_SQL}"))
            done.append(made)
            for r in made.select("target", "node", *_FOUND).collect():  # a row for each new node and block of features
                s = None if r["gain"] is None else Split(r["gain"], r["feature"], r["cut"], r["missing_left"], (r["gl"], r["hl"], r["gr"], r["hr"]))
                before = known[r["target"]].get(r["node"])
                if before is None or s is not None and (s.gain > before.gain + 1e-12 or abs(s.gain - before.gain) <= 1e-12 and s.feature < before.feature):
                    known[r["target"]][r["node"]] = s

        look([{0: (0, -1)} for _ in targets], {})
        depth = [{0: 0} for _ in targets]
        queue = [[0] for _ in targets]  # leaves of the trees as taken so far
        while True:
            expand = []
            for c in targets:
                while queue[c] and (not p.leaves or len(queue[c]) < p.leaves):
                    open_ = [n for n in queue[c] if known[c].get(n) is not None and n not in final[c] and (p.leaves or depth[c][n] < p.depth)]
                    if not open_:
                        break
                    best = max(open_, key=lambda n: (known[c][n].gain, -n)) if p.leaves else min(open_)
                    s = known[c][best]
                    last = (len(queue[c]) == p.leaves - 1) if p.leaves else depth[c][best] == p.depth - 1
                    if grown[c].left[best] < 0 and not last:
                        spare = p.leaves - len(queue[c]) if p.leaves else len(open_)
                        open_.sort(key=lambda n: (-known[c][n].gain, n))
                        expand += [(c, n) for n in open_[:spare] if grown[c].left[n] < 0 and (p.leaves or depth[c][n] < p.depth - 1)]
                        break
                    first = grown[c].left[best] if grown[c].left[best] >= 0 else grown[c].split(best, s)
                    final[c][best] = True
                    for side in range(2):
                        grown[c].value[first + side] = s.value(side, p)
                        depth[c][first + side] = depth[c][best] + 1
                    queue[c].remove(best)
                    queue[c] += [first, first + 1]
            if not expand:
                break
            wanted: list[dict[int, tuple[int, int]]] = [{} for _ in targets]
            children = {}
            for c, n in expand:
                s = known[c][n]
                first = grown[c].split(n, s)
                depth[c][first] = depth[c][first + 1] = depth[c][n] + 1
                small = first if s.sums[1] <= s.sums[3] else first + 1
                wanted[c][small] = (n, first)
                children[c, n] = (small, 2 * first + 1 - small)
            look(wanted, children)
        for c in targets:
            for n in range(len(grown[c].left)):
                if n not in final[c]:
                    grown[c].left[n] = -1  # prepared, not taken
            self.model.trees[c].append(grown[c])
        if len(self.model.trees[0]) - self.flushed >= _FLUSH:
            self._flush()

    def _flush(self) -> None:
        names = self.state.columns

        def run(batches):
            for batch, _, now in self._rows(batches):
                yield pa.RecordBatch.from_arrays([pa.array(list(now), pa.list_(pa.float64())) if n == "now" else batch.column(n) for n in names], names=names)

        self.state = cut(self.state.mapInArrow(run, self.state.schema))
        self.flushed = len(self.model.trees[0])

    def _limits(self) -> list[float]:
        """For each target the gradient that a share ``top`` of the rows reaches."""

        def run(batches):
            for batch, _, now in self._rows(batches):
                gap = np.abs(now - _matrix(batch.column("y"), now.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(gap.shape[1], dtype=np.int32), len(gap))), pa.array(gap.ravel())], names=["c", "g"])

        found = self.state.mapInArrow(run, "c int, g double").groupBy("c").agg(F.percentile_approx("g", 1 - self.p.top, 10_000).alias("g")).collect()
        by = {r["c"]: r["g"] for r in found}
        return [by.get(c, 0.0) for c in range(len(self.model.columns))]


def fit_boosted(train: DataFrame, columns: Sequence[str], settings: Boost = Boost()) -> Boosted:  # noqa: B008  frozen
    """Trees on ``features`` (a vector; NaN is missing) for every target of the array ``y``; ``columns`` names the targets.

    Rows whose target is null or NaN don't count for that target. The same settings and rows give the same trees, however the rows are dealt.
    """
    rows = train.select(vector_to_array("features").alias("x"), F.transform("y", lambda v: F.coalesce(v.cast("double"), F.lit(float("nan")))).alias("y"))
    facts = rows.select(F.size("x").alias("n"), *[F.when(~F.isnan(F.col("y")[i]), F.col("y")[i]).alias(f"y{i}") for i in range(len(columns))]).agg(F.max("n"), F.count(F.lit(1)), *[F.avg(f"y{i}") for i in range(len(columns))]).first()
    width, start = facts[0] or 0, [v or 0.0 for v in facts[2:]]
    tasks = 1 + facts[1] * width // _CELLS  # small tables aren't worth many tasks a pass
    edges = quantile_edges(rows, width, min(settings.bins, 254))

    def run(batches):
        for batch in batches:
            bins = to_bins(_matrix(batch.column("x"), width), edges)
            now = pa.array([start] * len(bins), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([r.tobytes() for r in bins], pa.binary()), batch.column("y"), now], names=["id", "bins", "y", "now"])

    # the number a row is sampled by comes from its values, so that it doesn't depend on how rows are dealt
    named = rows.select(F.xxhash64(F.transform("x", lambda v: v), F.col("y")).alias("id"), "x", "y")
    state = cut(named.mapInArrow(run, "id long, bins binary, y array<double>, now array<double>").coalesce(tasks))
    trainer = _Trainer(state, Boosted(tuple(columns), start, edges, [[] for _ in columns]), settings, tasks)
    for tree in range(settings.trees if width else 0):
        trainer.grow(tree)
    return trainer.model

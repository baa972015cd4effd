"""Preprocessing and models on lag windows, with pyspark.ml."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import PredictionModel
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import (
    DecisionTreeRegressionModel, DecisionTreeRegressor, GBTRegressionModel, GBTRegressor, LinearRegression, LinearRegressionModel, RandomForestRegressionModel, RandomForestRegressor,
)
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wattloom.functions.scaling import MinMax, fit_min_max
from wattloom.operators.boosting import Boost, Boosted, fit_boosted
from wattloom.operators.extra_trees import Extra, ExtraTrees, fit_extra
from wattloom.operators.knn import KnnImputer, KnnTable, fit_knn, stored_knn
from wattloom.operators.timeseries import chronological_split, lag_windows
from wattloom.schema import FEATURES, TIMESTAMP


def design(df: DataFrame, columns: Sequence[str] = FEATURES, lookback: int = 36, drop_last: bool = True, ts: str = TIMESTAMP) -> DataFrame:
    """(ts, features vector of lookback * columns numbers, time outside, column inside; y array)."""
    made = lag_windows(df, columns, lookback, 1, drop_last, ts=ts)
    return made.select(ts, array_to_vector(F.flatten("x")).alias("features"), F.col("y")[0].alias("y"))


FAMILIES: dict[str, Callable] = {
    "gbt": lambda **p: GBTRegressor(seed=7, **({"maxIter": 10, "maxDepth": 4} | p)),
    "forest": lambda **p: RandomForestRegressor(seed=7, **({"numTrees": 10, "maxDepth": 5} | p)),
    "tree": lambda **p: DecisionTreeRegressor(seed=7, **({"maxDepth": 5} | p)),
    "linear": lambda **p: LinearRegression(**({"regParam": 0.01} | p)),
}


#: Boosting of the library's own, all targets at once: by levels, and best leaf first on the rows of large gradients.
BOOSTED = {"hist": Boost(trees=20, depth=4, bins=32, rate=0.2), "leafwise": Boost(trees=20, leaves=15, bins=32, rate=0.2, top=0.2, rest=0.2)}


EXTRA = {"extra": Extra(trees=50, depth=8)}
Own = Boosted | ExtraTrees


@dataclass
class MultiOutput:
    """One model per target column over the same features."""

    columns: tuple[str, ...]
    models: list[PredictionModel] = field(default_factory=list)

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``prediction``: an array in the order of the columns."""
        for i, m in enumerate(self.models):
            df = m.copy().setPredictionCol(f"__p{i}").transform(df)
        return df.withColumn("prediction", F.array(*[f"__p{i}" for i in range(len(self.models))])).drop(*[f"__p{i}" for i in range(len(self.models))])

    def predict(self, features: Sequence[float]) -> list[float]:
        v = Vectors.dense(features)
        return [float(m.predict(v)) for m in self.models]


def at_once(work: Callable, items: Sequence, threads: int = 6) -> list:
    """``work`` of every item, a few at a time: small fits leave most of a cluster idle, so their jobs are submitted together."""
    with ThreadPool(max(1, min(threads, len(items)))) as pool:
        return pool.map(inheritable_thread_target(SparkSession.active())(work), items, chunksize=1)


def fit_multi(train: DataFrame, columns: Sequence[str], family: str = "gbt", **params) -> MultiOutput | Own:
    if family in BOOSTED:
        return fit_boosted(train, columns, replace(BOOSTED[family], **params))
    if family in EXTRA:
        return fit_extra(train, columns, replace(EXTRA[family], **params))

    def fit(i):
        return FAMILIES[family](**params).setLabelCol("label").setFeaturesCol("features").fit(train.select("features", F.col("y")[i].alias("label")))

    return MultiOutput(tuple(columns), at_once(fit, range(len(columns))))


def errors(predicted: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, mae, mse) of ``prediction`` against ``y``."""
    long = predicted.select(F.posexplode(F.arrays_zip("y", "prediction")).alias("i", "z"))
    names = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("i") + 1)
    gap = F.col("z.y") - F.col("z.prediction")
    return long.groupBy(names.alias("column")).agg(F.avg(F.abs(gap)).alias("mae"), F.avg(gap * gap).alias("mse"))


@dataclass
class Trained:
    imputer: KnnImputer | KnnTable
    scaler: MinMax
    model: MultiOutput | Own
    lookback: int
    scores: list[tuple[str, float, float]]
    test: tuple[float, float] | None = None

    def prepare(self, df: DataFrame) -> DataFrame:
        return self.scaler.transform(self.imputer.transform(df))

    def score(self, df: DataFrame) -> DataFrame:
        """(timestamp, y, prediction) in original units for every window."""
        columns = self.model.columns
        done = self.model.transform(design(self.prepare(df), columns, self.lookback))
        back = lambda name: F.array(*[self.scaler.restored(F.col(name)[i], c) for i, c in enumerate(columns)])
        return done.select(TIMESTAMP, back("y").alias("y"), back("prediction").alias("prediction"))

    def forecast(self, df: DataFrame, steps: int) -> DataFrame:
        """(step, timestamp, one column per feature): each forecast is the newest row of the next one's window.

        A forecast has one context of ``lookback`` rows; these come to the driver, and each step asks the models once.
        """
        columns = self.model.columns
        context = self.prepare(df).orderBy(F.col(TIMESTAMP).desc()).limit(self.lookback).collect()[::-1]
        if len(context) < self.lookback:
            raise ValueError(f"{self.lookback} rows are needed, there are {len(context)}")
        window = [[float(r[c]) for c in columns] for r in context]
        out = []
        for step in range(1, steps + 1):
            window.append(self.model.predict([v for row in window for v in row]))
            window.pop(0)
            out.append((step, *window[-1]))
        frame = df.sparkSession.createDataFrame(out, "step int, " + ", ".join(f"{c} double" for c in columns))
        last = F.lit(context[-1][TIMESTAMP]).cast("timestamp_ntz")
        return self.scaler.inverse(frame).withColumn(TIMESTAMP, last + F.make_dt_interval(hours="step")).select("step", TIMESTAMP, *columns)


    def backtest(self, df: DataFrame, steps: int) -> DataFrame:
        """(step, timestamp, column, actual, forecast) of the last ``steps`` rows, forecast from the rows before them."""
        columns = self.model.columns
        newest = Window.orderBy(F.col(TIMESTAMP).desc())
        ranked = df.withColumn("__back", F.row_number().over(newest))
        made = self.forecast(ranked.where(F.col("__back") > steps).drop("__back"), steps)
        long = lambda frame, name: frame.unpivot([TIMESTAMP], list(columns), "column", name)
        actual = long(ranked.where(F.col("__back") <= steps).select(TIMESTAMP, *columns), "actual")
        return long(made, "forecast").join(actual, [TIMESTAMP, "column"]).join(made.select(TIMESTAMP, "step"), TIMESTAMP).select("step", TIMESTAMP, "column", "actual", "forecast")

    def save(self, spark: SparkSession, path: str) -> None:
        """Everything that scoring needs: the models, the donors, and one JSON line for the rest."""
        own = isinstance(self.model, Own)
        models = [] if own else self.model.models
        for i, m in enumerate(models):
            m.write().overwrite().save(f"{path}/model_{i:03d}")
        self.imputer.table(spark).write.mode("overwrite").parquet(f"{path}/donors")
        about = {
            "columns": self.model.columns, "kinds": [type(m).__name__ for m in models], "own": [type(self.model).__name__, self.model.dumps()] if own else None, "lookback": self.lookback, "scores": self.scores, "test": self.test,
            "k": self.imputer.k, "means": self.imputer.means.tolist(), "bounds": {c: list(b) for c, b in self.scaler.bounds.items()},
        }
        spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


_KINDS = {c.__name__: c for c in (GBTRegressionModel, RandomForestRegressionModel, DecisionTreeRegressionModel, LinearRegressionModel)}


def load(spark: SparkSession, path: str) -> Trained:
    """What ``Trained.save`` wrote."""
    about = json.loads(spark.read.text(f"{path}/about").first()["value"])
    columns = tuple(about["columns"])
    imputer = stored_knn(spark.read.parquet(f"{path}/donors"), columns, about["means"], about["k"])
    models = [_KINDS[kind].load(f"{path}/model_{i:03d}") for i, kind in enumerate(about["kinds"])]
    bounds = {c: tuple(b) for c, b in about["bounds"].items()}
    model = {"Boosted": Boosted, "ExtraTrees": ExtraTrees}[about["own"][0]].loads(about["own"][1]) if about.get("own") else MultiOutput(columns, models)
    return Trained(imputer, MinMax(bounds), model, about["lookback"], [tuple(x) for x in about["scores"]], tuple(about["test"]) if about["test"] else None)


def train_and_select(hourly: DataFrame, families: Sequence[str] = ("gbt", "forest"), columns: Sequence[str] = FEATURES, lookback: int = 36, params: dict | None = None) -> Trained:
    """Split in time, impute and scale by the training part, fit each family, keep the one with the least validation error.

    Windows are told apart by the time they forecast: validation windows may look back on training rows, test windows on
    both. Only the chosen family meets the test windows, once, for its error.
    """
    split = chronological_split(hourly).cache()
    part = lambda name: split.where(F.col("split") == name).drop("split")
    imputer = fit_knn(part("train"), columns)
    filled = imputer.transform(part("train"))
    scaler = fit_min_max(filled, columns)
    train = design(scaler.transform(filled), columns, lookback).cache()
    whole = design(scaler.transform(imputer.transform(split.drop("split"))), columns, lookback, drop_last=False)
    windows = lambda name: whole.join(F.broadcast(split.where(F.col("split") == name).agg(F.min(TIMESTAMP).alias("a"), F.max(TIMESTAMP).alias("b"))), F.col(TIMESTAMP).between(F.col("a"), F.col("b"))).drop("a", "b")
    check = windows("valid").cache()
    mean = lambda frame: tuple(errors(frame, columns).agg(F.avg("mae"), F.avg("mse")).first())
    best, scores = None, []
    for family in families:
        model = fit_multi(train, columns, family, **(params or {}).get(family, {}))
        mae, mse = mean(model.transform(check))
        scores.append((family, mae, mse))
        if best is None or mae < best[0]:
            best = (mae, model)
    test = mean(best[1].transform(windows("test")))
    for frame in (train, check, split):
        frame.unpersist()
    return Trained(imputer, scaler, best[1], lookback, scores, test)


def expanding_folds(n: int, folds: int = 3) -> list[tuple[int, int, int]]:
    """(train_end, test_start, test_end) row numbers, exclusive ends: each fold trains on all before its test block."""
    size = n // (folds + 1)
    return [(n - (folds - i) * size, n - (folds - i) * size, n - (folds - i - 1) * size) for i in range(folds)]


def _labelled(hourly: DataFrame, target: str, lookback: int, columns: Sequence[str]) -> DataFrame:
    return design(hourly, columns, lookback).withColumn("__rn", F.row_number().over(_by_time())).select("__rn", "features", F.col("y")[list(columns).index(target)].alias("label"))


#: The settings that a grid search goes through unless told otherwise; trees of one fit serve all their numbers.
GRID = {"stepSize": (0.1, 0.001), "subsamplingRate": (0.7, 0.85), "maxIter": (50, 100)}


def grid_search(hourly: DataFrame, targets: Sequence[str], grid: dict[str, Sequence] | None = None, folds: int = 3, lookback: int = 36, columns: Sequence[str] = FEATURES, depth: int = 3) -> list[tuple[dict, float]]:
    """(parameters, mean r2 over targets and folds) of boosted trees, best first; folds are blocks of neighbouring rows.

    Boosting adds its trees one by one, so an ensemble of 100 holds that of 50: one fit of the largest number is scored at
    every number of the grid.
    """
    grid = grid or GRID
    sizes = sorted(grid["maxIter"])
    others = [(a, b) for a in grid["stepSize"] for b in grid["subsamplingRate"]]
    frames = {t: _labelled(hourly, t, lookback, columns).cache() for t in targets}
    n = frames[targets[0]].count()
    edges = [round(n * k / folds) for k in range(folds + 1)]

    def one(job):
        target, (rate, share), k = job
        inside = F.col("__rn").between(edges[k] + 1, edges[k + 1])
        rows = frames[target]
        model = GBTRegressor(seed=7, maxDepth=depth, maxIter=sizes[-1], stepSize=rate, subsamplingRate=share).setLabelCol("label").setFeaturesCol("features").fit(rows.where(~inside))
        held = rows.where(inside)
        losses = model.evaluateEachIteration(held.select("features", F.col("label").cast("double").alias("label")), "squared")
        spread = held.agg(F.var_pop("label")).first()[0]
        return [(rate, share, size, 1 - losses[size - 1] / spread if spread else 0.0) for size in sizes]

    scored: dict[tuple, list[float]] = {}
    for found in at_once(one, [(t, o, k) for t in targets for o in others for k in range(folds)], 8):
        for *choice, r2 in found:
            scored.setdefault(tuple(choice), []).append(r2)
    for frame in frames.values():
        frame.unpersist()
    named = [(dict(zip(("stepSize", "subsamplingRate", "maxIter"), c, strict=True)), sum(v) / len(v)) for c, v in scored.items()]
    return sorted(named, key=lambda x: -x[1])


def _expected_gain(seen: np.ndarray, values: np.ndarray, at: np.ndarray, width: float = 0.3) -> np.ndarray:
    """Expected improvement below the least value, by a Gaussian process on the unit cube."""
    scale = values.std() or 1.0
    y = (values - values.mean()) / scale
    kernel = lambda a, b: np.exp(-((a[:, None] - b[None]) ** 2).sum(-1) / (2 * width**2))
    solve = np.linalg.inv(kernel(seen, seen) + 1e-4 * np.eye(len(seen)))
    k = kernel(at, seen)
    mean, sd = k @ solve @ y, np.sqrt(np.maximum(1e-12, 1 - np.einsum("ij,jk,ik->i", k, solve, k)))
    z = (y.min() - mean) / sd
    return sd * (z * np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in z]) + np.exp(-z * z / 2) / math.sqrt(2 * math.pi))


def guided_search(hourly: DataFrame, target: str, space: dict[str, tuple], tries: int = 30, first: int = 8, folds: int = 3, lookback: int = 36, family: str = "gbt", seed: int = 42, columns: Sequence[str] = FEATURES) -> list[tuple[dict, float]]:
    """(parameters, mean absolute error over expanding folds), best first.

    ``space`` has (least, largest) per parameter, whole numbers if both are, and a third item "log" for a logarithmic
    scale. The ``first`` tries are random, each later one is the candidate with the largest expected improvement.
    """
    rng = np.random.default_rng(seed)
    rows = _labelled(hourly, target, lookback, columns).cache()
    n = rows.count()

    def real(u: np.ndarray) -> dict:
        out = {}
        for x, (name, (low, high, *how)) in zip(u.tolist(), space.items(), strict=True):
            value = math.exp(math.log(low) + x * (math.log(high) - math.log(low))) if how else low + x * (high - low)
            out[name] = round(value) if isinstance(low, int) and isinstance(high, int) else value
        return out

    def score(choice: dict) -> float:
        def fold(ends):
            end, a, b = ends
            model = FAMILIES[family](**choice).setLabelCol("label").setFeaturesCol("features").fit(rows.where(F.col("__rn") <= end))
            return model.transform(rows.where((F.col("__rn") > a) & (F.col("__rn") <= b))).agg(F.avg(F.abs(F.col("label") - F.col("prediction")))).first()[0]

        found = at_once(fold, expanding_folds(n, folds))
        return sum(found) / len(found) if all(v is not None for v in found) else math.inf

    points, done = [], []
    for k in range(tries):
        candidates = rng.random((1 if k < first else 256, len(space)))
        finite = [i for i, (_, v) in enumerate(done) if math.isfinite(v)]
        best = 0 if k < first or not finite else int(_expected_gain(np.array(points)[finite], np.array([done[i][1] for i in finite]), candidates).argmax())
        points.append(candidates[best])
        done.append((real(candidates[best]), score(real(candidates[best]))))
    rows.unpersist()
    return sorted(done, key=lambda x: x[1])


def _by_time():
    return Window.orderBy(TIMESTAMP)

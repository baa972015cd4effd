"""ARIMA with seasonal terms, for many series and many cutoffs, from one matrix of sums for each.

The regressors of every model tried here are linear in the value and its newest lags b = (1, y[t], y[t-1], ... y[t-K]): differences,
seasonal differences, lags of them, and, once a long autoregression is fitted, its residuals, which stand for the
innovations (Hannan and Rissanen, "Recursive estimation of mixed autoregressive-moving average order", 1982). So all
normal equations follow from the sums of b b' by small products, whatever the length of the series: the test for a unit root,
the long autoregression, and each order of the stepwise search (Hyndman and Khandakar, 2008). Sums over whole blocks
of the horizon, added from the oldest block on, are the sums before each cutoff, so one pass over the rows
refits a model at every cutoff of a back-test.

Series are dealt in ranges of (series, newest first). A task sums what it has of a series; the windows over the edge of two
tasks are added from the few values at their ends, so a series may be as long as it likes.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.ranges import deal
from wattloom.shared import cut

#: Seasonal strength beyond which a seasonal difference is taken, and the 5 % points of the Dickey-Fuller test with a constant
#: by 1, 1/n and 1/n^2 (MacKinnon, 2010). Fixed values.
STRONG = 0.64
UNIT_ROOT = (-2.86154, -2.8903, -4.234)


@dataclass(frozen=True)
class Settings:
    season: int = 0
    h: int = 24
    windows: int = 0
    most: int = 5  # of each of p and q
    seasonal_most: int = 1  # of each of P and Q

    @property
    def long(self) -> int:
        """Order of the long autoregression."""
        return self.season + 2 if self.season else 10

    @property
    def reach(self) -> int:
        """Newest residual lags that a model may use."""
        return max(self.most, self.season * self.seasonal_most)

    @property
    def lags(self) -> int:
        return self.long + self.reach + self.season + 1

    @property
    def newest(self) -> int:
        return self.h * self.windows + self.lags + 1


@dataclass
class Sums:
    """Sums of b b' by block, from values that come newest first. Block i ends ``i`` horizons before the end; the last block has all the rest."""

    settings: Settings
    start: int = 0
    at: int = 0  # number, from the newest, of the first value not yet in ``held`` or before it
    shift: float | None = None
    grams: dict[int, np.ndarray] = field(default_factory=dict)
    held: np.ndarray = field(default_factory=lambda: np.empty(0))  # the last values, whose lags are still to come
    head: np.ndarray = field(default_factory=lambda: np.empty(0))  # the first values

    def add(self, values: np.ndarray) -> None:
        if self.shift is None and len(values):
            self.shift = float(values[0])
        k, first = self.settings.lags, self.at - len(self.held)
        if len(self.head) < self.settings.newest:
            self.head = np.concatenate([self.head, values[: self.settings.newest - len(self.head)]])
        run = np.concatenate([self.held, values])
        self.at += len(values)
        n = len(run) - k
        if n > 0:
            b = np.column_stack([np.ones(n), np.lib.stride_tricks.sliding_window_view(run - self.shift, k + 1)])
            blocks = np.minimum((first + np.arange(n)) // self.settings.h, self.settings.windows)
            for block in np.unique(blocks).tolist():
                x = b[blocks == block]
                self.grams[block] = self.grams.get(block, 0) + x.T @ x
        self.held = run[max(n, 0) :]

    def merge(self, other: Sums) -> None:
        """Adds the sums of the values that come next (older ones)."""
        count = other.at - other.start
        if count <= self.settings.lags:  # it has no whole window of its own
            self.add(other.head[:count])
            return
        self.add(other.head[: self.settings.lags])  # the windows that begin here and end there
        move = np.eye(self.settings.lags + 2)
        move[1:, 0] = other.shift - self.shift
        for block, gram in other.grams.items():
            self.grams[block] = self.grams.get(block, 0) + move @ gram @ move.T
        if len(self.head) < self.settings.newest:
            self.head = np.concatenate([self.head, other.head[self.settings.lags :]])[: self.settings.newest]
        self.at, self.held = other.at, other.held


def _shifts(size: int, count: int, weights: dict[int, float]) -> np.ndarray:
    """Rows i = 0, 1, ...: the sum of weights[j] times the column of lag i + j; the first row and column are the constant."""
    out = np.zeros((count + 1, size))
    out[0, 0] = 1
    for i in range(count):
        for lag, w in weights.items():
            out[i + 1, 1 + i + lag] += w
    return out


def difference_weights(d: int, seasonal: int, season: int) -> dict[int, float]:
    """The polynomial (1 - B)^d (1 - B^season)^seasonal by lag."""
    poly = np.array([1.0])
    for _ in range(d):
        poly = np.convolve(poly, [1, -1])
    for _ in range(seasonal):
        poly = np.convolve(poly, np.r_[1, np.zeros(season - 1), -1])
    return {i: w for i, w in enumerate(poly.tolist()) if w}


def _regress(gram: np.ndarray, of: np.ndarray, on: np.ndarray) -> tuple[np.ndarray, float]:
    """Coefficients and sum of squares left, of the row ``of`` on the rows ``on``, all maps of the columns of ``gram``."""
    a, right, own = on @ gram @ on.T, on @ gram @ of, float(of @ gram @ of)
    scale = np.sqrt(np.maximum(np.diag(a), 1e-300))
    coefficients = np.linalg.lstsq(a / np.outer(scale, scale), right / scale, rcond=1e-12)[0] / scale
    rest = own - 2 * float(coefficients @ right) + float(coefficients @ a @ coefficients)
    return coefficients, max(rest, 1e-12 * own, 1e-300)


def unit_root(gram: np.ndarray, weights: dict[int, float], lags: int) -> bool:
    """Whether the augmented Dickey-Fuller test fails to reject a unit root at 5 %, with ``lags`` lagged differences."""
    z = _shifts(gram.shape[0], lags + 2, weights)
    change = z[1:-1] - z[2:]
    on = np.vstack([z[0], z[2], change[1:]])
    coefficients, rest = _regress(gram, change[0], on)
    n = gram[0, 0]
    if n <= len(on) + 1:
        return False
    a = on @ gram @ on.T
    error = np.sqrt(rest / (n - len(on)) * np.linalg.pinv(a, hermitian=True)[1, 1])
    return bool(coefficients[1] / max(error, 1e-300) > UNIT_ROOT[0] + UNIT_ROOT[1] / n + UNIT_ROOT[2] / n**2)


def seasonal_strength(gram: np.ndarray, season: int) -> float:
    """Correlation, at a season's distance, of the value less its trailing mean of a season: the share of the seasonal part in the variance."""
    weights = {i: (1.0 if i == 0 else 0.0) - 1 / season for i in range(season)}
    u = _shifts(gram.shape[0], season + 1, weights)
    n = gram[0, 0]
    a, b = u[1], u[-1]
    cov = lambda x, y: float(x @ gram @ y) / n - float(x @ gram @ u[0]) * float(y @ gram @ u[0]) / n**2
    return cov(a, b) / max(np.sqrt(max(cov(a, a), 0) * max(cov(b, b), 0)), 1e-300)


@dataclass
class Fit:
    order: tuple[int, int, int, int, int, int]
    constant: float
    ar: dict[int, float]  # by lag of the differenced series
    ma: dict[int, float]
    long: np.ndarray  # constant and coefficients of the long autoregression
    sigma2: float
    aicc: float


def _stable(ar: dict[int, float]) -> bool:
    if not ar:
        return True
    poly = np.zeros(max(ar) + 1)
    poly[0] = 1
    for lag, c in ar.items():
        poly[lag] = -c
    return bool(np.all(np.abs(np.roots(poly)) < 0.999))


def fit_sums(gram: np.ndarray, settings: Settings) -> Fit | None:
    """The model, of values less the shift of the sums, of least corrected Akaike criterion that a stepwise search finds; None if there are too few rows."""
    n, size, m = gram[0, 0] if gram is not None else 0, settings.lags + 2, settings.season
    if n <= 2 * settings.long + 2:
        return None
    seasonal = int(bool(m) and seasonal_strength(gram, m) > STRONG)
    d = int(unit_root(gram, difference_weights(0, seasonal, m), min(settings.long, 12)))
    weights = difference_weights(d, seasonal, m)
    z = _shifts(size, settings.lags + 1 - max(weights), weights)  # constant, z[t], z[t-1], ...
    constant, z = z[0], z[1:]
    long, _ = _regress(gram, z[0], np.vstack([constant, z[1 : settings.long + 1]]))
    e = {j: z[j] - long[0] * constant - long[1:] @ z[j + 1 : j + settings.long + 1] for j in range(1, settings.reach + 1)}
    known: dict[tuple, Fit] = {}

    def fit(p: int, q: int, sp: int, sq: int) -> Fit:
        if (p, q, sp, sq) not in known:
            ar = [*range(1, p + 1), *(m * i for i in range(1, sp + 1))]
            ma = [*range(1, q + 1), *(m * i for i in range(1, sq + 1))]
            with_constant = [constant] if d + seasonal < 2 else []
            got, rest = _regress(gram, z[0], np.vstack([*with_constant, *(z[j] for j in ar), *(e[j] for j in ma), np.zeros((0, size))]).reshape(-1, size))
            k = len(got) + 1
            aicc = n * np.log(rest / n) + 2 * k + (2 * k * (k + 1) / (n - k - 1) if n > k + 1 else np.inf)
            c = float(got[0]) if with_constant else 0.0
            got = got[len(with_constant) :]
            own = Fit((p, d, q, sp, seasonal, sq), c, dict(zip(ar, got[: len(ar)].tolist(), strict=True)), dict(zip(ma, got[len(ar) :].tolist(), strict=True)), long, rest / n, float(aicc))
            if not _stable(own.ar):
                own.aicc = np.inf
            known[p, q, sp, sq] = own
        return known[p, q, sp, sq]

    top = settings.seasonal_most if m else 0
    starts = [(2, 2, top, top), (0, 0, 0, 0), (1, 0, top, 0), (0, 1, 0, top)]
    best = min((fit(*s) for s in starts), key=lambda f: f.aicc)
    while True:
        p, _, q, sp, _, sq = best.order
        steps = [(a, b, c, e_) for a, b, c, e_ in ((p + i, q + j, sp + k, sq + o) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) for o in (-1, 0, 1) if abs(k) + abs(o) == 0 or i == j == 0) if 0 <= a <= settings.most and 0 <= b <= settings.most and 0 <= c <= top and 0 <= e_ <= top]
        better = min((fit(*s) for s in steps), key=lambda f: f.aicc)
        if better.aicc >= best.aicc:
            return best
        best = better


def forecast_values(found: Fit | None, newest: np.ndarray, settings: Settings, shift: float) -> list[float]:
    """The next ``h`` values after ``newest`` (newest first); the model is of values less ``shift``."""
    if found is None or len(newest) < settings.lags + 1:
        return [float(newest[0])] * settings.h
    y = (newest[::-1] - shift).tolist()
    _, d, _, _, seasonal, _ = found.order
    weights = difference_weights(d, seasonal, settings.season)
    z = [sum(w * y[t - lag] for lag, w in weights.items()) for t in range(max(weights), len(y))]
    e = [0.0] * len(z)
    for t in range(len(z) - settings.reach, len(z)):
        e[t] = z[t] - found.long[0] - sum(c * z[t - k] for k, c in enumerate(found.long[1:], 1))
    out = []
    for _ in range(settings.h):
        step = found.constant + sum(c * z[-k] for k, c in found.ar.items()) + sum(c * e[-k] for k, c in found.ma.items())
        z.append(step)
        e.append(0.0)
        y.append(step - sum(w * y[-lag] for lag, w in weights.items() if lag))
        out.append(y[-1] + shift)
    return out


def _cutoffs(sums: Sums, first_back: list[int]) -> Iterator[tuple[int, Fit | None, list[float]]]:
    """(values after the cutoff, model, forecasts) for cutoffs so many values before the end."""
    s = sums.settings
    for back in first_back:
        newest = sums.head[back : back + s.lags + 1]
        if not len(newest):
            continue
        grams = [g for b, g in sums.grams.items() if b >= back // s.h]
        found = fit_sums(sum(grams), s) if grams else None
        yield back, found, forecast_values(found, newest, s, sums.shift)


def _result(key, end, sums: Sums, hours: float) -> pd.DataFrame:
    s = sums.settings
    rows = []
    for back, found, values in _cutoffs(sums, [w * s.h for w in range(s.windows, 0, -1)] if s.windows else [0]):
        order = found.order if found else (0, 0, 0, 0, 0, 0)
        cutoff = end - pd.Timedelta(hours=hours) * back
        for step, v in enumerate(values, 1):
            rows.append((key, cutoff + pd.Timedelta(hours=hours) * step, cutoff, step, *order, v, float(sums.head[back - step]) if back else None))
    return pd.DataFrame(rows, columns=["unique_id", "ds", "cutoff", "step", "p", "d", "q", "sp", "sd", "sq", "forecast", "y"])


def _sum_up(settings: Settings, edges: dict, spread: set[int], hours: float):
    """Results of the series that a task has whole, and the sums of the others."""

    def run(frames):
        now = None
        first_pid = None
        done: list[pd.DataFrame] = []

        def finish(goes_on: bool) -> None:
            key, end, sums, before = now
            if not before and not goes_on:
                done.append(_result(key, end, sums, hours))
            else:
                done.append(pd.DataFrame({"unique_id": [key], "ds": [end], "cutoff": [end], "pid": [first_pid], "sums": [pickle.dumps(sums)]}))

        for pdf in frames:
            for key, group in pdf.groupby("unique_id", sort=False):
                if now is None or key != now[0]:
                    if now is not None:
                        finish(False)
                    pid = int(group["pid"].iloc[0])
                    before = edges[pid].before if now is None else 0
                    first_pid = pid
                    now = key, group["ds"].iloc[0], Sums(settings, at=before, start=before), before
                now[2].add(group["y"].to_numpy(float))
            if done:
                yield pd.concat(done)
                done.clear()
        if now is not None:
            finish(first_pid in spread)
            yield pd.concat(done)

    def shaped(frames):
        columns = ["unique_id", "ds", "cutoff", "step", "p", "d", "q", "sp", "sd", "sq", "forecast", "y", "pid", "sums"]
        for out in run(frames):
            yield out.reindex(columns=columns)

    return shaped


def _join_up(hours: float):
    """Results of series whose sums come from several tasks, newest first."""

    def run(frames):
        now = None
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                part: Sums = pickle.loads(r.sums)
                if now is None or r.unique_id != now[0]:
                    if now is not None:
                        yield _result(*now, hours)
                    now = r.unique_id, r.ds, part
                else:
                    now[2].merge(part)
        if now is not None:
            yield _result(*now, hours)

    return run


_OUT = "ds timestamp_ntz, cutoff timestamp_ntz, step int, p int, d int, q int, sp int, sd int, sq int, forecast double, y double"


def _run(long: DataFrame, settings: Settings, hours: float) -> DataFrame:
    named = long.where("unique_id IS NOT NULL AND ds IS NOT NULL AND y IS NOT NULL AND NOT isnan(y)").select("unique_id", "ds", F.col("y").cast("double").alias("y"))
    kind = named.schema["unique_id"].dataType.simpleString()
    rows, edges = deal(named, "unique_id", [F.desc("ds"), F.desc("y")])
    pids = sorted(edges)
    spread = {a for a, b in zip(pids, pids[1:], strict=False) if edges[b].before}
    made = rows.mapInPandas(_sum_up(settings, edges, spread, hours), f"unique_id {kind}, {_OUT}, pid int, sums binary")
    if not spread:
        return made.drop("pid", "sums")
    made = cut(made)
    parts = made.where("sums IS NOT NULL").select("unique_id", "ds", "pid", "sums").repartition("unique_id").sortWithinPartitions("unique_id", "pid")
    return made.where("sums IS NULL").drop("pid", "sums").unionByName(parts.mapInPandas(_join_up(hours), f"unique_id {kind}, {_OUT}"))


def auto_arima(long: DataFrame, season: int = 0, h: int = 24, hours: float = 1.0, most: int = 5) -> DataFrame:
    """(unique_id, ds, step, p, d, q, sp, sd, sq, forecast) of the ``h`` steps after each series' end.

    ``season`` adds a seasonal difference where the season is strong, and seasonal terms at its lag (added to the others, not
    multiplied by them). Rows without a series, a time or a value are left out; rows of one time go by their value. A
    series too short for the lags repeats its last value, as order 0. An empty table gives no rows.
    """
    return _run(long, Settings(season, h, 0, most), hours).drop("cutoff", "y")


def arima_rolling_origin(long: DataFrame, season: int = 0, windows: int = 25, h: int = 24, hours: float = 1.0, most: int = 5) -> DataFrame:
    """(unique_id, ds, cutoff, step, y, p, d, q, sp, sd, sq, forecast): the last ``windows`` blocks of ``h`` values, each forecast by a model refitted on all values before it.

    Blocks are counted from the end; one that has no value before it is left out.
    """
    return _run(long, Settings(season, h, windows, most), hours)

"""Means of the nearest rows in place of missing values.

Few donors are an array that every task gets (``KnnImputer``); more stay a table (``KnnTable``), whose blocks meet blocks
of the rows that miss something. Both give the same values.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wattloom.schema import FEATURES, TIMESTAMP
from wattloom.shared import cut


def _nearest(rows: np.ndarray, donors: np.ndarray, k: int, cells: int = 1 << 22) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray]]:
    """(rows, column, their donors, distances) of the ``k`` nearest donors, nearest first, for all that is missing in ``rows``.

    The distance is over the coordinates that both rows have, scaled up by the share they have; ties go to the earlier donor.
    """
    filled, missing = np.nan_to_num(donors), np.isnan(rows)
    known = (~np.isnan(donors)).astype(float)
    step = max(1, cells // max(1, len(donors)))
    for gaps in np.unique(missing[missing.any(axis=1)], axis=0):  # rows that miss the same columns
        members = np.flatnonzero((missing == gaps).all(axis=1))
        present = known[:, ~gaps].sum(axis=1)
        for some in (members[i : i + step] for i in range(0, len(members), step)):
            squares = np.zeros((len(some), len(donors)))
            for c in np.flatnonzero(~gaps):
                squares += known[:, c] * (rows[some, c][:, None] - filled[:, c]) ** 2
            with np.errstate(divide="ignore", invalid="ignore"):
                distance = np.sqrt(squares * (rows.shape[1] / present))
            for c in np.flatnonzero(gaps):
                usable = np.flatnonzero((known[:, c] > 0) & (present > 0))
                order = np.argsort(distance[:, usable], axis=1, kind="stable")[:, :k]
                yield some, int(c), usable[order], np.take_along_axis(distance[:, usable], order, axis=1)


@dataclass(frozen=True)
class KnnImputer:
    """Means of the ``k`` nearest donors, and the column means where no donor has a distance."""

    columns: tuple[str, ...]
    donors: np.ndarray
    means: np.ndarray
    k: int

    def fill(self, rows: np.ndarray) -> np.ndarray:
        out = rows.copy()
        for some, c, near, _ in _nearest(rows, self.donors, self.k):
            out[some, c] = self.donors[near, c].mean(axis=1) if near.shape[1] else self.means[c]
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        columns = list(self.columns)

        def run(frames):
            for pdf in frames:
                filled = self.fill(pdf[columns].to_numpy(np.float64, na_value=np.nan))
                yield pdf.assign(**{c: pd.array(filled[:, i], dtype="float64") for i, c in enumerate(columns)})

        return df.mapInPandas(run, df.schema)

    def table(self, spark: SparkSession) -> DataFrame:
        """The donors as (i, row)."""
        frame = pd.DataFrame({"i": range(len(self.donors)), "row": self.donors.tolist()})
        return spark.createDataFrame(frame, "i long, row array<double>")


@dataclass(frozen=True)
class KnnTable:
    """The same with the donors in a table (i, row), i in the order that ties are resolved in.

    Each of the rows that miss something meets all donors, in pairs of blocks of ``block`` rows; a pair sends on at most
    ``k`` donors for each missing value. Rows that miss nothing are not moved but for a join on their number.
    """

    columns: tuple[str, ...]
    donors: DataFrame
    means: np.ndarray
    k: int
    block: int = 1 << 14

    def transform(self, df: DataFrame) -> DataFrame:
        names, k = list(self.columns), self.k
        values = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in names])
        rows = cut(df.withColumn("__row", F.monotonically_increasing_id()))
        needy = rows.select("__row", values.alias("row")).where(F.exists("row", lambda v: F.isnan(v)))
        n_rows, n_donors = (-(-frame.count() // self.block) or 1 for frame in (needy, self.donors))
        every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
        dealt = lambda column, n, name: F.pmod(F.xxhash64(column), F.lit(n)).cast("int").alias(name)
        left = needy.select("__row", "row", dealt("__row", n_rows, "a"), every(n_donors, "b"))
        right = self.donors.select("i", "row", dealt("i", n_donors, "b"), every(n_rows, "a"))

        def meet(asking: pd.DataFrame, giving: pd.DataFrame) -> pd.DataFrame:
            found = []
            if len(asking) and len(giving):
                giving = giving.sort_values("i")
                ids, i = asking["__row"].to_numpy(), giving["i"].to_numpy()
                donors = np.stack(giving["row"].to_list())
                for some, c, near, distance in _nearest(np.stack(asking["row"].to_list()), donors, k):
                    found.append(pd.DataFrame({"__row": np.repeat(ids[some], near.shape[1]), "c": c, "distance": distance.ravel(), "i": i[near].ravel(), "v": donors[near, c].ravel()}))
            return pd.concat(found) if found else pd.DataFrame({"__row": [], "c": [], "distance": [], "i": [], "v": []})

        met = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInPandas(meet, "__row long, c int, distance double, i long, v double")
        rank = F.row_number().over(Window.partitionBy("__row", "c").orderBy("distance", "i"))
        best = met.withColumn("rank", rank).where(F.col("rank") <= k).groupBy("__row", "c").agg(F.avg("v").alias("v"))
        wide = best.groupBy("__row").agg(*[F.max(F.when(F.col("c") == n, F.col("v"))).alias(f"__v{n}") for n in range(len(names))])
        filled = {c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.col(f"__v{n}"), F.lit(float(self.means[n]))) for n, c in enumerate(names)}
        return rows.join(wide, "__row", "left").withColumns(filled).select(*df.columns)

    def table(self, spark: SparkSession) -> DataFrame:
        return self.donors


def fit_knn(train: DataFrame, columns: Sequence[str] = FEATURES, k: int = 3, max_donors: int = 200_000, ts: str = TIMESTAMP) -> KnnImputer | KnnTable:
    """Donors are the training rows, in time order; beyond ``max_donors`` they stay a table."""
    names = list(columns)
    values = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in names])
    known = [F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in names]
    n, *means = train.agg(F.count(F.lit(1)), *[F.avg(c) for c in known]).first()
    means = np.array([m or 0.0 for m in means])
    if n > max_donors:
        # i grows with time: ranges of time are partitions in order, and sorted inside
        ordered = train.select(ts, values.alias("row")).repartitionByRange(ts).sortWithinPartitions(ts)
        return KnnTable(tuple(names), cut(ordered.select(F.monotonically_increasing_id().alias("i"), "row")), means, k)
    found = train.select(ts, *names).orderBy(ts).toPandas()
    return KnnImputer(tuple(names), found[names].to_numpy(np.float64, na_value=np.nan).reshape(len(found), len(names)), means, k)


def stored_knn(table: DataFrame, columns: Sequence[str], means: Sequence[float], k: int, max_donors: int = 200_000) -> KnnImputer | KnnTable:
    """The imputer over donors (i, row) that were written before."""
    if table.count() > max_donors:
        return KnnTable(tuple(columns), table, np.array(means), k)
    rows = [r["row"] for r in table.orderBy("i").collect()]
    return KnnImputer(tuple(columns), np.array(rows, np.float64).reshape(len(rows), len(columns)), np.array(means), k)

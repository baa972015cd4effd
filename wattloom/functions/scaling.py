"""Min-max scaling to [0, 1] and back."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class MinMax:
    """Least and largest value per column; a constant column scales to 0 and back to itself. Nothing is clipped."""

    bounds: Mapping[str, tuple[float, float]]

    def scaled(self, c: str) -> Column:
        lo, hi = self.bounds[c]
        return (F.col(c) - F.lit(lo)) / F.lit((hi - lo) or 1.0)

    def restored(self, value: Column, c: str) -> Column:
        lo, hi = self.bounds[c]
        return value * F.lit((hi - lo) or 1.0) + F.lit(lo)

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: self.scaled(c) for c in self.bounds})

    def inverse(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: self.restored(F.col(c), c) for c in self.bounds})


def fit_min_max(df: DataFrame, columns: Sequence[str]) -> MinMax:
    row = df.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))]).first()
    return MinMax({c: (row[f"lo_{c}"] or 0.0, row[f"hi_{c}"] if row[f"hi_{c}"] is not None else 0.0) for c in columns})

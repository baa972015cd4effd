"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.ranges import Edge, deal  # noqa: F401  the operators take these from here
from wattloom.shared import cut  # noqa: F401

#: White space of the word rules: the space and the control characters from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Stands for a null id inside a job; it is turned back into null in results.
NO_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column | str) -> Column:
    """Words of a text as a long; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def slices(batch, text_column: int, limit: int = 4 << 20):
    """Row ranges (start, stop) of an Arrow batch that hold about ``limit`` bytes of text; a longer text stands alone."""

    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text_column)), 0))
    ends, start, total = [], 0, 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > limit:
            ends.append((start, i))
            start, total = i, 0
        total += n
    if start < len(sizes):
        ends.append((start, len(sizes)))
    return ends

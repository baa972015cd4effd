"""Tables dealt in ranges of a key and an order, so that one key may span any number of partitions."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattloom.shared import cut


class Edge(NamedTuple):
    """What a range partition has to know of the others: rows of its first key before it, and all rows of its first and its last key."""

    before: int
    first_total: int
    last_total: int


def deal(df: DataFrame, key: str, order: list[str | Column]) -> tuple[DataFrame, dict[int, Edge]]:
    """``df`` in ranges of (key, order), sorted and written out, with the column ``pid``; and an Edge for each pid that has rows.

    A key may hold any share of the rows: it is spread over as many partitions as it needs, even if all its rows are
    equal. Nulls come first. Only the edges reach the driver, one row for each partition.
    """
    at = "_deal_at"
    dealt = df.withColumn(at, F.monotonically_increasing_id()).repartitionByRange(F.asc(key), *order, at).sortWithinPartitions(F.asc(key), *order, at)
    dealt = cut(dealt.drop(at).withColumn("pid", F.spark_partition_id()))
    per = dealt.groupBy("pid", key).agg(F.count(F.lit(1)).alias("n"))
    pair = F.struct(F.col(key), F.col("n"))
    ends = per.groupBy("pid").agg(F.min(pair).alias("first"), F.max(pair).alias("last")).collect()
    ends = sorted(((r["pid"], tuple(r["first"]), tuple(r["last"])) for r in ends), key=lambda r: r[0])
    totals: list[list] = []  # [key, rows] of each run of partitions that share an edge key
    before: dict[int, int] = {}
    first_run: dict[int, int] = {}
    last_run: dict[int, int] = {}
    for pid, (k, n), (last, m) in ends:
        if totals and totals[-1][0] == k:
            before[pid] = totals[-1][1]
            totals[-1][1] += n
        else:
            before[pid] = 0
            totals.append([k, n])
        first_run[pid] = len(totals) - 1
        if last != k:
            totals.append([last, m])
        last_run[pid] = len(totals) - 1
    return dealt, {pid: Edge(before[pid], totals[first_run[pid]][1], totals[last_run[pid]][1]) for pid in before}

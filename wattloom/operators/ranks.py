"""Running sums over a whole ordered table without bringing it to one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattloom.shared import cut


def running_sums(df: DataFrame, order: Sequence[str], sums: Sequence[str], by: str | None = None) -> DataFrame:
    """Adds ``upto_<c>`` for each c of ``sums``: its sum over all rows up to this one by ``order`` (of the same ``by``, if given; ``by`` then comes first in the order).

    The rows are dealt by ranges of the order and summed inside each range; one row of totals per range (and ``by``)
    gives what the ranges before it add. Rows alike in ``order`` lie in one range; their order among themselves is open.
    """
    keys = ([by] if by else []) + list(order)
    ranged = cut(df.repartitionByRange(*keys).withColumn("__range", F.spark_partition_id()))
    group = ["__range", *([by] if by else [])]
    inside = Window.partitionBy(*group).orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*([by] if by else [])).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(*group).agg(*[F.sum(c).alias(c) for c in sums])
    totals = totals.select(*group, *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__before_{c}") for c in sums])
    added = ranged.join(F.broadcast(totals), group) if by is None else ranged.join(totals, group)
    done = added.withColumns({f"upto_{c}": F.sum(c).over(inside) + F.col(f"__before_{c}") for c in sums})
    return done.drop("__range", *[f"__before_{c}" for c in sums])

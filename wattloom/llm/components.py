"""Connected components of a link table, by alternating star contraction.

Each round is one large-star and one small-star step (Kiveris et al., "Connected Components in MapReduce and
Beyond", 2014): groupings with map-side combine and equi-joins only, so a node that a third of all links touch is
combined before its shuffle and its join can be split at run time. The number of rounds grows with the logarithm of
the component size, and links are cut from their lineage by a checkpoint each round.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut

#: The smaller side of a star join is keyed by a mixed id: it then gets an exchange of its own, and Spark may split
#: the partition of a hot node.
_MIX = 0x5BD1E995


def _join_min(links: DataFrame, least: DataFrame) -> DataFrame:
    left = links.withColumn("k", F.col("u").bitwiseXOR(F.lit(_MIX)))
    right = least.select(F.col("u").bitwiseXOR(F.lit(_MIX)).alias("k"), "m")
    return left.join(right, "k").drop("k")


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return _join_min(both.where("v > u"), least).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    # links come as (larger, smaller) from the large star
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = _join_min(links, least).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def spanning_forest(links: DataFrame, per_task: int = 1 << 18) -> DataFrame:
    """Links (a, b) that join the same nodes as ``links``: each task keeps a spanning forest of its own links.

    A task holds about ``per_task`` links, in a table of their nodes; the idea is the filtering of Lattanzi et al. ("Filtering:
    a method for solving graph problems in MapReduce", 2011). Nothing is shuffled. Pass links that are checkpointed, as they are counted first.
    """

    def run(batches):
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := up.setdefault(x, x)) != x:
                up[x] = x = up[y]
            return x

        for batch in batches:
            kept = []
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if a is not None and b is not None and (x := root(a)) != (y := root(b)):
                    up[max(x, y)] = min(x, y)
                    kept.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([k[c] for k in kept], pa.int64()) for c in range(2)], names=["a", "b"])

    return links.select("a", "b").coalesce(links.count() // per_task + 1).mapInArrow(run, "a long, b long")


def connected_components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node in ``links``; component is the smallest node reachable, itself included.

    Links are undirected; repeated links, self-links and links with a null end are allowed (the last two say
    nothing). No links give no rows.
    """
    u, v = F.greatest(F.col(a), F.col(b)), F.least(F.col(a), F.col(b))
    now = cut(links.where(F.col(a) != F.col(b)).select(u.alias("u"), v.alias("v")).distinct())
    digest = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    seen = digest(now)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        now = cut(_small_star(_large_star(now)).distinct())
        if (got := digest(now)) == seen:
            break
        seen = got
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)

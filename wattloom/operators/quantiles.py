"""Exact quantiles of groups of any size, by selection.

Each wanted pair of neighbouring ranks keeps a bracket, two values of its group that enclose it. A round takes three pivots for every
bracket from a sketch of fixed size, counts the rows in the seven classes that they cut the bracket into (below, at and
between pivots), and goes on with the class that holds the ranks. The counts are exact, so a poor sketch costs a round, never the result.
A bracket that one task can hold is sorted there. Counts and sketches combine before the shuffle; no group is brought together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattloom.shared import cut

#: Grid of the sketch: a round leaves about two of these parts of a bracket.
PARTS = 512
#: Wanted brackets up to this number are sent to every task: 100 bytes each, and the keys.
BROADCAST_ROWS = 50_000


def places(n: Column, p: float, method: str) -> Column:
    """Where quantile ``p`` of ``n`` values lies among their ranks from 0: "linear" at (n - 1) p, "hazen" at n p - 1/2 within 0 and n - 1."""
    if method == "linear":
        return (n - 1) * F.lit(float(p))
    if method == "hazen":
        return F.greatest(F.lit(0.0), F.least((n - 1).cast("double"), n * F.lit(float(p)) - 0.5))
    raise ValueError("method is 'linear' or 'hazen'")


def same_keys(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on keys that may be null; columns of ``b`` with the names of keys go."""
    named = b.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *[c for c in b.columns if c not in keys])
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return a.join(named, on).drop(*[f"__k{i}" for i in range(len(keys))])


def _round(rows: DataFrame, wants: DataFrame, keys: list[str]) -> DataFrame:
    """``wants`` with narrower brackets; ``lower`` and ``upper`` are set for those that are found. ``rows`` are (keys, __p, __v, __a, __b) inside brackets."""
    grid = F.percentile_approx("__v", F.lit([i / PARTS for i in range(PARTS + 1)]), F.lit(4 * PARTS))
    sketch = rows.groupBy(*keys, "__p").agg(grid.alias("__g"))
    at = F.floor((F.col("__low") - F.col("__below")) / F.col("__m") * PARTS).cast("int")
    pivot = lambda shift: F.element_at("__g", F.greatest(F.lit(1), F.least(F.lit(PARTS + 1), at + 1 + shift)))
    pivots = same_keys(wants, sketch, [*keys, "__p"]).select(*keys, "__p", *[pivot(s).alias(f"__s{i}") for i, s in enumerate((-1, 0, 2))])
    small = pivots.count() <= BROADCAST_ROWS
    met = same_keys(rows, F.broadcast(pivots) if small else pivots, [*keys, "__p"])
    place = sum([(F.col("__v") > F.col(s)).cast("int") + (F.col("__v") >= F.col(s)).cast("int") for s in ("__s0", "__s1", "__s2")], F.lit(0))
    classes = met.groupBy(*keys, "__p", place.alias("__c")).agg(F.count(F.lit(1)).alias("__k"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    joined = same_keys(classes, wants.select(*keys, "__p", "__low", "__high", "__below"), [*keys, "__p"])
    upto = F.col("__below") + F.sum("__k").over(Window.partitionBy(*keys, "__p").orderBy("__c"))
    joined = joined.withColumn("__upto", upto).withColumn("__from", F.col("__upto") - F.col("__k"))
    holds = lambda rank: (F.col("__from") < F.col(rank)) & (F.col(rank) <= F.col("__upto"))
    of = lambda rank, value: F.max(F.when(holds(rank), F.col(value)))
    # neighbouring ranks in two classes are the last of the one and the first of the other
    found = joined.groupBy(*keys, "__p", "__low", "__high").agg(
        of("__low", "__c").alias("__c0"), of("__high", "__c").alias("__c1"), of("__low", "__lo").alias("__a"), of("__low", "__hi").alias("__b"),
        of("__low", "__from").alias("__below"), of("__low", "__k").alias("__m"), of("__high", "__lo").alias("__next"),
    )
    apart, single = F.col("__c0") != F.col("__c1"), F.col("__a") == F.col("__b")
    return found.select(
        *keys, "__p", "__low", "__high", "__a", "__b", "__below", "__m",
        F.when(apart | single, F.col("__b")).alias("__lower"), F.when(apart, F.col("__next")).when(single, F.col("__b")).alias("__upper"),
    )


def exact_quantiles(df: DataFrame, value: str, by: Sequence[str], quantiles: dict[str, float], method: str = "linear", task_rows: int = 1 << 20) -> DataFrame:
    """(by, n, one column per name of ``quantiles``): exact quantiles of the known values of each group.

    Nulls and NaNs are left out; a group without values gives no row, an empty table none. Null keys are a group.
    Groups of up to ``task_rows`` values take Spark's percentile (for "linear"), which holds a group; with a larger one among them, or for
    "hazen", all are selected, with the same values.
    """
    return selected(known(df, value, by), list(by), quantiles, method, task_rows)


def known(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """(by, __v) of the rows with a value, written out once for the passes over it."""
    v = F.col(value).cast("double")
    return cut(df.select(*by, v.alias("__v")).where(F.col("__v").isNotNull() & ~F.isnan("__v")))


def selected(rows: DataFrame, keys: list[str], quantiles: dict[str, float], method: str = "linear", task_rows: int = 1 << 20) -> DataFrame:
    """``exact_quantiles`` of rows from ``known``."""
    if not keys:
        return selected(rows.withColumn("__all", F.lit(0)), ["__all"], quantiles, method, task_rows).drop("__all")
    groups = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("__v").alias("__a"), F.max("__v").alias("__b")).where("n > 0")
    largest = groups.agg(F.max("n")).first()[0] or 0
    if method == "linear" and largest <= task_rows:
        return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.percentile("__v", F.lit(float(p))).alias(c) for c, p in quantiles.items()]).where("n > 0")
    wanted = F.array(*[F.struct(F.lit(c).alias("__p"), places(F.col("n"), p, method).alias("__at")) for c, p in quantiles.items()])
    wants = groups.select(*keys, "__a", "__b", "n", F.explode(wanted).alias("__w")).select(*keys, "__a", "__b", "n", "__w.*")
    wants = wants.withColumns({"__low": F.floor("__at") + 1, "__high": F.ceil("__at") + 1, "__below": F.lit(0).cast("long"), "__m": F.col("n")})
    shares = cut(wants.select(*keys, "n", "__p", (F.col("__at") - F.floor("__at")).alias("__share")))
    single = F.when(F.col("__a") == F.col("__b"), F.col("__a"))
    wants = cut(wants.select(*keys, "__p", "__low", "__high", "__a", "__b", "__below", "__m", single.alias("__lower"), single.alias("__upper")))
    done, source = [], rows
    while True:
        done.append(wants.where("__lower is not null").select(*keys, "__p", "__lower", "__upper"))
        wants = wants.where("__lower is null")
        left, most = wants.agg(F.count(F.lit(1)), F.max("__m")).first()
        if not left:
            break
        bounds = wants.select(*keys, "__p", F.col("__a").alias("__x"), F.col("__b").alias("__y"))
        met = same_keys(source, F.broadcast(bounds) if left <= BROADCAST_ROWS else bounds, keys if source is rows else [*keys, "__p"])
        inside = met.where(F.col("__v").between(F.col("__x"), F.col("__y"))).select(*keys, "__p", "__v")
        if source is not rows:
            inside = cut(inside)
        if most <= task_rows:
            ranked = inside.withColumn("__i", F.row_number().over(Window.partitionBy(*keys, "__p").orderBy("__v")))
            ends = same_keys(ranked, wants.select(*keys, "__p", "__low", "__high", "__below"), [*keys, "__p"])
            of = lambda rank: F.max(F.when(F.col("__i") + F.col("__below") == F.col(rank), F.col("__v")))
            done.append(ends.groupBy(*keys, "__p").agg(of("__low").alias("__lower"), of("__high").alias("__upper")))
            break
        wants = cut(_round(inside, wants, keys))
        source = inside
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    values = same_keys(shares, found, [*keys, "__p"])
    between = F.col("__lower") + (F.col("__upper") - F.col("__lower")) * F.col("__share")
    values = values.withColumn("__q", F.when(F.col("__lower") == F.col("__upper"), F.col("__lower")).otherwise(between))
    return values.groupBy(*keys, "n").agg(*[F.max(F.when(F.col("__p") == c, F.col("__q"))).alias(c) for c in quantiles])

"""Mixing sources to target weights by Sainte-Laguë apportionment.

Blocks of equal word counts are given to sources, and then to the shards of each source, by the highest quotients
weight / (2 k + 1). A shard orders its documents by a seeded hash, cuts that stream into blocks, takes whole passes
while its quota reaches, and spreads the rest of its quota evenly over its blocks from a seeded start. Every document
then reads what is taken of it from the stream's running word count in closed form.

Everything is a DataFrame expression. The word counts are made once and cut from their lineage; what is shuffled after
that is a row of a few numbers per document. Sources are rows, ranked by running sums over ranges, so any number of
them works. A source has at most ``max_shards`` shards, so the array that holds its shards is bounded, and the hot
source's documents are spread over its shards.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattloom.operators.ranks import running_sums

from ._common import cut, n_words

#: Shares of a copy are counted in whole parts of this size.
_COPY = 1 << 20


def source_targets(sizes: DataFrame, weights: Sequence[float] = (3.0, 1.0, 2.0), share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """Adds weight and target to ``sizes`` (skey, source, source_size): one row per source.

    Sources in code-point order (null last) get ``weights`` in turn and share ``share`` times all sizes; no target is
    above ``limit`` times its source's size, and what is cut off is shared again by weight. Sorted by size per
    weight, the sources that are cut come first, so one pass of running sums finds the level of the others.
    """
    columns = sizes.columns
    named = running_sums(sizes.withColumn("last", F.col("source").isNull()).withColumn("one", F.lit(1).cast("long")), ["last", "source"], ["one"])
    weighed = named.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("upto_one") - 1) % len(weights) + 1).cast("int"))).drop("one", "upto_one")
    full = weighed.withColumn("cap", F.col("source_size") * F.lit(float(limit))).withColumn("ratio", F.col("cap") / F.col("weight"))
    rising = cut(running_sums(full, ["ratio", "last", "source"], ["cap", "weight"]))
    total, weight = rising.agg(F.sum("source_size"), F.sum("weight")).first()
    if not total:
        return rising.withColumn("target", F.lit(0.0)).select(*columns, "weight", "target")
    level = (F.lit(total * float(share)) - F.col("upto_cap") + F.col("cap")) / (F.lit(weight) - F.col("upto_weight") + F.col("weight"))
    found = rising.withColumn("level", level).where("level <= ratio").agg(F.min(F.struct("ratio", "last", "source", "level"))["level"]).first()[0]
    target = F.col("cap") if found is None else F.least("cap", F.lit(found) * F.col("weight"))
    return rising.withColumn("target", target).select(*columns, "weight", "target")


def _bracket(weight: Column, cap: Column, seats: Column, total: Column, half: Column) -> tuple[Column, Column]:
    """(sure, most): seats of a party that a divisor above and one below the right one give, one more on either side for rounding."""
    low = F.when(seats > half, F.floor(weight * (seats - half) / total + 0.5) - 1).otherwise(F.lit(0))
    high = F.floor(weight * (seats + half) / total + 0.5) + 1
    sure = F.least(F.greatest(low, F.lit(0)), cap).cast("long")
    most = F.when(weight > 0, F.least(F.greatest(high, F.lit(0)), cap)).otherwise(F.lit(0)).cast("long")
    return sure, F.greatest(sure, most)


def source_quotas(parties: DataFrame, seats: int) -> DataFrame:
    """Adds quota to ``parties`` (key, weight double, cap long, ...): ``seats`` given by highest quotients, ties to the smaller key.

    All seats above a divisor are given at once; the quotients between two divisors, a few for each party, are rows and
    are ranked by running counts over ranges of them.
    """
    total, positive = parties.agg(F.sum("weight"), F.count_if(F.col("weight") > 0)).first()
    sure, most = _bracket(F.col("weight"), F.col("cap"), F.lit(seats), F.lit(max(total or 0.0, 1e-300)), F.lit(positive / 2))
    known = cut(parties.withColumn("sure", sure).withColumn("most", most))
    rest = seats - (known.agg(F.sum("sure")).first()[0] or 0)
    tries = known.where("most > sure").select("key", F.col("weight").alias("w"), F.explode(F.sequence(F.col("sure"), F.col("most") - 1)).alias("n"))
    ranked = running_sums(tries.select("key", (-F.col("w") / (2 * F.col("n") + 1)).alias("q"), F.lit(1).cast("long").alias("one")), ["q", "key"], ["one"])
    won = ranked.where(F.col("upto_one") <= max(rest, 0)).groupBy("key").agg(F.count(F.lit(1)).alias("won"))
    return known.join(won, "key", "left").withColumn("quota", F.col("sure") + F.coalesce("won", F.lit(0))).drop("sure", "most", "won")


def _bound(value: Column, use) -> Column:
    """``use`` of ``value``, which is made once: inside a lambda function a name stands for a value, not for its expression."""
    return F.transform(F.array(value), use)[0]


def sainte_lague(parties: Column, seats: Column) -> Column:
    """array<struct<id, quota>>: ``seats`` given to ``parties`` (array<struct<id, weight double, cap long>>) by highest quotients.

    Two divisors bracket the right one: all seats above the first are given at once, and only those between the two
    (a few for each party) are sorted and compared with the last one that wins. Ties go to the smaller id. A party gets ``cap`` seats at most.
    """

    quotient = lambda p, n: -p["weight"] / (2 * n + 1)
    open_seats = lambda p: F.when(p["most"] > p["sure"], F.sequence(p["sure"], p["most"] - 1)).otherwise(F.array().cast("array<bigint>"))

    def bracket(s):
        def between(p):
            sure, most = _bracket(p["weight"], p["cap"], s["seats"], s["total"], s["half"])
            return F.struct(p["id"].alias("id"), p["weight"].alias("weight"), sure.alias("sure"), most.alias("most"))

        return _bound(F.struct(F.transform(s["p"], between).alias("known"), s["seats"].alias("seats")), contest)

    def contest(k):
        tries = F.flatten(F.transform(k["known"], lambda p: F.transform(open_seats(p), lambda n: F.struct(quotient(p, n).alias("q"), p["id"].alias("id")))))
        rest = F.greatest(k["seats"] - F.aggregate(k["known"], F.lit(0).cast("long"), lambda a, p: a + p["sure"]), F.lit(0)).cast("int")
        last = F.when(rest > 0, F.element_at(F.slice(F.array_sort(tries), F.lit(1), F.greatest(rest, F.lit(1))), -1))  # the last seat that is won
        return _bound(F.struct(k["known"].alias("known"), last.alias("last")), award)

    def award(w):
        wins = lambda p: F.filter(open_seats(p), lambda n: (quotient(p, n) < w["last"]["q"]) | ((quotient(p, n) == w["last"]["q"]) & (p["id"] <= w["last"]["id"])))
        return F.transform(w["known"], lambda p: F.struct(p["id"].alias("id"), (p["sure"] + F.when(w["last"].isNotNull(), F.size(wins(p))).otherwise(0)).alias("quota")))

    total = F.greatest(F.aggregate(parties, F.lit(0.0), lambda a, p: a + p["weight"]), F.lit(1e-300))
    half = F.size(F.filter(parties, lambda p: p["weight"] > 0)) / F.lit(2.0)
    return _bound(F.struct(parties.alias("p"), total.alias("total"), half.alias("half"), seats.alias("seats")), bracket)


def mix_sources(
    docs: DataFrame, weights: Sequence[float] = (3.0, 1.0, 2.0), share: float = 1.5, limit: float = 2.0,
    block_words: int = 32, docs_per_shard: int = 64, max_shards: int = 4096, seed: int = 17, row: str | None = None,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken, copies.

    size is the number of words (a null text has none), source_size and target those of the row's source (a null
    source is a source of its own, the last), and taken the words that the mix takes of the row, repeats counted: at
    most ``limit`` (a whole number) times its size. A source without words takes none. Other columns are not read;
    repeated rows are rows of their own; an empty table gives no rows. The same rows give the same result.

    copies says how often the whole row is to be taken, ``limit`` at most: taken / size is added up along streams of a
    source's rows by size, and a row has as many copies as whole numbers the sum passes at it, from a seeded start. Each
    row has taken / size copies on average, and as neighbours are of like size, the words of a stream's copies miss its
    taken words by some one row, however alike the ratios are. ``row`` names a column to carry into the result, such as
    a key of rows whose ids repeat.
    """
    skey = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    sized = cut(docs.select("doc_id", F.col("source").cast("string").alias("source"), skey.alias("skey"), n_words("text").alias("size"), *([row] if row else [])))
    sized = _numbered_repeats(sized, docs_per_shard)
    stats = sized.groupBy("skey").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    targets = source_targets(stats, weights, share, limit)

    blocks = lambda size: F.ceil(size / F.lit(block_words)).cast("long")
    parties = cut(targets.withColumnRenamed("weight", "share").withColumn("key", F.col("skey")).withColumn("weight", F.col("target").cast("double")).withColumn("cap", blocks(F.col("source_size")) * F.lit(int(limit))))
    quotas = source_quotas(parties, int(parties.agg(F.floor(F.coalesce(F.sum("target"), F.lit(0.0)) / block_words + 0.5)).first()[0]))
    shards = F.least(F.ceil(F.col("n_docs") / docs_per_shard), F.lit(max_shards)).cast("long")
    streams = F.least(F.ceil(F.col("n_docs") / (64 * docs_per_shard)), F.lit(max_shards)).cast("long")  # long ones, as each may miss by a row
    sources = cut(quotas.select("skey", "source_size", "target", "quota", F.greatest(shards, F.lit(1)).alias("n_shards"), F.greatest(streams, F.lit(1)).alias("n_streams")))

    # One short row per source: broadcast if there are few, else Spark splits the hot source's partition of the join.
    dealt = sized.join(F.broadcast(sources) if sources.count() <= 10_000 else sources, "skey").withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size", "no"), F.col("n_shards")))
    by_shard = dealt.groupBy("skey", "shard").agg(F.sum("size").alias("shard_size"), F.first("quota").alias("quota"))
    per_source = by_shard.groupBy("skey").agg(
        F.array_sort(F.collect_list(F.struct(F.col("shard").alias("id"), F.col("shard_size").cast("double").alias("weight"), (blocks(F.col("shard_size")) * int(limit)).alias("cap"), F.col("shard_size").alias("size")))).alias("p"),
        F.first("quota").alias("seats"),
    )
    plain = F.transform("p", lambda x: F.struct(x["id"].alias("id"), x["weight"].alias("weight"), x["cap"].alias("cap")))
    shard_quotas = per_source.select("skey", F.explode(F.arrays_zip(F.transform("p", lambda x: x["size"]).alias("size"), sainte_lague(plain, F.col("seats")).alias("q"))).alias("x")).select(
        "skey", F.col("x.q.id").alias("shard"), F.col("x.q.quota").alias("quota"), F.col("x.size").alias("shard_size")
    )
    stream = Window.partitionBy("skey", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.drop("quota").withColumn("stop", F.sum("size").over(stream)).join(shard_quotas, ["skey", "shard"])

    n, start = blocks(F.col("shard_size")), F.pmod(F.xxhash64(F.lit(seed + 2), "skey", "shard"), F.greatest(F.col("n"), F.lit(1)))
    placed = placed.withColumn("n", n).withColumn("u", start).withColumn("r", F.when(F.col("n") > 0, F.col("quota") % F.col("n")).otherwise(0))
    chosen = lambda b: F.expr(f"({b} * r + u) div n")  # noqa: E731  chosen blocks before block b

    def upto(p: str) -> Column:
        b = f"(({p}) div {block_words})"
        return chosen(b) * block_words + (F.expr(p) % block_words) * (chosen(f"({b} + 1)") - chosen(b))

    taken = F.when(F.col("n") > 0, F.expr("quota div n") * F.col("size") + upto("stop") - upto("(stop - size)")).otherwise(0)
    # Shares of a copy are whole numbers, so their sums don't depend on the order of ties.
    given = placed.withColumn("taken", taken.cast("long")).withColumn("part", F.when(F.col("size") > 0, F.expr(f"taken * {_COPY} div size")).otherwise(F.lit(0)).cast("long"))
    given = given.withColumn("stream", F.pmod(F.xxhash64(F.lit(seed + 3), "doc_id", "size", "no"), F.col("n_streams"))).withColumn("begin", F.pmod(F.xxhash64(F.lit(seed + 4), "skey", "stream"), F.lit(_COPY)))
    by_size = Window.partitionBy("skey", "stream").orderBy("size", F.xxhash64(F.lit(seed + 5), "doc_id"), "doc_id", "part").rowsBetween(Window.unboundedPreceding, 0)
    passed = given.withColumn("upto", F.sum("part").over(by_size) + F.col("begin"))
    return passed.select("doc_id", "size", "source_size", "target", "taken", F.expr(f"cast(upto div {_COPY} - (upto - part) div {_COPY} as int)").alias("copies"), *([row] if row else []))


def _numbered_repeats(sized: DataFrame, few: int) -> DataFrame:
    """``sized`` with ``no``, null but for rows that repeat source, doc_id and size more than ``few`` times: they are numbered, in blocks of ``few``.

    A hot group of such rows, say all rows without an id, is so dealt over shards and streams like rows with ids. Rows of a
    group are alike, so it is all the same which gets which number. The numbers are running counts over range partitions.
    """
    same = [F.col("skey"), F.col("doc_id"), F.col("size")]
    often = cut(sized.groupBy(*same).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > few).select("skey", "doc_id", "size"))
    if often.isEmpty():
        return sized.withColumn("no", F.lit(None).cast("long"))
    equal = lambda a, b: reduce(lambda x, y: x & y, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in ("skey", "doc_id", "size")])
    others = sized.alias("s").join(often.alias("o"), equal("s", "o"), "left_anti").withColumn("no", F.lit(None).cast("long"))
    hot = sized.alias("s").join(often.alias("o"), equal("s", "o"), "left_semi").withColumn("at", F.monotonically_increasing_id())
    dealt = cut(hot.repartitionByRange(*same, "at").withColumn("pid", F.spark_partition_id()).drop("at"))
    inside = Window.partitionBy("pid", *same).orderBy(F.lit(0))
    per = dealt.groupBy("pid", *same).agg(F.count(F.lit(1)).alias("n"))
    before = per.withColumn("before", F.sum("n").over(Window.partitionBy(*same).orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)))
    joined = dealt.withColumn("rn", F.row_number().over(inside) - 1).alias("s").join(before.alias("b"), equal("s", "b") & (F.col("s.pid") == F.col("b.pid")))
    number = F.floor((F.coalesce(F.col("b.before"), F.lit(0)) + F.col("s.rn")) / F.lit(few)).cast("long")
    return cut(others.unionByName(joined.select(*[f"s.{c}" for c in sized.columns], number.alias("no"))))


def apply_mix(docs: DataFrame, mixed: DataFrame, row: str = "doc_id") -> DataFrame:
    """``docs`` as the mix takes them: each row as often as its copies say, 0 drops it.

    ``row`` is the column of both by which rows are told; those with the same value get the most copies of any of
    them. If ``mixed`` has no column copies, each row is rounded by itself (half goes up).
    """
    key, times, n = (f"{name}_{uuid.uuid4().hex}" for name in ("key", "times", "n"))  # no column of docs has these names
    copies = F.col("copies") if "copies" in mixed.columns else F.floor(F.col("taken") / F.col("size") + 0.5)
    taken = mixed.where("size > 0").groupBy(F.col(row).alias(key)).agg(F.max(copies).cast("int").alias(times)).where(F.col(times) > 0)
    joined = docs.join(taken, docs[row].eqNullSafe(F.col(key)))
    return joined.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*[docs[c] for c in docs.columns])

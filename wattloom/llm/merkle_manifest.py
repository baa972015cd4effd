"""Merkle manifest of a dataset, built by an event-driven combineByKey.

A tree has the rows of one key (a language) as leaves, in the order of their ids; eight neighbours have one parent, and
the last parent of a level fewer. How many children a parent has follows from the number of leaves alone, so a parent
knows when it is complete: a partial parent holds its children's digests by their place, and the event that brings the
last one makes it emit its own digest, which is an event for its own parent, and so on up.

The leaves are dealt in ranges, so nearly all parents are complete within one task; the children of the others, the
frontier, are reshuffled by combineByKey to the block that they belong to, a subtree of 512 leaves. Blocks are the leaves of
the next round, 512 times fewer. Proofs go the other way, from the root down: a block's rows meet the proof of their
block, rebuild its parents and follow the reverse links from each row to the block's top. No task holds more than a block
of a tree at a time, whatever share of the rows one key has, and texts are hashed where they are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import Edge, cut, deal

ARITY = 8
#: Levels of a block and the leaves it has at most.
_LEVELS = 3
_BLOCK = ARITY**_LEVELS
#: Stands for the nodes of a level as long as they aren't counted: only parents of eight are complete then.
_MANY = [1 << 60] * (_LEVELS + 1)
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(children: list[str]) -> str:
    return hashlib.sha256("".join(children).encode()).hexdigest()


def leaf_digest(values: list[Column]) -> Column:
    """SHA-256 of the values one after another, each ``-`` if null, else the number of its bytes in UTF-8, ``:`` and the bytes."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def level_sizes(n: int) -> list[int]:
    """Nodes of a block's leaf level in the whole tree, and of the levels above it."""
    out = [n]
    for _ in range(_LEVELS):
        out.append(-(-out[-1] // ARITY))
    return out


class Parents:
    """The partial parents of one block. An event that completes a parent makes it emit an event to its own parent."""

    def __init__(self, sizes: list[int]):
        self.sizes = sizes
        self.pending: dict[tuple[int, int], dict[int, str]] = {}
        self.links: dict[tuple[int, int], list[str]] = {}  # the children of each complete parent
        self.top: str | None = None

    def add(self, level: int, index: int, value: str) -> Parents:
        while level < _LEVELS and self.sizes[level] > 1:
            up, place = divmod(index, ARITY)
            children = self.pending.setdefault((level + 1, up), {})
            children[place] = value
            if len(children) < min(ARITY, self.sizes[level] - ARITY * up):
                return self
            self.links[level + 1, up] = own = [children[i] for i in range(len(children))]
            del self.pending[level + 1, up]
            level, index, value = level + 1, up, digest(own)
        self.top = value
        return self

    def frontier(self) -> Iterator[tuple[int, int, str]]:
        """(level, index, digest) of the children whose parent isn't complete."""
        for (level, up), children in self.pending.items():
            for place, value in children.items():
                yield level - 1, ARITY * up + place, value

    def merge(self, other: Parents) -> Parents:
        self.top = self.top or other.top
        for event in other.frontier():
            self.add(*event)
        return self


def _indexed(edges: dict[int, Edge]) -> Callable:
    """Batches of a partition (its columns key and pid) with the index of each row among its key's."""

    def go(batches):
        key, seen, fresh = None, 0, True
        for batch in batches:
            keys = batch.column("key").to_pylist()
            index = np.empty(len(keys), np.int64)
            for i, k in enumerate(keys):
                if fresh:
                    key, seen, fresh = k, edges[batch.column("pid")[0].as_py()].before, False
                elif k != key:
                    key, seen = k, 0
                index[i] = seen
                seen += 1
            yield batch, keys, index

    return go


def _combine(edges: dict[int, Edge]) -> Callable:
    """The map side: (key, level, index, digest) of whole blocks (the last level) and of the frontier."""

    def run(batches):
        now, parents = None, Parents(_MANY)
        for batch, keys, index in _indexed(edges)(batches):
            out = []
            for key, i, value in zip(keys, index.tolist(), batch.column("value").to_pylist(), strict=True):
                if (key, i // _BLOCK) != now:
                    out += _left(now, parents)
                    now, parents = (key, i // _BLOCK), Parents(_MANY)
                parents.add(0, i, value)
            yield _rows(out)
        yield _rows(_left(now, parents))

    return run


def _left(now: tuple | None, parents: Parents) -> list[tuple]:
    if now is None:
        return []
    return [(now[0], _LEVELS, now[1], parents.top)] if parents.top else [(now[0], *event) for event in parents.frontier()]


def _rows(out: list[tuple]) -> pa.RecordBatch:
    types = {"key": pa.string(), "level": pa.int32(), "index": pa.int64(), "digest": pa.string()}
    cols = zip(*out, strict=True) if out else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types.values(), strict=True)], names=list(types))


def _resolve(events: DataFrame) -> DataFrame:
    """(key, index, digest) of the blocks whose frontier ``events`` (key, size, level, index, digest) holds."""
    pairs = events.select("key", "size", "level", "index", "digest").rdd.map(lambda r: ((r[0], r[3] // ARITY ** (_LEVELS - r[2])), r[1:]))
    blocks = pairs.combineByKey(lambda e: Parents(level_sizes(e[0])).add(*e[1:]), lambda parents, e: parents.add(*e[1:]), lambda a, b: a.merge(b))
    return events.sparkSession.createDataFrame(blocks.map(lambda kv: (*kv[0], kv[1].top)), "key string, index long, digest string", verifySchema=False)


class Tree(NamedTuple):
    """A tree for each key: its rows (key, value and others) in order, leaves per key, and the nodes of each round."""

    rows: DataFrame
    edges: dict[int, Edge]
    sizes: DataFrame
    rounds: list[DataFrame]

    @property
    def tops(self) -> DataFrame:
        """(key, digest) of each tree."""
        return self.rounds[-1].select("key", "digest")


def build(rows: DataFrame, order: list[str]) -> Tree:
    """The trees over ``rows``: key (a string that is not null), value (the leaf's digest) and what else they carry."""
    dealt, edges = deal(rows, "key", order)
    sizes = cut(dealt.groupBy("key").agg(F.count(F.lit(1)).alias("size")))
    most = sizes.agg(F.max("size")).first()[0] or 0
    combined = cut(dealt.select("key", "value", "pid").mapInArrow(_combine(edges), "key string, level int, index long, digest string"))
    events = combined.where(F.col("level") < _LEVELS).join(sizes, "key")
    rounds = [cut(combined.where(F.col("level") == _LEVELS).select("key", "index", "digest").unionByName(_resolve(events)))]
    width = _BLOCK
    while width < most:
        size = F.ceil(F.col("size") / F.lit(width)).cast("long")
        rounds.append(cut(_resolve(rounds[-1].join(sizes.withColumn("size", size), "key").withColumn("level", F.lit(0)))))
        width *= _BLOCK
    return Tree(dealt, edges, sizes, rounds)


_PROOF = pa.list_(pa.struct([("place", pa.int32()), ("others", pa.string())]))


def _descend(left: pa.Table, right: pa.Table) -> pa.Table:
    """Rows of one block (``index``, ``value``) with their proofs, the reverse links up to the block's top before the proof of the block."""
    index = left.column("index").to_pylist()
    parents = Parents(level_sizes(right.column("size")[0].as_py()))
    for i, value in zip(index, left.column("value").to_pylist(), strict=True):
        parents.add(0, i, value)
    above = right.column("proof")[0].as_py()
    known: dict[tuple[int, int, int], str] = {}
    places, others, ends = [], [], [0]
    for i in index:
        level = 0
        while level < _LEVELS and parents.sizes[level] > 1:
            up, place = divmod(i, ARITY)
            level += 1
            link = (level, up, place)
            if link not in known:
                children = parents.links[level, up]
                known[link] = "".join(children[:place] + children[place + 1 :])
            places.append(place)
            others.append(known[link])
            i = up
        places += [p["place"] for p in above]
        others += [p["others"] for p in above]
        ends.append(len(places))
    steps = pa.StructArray.from_arrays([pa.array(places, pa.int32()), pa.array(others, pa.string())], fields=list(_PROOF.value_type))
    left = left.append_column("proof", pa.ListArray.from_arrays(pa.array(ends, pa.int32()), steps))
    return left.append_column("top", pa.array([right.column("top")[0].as_py()] * len(index), pa.string()))


def prove(tree: Tree, above: DataFrame) -> DataFrame:
    """The rows of ``tree`` with ``proof``, from the row up, and ``top``; ``above`` has key, top and the proof of each tree's top."""
    found = above.select("key", F.lit(0).cast("long").alias("index"), "proof", "top")
    payload = [c for c in tree.rows.columns if c != "pid"]
    for i in range(len(tree.rounds) - 1, -1, -1):
        if i:
            lower = tree.rounds[i - 1].withColumnRenamed("digest", "value")
        else:
            kinds = ", ".join(f"`{c}` {tree.rows.schema[c].dataType.simpleString()}" for c in payload)

            def number(batches, edges=tree.edges):
                for batch, _, index in _indexed(edges)(batches):
                    yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in payload), pa.array(index)], names=[*payload, "index"])

            lower = tree.rows.mapInArrow(number, f"{kinds}, index long")
        size = F.ceil(F.col("size") / F.lit(_BLOCK**i)).cast("long").alias("size")
        right = found.join(tree.sizes, "key").select("key", F.col("index").alias("block"), "proof", "top", size)
        left = lower.withColumn("block", F.floor(F.col("index") / F.lit(_BLOCK)).cast("long"))
        schema = ", ".join(f"`{c}` {left.schema[c].dataType.simpleString()}" for c in left.columns)
        found = left.groupBy("key", "block").cogroup(right.groupBy("key", "block")).applyInArrow(_descend, f"{schema}, proof array<struct<place:int,others:string>>, top string").drop("block")
        if i:
            found = cut(found)
    return found


def fold(leaf: Column, proof: Column) -> Column:
    """The root that ``leaf`` leads to: at each step it takes its place among the others, and their digest goes on."""
    side = 64

    def step(done, p):
        return F.sha2(F.concat(p["others"].substr(F.lit(1), p["place"] * side), done, p["others"].substr(p["place"] * side + 1, F.lit((ARITY - 1) * side))), 256)

    return F.aggregate(proof, leaf, step)


class Manifest(NamedTuple):
    """``proofs``: doc_id, leaf, changed, subroot and the proof (place among the run and the others' digests, level by level)."""

    root: str | None
    subroots: DataFrame
    proofs: DataFrame


def manifest(docs: DataFrame, changed: Column | None = None, text: str = "text") -> Manifest:
    """The manifest of ``docs``: a tree per lang, whose leaves ascend by doc_id, and a tree of their roots by lang.

    Nulls are values of their own and come first, in lang, doc_id and all others. Rows that repeat an id are leaves
    side by side, by their digests. ``changed`` may be another text column; its leaf is carried as ``changed``, null where it is
    the same leaf. Texts are read whole; other columns than FIELDS are not read. An empty table has no root and no rows.
    """
    values = [F.col(c) for c in FIELDS]
    leaf = leaf_digest(values)
    other = F.lit(None).cast("string")
    if changed is not None:
        other = F.when(changed.isNotNull() & (changed != F.col(text)), leaf_digest([changed if c == text else F.col(c) for c in FIELDS]))
    key = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(""))
    leaves = cut(docs.select(key.alias("key"), F.col("doc_id").cast("long").alias("doc_id"), leaf.alias("value"), other.alias("changed")))
    langs = build(leaves, ["doc_id", "value"])
    subroots = langs.tops.withColumnRenamed("digest", "value").select(F.lit("").alias("key"), F.col("key").alias("lang"), "value")
    joined = build(subroots, ["lang"])
    root = joined.tops.first()
    empty = F.array().cast("array<struct<place:int,others:string>>")
    above = cut(prove(joined, joined.tops.select("key", F.col("digest").alias("top"), empty.alias("proof"))))
    proofs = prove(langs, above.select(F.col("lang").alias("key"), F.col("value").alias("top"), "proof"))
    proofs = proofs.select("doc_id", F.col("value").alias("leaf"), "changed", F.col("top").alias("subroot"), "proof")
    named = above.select(F.when(F.col("lang") != "", F.substring("lang", 2, 1 << 30)).alias("lang"), F.col("value").alias("subroot"))
    return Manifest(root["digest"] if root else None, named, proofs)


def verified(found: Manifest) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root (from ``changed``, else the leaf) and verified."""
    root = F.lit(found.root).cast("string")
    folded = found.proofs.select(
        "doc_id", "leaf", "subroot", root.alias("root"), F.sha2(F.array_join(F.col("proof.others"), ""), 256).alias("proof_sha256"),
        fold(F.coalesce("changed", "leaf"), F.col("proof")).alias("folded_root"),
    )
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


def tampered_text() -> Column:
    """The text with A-Z in lower case where 3 divides the crc32 of the decimal doc_id; elsewhere null."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return F.when(hit, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))

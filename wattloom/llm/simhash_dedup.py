"""SimHash near-dedup by pigeonhole blocks.

Fingerprints are cut into blocks; two that differ in at most ``radius`` bits agree on all but ``radius`` blocks, so
they meet under at least one choice of agreeing blocks. Rows are dealt and sorted by those block keys, and a task goes
through the runs of equal keys with the Hamming distance. Equal fingerprints are one node from the start, and a run
gives a spanning forest of its links, never all its pairs. Runs longer than ``run_limit`` are left to a next level,
which cuts the bits that the key does not fix into blocks again; no pair is dropped.

``simhash_dedup`` links by one fingerprint of shingles. ``near_copies`` is for similarities that differ in too many bits
for block keys: it meets its pairs by short fingerprints of word sets, which an edit hardly moves, and verifies them by
the Hamming distance of long fingerprints of shingle sets, which travel with the block keys.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut
from .components import connected_components, spanning_forest

_ALL = (1 << 64) - 1


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """The 64-bit SimHash of a text as a signed integer; 0 for a text without words."""

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        return _signed(xxhash.xxh64_intdigest(line, seed))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: len(words) - shingle] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    n = len(starts)
    hashes = np.fromiter((digest(line[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)), np.uint64, n)
    set_bits = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 16):
        set_bits += np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp) of every row; fp is the signed 64-bit fingerprint."""

    def run(batches):

        for batch in batches:
            texts = batch.column(1)
            fps = [fingerprint(texts[i].as_py(), shingle, seed) for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _blocks(bits: list[int], n: int) -> list[int]:
    """``bits`` cut into n masks of nearly equal size."""
    return [sum(1 << b for b in bits[k * len(bits) // n : (k + 1) * len(bits) // n]) for k in range(n)]


def block_masks(radius: int, n_blocks: int) -> list[int]:
    """The masks of every choice of blocks that can be the ones that agree."""
    parts = _blocks(list(range(64)), n_blocks)
    return [sum(c) for c in combinations(parts, n_blocks - radius)]


def _forest(fps, wide, radius: int, far: int):
    """(i, j) index pairs of a spanning forest of the links among ``fps``, breadth first over what is left."""

    left = np.arange(len(fps))
    while len(left):
        frontier, left = deque([left[0]]), left[1:]
        while frontier and len(left):
            i = frontier.popleft()
            near = np.bitwise_count(fps[left] ^ fps[i]) <= radius
            if wide.shape[1]:
                some = np.flatnonzero(near)
                near[some] = np.bitwise_count(wide[left[some]] ^ wide[i]).sum(axis=1) <= far
            if near.any():
                found, left = left[near], left[~near]
                frontier += found.tolist()
                yield np.full(len(found), i), found


def _link_runs(radius: int, run_limit: int, wide: Sequence[str] = (), far: int = 0):
    """Task over rows (mask, key, fp, node, wide columns) sorted by mask and key: links, and the rows of runs that are too long."""

    def run(batches):

        names = ["mask", "fp", "a", "b", *wide]
        held: list = []  # the rows of the run that may go on in the next batch
        key_now, n_held, over = None, 0, False

        def emit(mask, fp, a, b, long):
            b = b if isinstance(b, pa.Array) else pa.array(b, pa.int64())
            return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (mask, fp, a)), b, *(pa.array(long[:, c].view(np.int64)) for c in range(len(wide)))], names=names)

        def links(i, j, node):
            keep = node[i] != node[j]
            i, j = i[keep], j[keep]
            none = np.zeros(len(i), np.int64)
            return emit(none, none, node[i], node[j], np.zeros((len(i), len(wide)), np.uint64))

        def overflow(mask, fp, node, long):
            return emit(mask, fp, node, pa.nulls(len(fp), pa.int64()), long)

        def closed():
            nonlocal held, n_held, over
            rows, held, n_held, was, over = held, [], 0, over, False
            if rows and not was:
                mask, fp, node, long = (np.concatenate([r[k] for r in rows]) for k in range(4))
                if len(fp) > 1:
                    for i, j in _forest(fp.view(np.uint64), long, radius, far):
                        yield links(i, j, node)

        for batch in batches:
            mask, key, fp, node = (np.asarray(batch.column(k)) for k in range(4))
            if not len(mask):
                continue
            long = np.column_stack([np.asarray(batch.column(4 + c)).view(np.uint64) for c in range(len(wide))]) if wide else np.zeros((len(mask), 0), np.uint64)
            new = np.flatnonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1])) + 1
            starts, ends = np.r_[0, new], np.r_[new, len(mask)]
            inner = slice(1, max(1, len(starts) - 1))
            for which in dict.fromkeys((0, len(starts) - 1)):  # runs at the ends of a batch may go on
                a, b = starts[which], ends[which]
                if which or (mask[a], key[a]) != key_now:
                    yield from closed()
                    key_now = (mask[a], key[a])
                rows = (mask[a:b], fp[a:b], node[a:b], long[a:b])
                if not over and n_held + (b - a) > run_limit:
                    over = True
                    for r in held:
                        yield overflow(*r)
                    held = []
                if over:
                    yield overflow(*rows)
                else:
                    held.append(rows)
                n_held += b - a
            s, e = starts[inner], ends[inner]
            n = e - s
            two = s[n == 2]
            if len(two):
                x = fp.view(np.uint64)
                two = two[np.bitwise_count(x[two] ^ x[two + 1]) <= radius]
                two = two[np.bitwise_count(long[two] ^ long[two + 1]).sum(axis=1) <= far]
                if len(two):
                    yield links(two, two + 1, node)
            for a, b in zip(s[n > 2].tolist(), e[n > 2].tolist(), strict=True):
                if b - a > run_limit:
                    yield overflow(mask[a:b], fp[a:b], node[a:b], long[a:b])
                    continue
                for i, j in _forest(fp[a:b].view(np.uint64), long[a:b], radius, far):
                    yield links(a + i, a + j, node)
        yield from closed()

    return run


def _tiles(rest: DataFrame, run_limit: int) -> DataFrame:
    """Rows of runs that are too long, under a key for each pair of chunks of a run: every two rows meet in a tile of about ``run_limit`` rows."""
    rows = rest.drop("b").withColumnRenamed("a", "node").withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
    sized = rows.join(rows.groupBy("mask", "key").agg(F.ceil(2 * F.count(F.lit(1)) / run_limit).alias("chunks")), ["mask", "key"])
    own = sized.withColumn("own", F.pmod(F.xxhash64("node"), F.col("chunks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    return own.withColumn("key", F.xxhash64("mask", "key", F.least("own", "other"), F.greatest("own", "other"))).drop("own", "other", "chunks")


def hamming_links(nodes: DataFrame, radius: int = 4, n_blocks: int | None = None, run_limit: int = 100_000, far: int = 0) -> DataFrame:
    """(a, b): a spanning forest of the links between ``nodes`` (fp, node) at ``radius`` bits or fewer.

    Nodes are distinct in fp; further columns are the words of a long fingerprint, in which linked nodes differ in at most
    ``far`` bits, and nodes are distinct in all columns together. Long runs of these are compared tile by tile, as
    finer keys need not part them.

    ``n_blocks`` sets how many blocks a fingerprint has; by default it follows the number of nodes, so that a key
    fixes more bits than the nodes have. Every choice finds the same components.
    """
    if n_blocks is None:
        n_blocks = radius + (1 if (n := nodes.count()) < 1 << 13 else 2 if n < 1 << 24 else 3 if n < 1 << 30 else 4)
    masks = [_signed(m) for m in block_masks(radius, n_blocks)]
    wide = [c for c in nodes.columns if c not in ("fp", "node")]
    kinds = "mask long, fp long, a long, b long" + "".join(f", {c} long" for c in wide)

    def linked(keyed: DataFrame, limit: int) -> DataFrame:
        rows = keyed.select("mask", "key", "fp", "node", *wide).repartition("mask", "key").sortWithinPartitions("mask", "key", "node")  # least node first: runs of one group give the same links
        return cut(rows.mapInArrow(_link_runs(radius, limit, wide, far), kinds))

    level = nodes.select("fp", "node", *wide, F.explode(F.array(*[F.lit(m) for m in masks])).alias("mask"))
    found = None
    for depth in range(12):
        out = linked(level.withColumn("key", F.col("fp").bitwiseAND(F.col("mask"))), run_limit if depth < 11 else 1 << 62)
        links = out.where("b is not null").select("a", "b")
        found = links if found is None else found.unionByName(links)
        rest = out.where("b is null")
        used = [r[0] for r in rest.select("mask").distinct().collect()]  # at most as many as there are masks
        if not used:
            return found
        if wide:
            return found.unionByName(linked(_tiles(rest, run_limit), 1 << 62).select("a", "b"))
        finer = []
        for m in used:
            free = [b for b in range(64) if not (m & _ALL) >> b & 1]
            parts = _blocks(free, radius + 1) if len(free) > radius else []
            finer += [(m, _signed((m & _ALL) | p)) for p in parts] or [(m, -1)]
        cases = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(p).alias("p")) for m, p in finer])
        level = rest.select("fp", F.col("a").alias("node"), F.explode(F.filter(cases, lambda x: x["m"] == F.col("mask"))).alias("x")).select("fp", "node", F.col("x.p").alias("mask"))
    return found


def simhash_dedup(docs: DataFrame, shingle: int = 4, seed: int = 42, radius: int = 4, n_blocks: int | None = None, run_limit: int = 100_000) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp (signed), fingerprint (16 hex digits), component_id.

    Words are runs of bytes other than space and the controls from tab to carriage return, with A-Z lower-cased.
    A null text or one without words has fingerprint zero and links like any other. component_id is the smallest
    doc_id reachable over links, whatever its size; an id on several texts links nothing by itself; rows without an id get
    the component of the rows they link with, or null. Texts of any length are read whole. Other columns are not read. An empty table gives no rows.
    """
    fps = cut(fingerprints(docs, shingle, seed))
    named = _components(_nodes(fps, ["fp"]), ["fp"], lambda nodes: hamming_links(nodes.select("fp", "node"), radius, n_blocks, run_limit))
    return fps.join(named, "fp").select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _nodes(prints: DataFrame, keys: list[str]) -> DataFrame:
    """A node for each print, with a number of its own and the least doc_id that has it (null if no row has an id)."""
    return cut(prints.groupBy(*keys).agg(F.min("doc_id").alias("least")).withColumn("node", F.monotonically_increasing_id()))


def _components(nodes: DataFrame, keys: list[str], links) -> DataFrame:
    """(keys, component_id): the least doc_id that any node of the component has."""
    named = nodes.join(connected_components(links(nodes)), "node", "left").select(*keys, "least", F.coalesce("component", "node").alias("c"))
    named = cut(named)
    best = named.groupBy("c").agg(F.min("least").alias("component_id"))
    # a mixed key gives the join exchanges of its own, so that the nodes of a large component can be split
    mixed = F.col("c").bitwiseXOR(F.lit(0x5BD1E995))
    return named.select(*keys, mixed.alias("k")).join(best.select(mixed.alias("k"), "component_id"), "k").drop("k")


def _lanes(hashes, n_lanes: int) -> list[int]:
    """Signed SimHashes of the same features, each from hashes that are mixed anew."""
    out, n = [], len(hashes)
    for lane in range(n_lanes):
        x = hashes + np.uint64(lane * 0x9E3779B97F4A7C15 & _ALL)
        if lane:
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(31)
        set_bits = np.zeros(64, np.int64)
        for k in range(0, n, 1 << 16):
            set_bits += np.unpackbits(x[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(2 * set_bits > n, bitorder="little").view(np.int64)[0]))
    return out


def near_prints(text: str | None, shingle: int = 5, seed: int = 42) -> list[int]:
    """Two fingerprints of the set of words and four of the set of shingles (together 256 bits); zeros without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return [0] * 6
    digest = xxhash.xxh64_intdigest
    hashed = lambda features: np.fromiter((digest(f, seed) for f in features), np.uint64, len(features))
    line, ends, at = b" ".join(words), [], 0
    for w in words:
        at += len(w) + 1
        ends.append(at - 1)
    starts = [0, *(e + 1 for e in ends[: max(0, len(words) - shingle)])]
    shingles = {line[a:b] for a, b in zip(starts, ends[shingle - 1 :], strict=True)} if len(words) >= shingle else {line}
    return _lanes(hashed(set(words)), 2) + _lanes(hashed(shingles), 4)


def near_copies(docs: DataFrame, shingle: int = 5, radius: int = 6, far: int = 50, seed: int = 42, run_limit: int = 100_000) -> DataFrame:
    """One row per row of ``docs``: doc_id and component_id, for near copies of a similarity of about 0.8 or more.

    Two texts are linked if one of their two word-set fingerprints differs in at most ``radius`` of 64 bits and their
    fingerprints of ``shingle``-word sets in at most ``far`` of 256: at a Jaccard similarity of 0.8 about 39 differ,
    give or take 6, at 0.6 about 59. Words, null and empty texts, rows without an id, rows that repeat an id, other
    columns and empty tables are as for ``simhash_dedup``; texts of any length are read whole.
    """
    short, long = ["f0", "f1"], ["w0", "w1", "w2", "w3"]

    def run(batches):
        for batch in batches:
            prints = np.array([near_prints(t.as_py(), shingle, seed) for t in batch.column(1)], np.int64).reshape(-1, 6)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(prints[:, c]) for c in range(6))], names=["doc_id", *short, *long])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    prints = cut(texts.mapInArrow(run, "doc_id long" + "".join(f", {c} long" for c in short + long)))
    nodes = _nodes(prints, [*short, *long])

    def links(nodes: DataFrame) -> DataFrame:
        found = [hamming_links(nodes.select(F.col(f).alias("fp"), "node", *long), radius, None, run_limit, far) for f in short]
        return spanning_forest(found[0].unionByName(found[1]))

    return prints.join(_components(nodes, [*short, *long], links), [*short, *long]).select("doc_id", "component_id")

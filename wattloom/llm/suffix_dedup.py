"""Suffix-array dedup: every byte of a long string that also starts somewhere else is removed.

A match is a window of ``width`` bytes. Each window is dealt by its minimizer (the least hash of the short grams
inside it), which depends on its bytes alone, so equal windows meet wherever they are. Neighbouring windows with one
minimizer travel together as one strip of text, equal strips as one strip with a count, and strips whose minimizer
occurs nowhere else are left out: what is shuffled is a few numbers per strip and the bytes of the strips that may match.

A task keeps a logarithmic family of suffix arrays over its strips: every new batch gets a suffix array of its window
starts (positions in its bytes), is merge-scanned against the levels there are for prefixes of the window's length, and
levels of equal size are merged, so sizes grow geometrically. Strips come sorted by minimizer, and levels of minimizers
that are done are dropped. Of strips with the same minimizer and digest two come with their bytes, which the arrays
find equal; the others are told by these two 64-bit hashes. A minimizer with more strips than a task should hold is cut
again by the minimizers of longer grams, at last by grams of the window's own length: a strip is then one window, and
only windows that occur again travel.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import NO_ID, cut, slices

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_BYTES = np.random.default_rng(7).integers(0, 2**64, 256, np.uint64, endpoint=False)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes from every position; the last doubling overlaps."""
    h, size, factor = _BYTES[data], 1, int(_M1)
    while size < gram:
        step = min(size, gram - size)
        h = h[:-step] * np.uint64(factor) + h[step:]
        factor = factor * factor % 2**64 | 1
        size += step
    h *= _M2
    h ^= h >> np.uint64(32)
    h *= _M1
    return h


def window_minima(h: np.ndarray, span: int) -> np.ndarray:
    """Minimum of every ``span`` neighbours, from running minima of blocks in both directions."""
    n = len(h) - span + 1
    padded = np.full(-(-len(h) // span) * span, np.uint64(2**64 - 1))
    padded[: len(h)] = h
    blocks = padded.reshape(-1, span)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[span - 1 : span - 1 + n])


def strips(raw: list[bytes], width: int, gram: int, longest: int):
    """(text, minimizer, digest, first window, windows, inner) arrays of all strips of some texts.

    The digest tells strips of one minimizer apart; inner says that the minimizer occurs several times in the strip, so the strip's own windows may be equal.
    """
    data = np.frombuffer(b"".join(raw), np.uint8)
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    ends = np.cumsum(sizes)
    counts = np.maximum(sizes - width + 1, 0)
    if not counts.any():
        return None
    grams = gram_hashes(data, gram)
    least = window_minima(grams, width - gram + 1)
    owner = np.repeat(np.arange(len(raw)), counts)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    m = least[(ends - sizes)[owner] + offset]
    new = np.r_[True, (m[1:] != m[:-1]) | (owner[1:] != owner[:-1])]
    first = np.flatnonzero(new)
    length = np.diff(np.r_[first, len(m)])
    if (length > longest).any():  # periodic text: cut the run again
        pieces = -(-length // longest)
        step = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        length = np.minimum(np.repeat(length, pieces) - step * longest, longest)
        first = np.repeat(first, pieces) + step * longest
    text, start = owner[first], offset[first]
    view = memoryview(data)
    begin = (ends - sizes)[text] + start
    digest = xxhash.xxh3_64_intdigest
    sums = np.array([digest(view[a : a + n]) for a, n in zip(begin.tolist(), (length + width - 1).tolist(), strict=True)], np.uint64)
    count, span, value = np.count_nonzero, width - gram, m[first]
    inner = np.array([count(grams[a : a + n + span] == v) > 1 for a, n, v in zip(begin.tolist(), length.tolist(), value, strict=True)])
    return text, value.view(np.int64), sums.view(np.int64), start, length, inner


#: Positions of a batch fit in so many bits, two ranks and a position in one 63-bit number.
_BITS = 21


def _numbered(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of keys below 2**42: their rank among the distinct keys, their order, and whether each in that order equals the one before."""
    packed = np.sort(key << _BITS | np.arange(len(key)))
    order, value = packed & (1 << _BITS) - 1, packed >> _BITS
    same = np.r_[False, value[1:] == value[:-1]]
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(~same) - 1
    return rank, order, same


def suffix_order(data: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, same): the suffix array of ``starts`` by the first ``width`` bytes, and whether a suffix shares them all with the one before.

    Ranks of prefixes are doubled until they reach ``width``; the last step overlaps. Starts that lie far apart (their
    number is small against the bytes) are sorted as they are.
    """
    if len(data) > 8 * len(starts):
        whole = np.ndarray((len(data) - width + 1,), f"S{width}", data, strides=(1,))[starts]
        order = np.argsort(whole, kind="stable")
        return order, np.r_[False, whole[order[1:]] == whole[order[:-1]]]
    depth = min(5, width)
    key = np.zeros(len(data) - depth + 1, np.int64)
    for k in range(depth):
        key = key << 8 | data[k : len(data) - depth + 1 + k]
    rank = _numbered(key)[0]
    while 2 * depth <= width:
        rank = _numbered(rank[:-depth] << _BITS | rank[depth:])[0]
        depth *= 2
    _, order, same = _numbered(rank[starts] << _BITS | rank[starts + width - depth])
    return order, same


class SuffixLevel:
    """Suffixes of ``data`` in the order of their first ``width`` bytes, no two alike there; ``refs`` says which window each one is."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, refs: np.ndarray, width: int):
        self.data, self.starts, self.refs, self.width = data, starts, refs, width
        self._words = np.ndarray((max(0, len(data) - 7),), ">u8", data, strides=(1,))

    def __len__(self) -> int:
        return len(self.starts)

    def word(self, at: int, which) -> np.ndarray:
        """The eight bytes ``at`` some place of the chosen suffixes as a number, fewer if ``width`` is less."""
        return self._words[self.starts[which] + at].astype(np.uint64) >> np.uint64(8 * max(0, 8 - self.width))

    def only(self, which: np.ndarray) -> SuffixLevel:
        return SuffixLevel(self.data, self.starts[which], self.refs[which], self.width)

    def _bound(self, at: int, low: np.ndarray, high: np.ndarray, want: np.ndarray, above: bool) -> np.ndarray:
        """First place in [low, high) whose word is not below (or, with ``above``, is above) the wanted one."""
        low, high = low.copy(), high.copy()
        live = np.flatnonzero(low < high)
        while len(live):
            middle = (low[live] + high[live]) >> 1
            here = self.word(at, middle)
            before = here <= want[live] if above else here < want[live]
            low[live[before]], high[live[~before]] = middle[before] + 1, middle[~before]
            live = live[low[live] < high[live]]
        return low

    def merge_scan(self, other: SuffixLevel) -> tuple[np.ndarray, np.ndarray]:
        """Both orders side by side: (rank, shared) of the suffixes of ``other``.

        rank is where one belongs in this level, shared the length of the prefix it has in common with some suffix
        here, in whole words and ``width`` at most. The range that shares a prefix is narrowed word by word.
        """
        size = min(8, self.width)
        head, want = self.word(0, slice(None)), other.word(0, slice(None))
        low, high = np.searchsorted(head, want, "left"), np.searchsorted(head, want, "right")
        shared = np.where(low < high, size, 0)
        live = np.flatnonzero(low < high)
        at = size
        while len(live) and at < self.width:
            step = min(at, self.width - size)  # the last word overlaps
            want = other.word(step, live)
            a = self._bound(step, low[live], high[live], want, False)
            high[live] = self._bound(step, a, high[live], want, True)
            low[live] = a
            live = live[low[live] < high[live]]
            at = step + size
            shared[live] = at
        return low, shared

    def merged(self, other: SuffixLevel) -> SuffixLevel:
        """One level of two that have no window in common."""
        rank, _ = self.merge_scan(other)
        place = rank + np.arange(len(other))
        mine = np.ones(len(self) + len(other), bool)
        mine[place] = False
        starts, refs = np.empty(len(mine), np.int64), np.empty(len(mine), np.int64)
        starts[mine], starts[place] = self.starts, other.starts + len(self.data)
        refs[mine], refs[place] = self.refs, other.refs
        return SuffixLevel(np.concatenate([self.data, other.data]), starts, refs, self.width)


class SuffixFamily:
    """A logarithmic family of suffix arrays: windows that share all their bytes with another are told to ``mark``.

    A new batch gets a suffix array, is merge-scanned against every level, and becomes the last level; while a level
    is at least half as large as the one before it, the two are merged.
    """

    def __init__(self, width: int, mark):
        self.width, self.mark, self.levels = width, mark, []

    def __len__(self) -> int:
        return sum(map(len, self.levels))

    def add(self, data: bytes, starts: np.ndarray, refs: np.ndarray) -> None:
        """A batch: window starts in ``data``, and the number that stands for each window."""
        raw = np.frombuffer(data + bytes(8), np.uint8)
        order, same = suffix_order(raw, starts, self.width)
        again = refs[order][same | np.r_[same[1:], False]]
        self.mark(again)
        first = order[~same]
        new = SuffixLevel(raw, starts[first], refs[first], self.width)
        for level in self.levels:
            rank, shared = level.merge_scan(new)
            hit = shared >= self.width
            if hit.any():
                self.mark(new.refs[hit])
                self.mark(level.refs[rank[hit]])
                new = new.only(~hit)
        if len(new):
            self.levels.append(new)
        while len(self.levels) > 1 and 2 * len(self.levels[-1]) >= len(self.levels[-2]):
            self.levels[-2:] = [self.levels[-2].merged(self.levels[-1])]


def _ranges(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.r_[False, flags, False].astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


_FOUND = "h long, d long, begin array<int>, stop array<int>"
#: A strip's place in its text, its number of windows and whether it may repeat inside, in one number.
_PLACE, _COUNT, _INNER = "at div 4096", "at div 2 % 2048", "at % 2 = 1"


def _index(width: int, batch_bytes: int, hold: int):
    """Task over strips (h, d, r, c, n, piece, wide) sorted by wide and h: ranges of windows that occur elsewhere.

    c says how many strips are told by this one alone, r which of the two of its digest it is; the first one reports.
    Wide strips pass through with their bytes.
    """
    names = ["h", "d", "begin", "stop", "c", "piece"]
    batch_bytes = min(batch_bytes, (1 << _BITS) - (1 << 14))

    def run(batches):
        held, waiting = [], 0  # strips of the batch to come, and their bytes
        live: list = []  # strips whose windows are in the family: (h, d, r, flags)
        offsets = [0]

        def mark(refs):
            if len(refs):
                flags[refs] = True

        family, flags = SuffixFamily(width, mark), np.zeros(0, bool)

        def push():
            nonlocal held, waiting, flags
            if not held:
                return
            sizes = np.array([len(x[5]) for x in held], np.int64)
            n = np.array([x[4] for x in held], np.int64)
            base = offsets[-1]
            live.extend(x[:3] for x in held)
            offsets.extend((base + np.cumsum(n)).tolist())
            flags = np.r_[flags, np.repeat([x[3] > 1 for x in held], n)]
            inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            family.add(b"".join([x[5] for x in held]), np.repeat(np.cumsum(sizes) - sizes, n) + inside, base + np.arange(n.sum()))
            held, waiting = [], 0

        def drain():
            nonlocal live, offsets, family, flags
            out = [[], [], [], []]
            for (h, d, r), a, b in zip(live, offsets, offsets[1:], strict=False):
                if r == 0 and flags[a:b].any():
                    for column, value in zip(out, (h, d, *_ranges(flags[a:b])), strict=True):
                        column.append(value)
            live, offsets, family, flags = [], [0], SuffixFamily(width, mark), np.zeros(0, bool)
            if out[0]:
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:2]), *(pa.array(c, pa.list_(pa.int32())) for c in out[2:]), pa.nulls(len(out[0]), pa.int64()), pa.nulls(len(out[0]), pa.binary())], names=names)

        last = None
        for batch in batches:
            passing = batch.filter(batch.column(6))
            if passing.num_rows:
                none = pa.nulls(passing.num_rows, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([passing.column(0), passing.column(1), none, none, passing.column(3), passing.column(5)], names=names)
            for row in zip(*(c.to_pylist() for c in batch.filter(pc.invert(batch.column(6))).columns), strict=True):
                if row[0] != last and len(flags) >= hold:  # no earlier minimizer comes again
                    push()
                    yield from drain()
                if waiting and waiting + len(row[5]) > batch_bytes:
                    push()
                held.append(row)
                waiting += len(row[5])
                last = row[0]
        push()
        yield from drain()

    return run


def _windows_of(width: int):
    """Task over (h, d, ranges of bytes): the ranges of windows inside them, joined where they touch."""

    def run(batches):
        for batch in batches:
            out = []
            for ranges in batch.column(2).to_pylist():
                flags = np.zeros(max(x["stop"] for x in ranges) - width + 1, bool)
                for x in ranges:
                    flags[x["begin"] : x["stop"] - width + 1] = True
                out.append(_ranges(flags))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array([r[k] for r in out], pa.list_(pa.int32())) for k in (0, 1))], names=["h", "d", "begin", "stop"])

    return run


def _apart(df: DataFrame, key: str) -> DataFrame:
    """``df`` with its key under another name and mixed, so that a join gives it an exchange of its own and a hot key can be split."""
    return df.withColumn("__k", F.col(key).bitwiseXOR(F.lit(1))).drop(key)


def _on(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    return df.withColumn("__k", F.col(key).bitwiseXOR(F.lit(1))).join(_apart(other, key), "__k").drop("__k")


def repeated_spans(
    rows: DataFrame, width: int = 400, grams: tuple[int, ...] = (32, 256, 384), longest: int = 1024, batch_bytes: int = 1 << 18, hold: int = 1 << 18, most_strips: int = 1024, most_windows: int = 1 << 18,
    once: DataFrame | None = None,
) -> DataFrame:
    """(doc_id, th, begin, stop): byte ranges covered by windows that occur elsewhere, overlapping as they come.

    ``rows`` has doc_id, th (together the key of a text), text (binary) and c (how often the text occurs). ``grams``
    are at most ``width``. A minimizer with more than ``most_strips`` strips or ``most_windows`` windows is left to the
    next gram, which tells strips apart by more bytes, and after the last to grams of ``width`` bytes, whose strips
    are single windows (or periodic text), so that a minimizer has one strip. ``batch_bytes`` is the size of a batch,
    two million at most, and levels are dropped between minimizers once they hold ``hold`` windows. ``once`` has every
    text of ``rows`` once, if ``rows`` may repeat some.
    """
    gram, finer = grams[0], grams[1:] or ((width,) if grams[0] < width else ())

    def cut_strips(batches):
        for batch in batches:
            for start, stop in slices(batch, 3, 1 << 20):
                found = strips(batch.column(3).slice(start, stop - start).to_pylist(), width, gram, longest)
                if found is not None:
                    owner, h, d, first, n, inner = found
                    kept = [batch.column(k).take(pa.array(owner + start)) for k in range(3)]
                    yield pa.RecordBatch.from_arrays([*kept, pa.array(h), pa.array(d), pa.array(first * 4096 + n * 2 + inner)], names=["doc_id", "th", "c", "h", "d", "at"])

    # Strips whose minimizer comes once and not twice in the strip cannot match; the others are kept, a few numbers each.
    all_strips = cut(rows.select("doc_id", "th", "c", "text").mapInArrow(cut_strips, "doc_id long, th long, c int, h long, d long, at long"))
    often = all_strips.groupBy("h").agg(F.sum("c").alias("total"), F.bool_or(F.expr(_INNER)).alias("inner")).where("total > 1 or inner").select("h")
    places = cut(_on(all_strips, often, "h"))

    # Of equal strips the first and the last place come with their bytes.
    place = F.struct("doc_id", "th", "at")
    texts = places.groupBy("h", "d").agg(F.sum("c").alias("c"), F.array_distinct(F.array(F.min(place), F.max(place))).alias("x"))
    texts = texts.select("h", "d", F.when(F.size("x") == 1, F.col("c")).otherwise(F.lit(1)).alias("alone"), "c", F.posexplode("x").alias("r", "x")).select("h", "d", "alone", "c", "r", "x.*")
    texts = cut(texts.select("h", "d", "r", "alone", "c", "doc_id", "th", F.expr(_PLACE).cast("int").alias("s"), F.expr(_COUNT).cast("int").alias("n")))
    per = texts.groupBy("h").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("windows"))
    wide = ((F.col("k") > most_strips) | (F.col("windows") > most_windows)) & F.lit(bool(finer))
    chosen = _on(texts, per.select("h", wide.alias("wide")), "h").where("r = 0 or not wide")
    pieces = (rows if once is None else once).select("doc_id", "th", F.col("text").alias("raw")).join(chosen, ["doc_id", "th"])
    told = F.when(F.col("wide"), F.least("c", F.lit(2))).otherwise(F.col("alone")).cast("long")
    pieces = pieces.select("h", "d", "r", told.alias("c"), "n", F.expr(f"substring(raw, s + 1, n + {width - 1})").alias("piece"), "wide")
    dealt = pieces.repartition(F.when(F.col("wide"), F.col("d")).otherwise(F.col("h"))).sortWithinPartitions("wide", "h")
    out = cut(dealt.mapInArrow(_index(width, batch_bytes, hold), f"{_FOUND}, c long, piece binary"))
    found, rest = out.where("piece is null").select("h", "d", "begin", "stop"), out.where("piece is not null").select("h", "d", "c", "piece")
    if finer and not rest.isEmpty():
        below = rest.select(F.col("h").alias("doc_id"), F.col("d").alias("th"), F.col("piece").alias("text"), F.col("c").cast("int").alias("c"))
        inner = repeated_spans(below, width, finer, longest, batch_bytes, hold, most_strips, most_windows)
        more = inner.select(F.col("doc_id").alias("h"), F.col("th").alias("d"), F.struct("begin", "stop").alias("x")).groupBy("h", "d").agg(F.collect_set("x").alias("x"))
        found = found.unionByName(more.mapInArrow(_windows_of(width), _FOUND))
    spread = places.join(found, ["h", "d"]).select("doc_id", "th", F.expr(_PLACE).alias("s"), F.explode(F.arrays_zip("begin", "stop")).alias("x"))
    return spread.select("doc_id", "th", (F.col("s") + F.col("x.begin")).alias("begin"), (F.col("s") + F.col("x.stop") + (width - 1)).alias("stop"))


def remove_repeats(docs: DataFrame, width: int = 400, with_text: bool = True, **settings) -> DataFrame:
    """One row per row of ``docs``: doc_id, spans array<struct<begin, stop>> (removed byte ranges), kept binary (left out unless ``with_text``), n_bytes, n_removed, n_spans, kept_sha256.

    Texts are read whole as UTF-8 bytes, a null text as empty. A byte is removed if it is covered by a ``width``-byte
    string that also starts anywhere else, the same text included; strings are judged on the input. Texts shorter than
    ``width`` keep all their bytes. Repeated rows are occurrences of their own, so a repeated long text goes from all
    of them. Columns other than doc_id and text are not read; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    texts = rows.select("doc_id", "th", F.lit(1).alias("c"), F.col("text").cast("binary").alias("text"))
    # rows that repeat an id and text, or have none, send their strips once
    once = texts.dropDuplicates(["doc_id", "th"])
    spans = repeated_spans(texts, width, once=once, **settings).distinct().groupBy("doc_id", "th").agg(F.collect_list(F.struct("begin", "stop")).alias("found"))

    def run(batches):
        for batch in batches:
            out: list = [[] for _ in range(6)]
            texts, found = batch.column(1).cast(pa.binary()), batch.column(2)
            for k in range(batch.num_rows):
                raw, marks = texts[k].as_py(), found[k].as_py()
                runs, at, parts = [], 0, []
                for x in sorted(marks or (), key=lambda x: x["begin"]):
                    if runs and x["begin"] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], x["stop"])
                    else:
                        runs.append([x["begin"], x["stop"]])
                for a, b in runs:
                    parts.append(raw[at:a])
                    at = b
                left = b"".join([*parts, raw[at:]])
                values = (len(raw), len(raw) - len(left), len(runs), hashlib.sha256(left).hexdigest(), [{"begin": a, "stop": b} for a, b in runs], left)
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("begin", pa.int64()), ("stop", pa.int64())])), pa.binary()]
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"]
            wanted = [i for i, n in enumerate(names) if n in columns]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(out[i], types[i]) for i in wanted)], names=["doc_id", *(names[i] for i in wanted)])

    kinds = {"n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept_sha256": "string", "spans": "array<struct<begin:bigint,stop:bigint>>", "kept": "binary"}
    columns = [c for c in kinds if c != "kept" or with_text]
    joined = rows.join(spans, ["doc_id", "th"], "left").select("doc_id", "text", "found")
    done = joined.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} {kinds[c]}" for c in columns))
    return done.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))

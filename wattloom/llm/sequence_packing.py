"""Best-fit packing of token sequences by linear grouping.

The plan is made from the histogram of piece lengths, which has at most ``capacity`` rows whatever the corpus: the
large lengths are dealt, in falling order, into groups of equal cardinality and rounded up to the largest of their group
(Fernandez de la Vega and Lueker, "Bin packing can be solved within 1+epsilon in linear time", 1981); the few sizes are
combined by the linear programme over configurations with columns generated by a knapsack (Gilmore and Gomory, 1961);
whole numbers of each configuration are opened and each slot gets an actual length of its group; what is left, small
lengths above all, goes by falling length to the fullest sequence that has room. Sequences that got the same lengths are
one interval of sequence numbers, so the plan is a short table of moves: "the items number k.. of length l go t to
a sequence, from sequence b on, at offset o". Its size depends on ``capacity`` only. Every piece then finds its own
sequence and offset from its number among the pieces of its length, without any further shuffle.

Texts are read once; what is shuffled is a row of a few numbers for each piece.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Edge, cut, deal, slices

#: Words made of these characters only are in composed form already, and are split as the vocabulary's own rule splits them in lower case.
_PLAIN = "^[!-~À-ÖØ-öø-ÿ]+$"
_PART = "('s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+)"
#: Words that a worker remembers, in Arrow and numpy arrays of some 50 bytes a word; beyond it, it starts anew.
_MEMORY = 1 << 20


class WordIds:
    """Token ids of texts by a vocabulary that drops white space and never merges across it, so that ids go by words.

    Arrow finds the words and numbers the distinct ones; those that are known are looked up in one call, and of the
    others each distinct part is encoded once by the tokenizers library.
    """

    def __init__(self, path: str, memory: int = _MEMORY):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism; threads would have heaps of their own
        from tokenizers import Tokenizer

        self.tokenizer, self.memory = Tokenizer.from_file(path), memory
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([], pa.string())
        self.ids = np.empty(0, np.uint16)
        self.starts, self.counts = np.empty(0, np.int32), np.empty(0, np.int32)

    def _learn(self, words: pa.Array, ids: np.ndarray, counts: np.ndarray) -> None:
        self.known = pa.concat_arrays([self.known, words])
        self.starts = np.concatenate([self.starts, (len(self.ids) + np.cumsum(counts) - counts).astype(np.int32)])
        self.counts = np.concatenate([self.counts, counts.astype(np.int32)])
        self.ids = np.concatenate([self.ids, ids.astype(np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32)])

    def _gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of known words, one after another, and how many each has."""
        counts = self.counts[at]
        ends = np.cumsum(counts, dtype=np.int32)  # a slice of text is far below 2^31 ids
        flat = np.repeat(self.starts[at] - (ends - counts), counts)
        flat += np.arange(len(flat), dtype=np.int32)
        return self.ids[flat], counts

    def _find(self, words: pa.Array) -> np.ndarray:
        """Numbers of known words, -1 of others."""
        return np.array(pc.fill_null(pc.index_in(words, value_set=self.known), -1), np.int32)

    def _encode_parts(self, parts: pa.Array) -> None:
        """Makes parts known, each of which the vocabulary's rule leaves whole: many are sent as one text, and told apart by their numbers."""
        for begin in range(0, len(parts), 1 << 14):
            block = parts.slice(begin, 1 << 14)
            words = block.to_pylist()
            got = self.tokenizer.encode_batch([" ".join(words[i : i + 256]) for i in range(0, len(words), 256)], add_special_tokens=False)
            counts = [np.bincount(e.word_ids, minlength=min(256, len(words) - 256 * i)) for i, e in enumerate(got)]
            self._learn(block, np.concatenate([np.array(e.ids, np.uint32) for e in got]), np.concatenate(counts))

    def _encode(self, words: pa.Array) -> np.ndarray:
        """The numbers of ``words``, distinct and unknown till now."""
        # the names of special tokens go to the library whole
        plain = np.asarray(pc.and_(pc.match_substring_regex(words, _PLAIN), pc.invert(pc.match_substring(words, "<|"))))
        numbers = np.empty(len(words), np.int64)
        some = words.filter(pa.array(plain))
        split = pc.ascii_split_whitespace(pc.utf8_rtrim_whitespace(pc.replace_substring_regex(pc.utf8_lower(some), _PART, "\\1 ")))
        parts = split.flatten().dictionary_encode()
        at = self._find(parts.dictionary)
        new = at < 0
        at[new] = len(self.known) + np.arange(new.sum())
        self._encode_parts(parts.dictionary.filter(pa.array(new)))
        ids, counts = self._gather(at[np.asarray(parts.indices)])
        ends = np.concatenate([[0], np.cumsum(counts)])[np.asarray(split.offsets)]
        numbers[plain] = len(self.known) + np.arange(len(some))
        self._learn(some, ids, np.diff(ends))
        other = words.filter(pa.array(~plain))
        numbers[~plain] = len(self.known) + np.arange(len(other))
        for begin in range(0, len(other), 4096):
            block = other.slice(begin, 4096)
            lists = [e.ids for e in self.tokenizer.encode_batch_fast(block.to_pylist(), add_special_tokens=False)]
            counts = np.fromiter(map(len, lists), np.int64, len(lists))
            self._learn(block, np.fromiter(chain.from_iterable(lists), np.uint32, int(counts.sum())), counts)
        return numbers

    def of_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one after another, and where each text's ids end."""
        split = pc.ascii_split_whitespace(texts)
        offsets = np.asarray(split.offsets)
        words = split.flatten().dictionary_encode()
        if len(self.known) + len(words.dictionary) > self.memory:
            self._forget()
        at = self._find(words.dictionary)
        new = at < 0
        if new.any():
            at[new] = self._encode(words.dictionary.filter(pa.array(new)))
        ids, counts = self._gather(at[np.asarray(words.indices)])
        return ids, np.concatenate([[0], np.cumsum(counts)])[offsets[1:] - offsets[0]]


_ENCODERS: dict[str, WordIds] = {}


def _runs_of(text: str, limit: int) -> list[str]:
    """``text`` cut at white space into runs of about ``limit`` characters, which have the same ids one after another."""
    gaps, out, start = re.compile(r"[\x20\x09-\x0D]"), [], 0
    while len(text) - start > limit:
        gap = gaps.search(text, start + limit)
        if gap is None:
            break
        out.append(text[start : gap.start()])
        start = gap.start()
    return [*out, text[start:]]


def token_pieces(docs: DataFrame, capacity: int = 4096, path: str | None = None, end_id: int = 1, with_ids: bool = False, slice_bytes: int = 4 << 20) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): every document's ids and ``end_id``, cut every ``capacity`` ids.

    A null or empty text, or one of white space, has ``end_id`` alone. Texts of any length are read whole, cut at white
    space into runs of about ``slice_bytes`` for the tokenizer. Repeated rows and ids give rows of their own.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")

    def run(batches):
        words = _ENCODERS.get(path) or _ENCODERS.setdefault(path, WordIds(path))
        for batch in batches:
            for start, stop in slices(batch, 1, slice_bytes):
                out: list[list] = [[], [], [], [], [], []]
                texts, docs_ids = pc.fill_null(batch.column(1).slice(start, stop - start), ""), batch.column(0).slice(start, stop - start).to_pylist()
                if stop - start > 1:
                    flat, ends = words.of_texts(texts)
                    each = np.split(flat, ends[:-1])
                else:  # perhaps a very long text
                    each = [np.concatenate([words.of_texts(pa.array([t], pa.string()))[0] for t in _runs_of(texts[0].as_py(), slice_bytes)])]
                for doc, ids in zip(docs_ids, each, strict=True):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for piece, begin in enumerate(range(0, len(ids), capacity)):
                        part = ids[begin : begin + capacity]
                        for column, value in zip(out, (doc, piece, begin, len(part), zlib.crc32(part.tobytes()), part.astype(np.int32) if with_ids else None), strict=True):
                            column.append(value)
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                k = 6 if with_ids else 5
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out[:k], types[:k], strict=True)], names=names[:k])
                pa.default_memory_pool().release_unused()  # a worker lives on, and its share of an executor is small

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


class Move(NamedTuple):
    """Items ``start`` .. ``start + count - 1`` of one length go ``each`` to a sequence, from ``first`` on, at ``offset``."""

    length: int
    start: int
    count: int
    first: int
    each: int
    offset: int


def _knapsack(sizes: np.ndarray, values: np.ndarray, capacity: int) -> np.ndarray:
    """How many of each size, repeats allowed, give the largest value within ``capacity``."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for i, (s, v) in enumerate(zip(sizes.tolist(), values.tolist(), strict=True)):
        if v <= 0:
            continue
        for low in range(s, capacity + 1, s):  # within a stretch of s, no cell depends on another
            high = min(low + s, capacity + 1)
            with_it = best[low - s : high - s] + v
            better = with_it > best[low:high] + 1e-12
            best[low:high][better] = with_it[better]
            choice[low:high][better] = i
    taken, at = np.zeros(len(sizes)), capacity
    while choice[at] >= 0:
        taken[choice[at]] += 1
        at -= int(sizes[choice[at]])
    return taken


def configurations(sizes: np.ndarray, demands: np.ndarray, capacity: int) -> list[tuple[np.ndarray, float]]:
    """Configurations, as counts of each size, and how many sequences of each a fractional optimum opens."""
    k = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    x = demands / np.diag(basis)
    for _ in range(30 * k):
        prices = np.linalg.solve(basis.T, np.ones(k))
        column = _knapsack(sizes, prices, capacity)
        if prices @ column <= 1 + 1e-9:
            break
        step = np.linalg.solve(basis, column)
        ratios = np.where(step > 1e-9, x / np.maximum(step, 1e-9), np.inf)
        leave = int(np.argmin(ratios))
        x = np.maximum(x - ratios[leave] * step, 0)
        x[leave] = ratios[leave]
        basis[:, leave] = column
    return [(basis[:, j].astype(int), float(x[j])) for j in range(k)]


def plan_packing(counts: dict[int, int], capacity: int, groups: int = 256, large: int | None = None) -> list[Move]:
    """Moves that place all items of ``counts`` (length -> how many); lengths are 1 to ``capacity``, those over ``large`` (a third of it) are grouped."""
    large = capacity // 3 if large is None else large
    moves: list[Move] = []
    used = dict.fromkeys(counts, 0)  # items of each length that have a place
    opened = 0
    room: dict[int, list[tuple[int, int]]] = {}  # free tokens -> intervals (first, count) of sequences
    free: list[int] = []

    def leave(tokens: int, first: int, count: int) -> None:
        if tokens and count:
            if tokens not in room:
                room[tokens] = []
                insort(free, tokens)
            room[tokens].append((first, count))

    def place(length: int, count: int, first: int, each: int, offset: int) -> None:
        moves.append(Move(length, used[length], count, first, each, offset))
        used[length] += count

    if counts.get(capacity):
        place(capacity, counts[capacity], 0, 1, 0)
        opened = counts[capacity]
    queue = [[n, counts[n]] for n in sorted((n for n in counts if large < n < capacity), reverse=True) if counts[n]]
    total = sum(n for _, n in queue)
    by_size: dict[int, list[list[int]]] = {}  # rounded size -> its group's actual lengths, falling, with counts
    while queue:
        left, group = -(-total // groups), []
        while left and queue:
            take = min(left, queue[0][1])
            group.append([queue[0][0], take])
            left -= take
            queue[0][1] -= take
            if not queue[0][1]:
                queue.pop(0)
        by_size.setdefault(group[0][0], []).extend(group)
    if by_size:
        sizes = np.array(list(by_size))
        demands = np.array([sum(n for _, n in by_size[s]) for s in by_size], float)
        for config, x in configurations(sizes, demands, capacity):
            n = int(x + 1e-6)
            slots = [by_size[int(s)] for s, times in zip(sizes, config, strict=True) for _ in range(times)]
            lists = []
            for group in slots:  # a slot takes the next n items of its group, which lie side by side over the n sequences
                need, mine = n, []
                while need and group:
                    take = min(need, group[0][1])
                    mine.append([group[0][0], take])
                    need -= take
                    group[0][1] -= take
                    if not group[0][1]:
                        group.pop(0)
                lists.append([*mine, [0, need]] if need else mine)
            at = 0
            while at < n and lists:  # stretches of sequences that hold the same lengths
                stretch = min(m[0][1] for m in lists)
                offset = 0
                for mine in lists:
                    if mine[0][0]:
                        place(mine[0][0], stretch, opened + at, 1, offset)
                        offset += mine[0][0]
                    mine[0][1] -= stretch
                    if not mine[0][1]:
                        mine.pop(0)
                leave(capacity - offset, opened + at, stretch)
                at += stretch
            opened += at
    for length in sorted(counts, reverse=True):
        left = counts[length] - used[length]
        while left:
            i = bisect_left(free, length)
            if i < len(free):
                tokens = free[i]
                first, count = room[tokens].pop()
                if not room[tokens]:
                    del room[tokens]
                    free.pop(i)
            else:
                tokens, first, count = capacity, opened, -(-left // (capacity // length))
                opened += count
            each = tokens // length
            full = min(count, left // each)
            if full:
                place(length, full * each, first, each, capacity - tokens)
                leave(tokens - each * length, first, full)
                left -= full * each
            if full < count and left and left < each:
                place(length, left, first + full, each, capacity - tokens)
                leave(tokens - left * length, first + full, 1)
                left, full = 0, full + 1
            if tokens < capacity or first + full < opened:
                leave(tokens, first + full, count - full)
    return moves


def _assign(moves: list[Move], edges: dict[int, Edge], names: list[str]):
    """The task of a partition, whose rows come by length: each row's number among its length, and the place its move gives."""
    table = np.array(sorted(moves), np.int64).reshape(-1, 6)

    def run(batches):
        length, seen = None, 0
        for batch in batches:
            cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            lengths = np.asarray(cols["length"])
            if not len(lengths):
                continue
            starts = np.flatnonzero(np.concatenate([[True], lengths[1:] != lengths[:-1]]))
            rank = np.empty(len(lengths), np.int64)
            for a, b in zip(starts, [*starts[1:], len(lengths)], strict=True):
                if lengths[a] != length:
                    seen = edges[cols["pid"][0].as_py()].before if length is None else 0
                    length = lengths[a]
                rank[a:b] = seen + np.arange(b - a)
                seen += b - a
            at = np.empty(len(lengths), np.int64)
            for a, b in zip(starts, [*starts[1:], len(lengths)], strict=True):
                low, high = np.searchsorted(table[:, 0], [lengths[a], lengths[a] + 1])
                at[a:b] = low + np.searchsorted(table[low:high, 1], rank[a:b], "right") - 1
            into = rank - table[at, 1]
            places = [table[at, 3] + into // table[at, 4], table[at, 5] + into % table[at, 4] * lengths]
            yield pa.RecordBatch.from_arrays([*(cols[n] for n in names), *(pa.array(p, pa.int64()) for p in places)], names=[*names, "sequence_id", "offset"])

    return run


def pack_documents(docs: DataFrame, capacity: int = 4096, path: str | None = None, end_id: int = 1, with_ids: bool = False, groups: int = 256) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset and, if asked for, ids.

    Only documents of more than ``capacity`` ids are cut. A sequence's pieces lie one after another from offset 0.
    Rows may repeat an id or have none; each is packed by itself. A null, empty or blank text is one piece that holds ``end_id``.
    Columns other than doc_id and text are not read. An empty table gives no rows.
    """
    pieces = cut(token_pieces(docs, capacity, path, end_id, with_ids))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    dealt, edges = deal(pieces, "length", ["doc_id", "piece"])
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    names = [c.split()[0] for c in schema.split(", ")]
    return dealt.mapInArrow(_assign(plan_packing(histogram, capacity, groups), edges, names), f"{schema}, sequence_id long, offset long")


def packed_sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, pieces): the tokens of each sequence and the (doc_id, piece, offset) in it; ``packed`` has ids. A group is one sequence, so it is bounded."""
    inside = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    grouped = packed.groupBy("sequence_id").agg(inside.alias("p"))
    return grouped.select("sequence_id", F.flatten("p.ids").alias("ids"), F.transform("p", lambda p: F.struct(p["doc_id"].alias("doc_id"), p["piece"].alias("piece"), p["offset"].alias("offset"))).alias("pieces"))

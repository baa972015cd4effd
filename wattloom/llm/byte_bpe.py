"""Byte-level BPE encoding and decoding with length-bucketed numpy matrices.

Pieces of equal length are rows of one matrix of token ids. Each round every row merges its leftmost pair of minimum
rank, found in a matrix of pair ranks; the merged column is removed, so all rows shrink together, and the two pairs
next to the merge are looked up again in a hash table. Rows without a mergeable pair leave. A task keeps the pieces it
has seen, up to a bound, so each is merged once. Pieces longer than a matrix row allows take an exact heap.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import slices

_NONE = 2**31 - 1


class PairTable:
    """Open-addressing hash table (left id, right id) -> rank, looked up for whole arrays."""

    def __init__(self, pairs: dict[tuple[int, int], int]):

        size = 1 << max(4, (3 * len(pairs)).bit_length())
        self.shift = np.uint64(64 - size.bit_length() + 1)
        self.mask = size - 1
        self.keys = np.full(size, -1, np.int64)
        self.ranks = np.full(size, _NONE, np.int32)
        keys = np.fromiter(((a << 32) | b for a, b in pairs), np.int64, len(pairs))
        ranks = np.fromiter(pairs.values(), np.int32, len(pairs))
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] == -1
            self.keys[slot[free]] = keys[free]
            done = self.keys[slot] == keys
            self.ranks[slot[done]] = ranks[done]
            keys, ranks, slot = keys[~done], ranks[~done], (slot[~done] + 1) & self.mask

    def _slot(self, keys):

        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, left, right):

        keys = (left.astype(np.int64) << 32) | right
        slot = self._slot(keys)
        found, out = self.keys[slot], self.ranks[slot]
        left_over = np.flatnonzero((found != keys) & (found != -1))
        out[(found != keys)] = _NONE
        while len(left_over):
            slot_now = (slot[left_over] + 1) & self.mask
            slot[left_over] = slot_now
            found = self.keys[slot_now]
            hit = found == keys[left_over]
            out[left_over[hit]] = self.ranks[slot_now[hit]]
            left_over = left_over[~hit & (found != -1)]
        return out


class ByteBpe:
    """Encoder and decoder for a rank file (a base64 token and its rank per line) and a splitting pattern."""

    def __init__(self, path: str, pattern: str, max_row: int = 256, cells: int = 1 << 20, max_pieces: int = 400_000):

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}
        self.tokens = {r: t for t, r in self.ranks.items()}
        self.split = regex.compile(pattern).findall
        get = self.ranks.get
        pairs = {}
        for token, rank in self.ranks.items():
            for k in range(1, len(token)):
                a, b = get(token[:k]), get(token[k:])
                if a is not None and b is not None:
                    pairs[a, b] = rank
        self.pairs, self.table = pairs, PairTable(pairs)
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.max_row, self.cells, self.max_pieces = max_row, cells, max_pieces
        self._forget()

    def _forget(self):

        self.known: dict[str, int] = {}
        self.flat, self.starts, self.sizes = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.used = 0

    def merge_rows(self, rows):
        """Merges every row of an (n, width) matrix of ids; the rows' final ids in their order, one array each."""

        n, width = rows.shape
        out: list = [None] * n
        who = np.arange(n)
        ids = rows
        ranks = self.table.find(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1)
        while True:
            at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(who), np.int64)
            best = ranks[np.arange(len(who)), at] if ranks.shape[1] else np.full(len(who), _NONE, np.int32)
            done = best == _NONE
            if done.any():
                for i, row in zip(who[done].tolist(), ids[done], strict=True):
                    out[i] = row
                live = ~done
                who, ids, ranks, at, best = who[live], ids[live], ranks[live], at[live], best[live]
            m = len(who)
            if not m:
                return out
            w, r = ids.shape[1], np.arange(m)
            ids[r, at] = best
            keep = np.ones((m, w), bool)
            keep[r, at + 1] = False
            ids = ids[keep].reshape(m, w - 1)
            keep = np.ones((m, w - 1), bool)
            keep[r, at] = False
            ranks = ranks[keep].reshape(m, w - 2)
            k = np.flatnonzero(at > 0)
            ranks[k, at[k] - 1] = self.table.find(ids[k, at[k] - 1], ids[k, at[k]])
            k = np.flatnonzero(at < w - 2)
            ranks[k, at[k]] = self.table.find(ids[k, at[k]], ids[k, at[k] + 1])

    def merge_long(self, piece: bytes) -> list[int]:
        """The same merges for one long piece, leftmost pair of minimum rank first, from a heap."""
        ids = self.byte_ids[list(piece)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        get = self.pairs.get
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := get((rank, ids[k]))) is not None:
                    heapq.heappush(heap, (r, i, rank, ids[k]))
            if (h := before[i]) >= 0 and (r := get((ids[h], rank))) is not None:
                heapq.heappush(heap, (r, h, ids[h], rank))
        return [x for x in ids if x >= 0]

    def _learn(self, pieces: list[str]) -> None:
        """Merges new pieces and stores their ids."""

        raw = [p.encode() for p in pieces]
        got: list = [None] * len(raw)
        by_size: dict[int, list[int]] = {}
        for i, b in enumerate(raw):
            rank = self.ranks.get(b)
            if rank is not None:
                got[i] = (rank,)
            elif len(b) > self.max_row:
                got[i] = self.merge_long(b)
            else:
                by_size.setdefault(len(b), []).append(i)
        for width, members in by_size.items():
            step = max(1, self.cells // width)
            for k in range(0, len(members), step):
                some = members[k : k + step]
                rows = self.byte_ids[np.frombuffer(b"".join([raw[i] for i in some]), np.uint8)].reshape(len(some), width)
                for i, ids in zip(some, self.merge_rows(rows), strict=True):
                    got[i] = ids
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        flat = np.concatenate([np.asarray(g, np.int32) for g in got])
        first, end = len(self.known), self.used + len(flat)
        if end > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(2 * end - self.used, np.int32)])
        if first + len(got) > len(self.starts):
            more = np.zeros(first + 2 * len(got), np.int64)
            self.starts, self.sizes = np.concatenate([self.starts[:first], more]), np.concatenate([self.sizes[:first], more])
        self.flat[self.used : end] = flat
        self.starts[first : first + len(got)] = self.used + np.cumsum(sizes) - sizes
        self.sizes[first : first + len(got)] = sizes
        self.known.update(zip(pieces, range(first, first + len(got)), strict=True))
        self.used = end

    def encode(self, texts: list[str]):
        """(ids, ends): the token ids of all texts one after another, and where each text's end."""

        parts = [self.split(t) for t in texts]
        pieces = [p for x in parts for p in x]
        if not pieces:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        if len(self.known) > self.max_pieces:
            self._forget()
        if new := list(set(pieces).difference(self.known)):
            self._learn(new)
        which = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))
        sizes = self.sizes[which]
        ends = np.cumsum(sizes)
        ids = self.flat[np.repeat(self.starts[which] - ends + sizes, sizes) + np.arange(ends[-1])]
        last = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
        return ids, np.r_[0, ends][last]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> ByteBpe:
    """The codec of a Python worker; it is built once and reused by later tasks."""
    return ByteBpe(path, pattern)


def _default(path: str | None, pattern: str | None) -> tuple[str, str]:
    if path and pattern:
        return path, pattern
    import public_tokenizers

    return path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN


def _encoded(batch, text: int, path: str, pattern: str):
    """(row, ids) of a batch, a few megabytes of text at a time."""
    column = batch.column(text)
    for start, stop in slices(batch, text, 1 << 20):
        texts = [t or "" for t in column.slice(start, stop - start).to_pylist()]
        ids, ends = codec(path, pattern).encode(texts)
        for k, (a, b) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)):
            yield start + k, ids[a:b]


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, ids array<int>): the token ids of every text; a null or empty text has none."""
    path, pattern = _default(path, pattern)

    def run(batches):

        for batch in batches:
            start, held = 0, []
            for row, ids in _encoded(batch, 1, path, pattern):
                held.append(ids)
                if sum(map(len, held[-1:])) > 1 << 20 or len(held) == 512 or row == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(held)), pa.array(held, pa.list_(pa.int32()))], names=["id", "ids"])
                    start, held = row + 1, []

    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>").withColumnRenamed("id", id_column)


def decode(encoded: DataFrame, path: str | None = None, pattern: str | None = None, id_column: str = "doc_id") -> DataFrame:
    """(id, content binary): the bytes of every row of token ids; null ids give null. Unknown ids fail."""
    path, pattern = _default(path, pattern)

    def run(batches):

        for batch in batches:
            tokens = codec(path, pattern)
            out = [None if x is None else tokens.decode(np.asarray(x, np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["id", "content"])

    rows = encoded.select(F.col(id_column).alias("id"), "ids")
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, content binary").withColumnRenamed("id", id_column)


def round_trip(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): every text encoded, its ids decoded again, both digested.

    The digests are made in the task that has the ids, so neither ids nor decoded bytes are moved. A null text counts
    as empty. Rows keep their number; other columns are not read; an empty table gives no rows.
    """
    path, pattern = _default(path, pattern)

    def run(batches):

        for batch in batches:
            n, encoded, decoded = [], [], []
            for _, ids in _encoded(batch, 1, path, pattern):
                n.append(len(ids))
                encoded.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                decoded.append(hashlib.sha256(codec(path, pattern).decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

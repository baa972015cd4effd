"""Exact dedup by Patricia-trie owners.

Rows are dealt by ranges of (content hash, byte length, doc_id, row number). A group of equal texts is contiguous in that
order, and because id and row number are part of it, a group that holds a third of all rows is spread over as many
partitions as it needs instead of meeting in one task, even if its rows repeat one id. Every partition inserts its full
byte strings into a compressed radix trie whose terminals keep the smallest identifier seen (the largest id is the
smallest in falling order) and a count; a trie that outgrows its memory bound moves its largest subtree to a file and
goes on. Only the first and the last key of a partition can go on in a neighbour; the owners of those, two or so a
partition, are merged by hash, length and SHA-256, and no text travels twice.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut


class _Spill:
    """A subtree in a file: the strings below a node, with the terminal they had or None if they came later."""

    def __init__(self, folder: str | None):
        self.file = tempfile.TemporaryFile(dir=folder)

    def add(self, key: bytes, term: int, owner: tuple | None) -> None:
        pickle.dump((key, term, owner), self.file, protocol=5)

    def __iter__(self):
        self.file.seek(0)
        while True:
            try:
                yield pickle.load(self.file)
            except EOFError:
                self.file.close()
                return


class _Node:
    __slots__ = ("label", "children", "term")

    def __init__(self, label: bytes, term: int = -1):
        self.label, self.children, self.term = label, {}, term


def _common(key: bytes, at: int, label: bytes) -> int:
    """Length of the common prefix of key[at:] and label."""
    low, high = 0, min(len(key) - at, len(label))
    step = 16
    while low < high and key[at + low : at + min(low + step, high)] == label[low : min(low + step, high)]:
        low, step = min(low + step, high), step * 2
    high = min(high, low + step)
    while low < high:
        mid = (low + high + 1) // 2
        if key[at + low : at + mid] == label[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


class PatriciaTrie:
    """Compressed radix trie over byte strings; each distinct string has a terminal in ``terms``: [smallest identifier, rows].

    ``memory`` bounds the bytes of its labels. Beyond it the largest subtree below the first fork goes to a file;
    ``settle`` reads such files again, each into a trie of its own with the same bound.
    """

    def __init__(self, memory: int = 128 << 20, folder: str | None = None, terms: list | None = None):
        self.root, self.memory, self.folder = _Node(b""), memory, folder
        self.bytes, self.spills = 0, []
        self.terms = [] if terms is None else terms  # shared with the tries of spilled subtrees

    def insert(self, key: bytes, owner: tuple, term: int = -1) -> int:
        """The terminal of ``key``, which ``owner`` now may own, or -1 if it is in a spilled subtree (settle then tells it by its owner).

        ``term`` is that of a string whose terminal there is already.
        """
        node, at = self.root, 0
        while True:
            if at == len(key):
                node.term = self._own(node.term, owner, term)
                return node.term
            child = node.children.get(key[at])
            if child is None:
                leaf = _Node(key[at:], self._own(-1, owner, term))
                node.children[key[at]] = leaf
                found = leaf.term
                self.bytes += len(leaf.label) + 200
                if self.bytes > self.memory:
                    self._spill()  # perhaps the leaf itself
                return found
            if key.startswith(child.label, at):
                at += len(child.label)
                if isinstance(child.children, _Spill):
                    child.children.add(key[at:], term, owner)
                    return -1
                node = child
                continue
            n = _common(key, at, child.label)
            middle = _Node(child.label[:n])
            middle.children[child.label[n]] = child
            child.label = child.label[n:]
            node.children[key[at]] = middle
            self.bytes += 200
            node, at = middle, at + n

    def _own(self, there: int, owner: tuple | None, term: int) -> int:
        if term >= 0:  # a string read back from a file; if another row came before it, that row's terminal joins this one
            if there >= 0 and there != term:
                raise AssertionError("a spilled string is read before the rows that came after it")
            return term
        if there < 0:
            self.terms.append([owner, 1])
            return len(self.terms) - 1
        known = self.terms[there]
        known[0], known[1] = min(known[0], owner), known[1] + 1
        return there

    def _spill(self) -> None:
        node = self.root
        while len(node.children) == 1 and node.term < 0:
            only = next(iter(node.children.values()))
            if isinstance(only.children, _Spill):
                return
            node = only
        sizes = {c: self._size(x) for c, x in node.children.items() if not isinstance(x.children, _Spill)}
        if not sizes:
            return
        top = node.children[max(sizes, key=sizes.get)]
        spill = _Spill(self.folder)
        stack = [(top, b"")]
        while stack:
            x, before = stack.pop()
            if x.term >= 0:
                spill.add(before, x.term, None)
            if isinstance(x.children, _Spill):
                for key, term, owner in x.children:
                    spill.add(before + key, term, owner)
                self.spills = [s for s in self.spills if s.children is not x.children]
            else:
                stack += [(y, before + y.label) for y in x.children.values()]
        self.bytes -= self._size(top)
        top.children, top.term = spill, -1
        self.spills.append(top)

    def _size(self, top: _Node) -> int:
        total, stack = 0, [top]
        while stack:
            x = stack.pop()
            total += len(x.label) + 200
            if not isinstance(x.children, _Spill):
                stack += x.children.values()
        return total

    def settle(self) -> Iterator[tuple[tuple, int]]:
        """(owner, terminal) of the rows that went to spilled subtrees."""
        self.root = _Node(b"")
        pending = [x.children for x in self.spills]
        self.spills = []
        for spill in pending:
            below = PatriciaTrie(self.memory, self.folder, self.terms)
            for key, term, owner in spill:
                got = below.insert(key, owner, term)
                if owner is not None and got >= 0:
                    yield owner, got
            yield from below.settle()


_LIGHT = "doc_id long, h long, n_bytes long, owner long, at long, is_owner boolean, group_size long, text_sha256 string, edge boolean"


def _own(smallest: bool, memory: int):
    """The task of a partition: one row per document with the owner its trie gave it."""

    def run(batches):

        trie = PatriciaTrie(memory)
        ids, hashes, sizes, terms, ats = [], [], [], [], []
        rows: dict[int, int] = {}  # of rows in spilled subtrees, by their row number
        shas: dict[int, str] = {}
        waiting: dict[int, str] = {}
        for batch in batches:
            cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            texts = cols["text"].cast(pa.binary()).to_pylist()
            for doc, h, n, at, text in zip(cols["doc_id"].to_pylist(), cols["h"].to_pylist(), cols["n_bytes"].to_pylist(), cols["at"].to_pylist(), texts, strict=True):
                # identifiers in the order of preference; rows without an id come last, rows with the same id by their number
                term = trie.insert(text, (doc is None, (doc or 0) * (1 if smallest else -1), at))
                if term < 0:
                    rows[at] = len(ids)
                    waiting[len(ids)] = hashlib.sha256(text).hexdigest()
                elif term not in shas:
                    shas[term] = hashlib.sha256(text).hexdigest()
                ids.append(doc)
                hashes.append(h)
                sizes.append(n)
                terms.append(term)
                ats.append(at)
        for owner, term in trie.settle():
            row = rows[owner[2]]
            terms[row] = term
            shas[term] = waiting[row]
        keys = list(zip(hashes, sizes, strict=True))
        low, high = min(keys, default=None), max(keys, default=None)
        for start in range(0, len(ids), 8192):
            out = {n.split()[0]: [] for n in _LIGHT.split(", ")}
            for row in range(start, min(start + 8192, len(ids))):
                (none, best, at), count = trie.terms[terms[row]]
                owner = None if none else best if smallest else -best
                values = (ids[row], *keys[row], owner, at, ats[row] == at, count, shas[terms[row]], keys[row] in (low, high))
                for name, value in zip(out, values, strict=True):
                    out[name].append(value)
            types = [pa.int64()] * 5 + [pa.bool_(), pa.int64(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], names=list(out))

    return run


def exact_dedup(docs: DataFrame, keep: str = "largest", memory: int = 128 << 20) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their UTF-8 bytes are; a null text counts as empty. Of equal texts the row with the
    ``keep`` ("largest" or "smallest") doc_id stays; rows without an id stay only if no row of their group has one,
    and of rows repeated with the same id exactly one stays. Texts of any length are read whole. Columns other than
    doc_id and text are not read, so they may have any name. An empty table gives no rows.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError("keep is 'largest' or 'smallest'")
    smallest = keep == "smallest"
    text = F.coalesce(F.col("text"), F.lit(""))
    dealt = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), F.octet_length(text).cast("long").alias("n_bytes"), F.monotonically_increasing_id().alias("at"), text.alias("text")
    ).repartitionByRange("h", "n_bytes", "doc_id", "at")
    light = cut(dealt.mapInArrow(_own(smallest, memory), _LIGHT))
    inner = light.where("not edge").select("doc_id", F.col("owner").alias("keep_id"), "group_size", F.col("is_owner").alias("kept"), "text_sha256")
    order = F.struct(F.col("owner").isNull().alias("none"), (F.col("owner") if smallest else F.bitwise_not("owner")).alias("rank"), "at", "owner")
    owners = light.where("edge and is_owner").groupBy("h", "n_bytes", "text_sha256").agg(F.min(order).alias("best"), F.sum("group_size").alias("total"))
    # The first and the last key of each partition: two rows or so a partition, whatever the table's size.
    edge = light.where("edge").join(F.broadcast(owners), ["h", "n_bytes", "text_sha256"])
    edge = edge.select("doc_id", F.col("best.owner").alias("keep_id"), F.col("total").alias("group_size"), (F.col("is_owner") & (F.col("at") == F.col("best.at"))).alias("kept"), "text_sha256")
    return inner.unionByName(edge)

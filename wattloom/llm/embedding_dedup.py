"""Embedding near-dedup by product quantisation.

Unit vectors go into coarse inverted lists, and a list stores each vector once, with the code of its residual, one
codeword per subspace. A query probes the lists whose cells are nearest to it (leaving out those that cannot hold a vector
within the threshold distance), reads approximate distances from a table of its subspace distances to the codewords, and keeps
what the stored quantisation error cannot rule out; the exact cosine in double precision decides. A pair is found if
either of the two has the other's list among its probes, and it counts for both, once. The number of probes is all that
may lose a link.

Lists are kept per label and vector length, and vectors travel as the bytes of their source type. A list of more than a
tile's vectors or queries is dealt into tiles of bounded size, so a hot list is many tiles. A tile returns link counts
and a spanning forest of its links, never all pairs; equal vectors are one stored vector with a count.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut
from .components import connected_components


def _kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = (np.einsum("ij,ij->i", centres, centres)[None] - 2 * x @ centres.T).argmin(axis=1)
        for c in range(len(centres)):
            mine = x[near == c]
            centres[c] = mine.mean(axis=0) if len(mine) else x[rng.integers(len(x))]
    return centres


@dataclass(frozen=True)
class Quantiser:
    """centres (lists, d); books (subspaces, codewords, d / subspaces)."""

    centres: np.ndarray
    books: np.ndarray

    def nearest(self, x: np.ndarray) -> np.ndarray:
        return (np.einsum("ij,ij->i", self.centres, self.centres)[None] - 2 * x @ self.centres.T).argmin(axis=1)

    def probes(self, x: np.ndarray, own: np.ndarray, reach: float, most: int) -> np.ndarray:
        """(n, k) lists, k = ``most`` at most, by the distance of x to the plane between its own cell and theirs; its own comes first, and -1 stands for a list whose cell can hold no vector within ``reach`` of x."""
        c = self.centres
        norms = (c * c).sum(1)
        square = norms[None] - 2 * x @ c.T
        between = np.sqrt(np.maximum(norms[:, None] + norms[None] - 2 * c @ c.T, 1e-18))
        away = (square - square[np.arange(len(x)), own][:, None]) / (2 * between[own])
        away[np.arange(len(x)), own] = -1.0
        k = min(most, len(c))
        near = np.argpartition(away, k - 1, axis=1)[:, :k] if k < len(c) else np.tile(np.arange(len(c)), (len(x), 1))
        near = np.take_along_axis(near, np.argsort(np.take_along_axis(away, near, 1), axis=1, kind="stable"), 1)
        return np.where(np.take_along_axis(away, near, 1) <= reach + 1e-9, near, -1)

    def encode(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes (n, subspaces) of the residuals, and the length of what the codes miss."""
        m, _, sub = self.books.shape
        residual = (x - self.centres[own]).reshape(len(x), m, sub)
        codes = np.empty((len(x), m), np.uint8)
        rebuilt = np.empty_like(residual)
        for j in range(m):
            book = self.books[j]
            codes[:, j] = ((book * book).sum(1)[None] - 2 * residual[:, j] @ book.T).argmin(axis=1)
            rebuilt[:, j] = book[codes[:, j]]
        return codes, np.sqrt(((residual - rebuilt) ** 2).sum(axis=(1, 2)))


def fit_quantiser(vectors: np.ndarray, lists: int, subspaces: int = 8, codewords: int = 64) -> Quantiser:
    lists = max(1, min(lists, len(vectors)))
    d = vectors.shape[1]
    while d % subspaces:
        subspaces -= 1
    centres = _kmeans(vectors, lists)
    own = Quantiser(centres, np.zeros((1, 1, d))).nearest(vectors)
    residual = (vectors - centres[own]).reshape(len(vectors), subspaces, d // subspaces)
    books = np.stack([_kmeans(residual[:, j], min(codewords, len(vectors))) for j in range(subspaces)])
    return Quantiser(centres, books)


def _decoded(raw, kind: str, size: int) -> np.ndarray:
    """Unit vectors in double precision; a vector is scaled by its largest component first, so that no square overflows."""
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), size).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class _Forest:
    """Spanning forest of links among n nodes, fed block by block."""

    def __init__(self, n: int):
        self.parent = np.arange(n)
        self.edges: list[np.ndarray] = []

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            u, v = self.parent[a], self.parent[b]
            differ = u != v
            a, b, high, low = a[differ], b[differ], np.maximum(u, v)[differ], np.minimum(u, v)[differ]
            if not len(a):
                return
            _, first = np.unique(high, return_index=True)  # one link below each root
            self.edges.append(np.stack([a[first], b[first]], axis=1))
            self.parent[high[first]] = low[first]
            while (self.parent[self.parent] != self.parent).any():
                self.parent = self.parent[self.parent]


def _links_of_tile(model: Quantiser, here: int, x, q, codes, missed, x_reps, q_reps, x_n, q_n, both, cosine: float, reach: float):
    """(links of each query, links of each stored vector, forest) of one tile.

    ``both`` (stored, queries) is called with pairs and says which of them are also found the other way round, with
    the stored vector as query; such a pair counts for its query only.
    """
    m, _, sub = model.books.shape
    of_q, of_x = np.zeros(len(q), np.int64), np.zeros(len(x), np.int64)
    ids, node = np.unique(np.r_[q_reps, x_reps], return_inverse=True)
    forest = _Forest(len(ids))
    for k in range(0, len(q), 256):
        some = q[k : k + 256]
        residual = (some - model.centres[here]).reshape(len(some), m, sub)
        approximate = np.zeros((len(some), len(x)), np.float32)
        for j in range(m):
            lookup = ((residual[:, j, None, :] - model.books[j][None]) ** 2).sum(axis=2).astype(np.float32)
            approximate += lookup[:, codes[:, j]]
        a, b = np.nonzero(approximate <= (reach + missed[None] + 1e-4) ** 2)
        differ = q_reps[k + a] != x_reps[b]
        a, b = a[differ], b[differ]
        exact = np.concatenate([np.einsum("ij,ij->i", some[a[i : i + 65536]], x[b[i : i + 65536]]) for i in range(0, len(a), 65536)] or [np.zeros(0)])
        a, b = a[exact >= cosine] + k, b[exact >= cosine]
        np.add.at(of_q, a, x_n[b])
        once = ~both(b, a)
        np.add.at(of_x, b[once], q_n[a[once]])
        forest.add(node[a], node[len(q) + b])
    edges = np.concatenate(forest.edges or [np.zeros((0, 2), np.int64)])
    return of_q, of_x, ids[edges]


def embedding_dedup(
    vectors: DataFrame, cosine: float = 0.93, lists: int | None = None, probes: int = 4, subspaces: int = 8, codewords: int = 64, sample_rows: int = 8192, tile: int = 2048,
    fitted_lengths: int = 16, broadcast_rows: int = 200_000,
) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    Vectors with equal, non-null labels link at ``cosine`` or above, in double precision. Vectors that are null, zero
    or hold null or non-finite components link with nothing. Vectors of different lengths don't link, and each length has
    lists of its own: the ``fitted_lengths`` most common ones have a quantiser each, fitted on ``sample_rows`` vectors at
    most, chosen by a hash; the vectors of any other length are one list per label, in tiles like every list. Every
    vector is indexed. ``lists`` follows the square root of the number of vectors per label and length unless given, and a
    vector is looked for in the ``probes`` whose cells are nearest. Equal vectors are linked with each other; a repeated row counts
    as another vector. Rows without an id link with nothing and are not kept; rows with the same id are one node. Other
    columns are not read; an empty table gives no rows.
    """
    element = vectors.schema["embedding"].dataType.elementType.simpleString()
    kind = "<f4" if element == "float" else "<f8"
    label_type = vectors.schema["label"].dataType.simpleString()
    reach = float(np.sqrt(2 - 2 * cosine))

    def pack(batches):
        for batch in batches:
            column, n = batch.column(2), batch.num_rows
            ends = np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(column), 0)))
            flat = column.flatten()
            values = np.asarray(pc.fill_null(flat, float("nan")), kind)
            wrong = np.r_[0, np.cumsum(~np.isfinite(values))]
            some = np.r_[0, np.cumsum(values != 0)]
            starts = np.r_[0, ends[:-1]].astype(int)
            fit = (wrong[ends] == wrong[starts]) & (some[ends] > some[starts]) & np.asarray(batch.column(0).is_valid()) & np.asarray(batch.column(1).is_valid())
            raw = [values[a:b].tobytes() if ok else None for a, b, ok in zip(starts.tolist(), ends.tolist(), fit.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(raw, pa.binary()), pa.array((ends - starts).astype(np.int32) if n else [], pa.int32())], names=["vec_id", "label", "v", "size"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), F.col("embedding").cast(f"array<{'float' if kind == '<f4' else 'double'}>").alias("embedding"))
    packed = rows.mapInArrow(pack, f"vec_id long, label {label_type}, v binary, size int")
    keyed = packed.withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(29), "v"))
    group = ["label", "size", "h1", "h2"]
    groups = cut(keyed.where("v is not null").groupBy(*group, "v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n")))

    models = {}
    common = groups.groupBy("size").agg(F.count(F.lit(1)).alias("total"), F.count_distinct("label").alias("labels")).orderBy(F.desc("total"), "size").limit(fitted_lengths)
    for size, total, labels in common.collect():
        share, same = min(1.0, sample_rows / total), groups.where(F.col("size") == size)
        sample = same.where(F.pmod(F.xxhash64(F.lit(5), "rep"), F.lit(1_000_000)) < int(share * 1_000_000) + 1).select("v").limit(sample_rows).collect() or same.select("v").limit(1).collect()
        models[size] = fit_quantiser(_decoded([r["v"] for r in sample], kind, size), lists or max(1, round((total / labels) ** 0.5 / 4)), subspaces, codewords)

    def model_of(size: int) -> Quantiser:
        # one list and one codeword at the origin rule nothing out, so every pair of the list is compared
        return models[size] if size in models else Quantiser(np.zeros((1, size)), np.zeros((1, 1, size)))

    def assign(batches):
        for mixed in batches:
            sizes = np.asarray(mixed.column(1))
            for size in np.unique(sizes).tolist():
                batch = mixed.take(pa.array(np.flatnonzero(sizes == size)))
                model, x = model_of(size), _decoded(batch.column(2).to_pylist(), kind, size)
                own = model.nearest(x)
                codes, missed = model.encode(x, own)
                probed = model.probes(x, own, reach, probes)
                yield pa.RecordBatch.from_arrays([
                    *batch.columns, pa.array(own.astype(np.int32)), pa.array([r[r >= 0].astype(np.int32) for r in probed], pa.list_(pa.int32())),
                    pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(missed.astype(np.float32)),
                ], names=["label", "size", "v", "rep", "n", "list", "probed", "code", "missed"])

    indexed = cut(groups.select("label", "size", "v", "rep", "n").mapInArrow(assign, f"label {label_type}, size int, v binary, rep long, n long, list int, probed array<int>, code binary, missed float"))
    stored = indexed.select("label", "size", "list", "rep", "n", "v", "probed", "code", "missed")
    queries = indexed.select("label", "size", F.explode("probed").alias("list"), "rep", "n", "v", F.col("list").alias("home"))

    # A list of more than one tile has its stored vectors and its queries dealt over numbered tiles; other lists are one.
    list_key = ["label", "size", "list"]
    counts = lambda df, name: df.groupBy(*list_key).agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias(name))
    grid = cut(counts(stored, "x_tiles").join(counts(queries.select(*list_key), "q_tiles"), list_key).where("x_tiles > 1 or q_tiles > 1"))
    large = F.broadcast(grid) if grid.count() <= broadcast_rows else grid
    part = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), "rep"), F.coalesce(F.col(n), F.lit(1))).cast("int")
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(F.col(n), F.lit(1)) - 1))
    left = stored.join(large, list_key, "left").select(*stored.columns, part("x_tiles", 1).alias("xt"), copies("q_tiles").alias("qt"))
    right = queries.join(large, list_key, "left").select(*queries.columns, part("q_tiles", 2).alias("qt"), copies("x_tiles").alias("xt"))
    right = right.toDF(*[f"q_{c}" for c in right.columns])

    def run(key, x_tile: pd.DataFrame, q_tile: pd.DataFrame) -> pd.DataFrame:
        if not len(x_tile) or not len(q_tile):
            return pd.DataFrame({"rep": [], "other": [], "links": []})
        size, here = int(key[1]), int(key[2])
        model = model_of(size)
        homes, probed = q_tile["q_home"].to_numpy(), x_tile["probed"].to_numpy()
        width = max(map(len, probed))
        asked = np.array([np.r_[p, np.full(width - len(p), -1)] for p in probed])
        of_q, of_x, edges = _links_of_tile(
            model, here, _decoded(x_tile["v"], kind, size), _decoded(q_tile["q_v"], kind, size), np.frombuffer(b"".join(x_tile["code"]), np.uint8).reshape(len(x_tile), -1), x_tile["missed"].to_numpy(),
            x_tile["rep"].to_numpy(), q_tile["q_rep"].to_numpy(), x_tile["n"].to_numpy(), q_tile["q_n"].to_numpy(), lambda i, j: (asked[i] == homes[j][:, None]).any(axis=1), cosine, reach,
        )
        reps, links = np.r_[q_tile["q_rep"].to_numpy(), x_tile["rep"].to_numpy()], np.r_[of_q, of_x]
        some = links > 0
        return pd.DataFrame({"rep": np.r_[reps[some], edges[:, 0]], "other": pd.array([pd.NA] * int(some.sum()) + edges[:, 1].tolist(), "Int64"), "links": np.r_[links[some], np.zeros(len(edges), np.int64)]})

    key = [*list_key, "xt", "qt"]
    found = cut(left.groupBy(*key).cogroup(right.groupBy(*[f"q_{c}" for c in key])).applyInPandas(run, "rep long, other long, links long"))
    linked = found.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = connected_components(found.where("other is not null").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    reps = groups.select(*group, "rep", "n").join(linked, "rep", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    reps = cut(reps.select(*group, (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("c"), F.lit(True).alias("usable")))
    joined = keyed.withColumn("usable", F.col("v").isNotNull()).select("vec_id", *group, "usable").join(reps, [*group, "usable"], "left")
    own = F.coalesce("c", "vec_id")
    return joined.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(F.col("vec_id") == own, F.lit(False)).alias("kept")
    )

"""Centroid clustering over a vector-approximation file (VA-file).

Every vector is kept twice: whole, and as one small cell number per dimension.  Cells are cut at
quantiles of all values, found from a histogram of bounded size.  In a round of clustering the tasks read only
the cells; tables of centroid, dimension and cell give, by look-up and sum, an interval for the
distance to each centroid (less a part that is the same for all centroids, so intervals stay
narrow).  Where one centroid's interval lies under all others, its vector is assigned without having been
read.  Whole vectors are fetched where intervals overlap, or where the centroid has changed: the
sums of the clusters are carried on by what moves, so nothing is kept per vector between rounds.

The whole vectors lie in a bucketed table, so a fetch shuffles the numbers of the wanted rows and
never the vectors.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bucketed, staged
from .vectors import dense, steps

#: Bits of a cell number at most: one byte per dimension.
BITS = 8
#: Components are held within this range, so that squared distances fit in 64 bits.
LIMIT = 1 << 26


def _image(v: np.ndarray) -> np.ndarray:
    """A monotone image of integers with some 2,800 values: fine near zero, coarse far from it."""
    return (np.sign(v) * np.floor(64 * np.log2(1 + np.abs(v) / 16))).astype(np.int32)


class Cells:
    """Cell boundaries per dimension and the exact range of every cell."""

    def __init__(self, edges: list[np.ndarray], least: np.ndarray, most: np.ndarray):
        self.edges = edges
        self.low = [np.concatenate([[least[j]], e]) for j, e in enumerate(edges)]
        self.high = [np.concatenate([e - 1, [most[j]]]) for j, e in enumerate(edges)]

    def of(self, x: np.ndarray) -> np.ndarray:
        """Cell numbers of integer vectors, a byte for each component."""
        out = np.empty(x.shape, np.uint8)
        for j, e in enumerate(self.edges):
            out[:, j] = np.searchsorted(e, x[:, j], "right")
        return out

    def tables(self, centroids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per dimension the least and greatest value, over each cell, of ``(x - c)**2 - (x - m)**2`` for
        every centroid c, m being near their mean: the distance less the part that all have in common."""
        middle = centroids.sum(axis=0) // len(centroids)
        out = []
        for j, (low, high) in enumerate(zip(self.low, self.high, strict=True)):
            c, m = centroids[:, j], middle[j]
            at = lambda x, c=c, m=m: c * c - m * m - 2 * x[:, None] * (c - m)
            a, b = at(low), at(high)
            out.append((np.minimum(a, b), np.maximum(a, b)))
        return out


def candidates(cells: np.ndarray, tables: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For every vector and centroid, whether it can be the nearest: its interval begins no higher than the
    lowest end of all."""
    k = tables[0][0].shape[1]
    low, high = np.zeros((len(cells), k), np.int64), np.zeros((len(cells), k), np.int64)
    for j, (a, b) in enumerate(tables):
        low += a[cells[:, j]]
        high += b[cells[:, j]]
    return low <= high.min(axis=1, keepdims=True)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (ties: the smaller) and the squared distance."""
    d = np.stack([((x - c) ** 2).sum(axis=1) for c in centroids], axis=1)
    best = d.argmin(axis=1)
    return best, d[np.arange(len(x)), best]


#: Added to components when written as unsigned big-endian numbers, whose bytes sort as the components do.
_BIAS = 1 << 31


def _matrix(column: pa.Array, kind, width: int) -> np.ndarray:
    """A binary column of equally long values as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _whole(column: pa.Array, dims: int) -> np.ndarray:
    return _matrix(column, ">u4", dims).astype(np.int64) - _BIAS


def _binary(x: np.ndarray) -> pa.Array:
    body, width = np.ascontiguousarray(x).tobytes(), x.shape[1] * x.itemsize
    ends = np.arange(len(x) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(body)])


def _sums(parts: DataFrame, dims: int) -> dict[int, tuple[int, list[int]]]:
    """Partial ``cluster, n, sums`` of the tasks added up: a row for each cluster reaches the driver."""
    total = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[j]) for j in range(dims)]).alias("sums"))
    return {r["cluster"]: (r["n"], r["sums"]) for r in total.collect()}


def _per_cluster(cluster: np.ndarray, x: np.ndarray, sign: int, k: int, total: np.ndarray, n: np.ndarray) -> None:
    for c in range(k):
        mine = cluster == c
        if mine.any():
            total[c] += sign * x[mine].sum(axis=0)
            n[c] += sign * int(mine.sum())


_PARTS = "cluster int, n long, sums array<long>"


def _emit(total: np.ndarray, n: np.ndarray):
    used = np.flatnonzero((n != 0) | total.any(axis=1))
    sums = pa.array([total[c].tolist() for c in used], pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(n[used]), sums], ["cluster", "n", "sums"])


def approximate(vectors: DataFrame, vector: str, key: str, dims: int, scale: int, bits: int = BITS) -> tuple[DataFrame, Cells | None]:
    """The VA-file of the usable vectors: a bucketed table ``id, cells, vec, row, name`` (``row``: all other
    columns; ``name``: the key as text) and the cells.  No usable vector: no cells."""
    if not 1 <= bits <= BITS:
        raise ValueError(f"bits must be 1 to {BITS}")
    others = [vectors[c] for c in vectors.columns if c != vector]
    rows = vectors.select(F.struct(*others).alias("row"), F.coalesce(vectors[key].cast("string"), F.lit("")).alias("name"), vectors[vector].alias("vec"))
    out = T.StructType([rows.schema["row"], rows.schema["name"], T.StructField("vec", T.BinaryType())])

    def whole(batches):
        for batch in batches:
            use, x = dense(batch.column("vec"), dims)
            at = pa.array(use)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row").take(at), batch.column("name").take(at), _binary((steps(x, scale, LIMIT) + _BIAS).astype(">u4"))], ["row", "name", "vec"]
            )

    kept = staged(rows.mapInArrow(whole, out).withColumn("id", F.monotonically_increasing_id()), "va-vectors")

    def histogram(batches):
        seen: dict[int, list] = {}
        for batch in batches:
            x = _whole(batch.column(0), dims)
            for j in range(dims):
                bins, place, n = np.unique(_image(x[:, j]), return_index=True, return_counts=True)
                low, high = np.full(len(bins), np.iinfo(np.int64).max), np.full(len(bins), np.iinfo(np.int64).min)
                at = np.searchsorted(bins, _image(x[:, j]))
                np.minimum.at(low, at, x[:, j])
                np.maximum.at(high, at, x[:, j])
                for b, c, lo, hi in zip(bins.tolist(), n.tolist(), low.tolist(), high.tolist(), strict=True):
                    cell = seen.setdefault((j, b), [0, lo, hi])
                    cell[0], cell[1], cell[2] = cell[0] + c, min(cell[1], lo), max(cell[2], hi)
        names = list(seen)
        cols = [[n[0] for n in names], [n[1] for n in names], *([seen[n][i] for n in names] for i in range(3))]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["dim", "bin", "n", "low", "high"])

    counts = kept.select("vec").mapInArrow(histogram, "dim int, bin int, n long, low long, high long")
    found = counts.groupBy("dim", "bin").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).toArrow()
    found = found.sort_by([("dim", "ascending"), ("bin", "ascending")])
    dim, n, low, high = (found[c].to_numpy() for c in ("dim", "n", "low", "high"))
    if not len(dim):
        return kept.withColumn("cells", F.lit(None).cast("binary")), None
    edges, least, most = [], np.zeros(dims, np.int64), np.zeros(dims, np.int64)
    for j in range(dims):
        own = dim == j
        share = np.cumsum(n[own]) / n[own].sum()
        # a cell begins where the share of the values before it reaches the next quantile
        first = np.searchsorted(share, np.arange(1, 1 << bits) / (1 << bits), "left") + 1
        edges.append(np.unique(low[own][first[first < own.sum()]]))
        least[j], most[j] = low[own].min(), high[own].max()
    cells = Cells(edges, least, most)
    packed = T.StructType([*kept.schema.fields, T.StructField("cells", T.BinaryType())])

    def pack(batches):
        for batch in batches:
            x = _whole(batch.column(batch.schema.get_field_index("vec")), dims)
            yield pa.RecordBatch.from_arrays([*batch.columns, _binary(cells.of(x))], [*batch.schema.names, "cells"])

    return bucketed(kept.mapInArrow(pack, packed), "id", "va_file"), cells


def cluster_vectors(
    vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, dims: int = 64, scale: int = 1024, key: str = "vec_id", vector: str = "embedding", bits: int = BITS
) -> tuple[DataFrame, np.ndarray]:
    """Integer k-means of the vectors with exactly ``dims`` finite components, taken as ``floor(scale * x)``.

    Centroids start as the ``k`` vectors of smallest ``sha256('<seed>:<key>')``; each round assigns every vector to the
    nearest centroid (ties: the smaller number) and moves centroids to the floor of the mean; empty ones stay.

    Returns ``row`` (struct of all columns but the vector), ``cluster`` and ``distance`` (squared), and the final
    centroids.  Other vectors are left out; null keys count as empty text; equal keys are ordered by their vectors
    and every row is a vector of its own; with fewer than ``k`` vectors there are as many centroids; an empty table gives an empty
    result; components beyond 2**26 are held there.  Extra columns of any name are carried in ``row``."""
    if min(k, dims) < 1:
        raise ValueError("k and dims must be positive")
    table, cells = approximate(vectors, vector, key, dims, scale, bits)
    out = T.StructType([table.schema["row"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    if cells is None:
        return vectors.sparkSession.createDataFrame([], out), np.zeros((0, dims), np.int64)
    chosen = table.select(F.sha2(F.concat(F.lit(f"{seed}:"), "name"), 256).alias("h"), "vec").orderBy("h", "vec").limit(k)
    centroids = _whole(pa.array([r["vec"] for r in chosen.collect()], pa.binary()), dims)
    k = len(centroids)

    def everything(batches, centroids=centroids):
        total, n = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            x = _whole(batch.column(0), dims)
            _per_cluster(nearest(x, centroids)[0], x, 1, k, total, n)
        yield _emit(total, n)

    n, total = [0] * k, [[0] * dims for _ in range(k)]

    def take(parts):
        for c, (count, sums) in _sums(parts, dims).items():
            n[c] += count
            total[c] = [a + b for a, b in zip(total[c], sums, strict=True)]

    for turn in range(rounds):
        if turn == 0:
            take(table.select("vec").mapInArrow(everything, _PARTS))
        else:
            take(_moves(table, cells, before, centroids, dims))
        before = centroids
        centroids = np.array([[s // n[c] for s in total[c]] if n[c] else before[c].tolist() for c in range(k)], np.int64)
        if (centroids == before).all():
            break  # every further round would find the same

    tables = cells.tables(centroids)

    def last(batches):
        for batch in batches:
            x = _whole(batch.column("vec"), dims)
            may = candidates(_matrix(batch.column("cells"), np.uint8, dims), tables)
            best = may.argmax(axis=1)
            open_ = np.flatnonzero(may.sum(axis=1) > 1)
            best[open_] = nearest(x[open_], centroids)[0]
            distance = ((x - centroids[best]) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(best.astype(np.int32)), pa.array(distance)], ["row", "cluster", "distance"])

    return table.select("row", "vec", "cells").mapInArrow(last, out), centroids


def _moves(table: DataFrame, cells: Cells, before: np.ndarray, now: np.ndarray, dims: int) -> DataFrame:
    """What the clusters' counts and sums gain and lose between two sets of centroids.

    The cells tell which vectors are surely assigned alike by both sets; only the others are fetched."""
    old, new = cells.tables(before), cells.tables(now)
    k = len(now)

    def doubtful(batches):
        for batch in batches:
            c = _matrix(batch.column("cells"), np.uint8, dims)
            a, b = candidates(c, old), candidates(c, new)
            same = (a.sum(axis=1) == 1) & (b.sum(axis=1) == 1) & (a.argmax(axis=1) == b.argmax(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column("id").filter(pa.array(~same))], ["wanted"])

    def moved(batches):
        total, n = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            x = _whole(batch.column(0), dims)
            a, b = nearest(x, before)[0], nearest(x, now)[0]
            go = a != b
            _per_cluster(a[go], x[go], -1, k, total, n)
            _per_cluster(b[go], x[go], 1, k, total, n)
        yield _emit(total, n)

    wanted = table.select("id", "cells").mapInArrow(doubtful, "wanted long")
    fetched = table.select("id", "vec").join(wanted, F.col("id") == F.col("wanted")).select("vec")
    return fetched.mapInArrow(moved, _PARTS)


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Adds ``cluster_inertia`` and ``inertia`` (distances summed over the cluster and over all; null beyond 64
    bits) and ``centroid_sha256`` (of the centroid's components as decimal integers joined by commas)."""
    found = staged(assigned, "va-assigned")
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    fits = lambda s: s if s < 1 << 63 else None
    per = F.array(*[F.lit(fits(sums.get(c, 0))).cast("long") for c in range(len(centroids))])
    names = F.array(*[F.lit(hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for c in centroids])
    if not len(centroids):
        per, names = F.array(F.lit(0).cast("long")), F.array(F.lit(""))
    at = F.col("cluster")
    return found.select(
        "*", F.get(per, at).alias("cluster_inertia"), F.lit(fits(sum(sums.values()))).cast("long").alias("inertia"), F.get(names, at).alias("centroid_sha256")
    )

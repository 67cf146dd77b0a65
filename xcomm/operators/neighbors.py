"""Exact k nearest neighbours as joins of bounded tiles (C4 beyond the bound of one matrix).

Labelled and asked rows are dealt to the nearest of a few pivots; a cell knows its radius and size.  An asked row is
compared with its own cell first, which bounds the distance of its k-th neighbour.  A second round compares it with those
other cells only that can hold a nearer row: by the triangle inequality (the cell's ball is near enough) and by the plane
between the two pivots (no row of a cell lies on the other side of it).  Asked rows and cells are cut in tiles of
bounded size, and every pair of tiles is a row of one evenly dealt join.  Inside it a matrix product finds the rows
that may be among the k nearest, and only their distances are computed exactly.

Equal labelled rows are kept once with their number (up to k), so groups of copies make no tiles of their own.  Rows
with an entry that is not finite have no distances: they are no one's neighbours and have none.

The driver sees the pivots (``PIVOTS`` at most), and size and radius of each cell.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged

#: Rows of a tile on average: two of them are the memory of one comparison.
BLOCK = 8192
PIVOTS = 1024
#: Asked rows that are compared with a tile at once.
ROWS = 64
#: Numbers of one temporary array when rows meet the pivots.
_NUMBERS = 1 << 21
_NEAR = "id long, near array<struct<d:double,y:int>>"


def _matrix(column: pa.Array, p: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, p)


def _squares(x: np.ndarray, pivots: np.ndarray):
    """Slices of ``x`` with the squared distances to all pivots."""
    step = max(1, _NUMBERS // pivots.size)
    for k in range(0, len(x), step):
        yield slice(k, k + step), ((x[k : k + step, None, :] - pivots[None]) ** 2).sum(2)


def _dealt(rows: DataFrame, pivots: np.ndarray, name: str) -> DataFrame:
    """``rows`` (``x`` and more) with the number of the nearest pivot and the distance to it."""
    p = pivots.shape[1]

    def nearest(batches):
        for batch in batches:
            x = _matrix(batch.column(batch.schema.get_field_index("x")), p)
            cell, away = np.zeros(len(x), np.int32), np.zeros(len(x))
            for at, d in _squares(x, pivots):
                cell[at], away[at] = d.argmin(1), np.sqrt(d.min(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(away)], [*batch.schema.names, "cell", "away"])

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema), "cell int, away double"])
    return staged(rows.mapInArrow(nearest, schema), name)


def _sizes(dealt: DataFrame, cells: int) -> tuple[np.ndarray, np.ndarray]:
    n, radius = np.zeros(cells, np.int64), np.zeros(cells)
    for r in dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("r")).collect():
        n[r["cell"]], radius[r["cell"]] = r["n"], r["r"]
    return n, radius


def near_cells(pivots: np.ndarray, asked: tuple, known: tuple, k: int) -> list[tuple[int, int]]:
    """Pairs (asked cell, labelled cell) that may hold one of the k nearest rows of an asked one."""
    (n_asked, r_asked), (n_known, r_known) = asked, known
    between = _between(pivots)
    full = np.flatnonzero(n_known)
    pairs = []
    for q in np.flatnonzero(n_asked).tolist():
        reach = between[q, full] + r_known[full]
        order = np.argsort(reach, kind="stable")
        enough = np.searchsorted(np.cumsum(n_known[full][order]), k)
        # every asked row of the cell has k labelled ones within this distance
        within = r_asked[q] + reach[order[min(enough, len(full) - 1)]]
        least = between[q, full] - r_asked[q] - r_known[full]
        pairs += [(q, t) for t in full[least <= within * (1 + 1e-9) + 1e-12].tolist()]
    return pairs


def _between(pivots: np.ndarray) -> np.ndarray:
    out = np.zeros((len(pivots), len(pivots)))
    for at, d in _squares(pivots, pivots):
        out[at] = np.sqrt(d)
    return out


def _other_cells(rows: DataFrame, pivots: np.ndarray, radius: np.ndarray, pairs: list[tuple[int, int]], k: int) -> DataFrame:
    """``rows`` (``id, x, cell, near``: what the own cell gave) with ``bound``, the squared distance of the k-th row so
    far (infinite without k rows), and ``others``, the other cells that may hold a nearer one."""
    p, allowed, between = pivots.shape[1], np.zeros((len(pivots), len(pivots)), bool), _between(pivots)
    for q, t in pairs:
        allowed[q, t] = q != t

    def choose(batches):
        for batch in batches:
            ids, xs, cells, bounds = (batch.column(batch.schema.get_field_index(c)) for c in ("id", "x", "cell", "bound"))
            x, cell, bound = _matrix(xs, p), cells.to_numpy(), bounds.to_numpy()
            counts, found = [], []
            for at, d in _squares(x, pivots):
                own, limit = cell[at], np.sqrt(bound[at])[:, None] * (1 + 1e-9) + 1e-12
                apart, mine = between[own], d[np.arange(len(own)), own][:, None]
                slack = 1e-12 * (d + mine + radius[None] ** 2)
                ball = np.sqrt(d) - radius[None] * (1 + 1e-9) <= limit
                with np.errstate(invalid="ignore"):  # an infinite limit times the distance to the own cell
                    plane = d - mine - slack <= 2 * apart * limit
                take = allowed[own] & ball & plane
                counts.append(take.sum(1))
                found.append(np.nonzero(take)[1].astype(np.int32))
            ends = np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int32) if counts else np.zeros(1, np.int32)
            others = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found) if found else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([ids, xs, bounds, others], ["id", "x", "bound", "others"])

    kth = F.when(F.size("near") >= k, F.element_at("near", k)["d"]).otherwise(F.lit(float("inf")))
    return staged(rows.select("id", "x", "cell", kth.alias("bound")).mapInArrow(choose, "id long, x array<double>, bound double, others array<int>"),
                  "neighbors-bounded")


def _nearest(ids, bound, ax, kx, ys, copies, k: int) -> pa.RecordBatch:
    """The k nearest of one tile's rows for every asked row that has any within its bound."""
    centre = kx.mean(0)
    kc, numbers = kx - centre, kx.shape[1]
    square = (kc * kc).sum(1)
    at_row, ds, labels = [], [], []
    for a in range(0, len(ax), ROWS):
        mine = ax[a : a + ROWS]
        ac = mine - centre
        own = (ac * ac).sum(1)[:, None]
        error = 8 * (numbers + 8) * np.finfo(float).eps * (own + square.max())
        rough = own + square[None] - 2 * (ac @ kc.T)
        limit = bound[a : a + ROWS, None] * (1 + 1e-9) + error
        may = rough <= limit
        if len(kx) > k and may.sum() > 4 * k * len(mine):
            may &= rough <= np.partition(rough, k - 1, axis=1)[:, k - 1 : k] + 2 * error
        row, col = np.nonzero(may)
        d = ((mine[row] - kx[col]) ** 2).sum(1)
        order = np.lexsort((ys[col], d, row))
        row, col, d = row[order], col[order], d[order]
        first = _rank(row) < k
        row, d, y, n = row[first], d[first], ys[col[first]], copies[col[first]]
        row, d, y = np.repeat(row, n), np.repeat(d, n), np.repeat(y, n)
        first = _rank(row) < k
        at_row.append(row[first] + a)
        ds.append(d[first])
        labels.append(y[first])
    row, d, y = np.concatenate(at_row), np.concatenate(ds), np.concatenate(labels).astype(np.int32)
    some, counts = np.unique(row, return_counts=True)
    near = pa.StructArray.from_arrays([pa.array(d), pa.array(y)], ["d", "y"])
    ends = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.ListArray.from_arrays(ends, near)], ["id", "near"])


def _rank(row: np.ndarray) -> np.ndarray:
    """Place of each entry among those of its (sorted) row."""
    return np.arange(len(row)) - np.searchsorted(row, row)


def _compared(asked: DataFrame, known: DataFrame, n_asked: np.ndarray, n_known: np.ndarray, k: int, p: int, block: int) -> DataFrame:
    """``id, near`` for every tile pair: rows of ``asked`` (``id, x, bound, cell``) against those of ``known`` (``x, y, copies,
    cell``) in the same cell; ``n_asked``, ``n_known``: rows of each cell."""
    salts, parts = ([max(1, math.ceil(s / block)) for s in n.tolist()] for n in (n_asked, n_known))
    of = lambda numbers: F.get(F.array(*[F.lit(n) for n in numbers]), F.col("cell"))
    dealt = lambda by, numbers: F.pmod(F.xxhash64(*by), of(numbers)).cast("int")
    every = lambda numbers: F.explode(F.sequence(F.lit(0), of(numbers) - 1))
    mine = asked.groupBy("cell", dealt(["id"], salts).alias("salt")).agg(
        F.collect_list("id").alias("ids"), F.collect_list("bound").alias("bounds"), F.collect_list("x").alias("ax"))
    theirs = known.groupBy("cell", dealt(["x", "y"], parts).alias("part")).agg(
        F.collect_list("x").alias("kx"), F.collect_list("y").alias("ys"), F.collect_list("copies").alias("copies"))
    key = ["cell", "salt", "part"]
    tiles = sum(s * t for s, t, a, b in zip(salts, parts, n_asked, n_known, strict=True) if a and b)
    # a tile pair is small in bytes and long in time, so the number of tasks follows the pairs
    usual = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(1, min(tiles, max(usual, tiles // 4)))
    both = mine.withColumn("part", every(parts)).repartition(tasks, *key).join(
        theirs.withColumn("salt", every(salts)).repartition(tasks, *key).hint("merge"), key).select("ids", "bounds", "ax", "kx", "ys", "copies")

    def compare(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                ids, bound, ys, copies = (batch.column(c)[row].values.to_numpy() for c in ("ids", "bounds", "ys", "copies"))
                ax, kx = (_matrix(batch.column(c)[row].values, p) for c in ("ax", "kx"))
                yield _nearest(ids, bound, ax, kx, ys, copies, k)

    return both.mapInArrow(compare, _NEAR)


def k_nearest(asked: DataFrame, known: DataFrame, k: int, block: int = BLOCK, most_pivots: int = PIVOTS) -> DataFrame:
    """``id, near``: for every row of ``asked`` (``id`` unique, ``x`` array of doubles) its k nearest rows of ``known`` (``x``,
    ``y``) as an array of ``d`` (squared distance) and ``y``, nearest first; ties by the lower ``y``.  Fewer rows than k:
    all of them.  Without labelled or asked rows the result is empty; rows with an entry that is not finite have no row."""
    spark = asked.sparkSession
    finite = F.forall("x", lambda v: ~F.isnan(v) & (F.abs(v) < float("inf")))
    number = F.least(F.count(F.lit(1)), F.lit(k)).cast("int").alias("copies")
    known = staged(known.where(finite).groupBy("x", "y").agg(number), "neighbors-distinct")
    total = known.count()
    if not total:
        return spark.createDataFrame([], _NEAR)
    count = max(1, min(most_pivots, math.ceil(total / block)))
    chosen = known.select("x").distinct().orderBy(F.xxhash64("x"), "x").limit(count).collect()
    pivots = np.array([r["x"] for r in chosen], float).reshape(len(chosen), -1)
    p = pivots.shape[1]
    here, there = _dealt(asked.where(finite).select("id", "x"), pivots, "neighbors-asked"), _dealt(known, pivots, "neighbors-known")
    (n_asked, r_asked), (n_known, r_known) = (_sizes(x, len(pivots)) for x in (here, there))
    if not n_asked.sum():
        return spark.createDataFrame([], _NEAR)
    merged = lambda x: x.groupBy("id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
    open_ = here.withColumn("bound", F.lit(float("inf")))
    own = staged(merged(_compared(open_, there, n_asked, n_known, k, p, block)), "neighbors-own")
    # copies count as rows of their cell: with fewer distinct rows than k the bound of near_cells is only wider
    pairs = near_cells(pivots, (n_asked, r_asked), (n_known, r_known), k)
    if len(pivots) == 1:
        return own
    left = _other_cells(here.join(own, "id"), pivots, r_known, pairs, k).select("id", "x", "bound", F.explode("others").alias("cell"))
    n_left = np.zeros(len(pivots), np.int64)
    for r in left.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect():
        n_left[r["cell"]] = r["n"]
    if not n_left.sum():
        return own
    return merged(own.unionByName(_compared(left, there, n_left, n_known, k, p, block)))

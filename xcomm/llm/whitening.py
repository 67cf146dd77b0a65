"""Embedding whitening by a bidiagonal qd solver.

Tasks centre their rows and reduce them block by block to a triangular factor (QR of the last factor on
top of the next block); factors meet in a tree of QRs.  The one that is left, as wide as the vectors, is
made bidiagonal by Householder reflections on the driver.  Its singular values come from the
differential qd algorithm with shifts, which keeps their relative accuracy as no covariance is
formed, and its right singular vectors from twisted factorisations.  Rows are then projected where they are.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import staged
from .vectors import dense, lists_of, steps

COMPONENTS = 8
#: Rows that a task adds to its factor at once.
BLOCK = 2048
#: Factors that one task or the driver brings together at most.
FAN = 32
#: Entries are held within this range after scaling.
LIMIT = 1 << 40
_EPS = np.finfo(float).eps


# ---- the small solver: as wide as the vectors, independent of the number of rows ---------------------


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, superdiagonal and right reflections ``v`` (``r = u b v.T``) of a square matrix."""
    a, d = np.array(r, float), len(r)
    v = np.eye(d)

    def reflector(x):
        """Unit normal of the reflection that maps x to a multiple of the first axis; None for nothing to do."""
        if len(x) < 2 or not np.any(x[1:]):
            return None
        w = x / np.abs(x).max()
        w[0] += math.copysign(np.linalg.norm(w), w[0])
        return w / np.linalg.norm(w)

    for k in range(d):
        w = reflector(a[k:, k])
        if w is not None:
            a[k:, k:] -= 2 * np.outer(w, w @ a[k:, k:])
        if k + 2 < d:
            w = reflector(a[k, k + 1 :])
            if w is not None:
                a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ w, w)
                v[:, k + 1 :] -= 2 * np.outer(v[:, k + 1 :] @ w, w)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def _dqds(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float] | None:
    """One differential qd step with shift; None when the shift was too large.  Also the least pivot."""
    n, d = len(q), q[0] - shift
    least, new_q, new_e = d, [0.0] * n, [0.0] * (n - 1)
    for k in range(n - 1):
        if d < 0:
            return None
        new_q[k] = d + e[k]
        if new_q[k] == 0.0:
            return None if shift else (q, [*e[:k], 0.0, *e[k + 1 :]], 0.0)
        ratio = q[k + 1] / new_q[k]
        new_e[k] = e[k] * ratio
        d = d * ratio - shift
        least = min(least, d)
    if d < 0 or not math.isfinite(d):
        return None
    new_q[-1] = d
    return new_q, new_e, least


def squared_singular_values(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squares of the singular values of the bidiagonal matrix, in falling order, by dqds.

    ``a`` must hold no zero.  Values leave at the lower end when their coupling is negligible; a shift below
    the least value is tried, and given up for a smaller one when a pivot turns negative."""
    todo, found = [((a * a).tolist(), (b * b).tolist(), 0.0)], []
    while todo:
        q, e, moved = todo.pop()
        least, tries = 0.0, 0
        while q:
            n = len(q)
            if n == 1:
                found.append(q[0] + moved)
                break
            split = next((k for k in range(n - 1) if e[k] <= _EPS * _EPS * (moved + min(q[k], q[k + 1])) or e[k] == 0.0), None)
            if split is not None:
                todo.append((q[: split + 1], e[:split], moved))
                q, e, least = q[split + 1 :], e[split + 1 :], 0.0
                continue
            # the larger end belongs on top: values then leave quickly
            if q[-1] > 1.5 * q[0]:
                q, e = _flipped(q, e)
            shift = max(0.0, min(least * (1 - 1e-3 * min(tries, 900)), 0.999 * _lower_end(q, e)))
            done = _dqds(q, e, shift)
            while done is None:
                shift = shift / 4 if shift > 1e-30 * q[0] else 0.0
                done = _dqds(q, e, shift)
            q, e, least = done
            moved, tries = moved + shift, tries + 1
            if tries > 200 * n:
                raise ArithmeticError("dqds did not converge")
    return np.sort(np.array(found))[::-1]


def _flipped(q: list[float], e: list[float]) -> tuple[list[float], list[float]]:
    """The same values read from the other end: the bidiagonal factor of the reversed tridiagonal matrix."""
    main = [q[0], *(q[k] + e[k - 1] for k in range(1, len(q)))]
    off = [q[k] * e[k] for k in range(len(e))]
    main, off = main[::-1], off[::-1]
    new_q, new_e = [main[0]], []
    for k, o in enumerate(off):
        new_e.append(o / new_q[-1])
        new_q.append(max(main[k + 1] - new_e[-1], 0.0))
    return (new_q, new_e) if all(x > 0 for x in new_q) else (q, e)


def _lower_end(q: list[float], e: list[float]) -> float:
    """A lower bound of the least value that is near it once the last coupling is small."""
    if len(q) < 2:
        return q[0]
    x = math.sqrt(q[-1]) - math.sqrt(e[-1]) / 2
    y = min(math.sqrt(q[k]) - (math.sqrt(e[k]) + (math.sqrt(e[k - 1]) if k else 0)) / 2 for k in range(len(q) - 1))
    least = min(x, y)
    return least * least if least > 0 else 0.0


def twisted_vector(a: np.ndarray, b: np.ndarray, value: float) -> np.ndarray:
    """Unit eigenvector of ``b.T b`` (bidiagonal) for an accurate eigenvalue: the factorisations from above
    and from below are joined where the pivot is least, and the vector follows without cancellation."""
    n = len(a)
    d, low = a * a, b / a[:-1] if n > 1 else b
    tiny = np.finfo(float).tiny / _EPS
    keep = lambda x: x if x != 0 and math.isfinite(x) else tiny
    s, p = np.empty(n), np.empty(n)
    down, up = np.empty(n - 1), np.empty(n - 1)
    s[0] = -value
    for i in range(n - 1):
        pivot = keep(s[i] + d[i])
        down[i] = d[i] * low[i] / pivot
        s[i + 1] = down[i] * low[i] * s[i] - value
    p[-1] = d[-1] - value
    for i in range(n - 2, -1, -1):
        ratio = d[i] / keep(d[i] * low[i] * low[i] + p[i + 1])
        up[i] = low[i] * ratio
        p[i] = p[i + 1] * ratio - value
    twist = int(np.abs(np.nan_to_num(s + p + value, nan=np.inf)).argmin())
    z = np.zeros(n)
    z[twist] = 1.0
    for i in range(twist - 1, -1, -1):
        z[i] = -down[i] * z[i + 1]
    for i in range(twist, n - 1):
        z[i + 1] = -up[i] * z[i]
    return z / np.linalg.norm(z)


def principal_directions(r: np.ndarray, n: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of ``r.T r / n`` in falling order, and unit eigenvectors (rows) of the first ``count``.

    Values at rounding level of the largest are left out of the vectors.  Vectors of values that agree to 8
    digits are made orthogonal by inverse iteration within their group."""
    d = len(r)
    size = np.abs(r).max() if r.size else 0.0
    if not size:
        return np.zeros(d), np.zeros((0, d))
    a, b, v = bidiagonal(r / size)
    a = np.where(np.abs(a) < 1e-20, 1e-20, a)  # far under rounding level, but no zero pivot
    values = squared_singular_values(a, b)
    cuts = [0, *(np.flatnonzero(np.abs(b) < 1e-18) + 1).tolist(), d]
    own = [(x, y, squared_singular_values(a[x:y], b[x : y - 1]) if len(cuts) > 2 else values) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
    pairs = sorted(((value, x, y) for x, y, vals in own for value in vals), reverse=True)
    vectors: list[np.ndarray] = []
    tri = np.diag(a * a) + np.diag(a[:-1] * b, 1) + np.diag(a[:-1] * b, -1)
    tri[np.arange(1, d), np.arange(1, d)] += b * b
    for value, x, y in pairs[:count]:
        if value <= (d * _EPS) ** 2 * pairs[0][0]:
            break
        z = np.zeros(d)
        z[x:y] = twisted_vector(a[x:y], b[x : y - 1], value)
        near = [w for w, (other, _, _) in zip(vectors, pairs, strict=False) if other - value <= 1e-8 * value]
        for turn in range(3 if near else 0):
            for w in near:
                z = z - (w @ z) * w
            if np.linalg.norm(z) < 0.1:
                z = np.cos(np.arange(d) * (turn + 1.3))
                for w in near:
                    z = z - (w @ z) * w
            z = np.linalg.solve(tri - value * (1 - 8 * _EPS) * np.eye(d) + np.eye(d) * value * 1e-13, z / np.linalg.norm(z))
            z /= np.linalg.norm(z)
        for w in near:
            z = z - (w @ z) * w
        vectors.append(z / np.linalg.norm(z))
    found = v @ np.array(vectors).T if vectors else np.zeros((d, 0))
    return values * size * size / n, found.T


# ---- the passes over the rows ------------------------------------------------------------------------


@dataclass
class Whitening:
    """``n`` rows fitted; exact ``sums`` of the integer components; falling ``values`` of the covariance and the
    leading ``directions`` (rows)."""

    n: int
    sums: list[int]
    values: np.ndarray
    directions: np.ndarray


def _integers(column, dims: int, scale: int, offset: int) -> tuple[np.ndarray, np.ndarray]:
    use, x = dense(column, dims)
    return use, steps(x, scale, LIMIT) + offset




def fit_whitening(vectors: DataFrame, vector: str = "embedding", scale: int = 1024, offset: int = 100_000, components: int = COMPONENTS) -> Whitening | None:
    """Fits on all usable vectors; None when there are none."""

    def add(batches):
        totals: dict[int, list] = {}
        for batch in batches:
            lengths, first, values = lists_of(batch.column(0))
            for dims in np.unique(lengths[lengths > 0]).tolist():
                use, x = _integers(batch.column(0), dims, scale, offset)
                if len(use):
                    have = totals.setdefault(dims, [0, [0] * dims])
                    have[0] += len(use)
                    have[1] = [s + t for s, t in zip(have[1], x.sum(axis=0).tolist(), strict=True)]
        rows = [(dims, j, n, s) for dims, (n, sums) in totals.items() for j, s in enumerate(sums)]
        cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["dims", "j", "n", "s"])

    column = vectors.select(vector)
    parts = column.mapInArrow(add, "dims int, j int, n long, s long").groupBy("dims", "j")
    parts = staged(parts.agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")), "whitening-sums")
    most = parts.where("j = 0").orderBy(F.desc("n"), F.desc("dims")).limit(1).collect()
    if not most:
        return None
    dims, n = most[0]["dims"], most[0]["n"]
    sums = [int(r["s"]) for r in parts.where(F.col("dims") == dims).orderBy("j").collect()]
    centre = np.array(sums, object)
    whole, rest = np.array([s // n for s in sums], np.int64), np.array([(s % n) / n for s in centre.tolist()])

    def factor(batches):
        r = np.zeros((0, dims))
        for batch in batches:
            _, x = _integers(batch.column(0), dims, scale, offset)
            for k in range(0, len(x), BLOCK):
                r = np.linalg.qr(np.vstack([r, (x[k : k + BLOCK] - whole) - rest]), mode="r")
        if len(r):
            yield _factor_batch(r)

    factors = column.mapInArrow(factor, "r array<double>").withColumn("at", F.spark_partition_id())
    left = column.rdd.getNumPartitions()
    while left > FAN:
        # factors of FAN neighbouring tasks become one
        group = F.floor(F.col("at") / FAN).cast("int").alias("at")
        factors = factors.select("r", group).groupBy("at").applyInArrow(_joined_factors(dims), "at int, r array<double>")
        left = -(-left // FAN)
    r = np.zeros((0, dims))
    for row in factors.select("r").toLocalIterator():
        r = np.linalg.qr(np.vstack([r, np.array(row["r"]).reshape(-1, dims)]), mode="r")
    square = np.zeros((dims, dims))
    square[: len(r)] = r
    values, directions = principal_directions(square, n, components)
    return Whitening(n, sums, values, directions)


def _factor_batch(r: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.ravel().tolist()], pa.list_(pa.float64()))], ["r"])


def _joined_factors(dims: int):
    def join(key, table):
        r = np.zeros((0, dims))
        for value in table.column("r").to_pylist():
            r = np.linalg.qr(np.vstack([r, np.array(value).reshape(-1, dims)]), mode="r")
        return pa.table({"at": pa.array([key[0].as_py()], pa.int32()), "r": pa.array([r.ravel().tolist()], pa.list_(pa.float64()))})

    return join


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact ``sum((n * x - sums)**2)`` of every row; None where it takes more than 63 bits."""
    rough = (((x - np.array([s / n for s in sums])) * float(n)) ** 2).sum(axis=1)
    out: list[int | None] = []
    if not len(x):
        return out
    if rough.max() < 1 << 62 and n * (np.abs(x).max() + 1) < 1 << 62:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    for row in x.tolist():
        exact = sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True))
        out.append(exact if exact < 1 << 63 else None)
    return out


def whiten(vectors: DataFrame, model: Whitening | None, vector: str = "embedding", scale: int = 1024, offset: int = 100_000) -> DataFrame:
    """``row`` (struct of all columns but the vector), ``deviation`` and ``whitened`` (array of doubles, one for each
    component found) of every usable vector.

    A vector is usable when it is not null, holds no null or non-finite entry and is as long as
    most are (ties: the longer); others are left out, as are empty ones.  Entries beyond 2**40 after scaling are held
    there.  Components whose variance is at rounding level (all vectors equal, fewer rows than
    dimensions) are not there; a deviation of more than 63 bits is null.  Repeated rows count each; an
    empty table gives an empty result; extra columns of any name are carried in ``row``."""
    rows = vectors.select(F.struct(*[vectors[c] for c in vectors.columns if c != vector]).alias("row"), vectors[vector].alias("vec"))
    out = T.StructType([rows.schema["row"], T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    if model is None:
        return vectors.sparkSession.createDataFrame([], out)
    n, sums = model.n, model.sums
    dims, found = len(sums), len(model.directions)
    whole, rest = np.array([s // n for s in sums], np.int64), np.array([(s % n) / n for s in sums])
    project = (model.directions / np.sqrt(model.values[:found])[:, None]).T

    def work(batches):
        for batch in batches:
            use, x = _integers(batch.column("vec"), dims, scale, offset)
            w = ((x - whole) - rest) @ project
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * found)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row").take(pa.array(use)), pa.array(deviations(x, n, sums), pa.int64()), pa.ListArray.from_arrays(ends, pa.array(w.ravel()))],
                ["row", "deviation", "whitened"],
            )

    return rows.mapInArrow(work, out)


def identity_error(whitened: DataFrame, components: int) -> float | None:
    """Largest absolute entry of the covariance of the whitened components (divisor n) minus the identity."""
    w = F.col("whitened")
    pairs = [(i, j) for i in range(components) for j in range(i, components)]
    if not pairs:
        return None
    found = whitened.agg(*[F.covar_pop(w[i], w[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(found[f"c{i}_{j}"] - (i == j)) for i, j in pairs)

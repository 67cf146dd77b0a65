"""Cross-validation of closed-form classifiers from sufficient statistics.

Ridge, nearest centroid and both naive Bayes models are functions of per-class counts, sums, ranges and one
Gram matrix.  One pass gathers these per (fold, class) for all columns.  The statistics of the rows outside
a fold are the total less the fold's own, and those of a column subset are sub-matrices, so every (model,
subset, fold) cell is solved without reading a row again.  All four models are linear in x, in x
scaled to the training range, or in [x > 0]; a second pass scores every row under all cells at
once as matrix products and counts the confusion cells.

A search over s subsets, m models and k folds is two jobs, not s·m·k.  What reaches the driver is
k · 2 · (p² + 4p) numbers; what goes to the tasks is k · s · m · p.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .models import FEATURES, LABEL

#: Partial statistics that one task or the driver adds up at most.
FAN = 32
#: Smoothing of the naive Bayes models and penalty of the ridge, as in ``models``.
SMOOTHING, ALPHA = 0.01, 1.0

#: Input that each model is linear in: "x", "scaled" (to the training range) or "positive" (x > 0).
CLOSED_FORM = {"RidgeClassifier": "x", "NearestCentroid": "x", "MultinomialNB": "scaled", "BernoulliNB": "positive"}


@dataclass
class Stats:
    """Statistics of some rows, by class (0: label −1, 1: label +1).  ``sums`` and ``gram`` are of x − shift."""

    n: np.ndarray  # (2,)
    sums: np.ndarray  # (2, p)
    positive: np.ndarray  # (2, p)
    gram: np.ndarray  # (p, p), both classes
    low: np.ndarray  # (p,)
    high: np.ndarray  # (p,)

    def minus(self, other: Stats, low: np.ndarray, high: np.ndarray) -> Stats:
        return Stats(self.n - other.n, self.sums - other.sums, self.positive - other.positive, self.gram - other.gram, low, high)


@dataclass
class FoldStats:
    """Statistics per fold; ``outside(k)`` are those of all rows of other folds."""

    shift: np.ndarray
    folds: dict[int, Stats]

    def total(self) -> Stats:
        p = len(self.shift)
        out = Stats(np.zeros(2), np.zeros((2, p)), np.zeros((2, p)), np.zeros((p, p)), np.full(p, np.inf), np.full(p, -np.inf))
        for s in self.folds.values():
            out = Stats(out.n + s.n, out.sums + s.sums, out.positive + s.positive, out.gram + s.gram,
                        np.minimum(out.low, s.low), np.maximum(out.high, s.high))
        return out

    def outside(self) -> dict[int, Stats]:
        """Total less fold, for every fold; ranges, which cannot be subtracted, from those before and after it."""
        total, order = self.total(), sorted(self.folds)
        p = len(self.shift)
        before, after = [(np.full(p, np.inf), np.full(p, -np.inf))], [(np.full(p, np.inf), np.full(p, -np.inf))]
        for k in order:
            before.append((np.minimum(before[-1][0], self.folds[k].low), np.maximum(before[-1][1], self.folds[k].high)))
        for k in reversed(order):
            after.append((np.minimum(after[-1][0], self.folds[k].low), np.maximum(after[-1][1], self.folds[k].high)))
        after = after[::-1]
        return {k: total.minus(self.folds[k], np.minimum(before[i][0], after[i + 1][0]), np.maximum(before[i][1], after[i + 1][1]))
                for i, k in enumerate(order)}


def _matrix(column: pa.Array, p: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, p)


_STATS = "fold int, label int, at int, n long, sums array<double>, positive array<double>, gram array<double>, low array<double>, high array<double>"
_VALUES = ("sums", "positive", "gram", "low", "high")


def _arrow(rows: list[dict]) -> pa.Table:
    kinds = {"fold": pa.int32(), "label": pa.int32(), "at": pa.int32(), "n": pa.int64(), **{c: pa.list_(pa.float64()) for c in _VALUES}}
    return pa.table({c: pa.array([r[c] for r in rows], t) for c, t in kinds.items()})


def fold_statistics(data: DataFrame, p: int) -> FoldStats:
    """One pass over ``data`` (features vector of ``p`` columns, label ±1, fold).

    Sums are of x less the columns' means, so the Gram matrix loses no digits to a large mean.  Rows whose features
    hold NaN are not supported (they have no closed form)."""
    means = data.select(vector_to_array(FEATURES).alias("x")).agg(*[F.avg(F.get("x", F.lit(i))) for i in range(p)]).first()
    shift = np.array([m or 0.0 for m in means])
    rows = data.select(vector_to_array(FEATURES).alias("x"), F.col(LABEL).alias("label"), "fold", F.spark_partition_id().alias("at"))

    def gather(batches):
        found: dict[tuple, dict] = {}
        for batch in batches:
            x, label, fold = _matrix(batch.column(0), p), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            at = batch.column(3)[0].as_py() if len(batch) else 0
            for k in np.unique(fold).tolist():
                for y in (-1, 1):
                    own = x[(fold == k) & ((label == 1) if y == 1 else (label != 1))]
                    if not len(own):
                        continue
                    z = own - shift
                    new = {"n": len(own), "sums": z.sum(0), "positive": (own > 0).sum(0).astype(float), "gram": (z.T @ z).ravel(), "low": own.min(0), "high": own.max(0)}
                    have = found.setdefault((k, y), {"fold": k, "label": y, "at": at})
                    _add(have, new)
        yield from _arrow(list(found.values())).to_batches()

    parts = rows.mapInArrow(gather, _STATS)
    left = data.rdd.getNumPartitions()
    while left > FAN:
        parts = parts.withColumn("at", F.floor(F.col("at") / FAN).cast("int")).groupBy("fold", "label", "at").applyInArrow(_added, _STATS)
        left = -(-left // FAN)
    table = parts.withColumn("at", F.lit(0)).groupBy("fold", "label", "at").applyInArrow(_added, _STATS).toArrow()
    folds: dict[int, Stats] = {}
    for r in table.to_pylist():
        s = folds.setdefault(r["fold"], Stats(np.zeros(2), np.zeros((2, p)), np.zeros((2, p)), np.zeros((p, p)), np.full(p, np.inf), np.full(p, -np.inf)))
        c = int(r["label"] == 1)
        s.n[c], s.sums[c], s.positive[c] = r["n"], r["sums"], r["positive"]
        s.gram += np.array(r["gram"]).reshape(p, p)
        s.low, s.high = np.minimum(s.low, r["low"]), np.maximum(s.high, r["high"])
    return FoldStats(shift, folds)


def _add(have: dict, new: dict) -> None:
    if "n" not in have:
        have.update(new)
        return
    have["n"] += new["n"]
    for c in ("sums", "positive", "gram"):
        have[c] = np.asarray(have[c]) + np.asarray(new[c])
    have["low"], have["high"] = np.minimum(have["low"], new["low"]), np.maximum(have["high"], new["high"])


def _added(key, table):  # no annotations: Spark would read them
    total = dict(zip(("fold", "label", "at"), (k.as_py() for k in key), strict=True))
    for batch in table.to_batches(max_chunksize=1):
        for r in batch.to_pylist():
            _add(total, {c: np.array(r[c]) if c != "n" else r[c] for c in ("n", *_VALUES)})
    return _arrow([total])


# ---- the models, from the statistics of their training rows ------------------------------------------------


def solve(model: str, s: Stats, shift: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights over all columns (0 outside ``use``) and offset: +1 is predicted where weights · input + offset
    is above 0.  The input is x − shift, the scaled x, or [x > 0], as ``CLOSED_FORM`` says.  With one class
    only that class is predicted, with no rows −1."""
    w = np.zeros(len(shift))
    n0, n1 = s.n
    n = n0 + n1
    if not n0 or not n1:
        return w, 1.0 if n1 else -1.0
    if model == "RidgeClassifier":
        mean, y = s.sums.sum(0)[use] / n, (n1 - n0) / n
        gram = s.gram[np.ix_(use, use)] - n * np.outer(mean, mean)
        w[use] = np.linalg.solve(gram + ALPHA * np.eye(len(use)), (s.sums[1] - s.sums[0])[use] - n * y * mean)
        return w, y - float(w[use] @ mean)
    if model == "NearestCentroid":
        c0, c1 = s.sums[0][use] / n0, s.sums[1][use] / n1
        w[use] = 2 * (c1 - c0)
        return w, float(c0 @ c0 - c1 @ c1)
    prior = np.log(n1 + SMOOTHING) - np.log(n0 + SMOOTHING)
    if model == "MultinomialNB":
        span = s.high - s.low
        raw = s.sums + s.n[:, None] * shift
        sums = np.where(span > 0, (raw - s.n[:, None] * s.low) / np.where(span > 0, span, 1.0), 0.0)[:, use]
        theta = np.log(sums + SMOOTHING) - np.log(sums.sum(1, keepdims=True) + SMOOTHING * len(use))
        w[use] = theta[1] - theta[0]
        return w, float(prior)
    if model == "BernoulliNB":
        rate = (s.positive[:, use] + SMOOTHING) / (s.n[:, None] + 2 * SMOOTHING)
        yes, no = np.log(rate), np.log1p(-rate)
        w[use] = (yes[1] - yes[0]) - (no[1] - no[0])
        return w, float(prior + (no[1] - no[0]).sum())
    raise ValueError(f"no closed form: {model}")


def closed_form_cells(data: DataFrame, columns: list[str], cells: list[tuple[str, list[str]]], stats: FoldStats) -> list[tuple]:
    """Rows of ``evaluate.RESULT_SCHEMA`` for every cell (model, columns) and fold: one pass over ``data``."""
    p, folds = len(columns), sorted(stats.folds)
    if not cells or not folds:
        return []
    place = {c: i for i, c in enumerate(columns)}
    outside = stats.outside()
    inputs = [CLOSED_FORM[m] for m, _ in cells]
    weights, seconds = {}, {}
    for k in folds:
        w, b = np.zeros((len(cells), p)), np.zeros(len(cells))
        for i, (model, names) in enumerate(cells):
            began = time.perf_counter()
            w[i], b[i] = solve(model, outside[k], stats.shift, np.array([place[c] for c in names], int))
            seconds[k, i] = time.perf_counter() - began
        weights[k] = (w, b, outside[k].low, outside[k].high)
    shift = stats.shift
    kinds = {kind: np.array([i for i, x in enumerate(inputs) if x == kind], int) for kind in set(inputs)}

    def count(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            x, label, fold = _matrix(batch.column(0), p), batch.column(1).to_numpy() == 1, batch.column(2).to_numpy()
            for k in np.unique(fold).tolist():
                if k not in weights:
                    continue
                own, y = x[fold == k], label[fold == k]
                w, b, low, high = weights[k]
                counts = total.setdefault(k, np.zeros((4, len(b)), np.int64))
                for kind, at in kinds.items():
                    plus = _input(kind, own, shift, low, high) @ w[at].T + b[at] > 0
                    for row, (truth, said) in enumerate(((False, False), (False, True), (True, False), (True, True))):
                        counts[row, at] += (plus[y == truth] == said).sum(0)
        rows = [(k, i, *c[:, i].tolist()) for k, c in total.items() for i in range(c.shape[1])]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
        kinds_ = [pa.int32(), pa.int32(), *[pa.int64()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds_, strict=True)], ["fold", "cell", "tn", "fp", "fn", "tp"])

    rows = data.select(vector_to_array(FEATURES).alias("x"), F.col(LABEL).alias("label"), "fold")
    counted = rows.mapInArrow(count, "fold int, cell int, tn long, fp long, fn long, tp long").groupBy("fold", "cell")
    out = []
    for r in sorted(counted.agg(*[F.sum(c).alias(c) for c in ("tn", "fp", "fn", "tp")]).collect(), key=lambda r: (r["cell"], r["fold"])):
        (model, names), n = cells[r["cell"]], r["tn"] + r["fp"] + r["fn"] + r["tp"]
        both = r["tp"] + r["fn"] and r["tn"] + r["fp"]
        auc = (r["tp"] / (r["tp"] + r["fn"]) + r["tn"] / (r["tn"] + r["fp"])) / 2 if both else None
        out.append((model, list(names), r["fold"], (r["tp"] + r["tn"]) / n, auc, seconds[r["fold"], r["cell"]], r["tn"], r["fp"], r["fn"], r["tp"]))
    return out


def _input(kind: str, x: np.ndarray, shift: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    if kind == "x":
        return x - shift
    if kind == "positive":
        return (x > 0).astype(float)
    span = high - low
    with np.errstate(invalid="ignore"):
        return np.where(span > 0, np.clip((x - low) / np.where(span > 0, span, 1.0), 0.0, 1.0), 0.0)

"""Cross-validated logistic regression of all folds at once (C16 under V1, V2).

Every fold has its own model, fitted on the rows outside it: the minimum of the summed log loss and ½‖w‖²/C, intercept
free.  The objective is strictly convex, so Newton steps reach the same minimum as a fit per fold.  One pass over the
data serves all folds: a task has the models of all of them, and adds up loss, gradient and Hessian of each over its
rows as matrix products.  A search over k folds is some ten passes, not k fits of dozens of jobs each.

What reaches the driver of a pass is k · (p² + p) numbers; what goes to the tasks is k · p.
"""

from __future__ import annotations

import time
import warnings

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .models import FEATURES, LABEL

#: Newton passes at most; relative size of the last step's gain at which a model is done.
PASSES, TOL = 60, 1e-12
#: Numbers of one temporary array in a task.
_NUMBERS = 1 << 22


def _rows(data: DataFrame, use: list[int]) -> DataFrame:
    x = vector_to_array(FEATURES)
    return data.select(F.array(*[F.get(x, F.lit(i)) for i in use]).alias("x"), F.col(LABEL).alias("label"), "fold")


def _parts(batches, p: int, shift: np.ndarray, width: int):
    """(x − shift with a constant, class 0 or 1, fold) of bounded slices."""
    for batch in batches:
        x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, p)
        if batch.column(1).null_count or not np.isfinite(x).all():
            raise ValueError("logistic regression needs finite features and labels that are not null")
        x = np.hstack([x - shift, np.ones((len(x), 1))])
        y, fold = (batch.column(1).to_numpy() == 1).astype(float), batch.column(2).to_numpy()
        step = max(1, _NUMBERS // width)
        for k in range(0, len(x), step):
            yield x[k : k + step], y[k : k + step], fold[k : k + step]


def _pass(rows: DataFrame, shift: np.ndarray, folds: np.ndarray, models: np.ndarray) -> np.ndarray:
    """For each fold: loss, gradient and Hessian's upper half over the rows outside it, at its row of ``models``."""
    p = len(shift)
    upper = np.triu_indices(p + 1)
    width = max(len(upper[0]), len(folds))

    def gather(batches):
        total = np.zeros((len(folds), 1 + p + 1 + len(upper[0])))
        for x, y, fold in _parts(batches, p, shift, width):
            margin = x @ models.T
            outside = fold[:, None] != folds[None]
            likely = 1.0 / (1.0 + np.exp(-np.clip(margin, -700, 700)))
            loss = np.logaddexp(0.0, margin) - y[:, None] * margin
            total[:, 0] += (loss * outside).sum(0)
            total[:, 1 : p + 2] += ((likely - y[:, None]) * outside).T @ x
            total[:, p + 2 :] += (likely * (1 - likely) * outside).T @ (x[:, upper[0]] * x[:, upper[1]])
        sums = pa.ListArray.from_arrays(pa.array(np.arange(len(folds) + 1, dtype=np.int32) * total.shape[1]), pa.array(total.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(folds), dtype=np.int32)), sums], ["cell", "sums"])

    parts = rows.mapInArrow(gather, "cell int, sums array<double>")
    found = parts.groupBy("cell").agg(Summarizer.sum(array_to_vector("sums")).alias("s")).collect()
    out = np.zeros((len(folds), 1 + p + 1 + len(upper[0])))
    for r in found:
        out[r["cell"]] = r["s"].toArray()
    return out


def fit_folds(data: DataFrame, use: list[int], folds: list[int], C: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """``shift`` and, for each fold, weights and intercept for x − shift of the model of all rows outside it.  Training rows of
    one class only give that class (an infinite intercept); no rows are an error, as in Spark's estimator."""
    p, rows, at = len(use), _rows(data, use), np.array(folds)
    means = rows.agg(*[F.avg(F.get("x", F.lit(i))) for i in range(p)]).first()
    shift = np.array([m if m is not None and np.isfinite(m) else 0.0 for m in means])
    counts = {k: np.zeros(2) for k in folds}
    for r in data.groupBy("fold", (F.col(LABEL) == 1).alias("one")).agg(F.count(F.lit(1)).alias("n")).collect():
        counts[r["fold"]][int(bool(r["one"]))] += r["n"]
    outside = sum(counts.values()) - np.array([counts[k] for k in folds])
    if not outside.sum(1).all():
        raise ValueError("a fold has no training rows")
    upper = np.triu_indices(p + 1)
    penalty = np.append(np.full(p, 1.0 / C), 0.0)
    models, steps = np.zeros((len(folds), p + 1)), np.zeros((len(folds), p + 1))
    best, scale = np.full(len(folds), np.inf), np.ones(len(folds))
    going = (outside > 0).all(1)
    models[~going, -1] = np.where(outside[~going, 1] > 0, np.inf, -np.inf)
    for _ in range(PASSES):
        if not going.any():
            break
        live = np.flatnonzero(going)
        trial = models[live] + scale[live, None] * steps[live]
        for j, s in zip(live, _pass(rows, shift, at[live], trial), strict=True):
            w = trial[np.searchsorted(live, j)]
            value = s[0] + 0.5 * float(penalty @ (w * w))
            if value > best[j] + 1e-12 * abs(best[j]):  # too long a step: half of it
                scale[j] /= 2
                going[j] = scale[j] > 1e-10
                continue
            hessian = np.zeros((p + 1, p + 1))
            hessian[upper] = s[p + 2 :]
            hessian = hessian + hessian.T - np.diag(hessian.diagonal()) + np.diag(penalty)
            gradient = s[1 : p + 2] + penalty * w
            step = -np.linalg.lstsq(hessian, gradient, rcond=None)[0]
            models[j], best[j], steps[j], scale[j] = w, value, step, 1.0
            going[j] = -float(gradient @ step) > TOL * max(abs(value), 1.0)
            if not going[j]:  # this near, the last step only helps
                models[j] = w + step
    if going.any():
        warnings.warn(f"logistic regression: no convergence in {PASSES} passes", stacklevel=2)
    return shift, models


def logistic_cells(data: DataFrame, columns: list[str], cells: list[tuple[str, list[str]]], folds: list[int]) -> list[tuple]:
    """Rows of ``evaluate.RESULT_SCHEMA`` for every cell (model name, columns) and fold."""
    out = []
    for model, names in cells:
        if not folds:
            continue
        use, began = [columns.index(c) for c in names], time.perf_counter()
        shift, models = fit_folds(data, use, folds)
        seconds = (time.perf_counter() - began) / len(folds)
        weights = {k: models[i] for i, k in enumerate(folds)}
        p = len(use)

        def count(batches, shift=shift, weights=weights, p=p):
            total: dict[int, np.ndarray] = {}
            for x, y, fold in _parts(batches, p, shift, p + 1):
                for k in np.unique(fold).tolist():
                    own, truth, w = x[fold == k], y[fold == k] == 1, weights[k]
                    plus = (own @ w if np.isfinite(w).all() else np.full(len(own), w[-1])) > 0
                    found = [np.sum(~truth & ~plus), np.sum(~truth & plus), np.sum(truth & ~plus), np.sum(truth & plus)]
                    total[k] = total.get(k, 0) + np.array(found, np.int64)
            rows = [(k, *c.tolist()) for k, c in total.items()]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int32(), *[pa.int64()] * 4], strict=True)], ["fold", "tn", "fp", "fn", "tp"])

        counted = _rows(data, use).mapInArrow(count, "fold int, tn long, fp long, fn long, tp long").groupBy("fold")
        found = counted.agg(*[F.sum(c).alias(c) for c in ("tn", "fp", "fn", "tp")]).collect()
        for r in sorted(found, key=lambda r: r["fold"]):
            n = r["tn"] + r["fp"] + r["fn"] + r["tp"]
            both = r["tp"] + r["fn"] and r["tn"] + r["fp"]
            auc = (r["tp"] / (r["tp"] + r["fn"]) + r["tn"] / (r["tn"] + r["fp"])) / 2 if both else None
            out.append((model, list(names), r["fold"], (r["tp"] + r["tn"]) / n, auc, seconds, r["tn"], r["fp"], r["fn"], r["tp"]))
    return out

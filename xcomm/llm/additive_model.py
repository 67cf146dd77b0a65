"""Quality classifier: a generalised additive model with pairwise interactions.

Features of whole texts come from vectorised byte work in the tasks.  On a bounded sample of
labelled rows, cyclic boosting fits one shallow tree at a time on one feature's bins, all features
in turn, many times over with a small step, so each feature ends as a lookup table over its bins;
then the strongest pairs of features get two-dimensional tables the same way.  A score is the
logistic function of the sum of looked-up values.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textbytes import IS_SPACE, text_slices, word_hashes

#: Expected number of labelled rows that the model is fitted on (the bound of the sample).
SAMPLE_ROWS = 20_000
BINS = 32
PAIR_BINS = 8
PAIRS = 6
CYCLES = 60
PAIR_CYCLES = 30
STEP = 0.15
LEAVES = 4
SMOOTH = 1.0

FEATURES = [
    "log_words",
    "word_length",
    "symbols_per_word",
    "exclamations_per_word",
    "bars_per_word",
    "upper_share",
    "digit_share",
    "stops_per_word",
    "lines_per_word",
    "distinct_words",
    "distinct_pairs",
    "same_as_before",
    "top_word",
    "wide_share",
]


def _class(chars: str) -> np.ndarray:
    table = np.zeros(256, np.uint8)
    table[list(chars.encode())] = 1
    return table


_SYMBOLS = _class("#*$%&|<>@^~=_{}[]\\")
_EXCLAIM, _BAR, _STOP, _LINE = _class("!?"), _class("|"), _class(".,;:"), _class("\n")
_UPPER, _LOWER, _DIGIT = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("abcdefghijklmnopqrstuvwxyz"), _class("0123456789")
_WIDE = (np.arange(256) >= 0xC0).astype(np.uint8)
_PRINT = (~IS_SPACE & ((np.arange(256) < 0x80) | (np.arange(256) >= 0xC0))).astype(np.uint8)


def text_features(texts: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """One row of ``FEATURES`` per text.  A text without words has all features 0."""
    out = []
    for first, last, data, offsets in text_slices(texts):
        n = last - first
        sums = {}
        for name, table in (
            ("symbols", _SYMBOLS), ("exclaim", _EXCLAIM), ("bar", _BAR), ("stop", _STOP), ("line", _LINE),
            ("upper", _UPPER), ("lower", _LOWER), ("digit", _DIGIT), ("wide", _WIDE), ("print", _PRINT),
        ):
            total = np.zeros(len(data) + 1, np.int64)
            np.cumsum(table[data], out=total[1:])
            sums[name] = (total[offsets[1:]] - total[offsets[:-1]]).astype(np.float64)
        hashes, doc = word_hashes(data, offsets)
        words = np.bincount(doc, minlength=n).astype(np.float64)
        same_doc = doc[1:] == doc[:-1]
        repeat = np.bincount(doc[1:][same_doc & (hashes[1:] == hashes[:-1])], minlength=n)
        distinct, top = _distinct(hashes, doc, n)
        pairs = hashes[1:] * np.uint64(0x9E3779B97F4A7C15) + hashes[:-1]
        distinct2, _ = _distinct(pairs[same_doc], doc[1:][same_doc], n)
        w, p = np.maximum(words, 1), np.maximum(sums["print"], 1)
        letters = np.maximum(sums["upper"] + sums["lower"], 1)
        table = np.stack(
            [
                np.log1p(words), sums["print"] / w, sums["symbols"] / w, sums["exclaim"] / w, sums["bar"] / w,
                sums["upper"] / letters, sums["digit"] / p, sums["stop"] / w, sums["line"] / w,
                distinct / w, distinct2 / np.maximum(words - 1, 1), repeat / w, top / w, sums["wide"] / p,
            ],
            axis=1,
        )
        table[words == 0] = 0
        out.append(table)
    return np.concatenate(out) if out else np.zeros((0, len(FEATURES)))


def _distinct(hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each document and the count of its most frequent one."""
    if not len(hashes):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((hashes, doc))
    h, d = hashes[order], doc[order]
    starts = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])]))
    lengths = np.diff(np.append(starts, len(h)))
    top = np.zeros(n)
    np.maximum.at(top, d[starts], lengths)
    return np.bincount(d[starts], minlength=n).astype(np.float64), top


@dataclass
class AdditiveModel:
    """Bin edges and lookup tables."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pair_edges: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def raw(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for f, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edges, x[:, f], "right")]
        coarse = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(self.pair_edges)]
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[coarse[a], coarse[b]]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    cuts = np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))
    return cuts[(cuts > values.min())] if len(cuts) else cuts


def _tree(grad: np.ndarray, weight: np.ndarray, leaves: int) -> np.ndarray:
    """A regression tree over ordered bins: the best cuts, one after the other, then a Newton value
    for every leaf.  Returns the value of each bin."""
    parts = [(0, len(grad))]
    cg, cw = np.concatenate([[0], np.cumsum(grad)]), np.concatenate([[0], np.cumsum(weight)])

    def best(lo: int, hi: int) -> tuple[float, int]:
        if hi - lo < 2:
            return 0.0, lo
        mid = np.arange(lo + 1, hi)
        gl, wl = cg[mid] - cg[lo], cw[mid] - cw[lo]
        gr, wr = cg[hi] - cg[mid], cw[hi] - cw[mid]
        g, w = cg[hi] - cg[lo], cw[hi] - cw[lo]
        gain = gl**2 / (wl + SMOOTH) + gr**2 / (wr + SMOOTH) - g**2 / (w + SMOOTH)
        k = int(gain.argmax())
        return float(gain[k]), int(mid[k])

    while len(parts) < leaves:
        gains = [best(*p) for p in parts]
        k = int(np.argmax([g for g, _ in gains]))
        if gains[k][0] <= 1e-9:
            break
        lo, hi = parts[k]
        parts[k : k + 1] = [(lo, gains[k][1]), (gains[k][1], hi)]
    value = np.zeros(len(grad))
    for lo, hi in parts:
        value[lo:hi] = (cg[hi] - cg[lo]) / (cw[hi] - cw[lo] + SMOOTH)
    return value


def _pair_tree(grad: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """The best pair of crossing cuts of a two-dimensional table: four Newton values, and the gain."""
    cg, cw = grad.cumsum(0).cumsum(1), weight.cumsum(0).cumsum(1)
    g, w = cg[-1, -1], cw[-1, -1]
    best, at = -1.0, None
    for i in range(len(grad) - 1):
        quads = []
        for c in (cg, cw):
            a = c[i, :-1]
            quads.append((a, c[i, -1] - a, c[-1, :-1] - a, c[-1, -1] - c[i, -1] - c[-1, :-1] + a))
        gain = sum(x**2 / (y + SMOOTH) for x, y in zip(*quads, strict=True)) - g**2 / (w + SMOOTH)
        if len(gain) and gain.max() > best:
            best, at = float(gain.max()), (i + 1, int(gain.argmax()) + 1)
    value = np.zeros_like(grad)
    if at:
        for rows in (slice(0, at[0]), slice(at[0], None)):
            for cols in (slice(0, at[1]), slice(at[1], None)):
                value[rows, cols] = grad[rows, cols].sum() / (weight[rows, cols].sum() + SMOOTH)
    return value, best


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Fit on features ``x`` and labels ``y`` (0 / 1).  With one class only, every score is near it."""
    if not len(y):
        none = [np.zeros(0)] * x.shape[1]
        return AdditiveModel(0.0, none, [np.zeros(1)] * x.shape[1], none, [], [])
    rate = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(rate / (1 - rate)))
    edges = [_edges(x[:, f], BINS) for f in range(x.shape[1])]
    bins = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(edges)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    raw = np.full(len(y), base)

    def slopes(cell: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-raw))
        return np.bincount(cell, y - p, size), np.bincount(cell, p * (1 - p), size)

    for _ in range(CYCLES):
        for f, cell in enumerate(bins):
            step = STEP * _tree(*slopes(cell, len(tables[f])), LEAVES)
            tables[f] += step
            raw += step[cell]
    pair_edges = [_edges(x[:, f], PAIR_BINS) for f in range(x.shape[1])]
    coarse = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(pair_edges)]
    shapes = [len(e) + 1 for e in pair_edges]

    def joint(a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cell = coarse[a] * shapes[b] + coarse[b]
        grad, weight = slopes(cell, shapes[a] * shapes[b])
        return cell, grad.reshape(shapes[a], shapes[b]), weight.reshape(shapes[a], shapes[b])

    gains = []
    for a in range(x.shape[1]):
        for b in range(a + 1, x.shape[1]):
            if shapes[a] > 1 and shapes[b] > 1:
                _, grad, weight = joint(a, b)
                gains.append((_pair_tree(grad, weight)[1], a, b))
    pairs = [(a, b) for _, a, b in sorted(gains, reverse=True)[:PAIRS]]
    pair_tables = [np.zeros((shapes[a], shapes[b])) for a, b in pairs]
    for _ in range(PAIR_CYCLES):
        for k, (a, b) in enumerate(pairs):
            cell, grad, weight = joint(a, b)
            step = STEP * _pair_tree(grad, weight)[0]
            pair_tables[k] += step
            raw += step.ravel()[cell]
    return AdditiveModel(base, edges, tables, pair_edges, pairs, pair_tables)


def bounded_sample(labelled: DataFrame, key: str, rows: int) -> DataFrame:
    """About ``rows`` rows of ``labelled`` (all when there are fewer), chosen by a hash of the key:
    the same rows on every run."""
    total = labelled.count()
    share = min(1.0, rows / max(total, 1))
    chance = F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1 << 40)) / float(1 << 40)
    return labelled.where(chance < share) if share < 1 else labelled


def train_quality(
    docs: DataFrame, labels: DataFrame, usable: Column, text: str = "text", key: str = "doc_id", label: str = "quality", rows: int = SAMPLE_ROWS
) -> AdditiveModel:
    """Fit on about ``rows`` of the ``labels`` for which ``usable`` (a condition on the key) holds.

    Only features of the text are inputs.  Labels that are null, and keys that are null, are left
    out; a key with two labels counts twice."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & usable)
    chosen = bounded_sample(known, key, rows).select(F.col(key).alias("_key"), F.col(label).cast("int").alias("y"))
    sample = docs.select(F.col(key).alias("_key"), F.col(text).alias("text")).join(F.broadcast(chosen), "_key")

    def features(batches):
        for batch in batches:
            x = text_features(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(list(x), pa.list_(pa.float64()))], ["y", "x"])

    found = sample.select("y", "text").mapInArrow(features, "y int, x array<double>").toArrow()
    x = np.array(found["x"].to_pylist()).reshape(len(found), len(FEATURES))
    # the order of rows does not matter but for rounding; a fixed one makes reruns equal
    y = found["y"].to_numpy().astype(np.float64)
    order = np.lexsort(np.column_stack([x, y]).T)
    return fit(x[order], y[order])


def score_quality(docs: DataFrame, model: AdditiveModel, text: str = "text") -> DataFrame:
    """Score whole texts: ``row`` (struct of all columns of ``docs``), ``score`` (0 to 1) and
    ``features``.  Null and empty texts have all features 0 and get the score of those; equal texts
    get equal scores; an empty table gives an empty result."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns if c != text]).alias("row"), F.col(text).alias("text"))
    out = T.StructType(
        [rows.schema["row"], T.StructField("score", T.DoubleType()), T.StructField("features", T.ArrayType(T.DoubleType()))]
    )

    def score(batches):
        for batch in batches:
            x = text_features(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(model.score(x)), pa.array(list(x), pa.list_(pa.float64()))],
                ["row", "score", "features"],
            )

    return rows.mapInArrow(score, out)

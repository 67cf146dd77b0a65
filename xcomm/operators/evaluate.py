"""Cross-validation (V1, V2, V6) over a cached feature frame.

The feature vector is assembled once and persisted.  Models with a closed form are evaluated from sufficient
statistics (``sufficient``), all cells in two passes; logistic regression fits all folds together, a pass per Newton
step (``logistic``).  For the others every (model, fold) cell is a Spark job —
fit on ``fold != k``, predict ``fold == k``, one grouped aggregation for the metrics — submitted from a
small driver thread pool so independent fits overlap on the cluster.  Only the per-cell metric rows (a
handful of numbers) come back to the driver.
"""

from __future__ import annotations

import time
from concurrent.futures import ThreadPoolExecutor

from pyspark import StorageLevel
from pyspark.ml.feature import VectorAssembler, VectorSlicer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import append_cell, pending_cells
from .logistic import logistic_cells
from .metrics import binary_metrics
from .models import FEATURES, LABEL, make_model
from .sufficient import CLOSED_FORM, closed_form_cells, fold_statistics

#: The model whose folds are fitted together.
LOGISTIC = "LogisticRegression"

RESULT_SCHEMA = T.StructType([
    T.StructField("classifier_name", T.StringType()),
    T.StructField("features_list", T.ArrayType(T.StringType())),
    T.StructField("fold", T.IntegerType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("auc", T.DoubleType()),
    T.StructField("train_time", T.DoubleType()),
    T.StructField("tn", T.LongType()),
    T.StructField("fp", T.LongType()),
    T.StructField("fn", T.LongType()),
    T.StructField("tp", T.LongType()),
])


def assemble(df: DataFrame, feature_cols: list[str], label: str, fold: str) -> DataFrame:
    """Feature columns → one vector column; label → ``label`` (±1); fold → ``fold``."""
    va = VectorAssembler(inputCols=feature_cols, outputCol=FEATURES, handleInvalid="keep")
    return va.transform(df.select(*[F.col(c).cast("double").alias(c) for c in feature_cols],
                                  F.col(label).cast("int").alias(LABEL), F.col(fold).cast("int").alias("fold"))
                        ).select(FEATURES, LABEL, "fold")


def _cell(data: DataFrame, model_name: str, k: int, features: list[str]) -> tuple:
    train = data.where(F.col("fold") != k)
    test = data.where(F.col("fold") == k)
    t0 = time.time()
    model = make_model(model_name).fit(train)
    fit_time = time.time() - t0
    m = binary_metrics(model.predict(test), [], label=LABEL, prediction="prediction").first()
    if m is None or not m["n"]:
        return (model_name, features, k, None, None, fit_time, 0, 0, 0, 0)
    return (model_name, features, int(k), float(m["accuracy"]), None if m["auc"] is None else float(m["auc"]),
            fit_time, m["tn"], m["fp"], m["fn"], m["tp"])


class Grid:
    """A feature frame assembled and cached once, on which (model, feature columns) cells are cross-validated.

    Models with a closed form come from sufficient statistics, gathered in one pass when first needed and
    kept for later calls; the others are a Spark fit per cell and fold, from a small pool of driver threads."""

    def __init__(self, df: DataFrame, columns: list[str], label: str = "IsEfficient", fold: str = "group_number", threads: int = 4):
        self.spark, self.columns, self.threads = df.sparkSession, list(columns), threads
        self.data = assemble(df, self.columns, label, fold).persist(StorageLevel.MEMORY_AND_DISK)
        self._stats = self._folds = None

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.data.unpersist()

    @property
    def folds(self) -> list[int]:
        if self._folds is None:
            self._folds = sorted(r["fold"] for r in self.data.select("fold").distinct().collect())
        return self._folds

    def closed_form(self, cells: list[tuple[str, list[str]]]) -> list[tuple]:
        if not cells:
            return []
        if self._stats is None:
            self._stats = fold_statistics(self.data, len(self.columns))
            self._folds = sorted(self._stats.folds)
        return closed_form_cells(self.data, self.columns, cells, self._stats)

    def fit_cell(self, job: tuple[str, list[str], int]) -> tuple:
        model, cols, k = job
        sliced = self.data
        if list(cols) != self.columns:
            slicer = VectorSlicer(inputCol="__xc_wide", outputCol=FEATURES, indices=[self.columns.index(c) for c in cols])
            sliced = slicer.transform(self.data.withColumnRenamed(FEATURES, "__xc_wide")).drop("__xc_wide")
        return _cell(sliced, model, k, list(cols))

    def run(self, cells: list[tuple[str, list[str]]], done_path: str | None = None) -> list[tuple]:
        """Result rows of the cells; with ``done_path`` what is there is left out, and what is new is appended."""
        exact = [(m, list(c)) for m, c in cells if m in CLOSED_FORM or m == LOGISTIC]
        fitted = [(m, list(c)) for m, c in cells if m not in CLOSED_FORM and m != LOGISTIC]
        jobs = [(m, c, k) for m, c in fitted for k in self.folds] if fitted else []
        if done_path:
            keys = ["classifier_name", "features_list", "fold"]
            asked = [*jobs, *[(m, c, k) for m, c in exact for k in self.folds]]
            frame = self.spark.createDataFrame(asked, "classifier_name string, features_list array<string>, fold int")
            left = {(r[0], tuple(r[1]), r[2]) for r in pending_cells(self.spark, frame, done_path, keys).collect()}
            jobs = [j for j in jobs if (j[0], tuple(j[1]), j[2]) in left]
            exact = [(m, c) for m, c in exact if any((m, tuple(c), k) in left for k in self.folds)]

        def fit(job):
            row = self.fit_cell(job)
            if done_path:
                append_cell(self.spark.createDataFrame([row], RESULT_SCHEMA), done_path)
            return row

        rows = self.closed_form([c for c in exact if c[0] != LOGISTIC])
        together = [c for c in exact if c[0] == LOGISTIC]
        rows += logistic_cells(self.data, self.columns, together, self.folds) if together else []
        if done_path and rows:
            rows = [r for r in rows if (r[0], tuple(r[1]), r[2]) in left]
            append_cell(self.spark.createDataFrame(rows, RESULT_SCHEMA), done_path)
        with ThreadPoolExecutor(max_workers=max(1, self.threads)) as pool:
            return rows + list(pool.map(fit, jobs))


def cv_grid(df: DataFrame, cells: list[tuple[str, list[str]]], label: str = "IsEfficient", fold: str = "group_number",
            threads: int = 4, done_path: str | None = None) -> DataFrame:
    """V2 over a grid of (model, feature columns): one row per cell and fold.

    All columns of the grid are assembled and cached once.  With ``done_path`` finished cells are appended
    there and skipped by a later run (S9)."""
    columns = list(dict.fromkeys(c for _, cols in cells for c in cols))
    with Grid(df, columns, label, fold, threads) as grid:
        rows = grid.run(cells, done_path)
    if done_path:
        return df.sparkSession.read.schema(RESULT_SCHEMA).parquet(done_path)
    return df.sparkSession.createDataFrame(rows, RESULT_SCHEMA)


def grouped_cv(df: DataFrame, feature_cols: list[str], models: list[str], label: str = "IsEfficient",
               fold: str = "group_number", threads: int = 4, done_path: str | None = None) -> DataFrame:
    """V2: leave-one-fold-out evaluation of every model on the given feature columns.  Returns one
    row per (model, fold) with accuracy (``score``), hard-label ``auc`` (null for a one-class
    fold), fit wall time and the confusion counts."""
    return cv_grid(df, [(m, feature_cols) for m in models], label, fold, threads, done_path)


def pooled_cv(df: DataFrame, feature_cols: list[str], models: list[str], label: str, fold: str,
              threads: int = 4) -> DataFrame:
    """V1 evaluation: out-of-fold predictions of every fold pooled, then one accuracy / AUC per
    model (the stratified folds come from ``folds.stratified_folds``)."""
    spark = df.sparkSession
    with Grid(df, list(feature_cols), label, fold, threads) as grid:
        parts = grid.run([(m, list(feature_cols)) for m in models])
    # the confusion counts of the folds add up to those of the pooled predictions
    counts = spark.createDataFrame(parts, RESULT_SCHEMA).groupBy("classifier_name", "features_list").agg(
        F.sum("train_time").alias("train_time"), *[F.sum(c).alias(c) for c in ("tn", "fp", "fn", "tp")])
    right, total = F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")
    rates = (F.try_divide("tp", F.col("tp") + F.col("fn")) + F.try_divide("tn", F.col("tn") + F.col("fp"))) / 2
    pooled = counts.withColumns({"fold": F.lit(None).cast("int"), "score": F.try_divide(right, total), "auc": rates})
    return pooled.select(*[f.name for f in RESULT_SCHEMA])

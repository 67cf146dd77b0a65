"""Classifier zoo (C1–C16) behind one interface: ``fit(train) -> Model``, ``Model.predict(df)``
adds ``prediction`` ∈ {−1, +1} (and ``raw`` when there is a margin).

Input frames hold a ``features`` vector column and a ``label`` column in {−1, +1}.  Built-in
``pyspark.ml`` estimators are used where their objective matches (C1, C5, C9, C13, C14, C16).  The
rest are small distributed trainers: the data stays partitioned on the executors and only p-sized
(or p×p-sized) sums travel to the driver:

- ``SquaredHingeSVM`` (C7, C8, C15): Newton steps on the active set.  Each pass returns the
  active rows' Gram matrix and Xᵀy per partition (``mapInPandas``), summed on the driver, which
  solves the p×p system (L2) or runs coordinate descent on it (L1).
- ``MixedOnline`` (C2, C3, C10, C11): iterative parameter mixing — each epoch every partition runs
  the online update from the shared weights, the driver averages the results weighted by rows.
- ``RBFSVM`` (C6): random Fourier features (vectorised numpy inside a pandas UDF) + LinearSVC.
- ``NearestCentroid`` (C12): class means via ``Summarizer``; distances to the (two) centroids as
  column expressions — the centroids are one vector per class, a bound set by the label domain.
- ``KNeighbors`` (C4): exact, from one matrix or, beyond a bound, a join of blocks (``neighbors``).
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml import Pipeline
from pyspark.ml.classification import LinearSVC, LogisticRegression, NaiveBayes, RandomForestClassifier
from pyspark.ml.feature import Binarizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import staged
from .neighbors import k_nearest

FEATURES = "features"
LABEL = "label"


def _label01(df: DataFrame) -> DataFrame:
    return df.withColumn("__xc_y01", ((F.col(LABEL) + 1) / 2).cast("double"))


def _sign(c) -> F.Column:
    return F.when(c > 0, F.lit(1)).otherwise(F.lit(-1))


def _n_features(df: DataFrame) -> int:
    return len(df.select(vector_to_array(FEATURES).alias("a")).first()["a"])


# ---- Spark ML wrappers -------------------------------------------------------------------------


@dataclass
class SparkMLModel:
    model: object
    kind: str  # "classifier" (0/1 prediction) or "regressor" (sign of raw)

    def predict(self, df: DataFrame) -> DataFrame:
        out = self.model.transform(df)
        if self.kind == "regressor":
            return out.withColumn("raw", F.col("__xc_raw")).withColumn("prediction", _sign(F.col("__xc_raw"))).drop("__xc_raw")
        return out.withColumn("prediction", F.when(F.col("__xc_pred") > 0.5, 1).otherwise(-1)).drop("__xc_pred")


class Ridge:
    """Least squares on ±1 with an L2 penalty α, predicted by the sign.  Spark's normal-equation
    solver with regParam = α·std_pop(y)/n reproduces the intercept-free-penalty ridge."""

    def __init__(self, alpha: float = 1.0):
        self.alpha = alpha

    def fit(self, train: DataFrame) -> SparkMLModel:
        n, sd = train.agg(F.count(F.lit(1)), F.stddev_pop(F.col(LABEL).cast("double"))).first()
        reg = self.alpha * (sd or 1.0) / max(n, 1)
        lr = LinearRegression(featuresCol=FEATURES, labelCol="__xc_y", predictionCol="__xc_raw", solver="normal",
                              elasticNetParam=0.0, regParam=reg, standardization=False)
        return SparkMLModel(lr.fit(train.withColumn("__xc_y", F.col(LABEL).cast("double"))), "regressor")


class Logistic:
    """L2 logistic regression with C (regParam = 1/(C·n))."""

    def __init__(self, C: float = 1.0):
        self.C = C

    def fit(self, train: DataFrame) -> SparkMLModel:
        n = train.count()
        lr = LogisticRegression(featuresCol=FEATURES, labelCol="__xc_y01", predictionCol="__xc_pred",
                                regParam=1.0 / (self.C * max(n, 1)), elasticNetParam=0.0, standardization=False,
                                rawPredictionCol="__xc_rawp", probabilityCol="__xc_prob")
        m = lr.fit(_label01(train))
        return _Dropping(SparkMLModel(m, "classifier"), ["__xc_rawp", "__xc_prob"])


class Forest:
    """Random forest (seeded)."""

    def __init__(self, num_trees: int = 10, seed: int = 42):
        self.num_trees, self.seed = num_trees, seed

    def fit(self, train: DataFrame) -> SparkMLModel:
        rf = RandomForestClassifier(featuresCol=FEATURES, labelCol="__xc_y01", predictionCol="__xc_pred",
                                    numTrees=self.num_trees, seed=self.seed, rawPredictionCol="__xc_rawp",
                                    probabilityCol="__xc_prob")
        return _Dropping(SparkMLModel(rf.fit(_label01(train)), "classifier"), ["__xc_rawp", "__xc_prob"])


class HingeSVM:
    """Linear SVM, hinge loss, L2 penalty α (Spark's LinearSVC, OWL-QN/L-BFGS)."""

    def __init__(self, alpha: float = 1e-4, max_iter: int = 100):
        self.alpha, self.max_iter = alpha, max_iter

    def fit(self, train: DataFrame) -> SparkMLModel:
        svc = LinearSVC(featuresCol=FEATURES, labelCol="__xc_y01", predictionCol="__xc_pred", regParam=self.alpha,
                        standardization=False, maxIter=self.max_iter, rawPredictionCol="__xc_rawp")
        return _Dropping(SparkMLModel(svc.fit(_label01(train)), "classifier"), ["__xc_rawp"])


def _minmax_clamped(arr_col, lo: list, hi: list) -> F.Column:
    """(x − min)/(max − min) clamped to [0, 1]; a constant column gives 0 (Q27)."""
    lo_a = F.array(*[F.lit(float(v)) for v in lo])
    rng = F.array(*[F.lit(float(h - l)) for l, h in zip(lo, hi)])
    scaled = F.zip_with(F.zip_with(arr_col, lo_a, lambda x, a: x - a), rng,
                        lambda d, r: F.when(r > 0, F.least(F.greatest(d / r, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0)))
    return array_to_vector(scaled)


@dataclass
class NBModel:
    model: object
    lo: list | None
    hi: list | None

    def predict(self, df: DataFrame) -> DataFrame:
        x = df
        if self.lo is not None:
            x = x.withColumn("__xc_nb", _minmax_clamped(vector_to_array(FEATURES), self.lo, self.hi))
        else:
            x = x.withColumn("__xc_nb", F.col(FEATURES))
        out = self.model.transform(x)
        return out.withColumn("prediction", F.when(F.col("__xc_pred") > 0.5, 1).otherwise(-1)).drop(
            "__xc_pred", "__xc_nb", "__xc_nbb", "__xc_rawp", "__xc_prob")


class NaiveBayesModel:
    """C13 (multinomial on features min-max scaled by the training range, clamped to [0, 1] so
    test rows stay non-negative) and C14 (Bernoulli on x > 0)."""

    def __init__(self, kind: str = "multinomial", smoothing: float = 0.01):
        self.kind, self.smoothing = kind, smoothing

    def fit(self, train: DataFrame) -> NBModel:
        nb_kwargs = dict(labelCol="__xc_y01", predictionCol="__xc_pred", modelType=self.kind,
                         smoothing=self.smoothing, rawPredictionCol="__xc_rawp", probabilityCol="__xc_prob")
        if self.kind == "bernoulli":
            stages = [Binarizer(threshold=0.0, inputCol="__xc_nb", outputCol="__xc_nbb"),
                      NaiveBayes(featuresCol="__xc_nbb", **nb_kwargs)]
            m = Pipeline(stages=stages).fit(_label01(train).withColumn("__xc_nb", F.col(FEATURES)))
            return NBModel(m, None, None)
        r = train.agg(Summarizer.min(F.col(FEATURES)).alias("lo"), Summarizer.max(F.col(FEATURES)).alias("hi")).first()
        lo, hi = r["lo"].toArray().tolist(), r["hi"].toArray().tolist()
        x = _label01(train).withColumn("__xc_nb", _minmax_clamped(vector_to_array(FEATURES), lo, hi))
        m = NaiveBayes(featuresCol="__xc_nb", **nb_kwargs).fit(x)
        return NBModel(m, lo, hi)


@dataclass
class _Dropping:
    inner: SparkMLModel
    drop: list = field(default_factory=list)

    def predict(self, df: DataFrame) -> DataFrame:
        return self.inner.predict(df).drop(*self.drop)


# ---- nearest centroid (C12) ----------------------------------------------------------------------


@dataclass
class CentroidModel:
    centroids: dict  # label -> list[float]

    def predict(self, df: DataFrame) -> DataFrame:
        arr = vector_to_array(FEATURES)
        best = None
        for lab, c in sorted(self.centroids.items()):
            cen = F.array(*[F.lit(float(v)) for v in c])
            d = F.aggregate(F.zip_with(arr, cen, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, b: a + b)
            best = F.struct(d.alias("d"), F.lit(int(lab)).alias("l")) if best is None else F.least(
                best, F.struct(d.alias("d"), F.lit(int(lab)).alias("l")))
        return df.withColumn("prediction", best["l"])


class NearestCentroid:
    """Predict the class whose mean vector is nearest (Euclidean; ties → smaller label)."""

    def fit(self, train: DataFrame) -> CentroidModel:
        rows = train.groupBy(LABEL).agg(Summarizer.mean(F.col(FEATURES)).alias("m")).collect()
        return CentroidModel({r[LABEL]: r["m"].toArray().tolist() for r in rows})


# ---- k nearest neighbours (C4) -----------------------------------------------------------------------

#: Labelled rows up to which the neighbour model is one matrix, shipped once to every task.
KNN_ROWS = 20_000


@dataclass
class NeighborModel:
    X: np.ndarray
    y: np.ndarray
    k: int

    def predict(self, df: DataFrame) -> DataFrame:
        X, y, k = self.X, self.y, self.k
        squares = (X * X).sum(axis=1)

        @F.pandas_udf(T.IntegerType())
        def vote(rows: pd.Series) -> pd.Series:
            out = []
            for lo in range(0, len(rows), 256):
                Z = np.vstack(rows.iloc[lo:lo + 256].to_numpy())
                d = squares[None, :] - 2 * Z @ X.T + (Z * Z).sum(axis=1)[:, None]
                m = min(k, len(y))
                near = np.argpartition(d, m - 1, axis=1)[:, :m]
                out.append(np.where(y[near].sum(axis=1) > 0, 1, -1))
            return pd.Series(np.concatenate(out) if out else np.zeros(0), dtype="int32")

        return df.withColumn("prediction", vote(vector_to_array(FEATURES)))


@dataclass
class BlockNeighborModel:
    """The same vote over any number of labelled rows, which stay a table: ``neighbors.k_nearest``."""

    known: DataFrame
    k: int

    def predict(self, df: DataFrame) -> DataFrame:
        rows = staged(df.withColumn("__xc_row", F.monotonically_increasing_id()), "neighbors-rows")
        near = k_nearest(rows.select(F.col("__xc_row").alias("id"), vector_to_array(FEATURES).alias("x")), self.known, self.k)
        votes = F.aggregate("near", F.lit(0), lambda a, n: a + n["y"])
        found = near.select(F.col("id").alias("__xc_row"), F.when(votes > 0, 1).otherwise(-1).alias("prediction"))
        # a row with an entry that is not finite has no neighbours, hence no votes
        voted = rows.join(found, "__xc_row", "left").drop("__xc_row")
        return voted.withColumn("prediction", F.coalesce("prediction", F.lit(-1)))


class KNeighbors:
    """C4: majority of the ``k`` nearest labelled rows (Euclidean; a tie is the lower label).

    Up to ``rows`` labelled rows are one bounded matrix in every task, so prediction is a scan without a
    join.  More than that stay a table of blocks, and prediction is a join of blocks with the same result."""

    def __init__(self, k: int = 10, rows: int = KNN_ROWS):
        self.k, self.rows = k, rows

    def fit(self, train: DataFrame) -> NeighborModel | BlockNeighborModel:
        total = train.count()
        x = vector_to_array(FEATURES)
        data = train.select(x.alias("x"), F.col(LABEL).cast("int").alias("y"))
        if total > self.rows:
            return BlockNeighborModel(staged(data, "neighbors-labelled"), self.k)
        rows = data.collect()
        return NeighborModel(np.array([r["x"] for r in rows], float), np.array([r["y"] for r in rows]), self.k)


# ---- squared-hinge SVM by active-set Newton (C7, C8, C15) --------------------------------------------


#: Partial matrices that reach the driver from one pass, whatever the number of partitions.
GRAM_SUMS = 8


def _gram_pass(train: DataFrame, w: np.ndarray, p: int) -> tuple[float, np.ndarray, np.ndarray, int]:
    """One distributed pass: Σ loss², Gram matrix and Xᵀy over the active rows (y·f < 1)."""
    wb = w.tolist()
    schema = T.StructType([T.StructField("loss", T.DoubleType()), T.StructField("g", T.ArrayType(T.DoubleType())),
                           T.StructField("r", T.ArrayType(T.DoubleType())), T.StructField("na", T.LongType())])

    def part(batches):
        wv = np.asarray(wb)
        G = np.zeros((p + 1, p + 1))
        r = np.zeros(p + 1)
        loss, na = 0.0, 0
        for pdf in batches:
            if len(pdf) == 0:
                continue
            X = np.vstack(pdf["x"].to_numpy())
            X = np.hstack([X, np.ones((len(X), 1))])
            y = pdf["y"].to_numpy(dtype=float)
            m = 1.0 - y * (X @ wv)
            act = m > 0
            loss += float((m[act] ** 2).sum())
            Xa = X[act]
            G += Xa.T @ Xa
            r += Xa.T @ y[act]
            na += int(act.sum())
        yield pd.DataFrame({"loss": [loss], "g": [G.ravel().tolist()], "r": [r.tolist()], "na": [na]})

    def add(pdf):
        return pd.DataFrame({"loss": [pdf["loss"].sum()], "g": [np.sum(pdf["g"].to_list(), axis=0).tolist()],
                             "r": [np.sum(pdf["r"].to_list(), axis=0).tolist()], "na": [int(pdf["na"].sum())]})

    # partial matrices meet on the executors first; at most GRAM_SUMS of them reach the driver
    sums = train.mapInPandas(part, schema).withColumn("__xc_b", F.pmod(F.spark_partition_id(), F.lit(GRAM_SUMS)))
    rows = sums.groupBy("__xc_b").applyInPandas(lambda pdf: add(pdf), schema).collect()
    loss = sum(x["loss"] for x in rows)
    G = sum(np.asarray(x["g"]).reshape(p + 1, p + 1) for x in rows)
    r = sum(np.asarray(x["r"]) for x in rows)
    return loss, G, r, sum(x["na"] for x in rows)


def _lasso_quadratic(Q: np.ndarray, q: np.ndarray, lam: float, w0: np.ndarray, sweeps: int = 200) -> np.ndarray:
    """min ½wᵀQw − qᵀw + lam·‖w‖₁ by cyclic coordinate descent (driver side, p×p)."""
    w = w0.copy()
    for _ in range(sweeps):
        delta = 0.0
        for j in range(len(w)):
            if Q[j, j] <= 0:
                continue
            rho = q[j] - Q[j] @ w + Q[j, j] * w[j]
            new = np.sign(rho) * max(abs(rho) - lam, 0.0) / Q[j, j]
            delta = max(delta, abs(new - w[j]))
            w[j] = new
        if delta < 1e-12:
            break
    return w


@dataclass
class LinearModel:
    w: np.ndarray  # last entry = intercept

    def predict(self, df: DataFrame) -> DataFrame:
        arr = vector_to_array(FEATURES)
        coef = F.array(*[F.lit(float(v)) for v in self.w[:-1]])
        raw = F.aggregate(F.zip_with(arr, coef, lambda x, y: x * y), F.lit(float(self.w[-1])), lambda a, b: a + b)
        return df.withColumn("raw", raw).withColumn("prediction", _sign(F.col("raw")))


class SquaredHingeSVM:
    """C7 / C15 (penalty l2: ½‖w‖²) and C8 (penalty l1: ‖w‖₁) with C·Σ max(0, 1 − y·f)²; the
    intercept is a penalised weight on a constant feature, as in the reference's library."""

    def __init__(self, C: float = 1.0, penalty: str = "l2", max_passes: int = 30, tol: float = 1e-3):
        self.C, self.penalty, self.max_passes, self.tol = C, penalty, max_passes, tol

    def _objective(self, w, loss):
        reg = 0.5 * float(w @ w) if self.penalty == "l2" else float(np.abs(w).sum())
        return reg + self.C * loss

    def fit(self, train: DataFrame) -> LinearModel:
        data = train.select(vector_to_array(FEATURES).alias("x"), F.col(LABEL).cast("double").alias("y"))
        p = _n_features(train)
        w = np.zeros(p + 1)
        loss, G, r, _ = _gram_pass(data, w, p)
        obj = self._objective(w, loss)
        for _ in range(self.max_passes):
            Q = 2 * self.C * G
            q = 2 * self.C * r
            if self.penalty == "l2":
                cand = np.linalg.solve(np.eye(p + 1) + Q, q)
            else:
                cand = _lasso_quadratic(Q, q, 1.0, w)
            step = 1.0
            while step >= 1e-4:
                trial = w + step * (cand - w)
                t_loss, t_G, t_r, _ = _gram_pass(data, trial, p)
                t_obj = self._objective(trial, t_loss)
                if t_obj <= obj:
                    break
                step /= 2
            else:  # no step along this direction helps: w is kept
                return LinearModel(w)
            done = abs(obj - t_obj) <= self.tol * max(abs(obj), 1.0)
            w, obj, G, r = trial, t_obj, t_G, t_r
            if done:
                return LinearModel(w)
        warnings.warn(f"squared hinge SVM: no convergence in {self.max_passes} passes", stacklevel=2)
        return LinearModel(w)


# ---- online learners by iterative parameter mixing (C2, C3, C10, C11) ------------------------------


#: Shards of the online learners: fixed, so a result does not depend on partitions or batches.
SHARDS = 8


class MixedOnline:
    """Perceptron (C2), passive-aggressive hinge (C3) and SGD hinge with L1 (C10) or elastic-net
    (C11) penalty, trained by iterative parameter mixing (McDonald, Hall & Mann, 2010): rows are
    dealt to ``SHARDS`` shards by a hash of their values, each epoch passes every shard once from
    the common weights, and the shards' weights are averaged by their rows."""

    def __init__(self, rule: str = "perceptron", alpha: float = 1e-4, l1_ratio: float = 0.15, C: float = 1.0,
                 epochs: int = 50, seed: int = 42):
        self.rule, self.alpha, self.l1_ratio, self.C, self.epochs, self.seed = rule, alpha, l1_ratio, C, epochs, seed

    def fit(self, train: DataFrame) -> LinearModel:
        p = _n_features(train)
        hashed = F.xxhash64(F.lit(self.seed), vector_to_array(FEATURES).cast("string"), F.col(LABEL))
        data = train.select(vector_to_array(FEATURES).alias("x"), F.col(LABEL).cast("double").alias("y"), hashed.alias("o"))
        data = data.withColumn("s", F.pmod(F.xxhash64("o"), F.lit(SHARDS)).cast("int"))
        data = data.repartition(SHARDS, "s").sortWithinPartitions("s", "o", "y").persist(StorageLevel.MEMORY_AND_DISK)
        w, rows_of = np.zeros(p + 1), {}
        try:
            for epoch in range(self.epochs):
                step = self._epoch(w.tolist(), epoch, rows_of)
                rows = data.mapInPandas(step, "s int, w array<double>, n long").collect()
                rows_of = {r["s"]: r["n"] for r in rows}
                total = sum(rows_of.values())
                if not total:
                    break
                w = sum(np.asarray(r["w"]) * r["n"] for r in sorted(rows, key=lambda r: r["s"])) / total
        finally:
            data.unpersist()
        return LinearModel(w)

    def _epoch(self, start: list[float], epoch: int, rows_of: dict[int, int]):
        rule, alpha, l1r, C = self.rule, self.alpha, self.l1_ratio, self.C

        def update(w, xi, yi, t):
            f = float(xi @ w)
            if rule == "perceptron":
                return w + yi * xi if yi * f <= 0 else w
            if rule == "passive_aggressive":
                loss = max(0.0, 1.0 - yi * f)
                return w + min(C, loss / float(xi @ xi)) * yi * xi if loss > 0 else w
            eta = 1.0 / (alpha * (1.0 / alpha + t))
            w = w * (1.0 - eta * alpha * (1.0 - l1r))
            if yi * f < 1:
                w = w + eta * yi * xi
            w[:-1] = np.sign(w[:-1]) * np.maximum(np.abs(w[:-1]) - eta * alpha * l1r, 0.0)
            return w

        def run(batches):
            states: dict[int, tuple[np.ndarray, int]] = {}
            for pdf in batches:
                for shard, part in pdf.groupby("s", sort=False):
                    w, n = states.get(shard, (np.asarray(start), 0))
                    X = np.hstack([np.vstack(part["x"].to_numpy()), np.ones((len(part), 1))])
                    # the step counter runs on over batches and epochs
                    for xi, yi in zip(X, part["y"].to_numpy(dtype=float)):
                        n += 1
                        w = update(w, xi, yi, epoch * rows_of.get(int(shard), 0) + n)
                    states[shard] = (w, n)
            if not states:
                return
            yield pd.DataFrame({"s": [int(k) for k in states], "w": [w.tolist() for w, _ in states.values()],
                                "n": [n for _, n in states.values()]})

        return run


# ---- RBF kernel SVM via random Fourier features (C6) -------------------------------------------


@dataclass
class RFFModel:
    W: np.ndarray
    b: np.ndarray
    inner: object

    def predict(self, df: DataFrame) -> DataFrame:
        return self.inner.predict(_rff(df, self.W, self.b)).drop("__xc_rff").withColumnRenamed("__xc_orig", FEATURES)


def _rff(df: DataFrame, W: np.ndarray, b: np.ndarray) -> DataFrame:
    Wl, bl, D = W.tolist(), b.tolist(), W.shape[1]

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def rff(x: pd.Series) -> pd.Series:
        X = np.vstack(x.to_numpy()) if len(x) else np.zeros((0, len(Wl)))
        Z = np.sqrt(2.0 / D) * np.cos(X @ np.asarray(Wl) + np.asarray(bl))
        return pd.Series(list(Z))

    return (df.withColumnRenamed(FEATURES, "__xc_orig")
            .withColumn("__xc_rff", rff(vector_to_array("__xc_orig")))
            .withColumn(FEATURES, array_to_vector("__xc_rff")))


class RBFSVM:
    """RBF kernel exp(−γ‖x−x'‖²) approximated by D random Fourier features, then a linear SVM
    with regParam = 1/(C·n).  γ defaults to 1/(p+1) (Q22)."""

    def __init__(self, C: float = 1e-8, gamma: float | None = None, n_components: int = 100, seed: int = 42):
        self.C, self.gamma, self.D, self.seed = C, gamma, n_components, seed

    def fit(self, train: DataFrame) -> RFFModel:
        p = _n_features(train)
        gamma = self.gamma if self.gamma is not None else 1.0 / (p + 1)
        rng = np.random.default_rng(self.seed)
        W = rng.normal(0.0, np.sqrt(2 * gamma), size=(p, self.D))
        b = rng.uniform(0, 2 * np.pi, size=self.D)
        n = train.count()
        z = _rff(train, W, b).drop("__xc_rff", "__xc_orig").persist(StorageLevel.MEMORY_AND_DISK)
        inner = HingeSVM(alpha=1.0 / (self.C * max(n, 1)), max_iter=200).fit(z)
        z.unpersist()
        return RFFModel(W, b, inner)


# ---- registry ----------------------------------------------------------------------------------

MODELS = {
    "RidgeClassifier": lambda: Ridge(alpha=1.0),
    "Perceptron": lambda: MixedOnline("perceptron"),
    "PassiveAggressive": lambda: MixedOnline("passive_aggressive", C=1.0),
    "KNeighbors": lambda: KNeighbors(k=10),
    "RandomForest": lambda: Forest(num_trees=10),
    "SVC_rbf": lambda: RBFSVM(C=1e-8),
    "LinearSVC_l1": lambda: SquaredHingeSVM(penalty="l1"),
    "LinearSVC_l2": lambda: SquaredHingeSVM(penalty="l2"),
    "SGD_l2": lambda: HingeSVM(alpha=1e-4),
    "SGD_l1": lambda: MixedOnline("sgd", alpha=1e-4, l1_ratio=1.0),
    "SGD_elasticnet": lambda: MixedOnline("sgd", alpha=1e-4, l1_ratio=0.15),
    "NearestCentroid": lambda: NearestCentroid(),
    "MultinomialNB": lambda: NaiveBayesModel("multinomial", 0.01),
    "BernoulliNB": lambda: NaiveBayesModel("bernoulli", 0.01),
    "LinearSVC": lambda: SquaredHingeSVM(penalty="l2"),
    "LogisticRegression": lambda: Logistic(C=1.0),
}


def make_model(name: str):
    return MODELS[name]()

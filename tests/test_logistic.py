"""Logistic regression of all folds at once: the optimum of every fold, few passes, edge cases."""

import numpy as np
import pytest

from xcomm.operators import logistic
from xcomm.operators.evaluate import Grid, pooled_cv
from xcomm.operators.models import LABEL, make_model


def frame(spark, n=600, k=7, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) * [1.0, 40.0, 0.1] + [0.0, 900.0, 5.0]
    y = np.where(x[:, 0] + (x[:, 1] - 900) / 40 + rng.normal(size=n) > 0, 1, -1)
    rows = [(*map(float, r), int(c), i % k) for i, (r, c) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "a double, b double, c double, y int, fold int").repartition(5), x, y


def test_every_fold_is_at_its_optimum(spark):
    df, x, y = frame(spark)
    with Grid(df, ["a", "b", "c"], "y", "fold") as grid:
        shift, models = logistic.fit_folds(grid.data, [0, 1, 2], grid.folds)
    for k, w in enumerate(models):
        out = np.arange(len(x)) % 7 != k
        z, t = np.hstack([x[out] - shift, np.ones((out.sum(), 1))]), (y[out] == 1).astype(float)
        gradient = z.T @ (1 / (1 + np.exp(-z @ w)) - t) + np.append(w[:-1], 0.0)
        assert np.abs(gradient).max() < 1e-4


def test_folds_are_fitted_in_common_passes(spark, monkeypatch):
    passes = []
    monkeypatch.setattr(logistic, "_pass", lambda *a, run=logistic._pass: passes.append(1) or run(*a))
    df, x, y = frame(spark, k=60)
    got = pooled_cv(df, ["a", "b", "c"], ["LogisticRegression"], "y", "fold").first()
    assert got["tn"] + got["fp"] + got["fn"] + got["tp"] == len(x) and got["score"] > 0.8
    assert 0 < len(passes) < 25


def test_same_counts_as_a_fit_per_fold_and_column_subsets(spark):
    df, _, _ = frame(spark, k=3)
    with Grid(df, ["a", "b", "c"], "y", "fold") as grid:
        rows = {r[2]: r for r in grid.run([("LogisticRegression", ["c", "a"])])}
        for k in grid.folds:
            assert rows[k][6:] == grid.fit_cell(("LogisticRegression", ["c", "a"], k))[6:]
        test = grid.data.where("fold = 1")
        alone = make_model("LogisticRegression").fit(grid.data.where("fold <> 1")).predict(test)
        with Grid(df, ["a", "b", "c"], "y", "fold") as other:
            whole = {r[2]: r for r in other.run([("LogisticRegression", ["a", "b", "c"])])}[1]
        assert whole[9] == alone.where(f"{LABEL} = 1 and prediction = 1").count()


def test_one_class_and_bad_rows(spark):
    rows = [(1.0, 1, 0), (2.0, 1, 0), (3.0, -1, 1), (4.0, 1, 1)]
    df = spark.createDataFrame(rows, "a double, y int, fold int")
    with Grid(df, ["a"], "y", "fold") as grid:
        found = {r[2]: r for r in grid.run([("LogisticRegression", ["a"])])}
    assert found[1][6:] == (0, 1, 0, 1)  # outside fold 1 there is class 1 only
    bad = spark.createDataFrame([*rows, (float("nan"), 1, 1)], "a double, y int, fold int")
    with Grid(bad, ["a"], "y", "fold") as grid, pytest.raises(Exception, match="finite"):
        grid.run([("LogisticRegression", ["a"])])

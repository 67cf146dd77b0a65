"""Closed-form cross-validation: equal to fitting every cell, in one pass and in a tree of partial sums."""

import numpy as np
import pandas as pd
import pytest

from xcomm.operators import sufficient
from xcomm.operators.evaluate import Grid, _cell, assemble, cv_grid, pooled_cv
from xcomm.operators.select import feature_group_search, stepwise

COLUMNS = ["a", "b", "c", "d", "e"]


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (400, 5)) * [1, 10, 0.1, 1000, 0] + [0, -3, 5, 1e6, 2]  # mixed scales, a large mean, a constant column
    y = np.where(x[:, 0] + x[:, 1] / 10 + rng.normal(0, 1.2, 400) > 0, 1, -1)
    fold = np.where(y == 1, rng.integers(0, 5, 400), rng.integers(0, 4, 400))  # the last fold has one class
    return spark.createDataFrame(pd.DataFrame(x, columns=COLUMNS).assign(IsEfficient=y, group_number=fold)).repartition(6)


CELLS = [(m, cols) for m in sufficient.CLOSED_FORM for cols in (COLUMNS, ["b", "d"], ["e"], ["c"])]


def test_cells_equal_fitted_models(spark, frame):
    got = {(r[0], tuple(r[1]), r[2]): r for r in Grid(frame, COLUMNS).run(CELLS)}
    assert len(got) == len(CELLS) * 5
    for model, cols in CELLS:
        data = assemble(frame, cols, "IsEfficient", "group_number").cache()
        for k in (0, 4):
            want, row = _cell(data, model, k, cols), got[model, tuple(cols), k]
            assert row[3:5] == pytest.approx(want[3:5]) if want[4] is not None else (row[3], row[4]) == (pytest.approx(want[3]), None)
            assert row[6:] == want[6:], (model, cols, k)
        data.unpersist()


def test_partial_sums_meet_in_a_tree(spark, frame, monkeypatch):
    data = assemble(frame, COLUMNS, "IsEfficient", "group_number")
    whole = sufficient.fold_statistics(data, 5).total()
    monkeypatch.setattr(sufficient, "FAN", 2)
    tree = sufficient.fold_statistics(data, 5)
    for name in ("n", "sums", "positive", "gram", "low", "high"):
        np.testing.assert_allclose(getattr(tree.total(), name), getattr(whole, name), rtol=1e-9, atol=1e-6)
    x = frame.toPandas()
    for k, s in tree.outside().items():
        own = x[x.group_number != k]
        np.testing.assert_allclose(s.n, [(own.IsEfficient == -1).sum(), (own.IsEfficient == 1).sum()])
        np.testing.assert_allclose(s.low, own[COLUMNS].min())
        np.testing.assert_allclose(s.high, own[COLUMNS].max())


def test_stepwise_equals_a_plain_search(spark, frame):
    """Greedy search over the same cells, cell by cell."""
    score = {}

    def auc(cols):
        if tuple(cols) not in score:
            rows = Grid(frame, list(cols)).run([("NearestCentroid", list(cols))])
            score[tuple(cols)] = float(np.mean([r[4] for r in rows if r[4] is not None]))
        return score[tuple(cols)]

    names, current, best, taken = ["a", "b", "c"], ["a", "b", "c"], 0.0, []
    while len(current) > 1:
        cands = [[f for f in current if f != drop] for drop in current]
        top = max(range(len(cands)), key=lambda i: (auc(cands[i]), i))
        if auc(cands[top]) < best:
            break
        current, best = cands[top], auc(cands[top])
        taken.append(tuple(current))
    rows = stepwise(frame, names, ["NearestCentroid"], "IsEfficient", "group_number").collect()
    assert [tuple(r.features_list) for r in rows if r.chosen] == taken
    assert all(r.auc == pytest.approx(score[tuple(r.features_list)]) for r in rows)


def test_searches_and_resume(spark, frame, tmp_path):
    groups = {"one": ["a", "b"], "two": ["c"], "text": ["d", "e"]}
    models = ["NearestCentroid", "RidgeClassifier"]
    found = feature_group_search(frame, groups, models, "IsEfficient", "group_number", must_include="text").collect()
    assert len(found) == 4 * 2 * 5 and {tuple(r.group_list) for r in found} == {("text",), ("one", "text"), ("two", "text"), ("one", "two", "text")}
    path = str(tmp_path / "cells")
    cells = [("NearestCentroid", ["a"]), ("BernoulliNB", ["a", "b"])]
    first = cv_grid(frame, cells[:1], done_path=path).count()
    assert first == 5 and cv_grid(frame, cells, done_path=path).count() == 10 and cv_grid(frame, cells, done_path=path).count() == 10
    pooled = pooled_cv(frame, COLUMNS, models, "IsEfficient", "group_number").collect()
    assert all(r.tn + r.fp + r.fn + r.tp == 400 for r in pooled)


def test_empty_and_single_class(spark, frame):
    assert Grid(frame.where("false"), COLUMNS).run(CELLS) == []
    one = Grid(frame.where("IsEfficient = 1"), ["a"]).run([(m, ["a"]) for m in sufficient.CLOSED_FORM])
    assert all(r[3] == 1.0 and r[4] is None for r in one)

"""Exact neighbours by blocks: equal to all distances, with ties, equal rows and far cells pruned."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from xcomm.operators.models import FEATURES, LABEL, BlockNeighborModel, KNeighbors
from xcomm.operators.neighbors import k_nearest, near_cells


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(0, 9, (500, 3)) + rng.choice([-90, 0, 90], (500, 1)))  # whole numbers: many exact ties
    x = np.vstack([x, np.tile(x[:1], (200, 1))])  # a third of the rows are equal
    return x, rng.choice([-1, 1], len(x)), np.round(rng.normal(0, 60, (80, 3)))


@pytest.mark.parametrize("block,pivots", [(40, 16), (1000, 256), (7, 3)])
def test_k_nearest_equals_all_distances(spark, points, block, pivots):
    x, y, asked = points
    known = spark.createDataFrame([(r.tolist(), int(c)) for r, c in zip(x, y)], "x array<double>, y int").repartition(4)
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(asked)], "id long, x array<double>")
    got = {r.id: [(round(n.d, 6), n.y) for n in r.near] for r in k_nearest(rows, known, 10, block, pivots).collect()}
    for i, a in enumerate(asked):
        d = np.round(((x - a) ** 2).sum(1), 6)
        assert got[i] == sorted(zip(d.tolist(), y.tolist()))[:10]


def test_few_rows_and_models(spark, points):
    x, y, asked = points
    known = spark.createDataFrame([([0.0], 1), ([1.0], -1)], "x array<double>, y int")
    rows = spark.createDataFrame([(1, [0.2]), (2, [5.0])], "id long, x array<double>")
    assert {r.id: [n.y for n in r.near] for r in k_nearest(rows, known, 10).collect()} == {1: [1, -1], 2: [-1, 1]}
    assert k_nearest(rows, known.where("false"), 10).count() == 0 and k_nearest(rows.where("false"), known, 10).count() == 0
    frame = lambda v, l: spark.createDataFrame([(r.tolist(), int(c)) for r, c in zip(v, l)], "x array<double>, y int").select(array_to_vector("x").alias(FEATURES), F.col("y").alias(LABEL))
    train, test = frame(x[:400], y[:400]), frame(asked, np.ones(len(asked)))
    blocks = KNeighbors(5, rows=50).fit(train)
    assert isinstance(blocks, BlockNeighborModel)
    got = {tuple(r[FEATURES]): r.prediction for r in blocks.predict(test).collect()}
    for a in asked:
        near = sorted(zip(np.round(((x[:400] - a) ** 2).sum(1), 9).tolist(), y[:400].tolist()))[:5]
        assert got[tuple(a)] == (1 if sum(c for _, c in near) > 0 else -1)


def test_far_cells_are_pruned():
    pivots = np.array([[0.0], [1.0], [100.0]])
    sizes = (np.array([5, 5, 5]), np.array([0.4, 0.4, 0.4])), (np.array([20, 20, 20]), np.array([0.5, 0.5, 0.5]))
    pairs = near_cells(pivots, *sizes, 10)
    assert (0, 0) in pairs and (0, 2) not in pairs and (2, 0) not in pairs


def test_rows_that_are_not_finite_stay_and_copies_count(spark):
    known = [([0.0, 0.0], 1)] * 30 + [([0.5, 0.0], -1)] * 4 + [([float("nan"), 0.0], -1)] * 40 + [([9.0, float(i)], -1) for i in range(30)]
    frame = lambda rows: spark.createDataFrame(rows, "x array<double>, y int").select(array_to_vector("x").alias(FEATURES), F.col("y").alias(LABEL))
    model = KNeighbors(10, rows=20).fit(frame(known))
    assert isinstance(model, BlockNeighborModel)
    asked = [([0.4, 0.0], 0), ([float("nan"), 1.0], 1), ([9.0, 3.0], 2)]
    assert {r[LABEL]: r.prediction for r in model.predict(frame(asked)).collect()} == {0: 1, 1: -1, 2: -1}


def test_tile_pairs_are_tasks_of_their_own(spark, points):
    """Few bytes, long work: the join of the tiles is not merged into a few tasks."""
    x, y, asked = points
    known = spark.createDataFrame([(r.tolist(), int(c)) for r, c in zip(x, y)], "x array<double>, y int")
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(asked)], "id long, x array<double>")
    near = k_nearest(rows, known, 10, 40, 16)
    assert near.count() == len(asked)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan

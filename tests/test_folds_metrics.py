"""Folds (W2, V1, M7), band (P14) and metrics (V3–V5, V7, A14) against plain loops."""

import random

import pandas as pd
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from xcomm.operators.folds import author_folds, class_sample, history_band, stratified_folds
from xcomm.operators.metrics import binary_metrics, mean_over_folds, roc_table


def loop_folds(authors, k):
    """Rows in author order; fold i takes rows until it holds >= n/k, then the next author opens
    fold i + 1 (a plain statement of the rule)."""
    rows = sorted(authors)
    per = len(rows) / k
    fold, count, last, out = 0, 0, None, []
    for a in rows:
        if count < per:
            count += 1
        elif a != last:
            fold, count = fold + 1, 1
        else:
            count += 1
        out.append((a, fold))
        last = a
    return dict(out)


def test_author_folds_match_loop(spark):
    rnd = random.Random(3)
    cases = [
        ["big"] * 60 + [f"a{i}" for i in range(30)],  # one author with over half the rows
        ["x", "y"],                                    # fewer authors than k
        ["solo"],                                      # one row
        [f"a{rnd.randint(0, 40)}" for _ in range(301)],  # not divisible by k, unsorted
    ]
    for authors in cases:
        for k in (1, 3, 15):
            df = spark.createDataFrame([(i, a) for i, a in enumerate(authors)], "id long, author string")
            got = {r["author"]: r["group_number"] for r in author_folds(df, "author", k).collect()}
            assert got == loop_folds(authors, k), (authors[:5], k)
            assert max(got.values()) < k


def test_stratified_folds_and_sample(spark):
    df = spark.createDataFrame([(i, int(i % 7 == 0)) for i in range(500)], "id long, y int")
    f = stratified_folds(df, "y", "id", 10).toPandas()
    sizes = f.groupby(["y", "fold"]).size()
    assert sizes.max() - sizes.min() <= 1 or all(
        f[f.y == c].groupby("fold").size().max() - f[f.y == c].groupby("fold").size().min() <= 1 for c in (0, 1))
    s = class_sample(df, "y", "id", {1: 20, 0: 1000}).toPandas()
    assert (s.y == 1).sum() == 20 and (s.y == 0).sum() == (df.where("y = 0").count())


def test_band_and_metrics(spark):
    df = spark.createDataFrame([(20.0,), (19.9,), (50.0,), (50.1,)], "p double")
    assert history_band(df, "p", 20.0, 50.0).count() == 2
    pred = spark.createDataFrame([
        (0, 1, 1), (0, 1, -1), (0, -1, -1), (0, -1, -1),  # fold 0
        (1, 1, 1), (1, 1, 1),                              # fold 1: one class only -> null AUC
    ], "fold int, label int, prediction int")
    m = {r["fold"]: r for r in binary_metrics(pred, ["fold"]).collect()}
    assert (m[0]["tn"], m[0]["fp"], m[0]["fn"], m[0]["tp"]) == (2, 0, 1, 1)
    assert m[0]["accuracy"] == 0.75 and m[0]["auc"] == 0.75 and m[1]["auc"] is None
    mean = mean_over_folds(binary_metrics(pred, ["fold"]).withColumn("model", F.lit("m")), ["model"], ["auc"]).first()
    assert mean["auc"] == 0.75 and mean["auc_null_folds"] == 1


def test_roc_area_matches_spark_evaluator(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice([0.1, 0.2, 0.3, 0.5, 0.9]), rnd.randint(0, 1)) for _ in range(400)]
    df = spark.createDataFrame(rows, "score double, label int")
    _, area = roc_table(df, [], label="label", score="score", pos=1)
    ours = area.first()["roc_auc"]
    ev = BinaryClassificationEvaluator(rawPredictionCol="raw", labelCol="y", metricName="areaUnderROC", numBins=0)
    ref = ev.evaluate(df.select(array_to_vector(F.array(-F.col("score"), F.col("score"))).alias("raw"),
                                F.col("label").cast("double").alias("y")))
    assert abs(ours - ref) < 1e-12


def test_author_folds_keep_rows_without_author(spark):
    rows = [(i, a) for i, a in enumerate(["a", None, "b", None, "c"])]
    df = spark.createDataFrame(rows, "id long, author string")
    got = author_folds(df, "author", 2).collect()
    assert sorted(r["id"] for r in got) == [0, 1, 2, 3, 4]
    assert len({r["group_number"] for r in got if r["author"] is None}) == 1

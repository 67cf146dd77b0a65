"""Evaluation metrics over prediction tables: V3 (accuracy), V4 (AUC on hard labels = balanced
accuracy), A19 / V5 (confusion matrix, label order −1, +1), V7 (ROC points and area), A14 (mean
over folds).  Everything is a grouped aggregation; the ROC cumulative sums use the skew-proof
keyed scan instead of a single-partition window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .prefix import exclusive_sums


def binary_metrics(pred: DataFrame, group: list[str], label: str = "label", prediction: str = "prediction",
                   pos=1, neg=-1) -> DataFrame:
    """Per group: n, accuracy, confusion counts (tn, fp, fn, tp) and ``auc`` = (TPR + TNR) / 2 on
    hard labels (null when the group holds a single class, Q28)."""
    y, p = F.col(label), F.col(prediction)
    g = pred.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(y == p, 1).otherwise(0)).cast("long").alias("n_right"),
        F.sum(F.when((y == neg) & (p == neg), 1).otherwise(0)).cast("long").alias("tn"),
        F.sum(F.when((y == neg) & (p == pos), 1).otherwise(0)).cast("long").alias("fp"),
        F.sum(F.when((y == pos) & (p == neg), 1).otherwise(0)).cast("long").alias("fn"),
        F.sum(F.when((y == pos) & (p == pos), 1).otherwise(0)).cast("long").alias("tp"),
    )
    tpr = F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    tnr = F.try_divide(F.col("tn"), F.col("tn") + F.col("fp"))
    return g.select(
        *group, "n", (F.col("n_right") / F.col("n")).alias("accuracy"), "tn", "fp", "fn", "tp",
        F.when((F.col("tp") + F.col("fn") > 0) & (F.col("tn") + F.col("fp") > 0), (tpr + tnr) / 2).alias("auc"),
    )


def mean_over_folds(per_fold: DataFrame, group: list[str], cols: list[str]) -> DataFrame:
    """A14 (+ Q20, Q28): mean and population std over folds; folds with a null metric are skipped
    and counted."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(c), F.stddev_pop(c).alias(f"{c}_std"),
                 F.sum(F.when(F.col(c).isNull(), 1).otherwise(0)).cast("long").alias(f"{c}_null_folds")]
    return per_fold.groupBy(*group).agg(F.count(F.lit(1)).alias("k_fold"), *aggs)


def roc_table(scored: DataFrame, group: list[str], label: str = "label", score: str = "score",
              pos=1) -> tuple[DataFrame, DataFrame]:
    """V7: ROC points and area per group.

    Scores are collapsed to distinct values with their positive / negative counts; cumulative
    counts over score descending come from the keyed scan (key = group).  Points
    ``(group, score, fpr, tpr)`` are the curve after each distinct score; the trapezoid area is
    Σ fp_s · (2·tp_before + tp_s) / (2·P·N), one grouped sum.  Returns (points, area)."""
    y = F.col(label) == F.lit(pos)
    per_score = scored.groupBy(*group, score).agg(
        F.sum(F.when(y, 1).otherwise(0)).cast("long").alias("__xc_tp"),
        F.sum(F.when(~y, 1).otherwise(0)).cast("long").alias("__xc_fp"),
    ).withColumn("__xc_neg_score", -F.col(score))
    keys = group if group else ["__xc_all"]
    if not group:
        per_score = per_score.withColumn("__xc_all", F.lit(0))
    cum = exclusive_sums(per_score, keys, ["__xc_neg_score"], ["__xc_tp", "__xc_fp"], suffix="_before")
    totals = per_score.groupBy(*keys).agg(F.sum("__xc_tp").alias("__xc_P"), F.sum("__xc_fp").alias("__xc_N"))
    cum = cum.join(totals, keys)
    points = cum.select(
        *group, score,
        F.try_divide(F.col("__xc_fp_before") + F.col("__xc_fp"), F.col("__xc_N")).alias("fpr"),
        F.try_divide(F.col("__xc_tp_before") + F.col("__xc_tp"), F.col("__xc_P")).alias("tpr"),
    )
    area = cum.groupBy(*keys).agg(
        F.try_divide(
            F.sum(F.col("__xc_fp").cast("double") * (2 * F.col("__xc_tp_before") + F.col("__xc_tp"))),
            2.0 * F.first("__xc_P") * F.first("__xc_N"),
        ).alias("roc_auc")
    )
    if not group:
        area = area.drop("__xc_all")
    return points, area

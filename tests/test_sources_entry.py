"""Sources / sinks (S1–S14, S9) and the driver contract (entry, queries, oracle keys)."""

import os
import tempfile

from pyspark.sql import functions as F

from xcomm.sources.tables import (append_cell, comment_tree, pending_cells, read_allow_list, read_similarity_input,
                                  save_table, scan_archive, to_activity, top_listing)

SF001 = "/root/testdata/sf0.001"


def test_allow_list_files_and_similarity_csv(spark):
    d = tempfile.mkdtemp(prefix="xcomm-test-")
    paths = []
    for i, names in enumerate([["keto", "diet"], ["keto"], ["running"], []]):
        p = os.path.join(d, f"list{i}.csv")
        with open(p, "w") as fh:
            fh.write("".join(n + "\n" for n in names))
        paths.append(p)
    assert sorted(r["name"] for r in read_allow_list(spark, paths).collect()) == ["diet", "keto", "running"]
    csv = os.path.join(d, "sim.csv")
    with open(csv, "w") as fh:
        fh.write("comment_body,comment_path,comment_id,parent_id,submission_id,manual_label,comments,"
                 "original_message,parent_body,extra_9,extra_10\n")
        fh.write('"line one\nline ""two""",p,c1,p1,s1,1,x,"orig text","parent text",,\n')
    rows = read_similarity_input(spark, csv).collect()
    assert len(rows) == 1 and rows[0]["comment_body"] == 'line one\nline "two"'
    assert rows[0]["parent_body"] == "parent text"


def test_archive_scan_prunes_months(spark):
    d = tempfile.mkdtemp(prefix="xcomm-test-")
    df = spark.createDataFrame([("2015_01", "a", 1), ("2015_02", "b", 2), ("2016_01", "a", 3)],
                               "month string, subreddit string, v long")
    save_table(df, d, partition_by=["month"])
    got = scan_archive(spark, d, "2015_01", "2015_12", communities=["a", "b", "a"])
    assert sorted(r["v"] for r in got.collect()) == [1, 2]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan


def test_activity_listing_tree_and_cells(spark):
    comments = spark.createDataFrame([("c1", "u", 5, "s", "p1"), ("c1", "u", 5, "s", "p1"), ("c2", "v", 6, "s", "p2")],
                                     "comment_id string, comment_author string, comment_created_time long, "
                                     "subreddit string, submission_id string")
    posts = spark.createDataFrame([("p1", "w", 1, "s"), ("p2", "w", 2, "s")],
                                  "submission_id string, submission_author string, submission_created_time long, "
                                  "subreddit string")
    assert to_activity(comments, posts).count() == 4
    listing = posts.withColumn("rank", F.col("submission_created_time"))
    top = top_listing(listing, "rank", 1, "submission_id")
    assert [r["submission_id"] for r in top.collect()] == ["p1"]
    assert [r["comment_id"] for r in comment_tree(comments, top).collect()] == ["c1", "c1"]
    d = os.path.join(tempfile.mkdtemp(prefix="xcomm-test-"), "done")
    cells = spark.createDataFrame([("m1", 0), ("m1", 1), ("m2", 0)], "model string, fold int")
    assert pending_cells(spark, cells, d, ["model", "fold"]).count() == 3
    append_cell(spark.createDataFrame([("m1", 0, 0.5)], "model string, fold int, auc double"), d)
    assert sorted(tuple(r) for r in pending_cells(spark, cells, d, ["model", "fold"]).collect()) == [("m1", 1), ("m2", 0)]


def test_entry_and_contract(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.count() > 0
    assert "IsEfficient" in df.columns and len(df.columns) == 21
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs) and len(qs) >= 60


def test_small_queries_run_on_smoke_tables(spark):
    import __spark_entry__ as E

    qs = E.queries()
    for name in ["label_effect", "referral_filter", "mention_target_pages", "corpus_similarity", "idf_table",
                 "roc_auc", "author_folds"]:
        assert qs[name](spark, SF001).count() >= 0


def test_pair_similarity_job(spark):
    from xcomm.plans.jobs import pair_similarity_job

    d = tempfile.mkdtemp(prefix="xcomm-test-")
    src = os.path.join(d, "in.csv")
    with open(src, "w") as fh:
        fh.write("comment_body,comment_path,comment_id,parent_id,submission_id,manual_label,comments,"
                 "original_message,parent_body,extra_9,extra_10\n")
        fh.write('"a b b",p,c1,p1,s1,1,x,"a b b","c d",,\n')
        fh.write('"x",p,c2,p1,s1,0,x,,"x",,\n')
    out = pair_similarity_job(spark, src, os.path.join(d, "out"))
    got = {r["comment_id"]: (r["parent_similarity"], r["original_similarity"]) for r in out.collect()}
    assert got["c1"][0] == 0.0 and abs(got["c1"][1] - 1.0) < 1e-12
    assert abs(got["c2"][0] - 1.0) < 1e-12 and got["c2"][1] == 0.0
    back = spark.read.csv(os.path.join(d, "out"), header=True)
    assert set(back.columns) >= {"parent_similarity", "original_similarity", "comment_body"}


def test_extract_listing_mentions(spark):
    from xcomm.plans.jobs import extract_listing_mentions
    from xcomm.sources.tables import allow_list_frame

    listing = spark.createDataFrame([("p1", 1), ("p2", 2), ("p3", 3)], "submission_id string, rank int")
    comments = spark.createDataFrame([
        ("c1", "p1", "try /r/keto", "diet"), ("c2", "p1", "try /r/keto", "keto"), ("c3", "p2", "/r/running!", "diet"),
        ("c4", "p3", "/r/keto", "diet"), ("c5", "p2", "/r/keto edited", "diet"), ("c6", "p1", "/r/unknown", "diet"),
    ], "comment_id string, submission_id string, comment_body string, subreddit string")
    got = extract_listing_mentions(listing, comments, allow_list_frame(spark, ["keto", "running!"]), 2)
    assert sorted((r["comment_id"], r["target"]) for r in got.collect()) == [("c1", "keto"), ("c3", "running!")]


def test_cast_numeric_and_model_save(spark):
    from pyspark.ml.classification import LogisticRegressionModel
    from pyspark.ml.functions import array_to_vector

    from xcomm.operators.models import FEATURES, LABEL, Logistic
    from xcomm.sources.tables import cast_numeric, save_model

    df = spark.createDataFrame([("12", "a"), ("x", "b"), (None, "c")], "n string, s string")
    assert [r["n"] for r in cast_numeric(df, ["n"]).orderBy("s").collect()] == [12, None, None]
    train = spark.createDataFrame([([0.0, 1.0], 1), ([1.0, 0.0], -1), ([0.1, 0.9], 1), ([0.9, 0.2], -1)],
                                  "x array<double>, y int").select(array_to_vector("x").alias(FEATURES),
                                                                   F.col("y").alias(LABEL))
    model = Logistic().fit(train)
    path = os.path.join(tempfile.mkdtemp(prefix="xcomm-test-"), "model")
    save_model(model.inner.model, path)
    assert LogisticRegressionModel.load(path).numFeatures == 2

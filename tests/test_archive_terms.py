"""Month-partitioned archives are pruned; the kept term table counts every month once."""

from collections import Counter

from pyspark.sql import functions as F

from xcomm.sources.tables import save_table, scan_archive, scan_archive_listed
from xcomm.sources.terms import TermTable


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_archive_scans_prune_months(spark, tmp_path):
    root = str(tmp_path / "archive")
    rows = [(i, f"2015_{i % 12 + 1:02d}", "a" if i % 2 else "b") for i in range(240)]
    save_table(spark.createDataFrame(rows, "id long, month string, subreddit string"), root, partition_by=["month"])
    found = scan_archive(spark, root, "2015_03", "2015_05", communities=["a"])
    filters = plan_of(found).split("PartitionFilters: [")[1].split("]")[0]
    assert "2015_03" in filters and "2015_05" in filters
    assert {r.id for r in found.collect()} == {i for i, m, s in rows if "2015_03" <= m <= "2015_05" and s == "a"}
    months = spark.createDataFrame([(f"2015_{m:02d}", m % 4) for m in range(1, 13)] + [("2015_04", 0), (None, 0)], "month string, part int")
    listed = scan_archive_listed(spark, root, months.where("part = 0"), ["id", "month"])
    assert "dynamicpruning" in plan_of(listed)
    assert sorted(r.id for r in listed.collect()) == sorted(i for i, m, _ in rows if m in ("2015_04", "2015_08", "2015_12"))


def test_term_table_is_kept(spark, tmp_path):
    path = str(tmp_path / "terms")
    rows = [("x", "Alpha beta beta", "2015_01"), ("y", "beta", "2015_01"), ("x", "beta gamma", "2015_02"), ("x", None, "2015_02"),
            (None, "lost", "2015_02"), ("y", "a b", "2015_03"), ("z", "late late", None)]
    texts = spark.createDataFrame(rows, "community string, text string, month string")
    table = TermTable(spark, path)
    assert table.months() == [] and table.counts().count() == 0
    assert table.update(texts.where("month = '2015_01'"), "community", "text", "month") == ["2015_01"]
    # a second run does not read the counted month again, whatever its rows say now
    changed = texts.withColumn("text", F.when(F.col("month") == "2015_01", F.lit("other words")).otherwise(F.col("text")))
    assert TermTable(spark, path).update(changed, "community", "text", "month") == ["2015_02"]
    want = Counter({("x", "alpha"): 1, ("x", "beta"): 3, ("y", "beta"): 1, ("x", "gamma"): 1})
    assert {(r.community, r.term): r.cnt for r in table.counts().collect()} == want
    assert {(r.community, r.term): r.cnt for r in table.counts("2015_01").collect()} == {("x", "alpha"): 1, ("x", "beta"): 2, ("y", "beta"): 1}
    # a month can be recounted, whole
    table.update(changed, "community", "text", "month", recount=("2015_01",))
    assert {(r.community, r.term): r.cnt for r in table.counts().collect()} == {
        ("x", "other"): 1, ("x", "words"): 1, ("y", "other"): 1, ("y", "words"): 1, ("x", "beta"): 1, ("x", "gamma"): 1}


def test_archive_is_written_without_a_shuffle_by_month(spark, tmp_path, monkeypatch):
    from xcomm.plans import q_archive

    times = [86400 * 40 * i for i in range(12)]
    comments = spark.createDataFrame([(f"k{i}", i, "s", "5-LOW", t) for i, t in enumerate(times)],
                                     "comment_id string, link_id long, comment_author string, subreddit string, comment_created_time long")
    posts = spark.createDataFrame([(i, "c", "5-LOW", t) for i, t in enumerate(times)],
                                  "link_id long, submission_author string, subreddit string, submission_created_time long")
    written = []

    def save(df, path, **options):
        written.append(plan_of(df))
        save_table(df, path, **options)

    monkeypatch.setattr(q_archive, "thread", lambda *_: comments)
    monkeypatch.setattr(q_archive, "thread_posts", lambda *_: posts)
    monkeypatch.setattr(q_archive, "save_table", save)
    folders = q_archive.archive(spark, "none")
    assert len(written) == 2 and not any("Exchange" in p for p in written)
    for folder, n in zip(folders, (12, 12), strict=True):
        back = spark.read.parquet(folder)
        assert back.count() == n and back.select("month").distinct().count() == 12

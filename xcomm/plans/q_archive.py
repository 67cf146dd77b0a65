"""Fixture queries: scans of a month-partitioned archive (S1, S2, S3, U1, P5) and the kept term table.

The archive is written from the test tables first: comments = line items by ship month, posts = orders by order month.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import VECTORIZER_TOKEN, clean_text
from ..session import scratch_folder
from ..sources.tables import save_table, scan_archive, scan_archive_listed, to_activity
from ..sources.terms import TermTable
from .fixtures import PRIORITIES, table, thread_posts
from .q_history import THREAD_CTES, thread
from .registry import query, sql_list

FIRST, LAST = "1996_03", "1997_10"
COMMUNITIES = [PRIORITIES[0], PRIORITIES[2], PRIORITIES[2]]
#: Months of the first run of the term table.
SPLIT = "2015_07"


def _month(seconds):
    return F.date_format(F.timestamp_seconds(seconds), "yyyy_MM")


def archive(spark, sf_dir):
    """Comments and posts as the extracts land: one folder per kind, partitioned by month.  Each task writes its own
    file in a month's folder, so rows are not shuffled by month first and no month is one task."""
    comments = thread(spark, sf_dir).select("comment_id", "link_id", "comment_author", "subreddit", "comment_created_time").withColumn("month", _month("comment_created_time"))
    posts = thread_posts(spark, sf_dir).withColumn("month", _month("submission_created_time"))
    folders = []
    for name, df in (("comments", comments), ("posts", posts)):
        folders.append(scratch_folder(spark, f"archive-{name}"))
        save_table(df, folders[-1], partition_by=["month"])
    return folders


_MONTH_SQL = "strftime(make_timestamp({} * 1000000), '%Y_%m')"


@query("archive_scan", f"""
WITH {THREAD_CTES},
c AS (SELECT *, {_MONTH_SQL.format('comment_created_time')} AS month FROM thread),
p AS (SELECT *, {_MONTH_SQL.format('submission_created_time')} AS month FROM posts)
SELECT DISTINCT * FROM (
  SELECT comment_author AS actor, subreddit AS community, comment_created_time AS t, 'comment' AS kind, CAST(comment_id AS VARCHAR) AS id FROM c
  WHERE month BETWEEN '{FIRST}' AND '{LAST}' AND subreddit IN (SELECT unnest({sql_list(COMMUNITIES)}))
  UNION ALL
  SELECT submission_author, subreddit, submission_created_time, 'post', CAST(link_id AS VARCHAR) FROM p
  WHERE month BETWEEN '{FIRST}' AND '{LAST}' AND subreddit IN (SELECT unnest({sql_list(COMMUNITIES)})))
""")
def q_archive_scan(spark, sf_dir):
    """S1 + S2 + U1 + P5 + S3: twenty months of both kinds for some communities, only those folders read."""
    comments, posts = (scan_archive(spark, root, FIRST, LAST, communities=COMMUNITIES) for root in archive(spark, sf_dir))
    return to_activity(comments, posts.withColumn("submission_id", F.col("link_id")))


@query("archive_scan_listed", f"""
WITH {THREAD_CTES},
c AS (SELECT *, {_MONTH_SQL.format('comment_created_time')} AS month FROM thread),
busy AS (SELECT {_MONTH_SQL.format('submission_created_time')} AS month, count(*) AS n FROM posts GROUP BY 1),
wanted AS (SELECT month FROM busy WHERE n >= (SELECT avg(n) FROM busy))
SELECT comment_id, link_id, comment_author, month FROM c WHERE month IN (SELECT month FROM wanted)
""")
def q_archive_scan_listed(spark, sf_dir):
    """U1 by a joined list: comments of the months with at least the average number of posts."""
    comments, posts = archive(spark, sf_dir)
    busy = spark.read.parquet(posts).groupBy("month").agg(F.count(F.lit(1)).alias("n"))
    mean = busy.agg(F.avg("n")).first()[0]
    return scan_archive_listed(spark, comments, busy.where(F.col("n") >= F.lit(mean)), ["comment_id", "link_id", "comment_author", "month"])


@query("kept_term_table", f"""
SELECT community, term, count(*) AS cnt FROM (
  SELECT source AS community, unnest(regexp_extract_all(lower(CASE WHEN text IS NULL OR text IN ('[removed]', '[deleted]') THEN ' ' ELSE text END),
                                                        '{VECTORIZER_TOKEN}')) AS term
  FROM documents WHERE source IS NOT NULL) GROUP BY ALL
""")
def q_kept_term_table(spark, sf_dir):
    """S11 + A8: a first run counts the months before July, a second one reads the kept table and counts only the rest."""
    month = F.concat(F.lit("2015_"), F.lpad((F.pmod(F.col("doc_id"), F.lit(12)) + 1).cast("string"), 2, "0"))
    texts = table(spark, sf_dir, "documents").select("source", clean_text("text").alias("text"), month.alias("month"))
    path = scratch_folder(spark, "term-table")
    TermTable(spark, path).update(texts.where(F.col("month") < SPLIT), "source", "text", "month")
    kept = TermTable(spark, path)
    kept.update(texts, "source", "text", "month")
    return kept.counts()

"""Fixture queries: scans, joins, projections, listing extracts and time features
(S3, S6, S13, S14, P1–P5, P14, J1, J2, J6, U2, A12, O3, F11, F12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.time import elapsed_hmm, gmt_hour
from ..operators.mentions import allowed_rows
from ..sources.tables import allow_list_frame, cast_numeric, comment_tree, ranked, to_activity, top_listing
from .fixtures import ALLOWED, epoch_seconds, table, thread_posts
from .q_history import THREAD_CTES, thread
from .q_mentions import REFERRAL_CTES, referrals_from_events
from .registry import query, sql_list

THREAD_COLS = ["comment_id", "link_id", "comment_author", "comment_created_time", "submission_author", "subreddit",
               "submission_created_time"]


@query("thread_join", f"""
WITH {THREAD_CTES}
SELECT {", ".join(THREAD_COLS)} FROM thread
""")
def q_thread_join(spark, sf_dir):
    """J1 + P1 + P2: comments joined to their post on the post key, renamed projection."""
    return thread(spark, sf_dir).select(*THREAD_COLS)


@query("activity_union", f"""
WITH {THREAD_CTES}
SELECT DISTINCT * FROM (
  SELECT comment_author AS actor, subreddit AS community, comment_created_time AS t, 'comment' AS kind,
         CAST(comment_id AS VARCHAR) AS id FROM thread
  UNION ALL
  SELECT submission_author, subreddit, submission_created_time, 'post', CAST(link_id AS VARCHAR) FROM posts)
""")
def q_activity_union(spark, sf_dir):
    """S3 + U2 + A12: posts and comments (different columns) as one de-duplicated activity table."""
    posts = thread_posts(spark, sf_dir).withColumn("submission_id", F.col("link_id"))
    return to_activity(thread(spark, sf_dir), posts)


COMMUNITY_LIST = ["1-URGENT", "2-HIGH", "2-HIGH"]  # a duplicate on purpose: rows must not repeat


@query("community_in_list", f"""
SELECT o_orderkey, o_custkey, o_orderpriority FROM orders
WHERE o_orderpriority IN (SELECT unnest({sql_list(COMMUNITY_LIST)}))
""")
def q_community_in_list(spark, sf_dir):
    """P5: one scan with an IN filter (pushed to parquet) instead of one query per name."""
    o = table(spark, sf_dir, "orders")
    return o.where(F.col("o_orderpriority").isin(*sorted(set(COMMUNITY_LIST)))).select(
        "o_orderkey", "o_custkey", "o_orderpriority")


@query("allowlist_semi", f"""
SELECT event_id, event_type FROM events WHERE event_type IN (SELECT unnest({sql_list(ALLOWED)}))
""")
def q_allowlist_semi(spark, sf_dir):
    """Membership in an allow-list table as a left-semi join (the list is a small table)."""
    e = table(spark, sf_dir, "events")
    allow = allow_list_frame(spark, ALLOWED).withColumnRenamed("name", "event_type")
    return allowed_rows(e, allow, "event_type").select("event_id", "event_type")


THREE_KEY_SQL = f"""
WITH {REFERRAL_CTES},
s AS (SELECT event_id, event_type AS subreddit,
             CASE WHEN user_id % 9 = 0 THEN '[deleted]' ELSE 'u' || CAST(user_id AS VARCHAR) END AS submission_author,
             value / (value + 10.0) AS classifier_result FROM events)
SELECT k.event_id, k.recommend_subreddit, round(s.classifier_result, 6) AS classifier_result
FROM kept k JOIN s ON k.event_id = s.event_id AND k.subreddit = s.subreddit AND k.submission_author = s.submission_author
"""


@query("three_key_join", THREE_KEY_SQL)
def q_three_key_join(spark, sf_dir):
    """First-stage scores joined back onto the referrals on three keys."""
    refs = referrals_from_events(spark, sf_dir)
    e = table(spark, sf_dir, "events")
    author = F.when(F.pmod(F.col("user_id"), F.lit(9)) == 0, F.lit("[deleted]")).otherwise(
        F.concat(F.lit("u"), F.col("user_id").cast("string")))
    scores = e.select("event_id", F.col("event_type").alias("subreddit"), author.alias("submission_author"),
                      (F.col("value") / (F.col("value") + F.lit(10.0))).alias("classifier_result"))
    return refs.join(scores, ["event_id", "subreddit", "submission_author"], "inner").select(
        "event_id", "recommend_subreddit", F.round("classifier_result", 6).alias("classifier_result"))


TOP_N = 100


@query("top_posts", f"""
SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT {TOP_N}
""")
def q_top_posts(spark, sf_dir):
    """S13 + O3: the top posts of a landed listing (a top-k report: the limit is the feature)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return top_listing(o.withColumn("rank", -F.col("o_totalprice")), "rank", TOP_N, "o_orderkey").drop("rank")


@query("comment_tree", f"""
WITH top AS (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT {TOP_N})
SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM top)
""")
def q_comment_tree(spark, sf_dir):
    """All comments under the top posts (left-semi join on the post key)."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    top = q_top_posts(spark, sf_dir).select(F.col("o_orderkey").alias("l_orderkey"))
    return comment_tree(li, top, "l_orderkey")


@query("gmt_hour", """
SELECT event_id, CAST(hour(ts) AS INTEGER) AS comment_created_time_hour FROM events
""")
def q_gmt_hour(spark, sf_dir):
    """hour of day in GMT of an epoch-seconds time."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", gmt_hour(epoch_seconds("ts")).alias("comment_created_time_hour"))


@query("elapsed_hmm", """
WITH d AS (SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) - 1704067200 AS s FROM events)
SELECT event_id, s AS time_to_comment,
       round(floor(s / 3600.0) + floor((s - 3600 * floor(s / 3600.0)) / 60.0) / 100.0, 6) AS time_between_messages
FROM d
""")
def q_elapsed_hmm(spark, sf_dir):
    """a duration as H.MM; the duration is seconds since the start of the event log."""
    e = table(spark, sf_dir, "events").select("event_id", (epoch_seconds("ts") - F.lit(1704067200)).alias("time_to_comment"))
    return e.select("event_id", "time_to_comment", F.round(elapsed_hmm("time_to_comment"), 6).alias("time_between_messages"))


@query("ranked_referrals", f"""
SELECT * FROM ({THREE_KEY_SQL}) WHERE classifier_result > 0.5 ORDER BY classifier_result DESC, event_id
""")
def q_ranked_referrals(spark, sf_dir):
    """P13 + O1: scored referrals above a score, ordered by score for the sink."""
    return ranked(q_three_key_join(spark, sf_dir).where(F.col("classifier_result") > 0.5), "classifier_result",
                  "event_id")


@query("numeric_cast", """
SELECT event_id, TRY_CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS k FROM events
""")
def q_numeric_cast(spark, sf_dir):
    """A numeric field read from text with an explicit, failure-tolerant cast."""
    e = table(spark, sf_dir, "events").select("event_id", F.regexp_extract("props", "[0-9]+", 0).alias("k"))
    return cast_numeric(e, ["k"])

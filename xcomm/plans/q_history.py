"""Fixture queries: as-of history features (W1, A1–A7, A2 + F15)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.asof import asof_bag, asof_many, asof_sums, pair_bag_cosine, percent
from ..operators.similarity import bag_cosine
from ..session import staged
from .fixtures import (EVENT_TYPES, LINE_COMMENT_ID_SQL, event_activity, order_activity, order_referrals,
                       thread_comments, thread_posts)
from .q_effect import LABELLED_CTE, ORDER_CTES, labelled_orders
from .registry import query, sql_list

EFFICIENT_THRESHOLD = 0.8  # default score bound of A3 / A6


@query("asof_pair_counts", f"""
WITH {ORDER_CTES}
SELECT referral_id, actor, own, target, t,
  (SELECT count(*) FROM act a WHERE a.actor = r.actor AND a.community = r.own AND a.t < r.t) AS n_own,
  (SELECT count(*) FROM act a WHERE a.actor = r.actor AND a.community = r.target AND a.t < r.t) AS n_target
FROM ref r
""")
def q_asof_pair_counts(spark, sf_dir):
    """A1 on ``orders`` (day-level ties: same-day activity must not count)."""
    refs = order_referrals(spark, sf_dir).select("referral_id", "actor", "own", "target", "t")
    act = order_activity(spark, sf_dir)
    counts = asof_many(refs, ["referral_id"], [
        dict(history=act, keys={"actor": "actor", "own": "community"}, time="t", weights={"n_own": F.lit(1)}),
        dict(history=act, keys={"actor": "actor", "target": "community"}, time="t", weights={"n_target": F.lit(1)}),
    ])
    return refs.join(counts, "referral_id")


@query("asof_actor_counts", f"""
WITH e AS (SELECT event_id, user_id AS actor, event_type AS community, epoch_us(ts) AS t,
                  {sql_list(EVENT_TYPES)}[(event_id % 5) + 1] AS target FROM events)
SELECT event_id, actor, community, target, t,
  (SELECT count(*) FROM e h WHERE h.actor = p.actor AND h.community = p.community AND h.t < p.t) AS n_own,
  (SELECT count(*) FROM e h WHERE h.actor = p.actor AND h.community = p.target AND h.t < p.t) AS n_target,
  (SELECT count(*) FROM e h WHERE h.actor = p.actor AND h.t < p.t) AS n_all
FROM e p
""")
def q_asof_actor_counts(spark, sf_dir):
    """A1 on ``events`` (microsecond times): per event, the user's earlier events in its own type,
    in the target type, and in all types."""
    ev = event_activity(spark, sf_dir)
    hist = ev.select("actor", "community", "t")
    counts = asof_many(ev, ["event_id"], [
        dict(history=hist, keys=["actor", "community"], time="t", weights={"n_own": F.lit(1)}),
        dict(history=hist, keys={"actor": "actor", "target": "community"}, time="t", weights={"n_target": F.lit(1)}),
        dict(history=hist, keys=["actor"], time="t", weights={"n_all": F.lit(1)}),
    ])
    return ev.join(counts, "event_id")


@query("asof_effect_rate", f"""
WITH {ORDER_CTES}, {LABELLED_CTE},
c AS (SELECT p.referral_id, p.actor, p.t,
  (SELECT count(*) FROM lab h WHERE h.actor = p.actor AND h.score >= {EFFICIENT_THRESHOLD} AND h.t < p.t) AS n_refs,
  (SELECT count(*) FROM lab h WHERE h.actor = p.actor AND h.t < p.t) AS n_checked,
  (SELECT count(*) FROM lab h WHERE h.actor = p.actor AND h.is_effective = 1 AND h.t < p.t) AS n_eff,
  (SELECT count(*) FROM lab h WHERE h.actor = p.actor AND h.is_effective = -1 AND h.t < p.t) AS n_ineff
  FROM lab p)
SELECT *, round(CASE WHEN n_checked > 0 THEN 100.0 * n_eff / n_checked ELSE 0.0 END, 6) AS pct_eff FROM c
""")
def q_asof_effect_rate(spark, sf_dir):
    """The actor's earlier referrals (score ≥ threshold), labelled referrals,
    effective / ineffective ones and the effective percentage ("Peff")."""
    lab = labelled_orders(spark, sf_dir)
    hist = lab.select("actor", "t", "score", "is_effective")
    x = asof_sums(hist, lab.select("referral_id", "actor", "t"), ["actor"], "t", {
        "n_refs": F.when(F.col("score") >= EFFICIENT_THRESHOLD, 1).otherwise(0),
        "n_checked": F.lit(1),
        "n_eff": F.when(F.col("is_effective") == 1, 1).otherwise(0),
        "n_ineff": F.when(F.col("is_effective") == -1, 1).otherwise(0),
    })
    return x.withColumn("pct_eff", F.round(percent(F.col("n_eff"), F.col("n_checked")), 6))


@query("asof_target_popularity", f"""
WITH {ORDER_CTES}
SELECT referral_id, target, t,
  (SELECT count(*) FROM ref h WHERE h.target = r.target AND h.score >= {EFFICIENT_THRESHOLD} AND h.t < r.t)
    AS n_to_target
FROM ref r
""")
def q_asof_target_popularity(spark, sf_dir):
    """Earlier referrals (score ≥ threshold) to the same target community."""
    refs = order_referrals(spark, sf_dir)
    return asof_sums(refs.select("target", "t", "score"), refs.select("referral_id", "target", "t"), ["target"], "t",
                     {"n_to_target": F.when(F.col("score") >= EFFICIENT_THRESHOLD, 1).otherwise(0)})


THREAD_CTES = f"""
posts AS (SELECT o_orderkey AS link_id, 'c' || CAST(o_custkey AS VARCHAR) AS submission_author,
                 o_orderpriority AS subreddit, CAST(epoch(o_orderdate) AS BIGINT) AS submission_created_time
          FROM orders),
comments AS (SELECT {LINE_COMMENT_ID_SQL} AS comment_id, l_orderkey AS link_id,
                    's' || CAST(l_suppkey AS VARCHAR) AS comment_author,
                    CAST(epoch(l_shipdate) AS BIGINT) AS comment_created_time FROM lineitem),
thread AS (SELECT c.*, p.submission_author, p.subreddit, p.submission_created_time
           FROM comments c JOIN posts p USING (link_id)),
act AS (SELECT submission_author AS actor, subreddit AS community, submission_created_time AS t FROM posts
        UNION ALL SELECT comment_author, subreddit, comment_created_time FROM thread)
"""


def thread(spark, sf_dir):
    """Comments ⋈ posts on the post key."""
    return thread_comments(spark, sf_dir).join(thread_posts(spark, sf_dir), "link_id", "inner")


def thread_activity(spark, sf_dir, th=None):
    """Posts ∪ comments as (actor, community, t)."""
    posts = thread_posts(spark, sf_dir)
    th = th if th is not None else thread(spark, sf_dir)
    return posts.select(F.col("submission_author").alias("actor"), F.col("subreddit").alias("community"),
                        F.col("submission_created_time").alias("t")).unionByName(
        th.select(F.col("comment_author").alias("actor"), F.col("subreddit").alias("community"),
                  F.col("comment_created_time").alias("t")))


@query("asof_bag_cosine", f"""
WITH {THREAD_CTES},
bc AS (SELECT th.comment_id, a.community, count(*) AS n FROM thread th
       JOIN act a ON a.actor = th.comment_author AND a.t < th.comment_created_time GROUP BY ALL),
bp AS (SELECT p.link_id, a.community, count(*) AS n FROM posts p
       JOIN act a ON a.actor = p.submission_author AND a.t < p.submission_created_time GROUP BY ALL),
bpc AS (SELECT th.comment_id, bp.community, bp.n FROM thread th JOIN bp USING (link_id)),
terms AS (SELECT comment_id, community, sum(n1) AS c1, sum(n2) AS c2 FROM (
            SELECT comment_id, community, n AS n1, 0 AS n2 FROM bc
            UNION ALL SELECT comment_id, community, 0, n FROM bpc) GROUP BY ALL),
cs AS (SELECT comment_id, CAST(sum(c1 * c2) AS DOUBLE) AS dot, CAST(sum(c1 * c1) AS DOUBLE) AS s1,
              CAST(sum(c2 * c2) AS DOUBLE) AS s2 FROM terms GROUP BY ALL)
SELECT th.comment_id,
       round(coalesce(CASE WHEN s1 > 0 AND s2 > 0 THEN dot / (sqrt(s1) * sqrt(s2)) END, 0.0), 6)
         AS cosine_similarity_subreddits_list
FROM thread th LEFT JOIN cs USING (comment_id)
""")
def q_asof_bag_cosine(spark, sf_dir):
    """F15 (+ A2 implicitly): cosine between the community bag of the comment author before the
    comment and that of the post author before the post, without materialising the bags."""
    th = staged(thread(spark, sf_dir).drop("link_id"), "thread")
    act = thread_activity(spark, sf_dir, th)
    cos = pair_bag_cosine(act, th, "comment_id", ("comment_author", "comment_created_time"),
                          ("submission_author", "submission_created_time"), out="c")
    return cos.select("comment_id", F.round("c", 6).alias("cosine_similarity_subreddits_list"))


@query("asof_bag_cosine_materialised", f"""
WITH {THREAD_CTES},
bc AS (SELECT th.comment_id, a.community, count(*) AS n FROM thread th
       JOIN act a ON a.actor = th.comment_author AND a.t < th.comment_created_time GROUP BY ALL),
bp AS (SELECT p.link_id, a.community, count(*) AS n FROM posts p
       JOIN act a ON a.actor = p.submission_author AND a.t < p.submission_created_time GROUP BY ALL),
bpc AS (SELECT th.comment_id, bp.community, bp.n FROM thread th JOIN bp USING (link_id)),
terms AS (SELECT comment_id, community, sum(n1) AS c1, sum(n2) AS c2 FROM (
            SELECT comment_id, community, n AS n1, 0 AS n2 FROM bc
            UNION ALL SELECT comment_id, community, 0, n FROM bpc) GROUP BY ALL),
cs AS (SELECT comment_id, CAST(sum(c1 * c2) AS DOUBLE) AS dot, CAST(sum(c1 * c1) AS DOUBLE) AS s1,
              CAST(sum(c2 * c2) AS DOUBLE) AS s2 FROM terms GROUP BY ALL)
SELECT th.comment_id,
       round(coalesce(CASE WHEN s1 > 0 AND s2 > 0 THEN dot / (sqrt(s1) * sqrt(s2)) END, 0.0), 6)
         AS cosine_similarity_subreddits_list
FROM thread th LEFT JOIN cs USING (comment_id)
""")
def q_asof_bag_cosine_materialised(spark, sf_dir):
    """A2 + F9 + F15 with the bags materialised as long-form (probe, community, n) tables, then
    the generic bag cosine (the post bag is computed once per post and joined to its comments)."""
    th = staged(thread(spark, sf_dir), "thread")
    act = thread_activity(spark, sf_dir, th)
    posts = thread_posts(spark, sf_dir)
    bag_c = asof_bag(act, th, "comment_id", ("comment_author", "actor"), "community", ("comment_created_time", "t"))
    bag_p = asof_bag(act, posts, "link_id", ("submission_author", "actor"), "community",
                     ("submission_created_time", "t"))
    bag_p = th.select("comment_id", "link_id").join(bag_p, "link_id").drop("link_id")
    cos = bag_cosine(bag_c, bag_p, "comment_id", "community", "n", out="c")
    return th.select("comment_id").join(cos, "comment_id", "left").select(
        "comment_id", F.round(F.coalesce(F.col("c"), F.lit(0.0)), 6).alias("cosine_similarity_subreddits_list"))


@query("asof_hot_actor_counts", f"""
WITH e AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN -1 ELSE user_id END AS actor, event_type AS community,
                  epoch_us(ts) AS t FROM events)
SELECT event_id, actor, community, t,
  (SELECT count(*) FROM e h WHERE h.actor = p.actor AND h.t < p.t) AS n_all,
  (SELECT count(*) FROM e h WHERE h.actor = p.actor AND h.community = p.community AND h.t < p.t) AS n_own
FROM e p
""")
def q_asof_hot_actor_counts(spark, sf_dir):
    """A1 with a hot actor: every third event is re-assigned to actor -1 (a stand-in for
    '[deleted]'), so one key holds a third of all rows.  Windows run inside
    (key, part of the time axis), so the group is cut over tasks."""
    ev = event_activity(spark, sf_dir).withColumn(
        "actor", F.when(F.pmod(F.col("event_id"), F.lit(3)) == 0, F.lit(-1).cast("long")).otherwise(F.col("actor")))
    hist = ev.select("actor", "community", "t")
    counts = asof_many(ev, ["event_id"], [
        dict(history=hist, keys=["actor"], time="t", weights={"n_all": F.lit(1)}),
        dict(history=hist, keys=["actor", "community"], time="t", weights={"n_own": F.lit(1)}),
    ])
    return ev.select("event_id", "actor", "community", "t").join(counts, "event_id")

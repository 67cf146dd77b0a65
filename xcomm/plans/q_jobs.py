"""Fixture queries for the secondary jobs: listing extraction
and reply similarity (S5 shape, F5, F9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import BOT_SENTENCE, WORD_TOKEN
from ..sources.tables import allow_list_frame
from .fixtures import LINE_COMMENT_ID_SQL, PRIORITIES, table
from .jobs import extract_listing_mentions, pair_similarity
from .q_features import MENTION_TAILS, text_thread
from .registry import query, sql_list, sql_str

POST_LIMIT = 100


@query("listing_mentions", f"""
WITH top AS (SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT {POST_LIMIT}),
c AS (SELECT {LINE_COMMENT_ID_SQL} AS comment_id, t.o_orderpriority AS subreddit,
             'see /r/' || {sql_list(PRIORITIES)}[(l_partkey + l_linenumber) % 5 + 1]
               || {sql_list(MENTION_TAILS)}[l_suppkey % 4 + 1] || coalesce(p.p_name, '') AS body
      FROM lineitem l JOIN top t ON t.o_orderkey = l.l_orderkey LEFT JOIN part p ON p.p_partkey = l.l_partkey),
m AS (SELECT comment_id, subreddit, body,
             split_part(split_part(substr(body, instr(body, '/r/') + 3), '/', 1), ' ', 1) AS target
      FROM c WHERE instr(body, '/r/') > 0)
SELECT comment_id, target FROM m
WHERE instr(body, 'edit') = 0 AND instr(body, {sql_str(BOT_SENTENCE)}) = 0
  AND instr(body, '/r/' || subreddit) = 0 AND target IN (SELECT unnest({sql_list(PRIORITIES)}))
""")
def q_listing_mentions(spark, sf_dir):
    """Comments under the 100 top posts (by order value) that point to another allowed community."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("link_id"),
                                               (-F.col("o_totalprice")).alias("rank"))
    comments = text_thread(spark, sf_dir).select("comment_id", "link_id", "comment_body", "subreddit")
    got = extract_listing_mentions(o, comments, allow_list_frame(spark, PRIORITIES), POST_LIMIT, rank="rank",
                                   post_key="link_id")
    return got.select("comment_id", "target")


@query("reply_similarity", f"""
WITH x AS (SELECT c.conv_id, c.turn, c.text AS b, p.text AS pb, o.text AS ob FROM conversations c
           JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1
           JOIN conversations o ON o.conv_id = c.conv_id AND o.turn = 0 WHERE c.turn > 0),
tok AS (SELECT conv_id, turn, 1 AS side, unnest(regexp_extract_all(b, '{WORD_TOKEN}')) AS term FROM x
        UNION ALL SELECT conv_id, turn, 2, unnest(regexp_extract_all(pb, '{WORD_TOKEN}')) FROM x
        UNION ALL SELECT conv_id, turn, 3, unnest(regexp_extract_all(ob, '{WORD_TOKEN}')) FROM x),
terms AS (SELECT conv_id, turn, term, CAST(sum(CASE WHEN side = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS c1,
                 CAST(sum(CASE WHEN side = 2 THEN 1 ELSE 0 END) AS DOUBLE) AS c2,
                 CAST(sum(CASE WHEN side = 3 THEN 1 ELSE 0 END) AS DOUBLE) AS c3 FROM tok GROUP BY ALL),
agg AS (SELECT conv_id, turn, sum(c1 * c2) AS d2, sum(c1 * c3) AS d3, sum(c1 * c1) AS s1, sum(c2 * c2) AS s2,
               sum(c3 * c3) AS s3 FROM terms GROUP BY ALL)
SELECT x.conv_id, x.turn,
       round(coalesce(CASE WHEN s1 > 0 AND s2 > 0 THEN d2 / (sqrt(s1) * sqrt(s2)) END, 0.0), 6) AS parent_similarity,
       round(coalesce(CASE WHEN s1 > 0 AND s3 > 0 THEN d3 / (sqrt(s1) * sqrt(s3)) END, 0.0), 6) AS original_similarity
FROM x LEFT JOIN agg USING (conv_id, turn)
""")
def q_reply_similarity(spark, sf_dir):
    """The pair-similarity job on conversations: each reply against its parent turn and against
    the opening turn (word-count cosine)."""
    c = table(spark, sf_dir, "conversations")
    parent = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("parent_body"))
    first = c.where(F.col("turn") == 0).select("conv_id", F.col("text").alias("original_message"))
    x = c.where(F.col("turn") > 0).select("conv_id", "turn", F.col("text").alias("comment_body")) \
        .join(parent, ["conv_id", "turn"]).join(first, "conv_id") \
        .withColumn("pair_id", F.struct("conv_id", "turn"))
    sims = pair_similarity(x)
    return sims.select("conv_id", "turn", F.round("parent_similarity", 6).alias("parent_similarity"),
                       F.round("original_similarity", 6).alias("original_similarity"))

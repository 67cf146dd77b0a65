"""Stand-ins: how the test tables play the roles of the referral workload's inputs.

- activity with day-level ties: ``orders`` — actor = customer, community = order priority,
  t = order date (epoch seconds);
- fine-grained activity: ``events`` — actor = user, community = event type, t = epoch micros;
- a thread world: posts = ``orders`` (author ``c<custkey>``), comments = ``lineitem`` rows of the
  order (author ``s<suppkey>``, time = ship date), joined on the order key (J1);
- referrals: every order / event points to a "target" community picked by a fixed rule from its id.

Each function returns a DataFrame over the whole table; nothing is sampled or capped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values shared with the oracle SQL: the community names of the two stand-in tables, in
# the order used by the "target = list[id mod 5]" rule.
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_seconds(c: str) -> Column:
    return F.unix_seconds(F.col(c).cast("timestamp"))


def epoch_micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def pick(values: list, idx: Column) -> Column:
    """values[pmod(idx, len)] as a column (array lookup, no join); values are literals or columns."""
    arr = F.array(*[v if isinstance(v, Column) else F.lit(v) for v in values])
    return F.element_at(arr, (F.pmod(idx, F.lit(len(values))) + 1).cast("int"))


def idiv(c: str, d: int) -> Column:
    """Integer division of a non-negative integral column."""
    return F.floor(F.col(c) / F.lit(d)).cast("long")


def order_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("actor"), F.col("o_orderpriority").alias("community"),
                    epoch_seconds("o_orderdate").alias("t"), F.col("o_orderkey").alias("id"))


def order_referrals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One referral per order: the customer is pointed from its order's priority to another one."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("referral_id"),
        F.col("o_custkey").alias("actor"),
        F.col("o_orderpriority").alias("own"),
        pick(PRIORITIES, F.col("o_orderkey")).alias("target"),
        epoch_seconds("o_orderdate").alias("t"),
        F.least(F.col("o_totalprice") / F.lit(400000.0), F.lit(1.0)).alias("score"),
    )


def event_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id"), F.col("user_id").alias("actor"), F.col("event_type").alias("community"),
                    epoch_micros("ts").alias("t"), pick(EVENT_TYPES, F.col("event_id")).alias("target"))


def thread_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("link_id"),
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("submission_author"),
        F.col("o_orderpriority").alias("subreddit"),
        epoch_seconds("o_orderdate").alias("submission_created_time"),
    )


def line_comment_id() -> Column:
    """A line item's comment id: (order, line, part, supplier, ship time) — the order and line
    number alone repeat in the generated tables."""
    return F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")],
                       epoch_seconds("l_shipdate").cast("string"))


# The same id in the oracle SQL.
LINE_COMMENT_ID_SQL = ("CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) || '-' || "
                       "CAST(l_partkey AS VARCHAR) || '-' || CAST(l_suppkey AS VARCHAR) || '-' || "
                       "CAST(CAST(epoch(l_shipdate) AS BIGINT) AS VARCHAR)")


def thread_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        line_comment_id().alias("comment_id"),
        F.col("l_orderkey").alias("link_id"),
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("comment_author"),
        epoch_seconds("l_shipdate").alias("comment_created_time"),
    )


# Fixed pieces of the synthetic comment bodies built from ``events`` (each event is a comment):
# lead-in text, marker (the last one is not a marker), stop text after the name, trailing text.
BODY_LEADS = ["see ", "go to ", "I am a bot, and this action was performed automatically ", "credit to ",
              "Edit: try ", "you might like "]
BODY_MARKERS = ["/r/", "/r/", "/r/", "r/"]
BODY_STOPS = ["", " ", "\n", "!", ")", "]", ".", "?", ",", '"', ".)", ").", " now!", ',"', "/x", "\n!"]
ALLOWED = ["click", "purchase", "signup", "view"]


def event_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as a comment: own community = event type; body points to a type picked from the
    ids; the post author is '[deleted]' for every ninth user."""
    e = table(spark, sf_dir, "events")
    other = pick(EVENT_TYPES, F.col("user_id"))
    tails = [F.lit(""), F.concat(F.lit(" and /r/"), other), F.lit(" thanks"), F.concat(F.lit("/r/"), other, F.lit(" too"))]
    body = F.concat(
        pick(BODY_LEADS, idiv("event_id", 3)),
        pick(BODY_MARKERS, idiv("event_id", 11)),
        pick(EVENT_TYPES, F.col("user_id") + idiv("event_id", 5)),
        pick(BODY_STOPS, F.col("event_id")),
        pick(tails, idiv("event_id", 7)),
    )
    author = F.when(F.pmod(F.col("user_id"), F.lit(9)) == 0, F.lit("[deleted]")).otherwise(
        F.concat(F.lit("u"), F.col("user_id").cast("string")))
    return e.select("event_id", F.col("event_type").alias("subreddit"), author.alias("submission_author"),
                    body.alias("comment_body"))

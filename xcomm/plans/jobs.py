"""The reference's secondary entry points as Spark jobs.

- ``pair_similarity_job``: the pair-similarity file job — read the similarity CSV (S5), add the
  word-count cosine of the body with the parent body and with the original message (F5, A9, F9),
  write the result by column name (Q7 fixed) (S8).
- ``extract_listing_mentions``: the listing extraction — top posts of a landed listing (S13, O3),
  all comments under them (S14), mentions by the simple rule (F2) kept when they point to another
  allowed community (P6, P9–P12, J6); every match is returned (Q2 fixed).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import BOT_SENTENCE, EDIT_WORD, MARKER, mention_target_simple
from ..operators.mentions import allowed_rows
from ..operators.similarity import with_text_cosine
from ..sources.tables import comment_tree, read_similarity_input, save_table, top_listing


def pair_similarity(df: DataFrame) -> DataFrame:
    """Adds ``parent_similarity`` (body vs parent body) and ``original_similarity`` (body vs original
    message) to every row; ids may repeat or be missing."""
    df = with_text_cosine(df, "comment_body", "parent_body", out="parent_similarity")
    return with_text_cosine(df, "comment_body", "original_message", out="original_similarity")


def pair_similarity_job(spark: SparkSession, in_path: str, out_path: str, fmt: str = "csv") -> DataFrame:
    df = pair_similarity(read_similarity_input(spark, in_path))
    save_table(df, out_path, fmt=fmt, **({"header": "true"} if fmt == "csv" else {}))
    return df


def extract_listing_mentions(listing: DataFrame, comments: DataFrame, allow_list: DataFrame, post_limit: int,
                             rank: str = "rank", post_key: str = "submission_id", body: str = "comment_body",
                             own: str = "subreddit", name_col: str = "name", marker: str = MARKER) -> DataFrame:
    """Comments under the first ``post_limit`` posts that mention another allowed community."""
    top = top_listing(listing, rank, post_limit, post_key)
    tree = comment_tree(comments, top, post_key)
    c = tree.where(F.col(body).contains(marker)).withColumn("target", mention_target_simple(F.col(body), marker))
    c = c.where(F.instr(F.col(body), EDIT_WORD) == 0).where(F.instr(F.col(body), BOT_SENTENCE) == 0)
    c = c.where(~F.col(body).contains(F.concat(F.lit(marker), F.col(own))))
    return allowed_rows(c, allow_list.select(F.col(name_col).alias("target")), "target")

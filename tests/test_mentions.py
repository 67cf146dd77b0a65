"""Mention parsing (F1–F3) against a plain-Python statement of the rule, and the referral filter."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from xcomm.functions.text import STOP_MARKS, mention_count, mention_target, mention_target_simple
from xcomm.operators import mentions
from xcomm.operators.mentions import filter_referrals, multi_mention_total
from xcomm.sources.tables import allow_list_frame


def plain_target(body, marker="/r/", strict=True):
    """The rule in words: take the text after the first marker up to the next '/', then up to the
    first newline.  With a space: cut at the space, then at the earliest stop mark.  Without a
    space: cut at the first stop mark found in the priority order (strict) or the earliest one."""
    i = body.find(marker)
    if i < 0:
        return None
    piece = body[i + len(marker):].split("/")[0].split("\n")[0]
    if " " in piece or not strict:
        piece = piece.split(" ")[0]
        cut = min([piece.find(m) for m in STOP_MARKS if m in piece], default=len(piece))
        return piece[:cut]
    for m in STOP_MARKS:
        if m in piece:
            return piece[: piece.find(m)]
    return piece


def plain_count(body, marker="/r/"):
    i = body.find(marker)
    if i < 0:
        return 0
    return sum(1 for p in body[i:].split("/") if p == "r")


ALPHABET = list("ab /r!)].?,\"\nxé") + ["/r/", "/r/"]


def random_bodies(n, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 25))) for _ in range(n)]


def test_mention_expressions_match_plain_rule(spark):
    bodies = random_bodies(1500, 7) + ["see /r/keto.) now", "x /r/keto!)", "/r/a b.c", "/r/", "/r/x/r/y /r",
                                       "edit /r/abc\ndef", "/r/é,z", "no marker"]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "id long, body string")
    rows = df.select("id", mention_target("body").alias("t"), mention_target("body", strict=False).alias("l"),
                     mention_target_simple("body").alias("s"), mention_count("body").alias("c")).collect()
    for r in rows:
        b = bodies[r["id"]]
        assert r["t"] == plain_target(b), b
        assert r["l"] == plain_target(b, strict=False), b
        assert r["c"] == plain_count(b), b
        if "/r/" in b:
            assert r["s"] == b[b.find("/r/") + 3:].split("/")[0].split(" ")[0]


def test_filter_referrals_rules(spark):
    rows = [
        (1, "go /r/keto now", "diet", "alice"),         # kept
        (2, "go /r/diet now", "diet", "alice"),         # own community
        (3, "go /r/keto now", "diet", "[deleted]"),     # deleted post author
        (4, "credit /r/keto", "diet", "alice"),         # 'edit' inside 'credit'
        (5, "Edit: /r/keto", "diet", "alice"),          # capital E kept
        (6, "/r/other", "diet", "alice"),               # not in the allow-list
        (7, "no marker", "diet", "alice"),
        (8, "/r/keto and /r/diet", "food", None),       # null author kept; two mentions
        (9, "/r/keto I am a bot, and this action was performed automatically", "diet", "bob"),
    ]
    df = spark.createDataFrame(rows, "id long, comment_body string, subreddit string, submission_author string")
    allow = allow_list_frame(spark, ["keto", "diet", "keto"])
    kept = filter_referrals(df, allow)
    got = {r["id"]: (r["recommend_subreddit"], r["number_of_r"]) for r in kept.collect()}
    assert got == {1: ("keto", 1), 5: ("keto", 1), 8: ("keto", 2)}
    assert multi_mention_total(kept).first()[0] == 1


@pytest.mark.parametrize("broadcast_names", [100, 1])
def test_rows_of_a_popular_target_go_to_many_tasks(spark, monkeypatch, broadcast_names):
    monkeypatch.setattr(mentions, "BROADCAST_NAMES", broadcast_names, raising=False)
    rows = [(i, f"go /r/{'keto' if i % 50 else 'diet'} now", "food", f"p{i}") for i in range(4000)]
    rows += [(i, "go /r/other now", "food", "p") for i in range(4000, 4100)] + [(7, "go /r/keto now", "food", "p7")]  # a repeated row
    df = spark.createDataFrame(rows, "id long, comment_body string, subreddit string, submission_author string")
    df = df.withColumn("seen", F.create_map(F.lit("id"), F.col("id")))  # a type that has no hash
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        kept = filter_referrals(df, allow_list_frame(spark, ["keto", "diet"]))
        got = kept.select("id", "recommend_subreddit", F.spark_partition_id().alias("task")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert kept.columns == ["recommend_subreddit", *df.columns, "number_of_r"]
    assert sorted(r["id"] for r in got) == sorted([*range(4000), 7])
    tasks = Counter(r["task"] for r in got if r["recommend_subreddit"] == "keto")
    assert len(tasks) > 1 and max(tasks.values()) < 0.5 * sum(tasks.values())

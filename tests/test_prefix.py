"""Keyed exclusive scan == brute force, including a hot key, ties, nulls and use under a union."""

import random

import math
from collections import Counter

import pandas as pd
from pyspark.sql import functions as F

from xcomm.operators.asof import pair_bag_cosine
from xcomm.operators.prefix import exclusive_sums, keyed_exclusive_sum, quantile_cut


def brute(rows, keys, order, weights):
    out = []
    for r in rows:
        k = tuple(r[c] for c in keys)
        o = tuple(r[c] for c in order)
        s = {w: sum(x[w] or 0 for x in rows if tuple(x[c] for c in keys) == k and tuple(x[c] for c in order) < o)
             for w in weights}
        out.append((r["id"], *[s[w] for w in weights]))
    return sorted(out)


def make_rows(n, seed, hot_share=0.34, null_keys=False):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if rnd.random() < hot_share else f"k{rnd.randint(0, 20)}"
        if null_keys and rnd.random() < 0.05:
            key = None
        rows.append({"id": i, "k": key, "t": rnd.randint(0, 30), "w": rnd.randint(0, 3), "v": rnd.random()})
    # the order must be total for a deterministic result: t then id
    return rows


def test_scan_matches_brute_force_with_hot_key(spark):
    rows = make_rows(600, 1, null_keys=True)
    df = spark.createDataFrame(pd.DataFrame(rows))
    exp = brute(rows, ["k"], ["t", "id"], ["w"])
    got = keyed_exclusive_sum(df, ["k"], ["t", "id"], ["w"])
    assert sorted((r["id"], r["w_before"]) for r in got.collect()) == exp


def test_scan_global_key_and_float_weights(spark):
    rows = make_rows(300, 2)
    for r in rows:
        r["g"] = 0
    df = spark.createDataFrame(pd.DataFrame(rows))
    exp = [(i, a, round(b, 9)) for i, a, b in brute(rows, ["g"], ["t", "id"], ["w", "v"])]
    got = keyed_exclusive_sum(df, ["g"], ["t", "id"], ["w", "v"])
    assert sorted((r["id"], r["w_before"], round(r["v_before"], 9)) for r in got.collect()) == exp


def test_scan_multi_key_columns(spark):
    rows = make_rows(300, 4)
    for r in rows:
        r["k2"] = r["id"] % 3
    df = spark.createDataFrame(pd.DataFrame(rows))
    got = keyed_exclusive_sum(df, ["k", "k2"], ["t", "id"], ["w"])
    assert sorted((r["id"], r["w_before"]) for r in got.collect()) == brute(rows, ["k", "k2"], ["t", "id"], ["w"])


def test_big_ids_and_orders(spark):
    """Keys, orders and payload beyond 2**53 stay exact; null keys are one key."""
    big = 2**53
    rows = [{"id": big + i, "k": None if i % 4 == 0 else big + i % 3, "t": big + (i * 7) % 40, "w": 1 + i % 2} for i in range(120)]
    df = spark.createDataFrame([(r["id"], r["k"], r["t"], r["w"]) for r in rows], "id long, k long, t long, w long")
    got = keyed_exclusive_sum(df, ["k"], ["t", "id"], ["w"])
    assert sorted((r["id"], r["w_before"]) for r in got.collect()) == brute(rows, ["k"], ["t", "id"], ["w"])


def test_text_and_float_orders(spark):
    rnd = random.Random(8)
    rows = [{"id": i, "k": "a", "s": "user_" + str(rnd.randint(0, 60)), "x": rnd.choice([-1, 1]) * rnd.random() * 10 ** rnd.randint(-3, 6), "w": 1} for i in range(200)]
    df = spark.createDataFrame(pd.DataFrame(rows))
    for order in ("s", "x"):
        got = keyed_exclusive_sum(df, ["k"], [order], ["w"])
        assert sorted((r["id"], r["w_before"]) for r in got.collect()) == brute(rows, ["k"], [order], ["w"])


def test_no_window_holds_a_key(spark):
    """Windows run inside (key, part of the order), never over all rows of a key; no Python."""
    df = spark.createDataFrame(pd.DataFrame(make_rows(50, 9)))
    plan = keyed_exclusive_sum(df, ["k"], ["t", "id"], ["w"])._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window" in line]
    assert windows and "MapInPandas" not in plan
    assert sum("shiftright" in plan for _ in windows) and len(windows) == 2


def test_common_prefix_still_gives_many_ranges(spark):
    """A text order whose values share a long prefix, and dates, timestamps and decimals, are cut into many ranges."""
    rows = [(i, f"Customer#{i * 7919 % 1000003:012d}" if i % 50 else None, i % 3 + 1) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, s string, w long")
    cut = df.select("s", quantile_cut(df, "s", ranges=32).alias("r")).where("s is not null")
    sizes = [r["n"] for r in cut.groupBy("r").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 32 and max(sizes) <= 2 * min(sizes)
    ordered = [r["r"] for r in cut.orderBy("s").collect()]
    assert ordered == sorted(ordered)
    kinds = df.selectExpr("id", "w", "s", "date_add(date'2001-01-01', int(id * 3)) AS d", "timestamp_seconds(id * 100000) AS t", "cast(id / 7 AS decimal(12, 4)) AS n")
    for order in ("s", "d", "t", "n"):
        totals = kinds.groupBy(F.lit(1).alias("k"), order).agg(F.sum("w").alias("w"))
        table = sorted(((r[order] is not None, r[order] or 0, r["w"], r["w_before"]) for r in exclusive_sums(totals, ["k"], [order], ["w"]).collect()), key=lambda r: r[:2])
        running = 0
        for _, _, w, before in table:
            assert before == running
            running += w
    assert exclusive_sums(df.where("false").withColumn("k", F.lit(1)).groupBy("k", "s").agg(F.sum("w").alias("w")), ["k"], ["s"], ["w"]).count() == 0


def test_bag_cosine_of_a_hot_actor(spark):
    """F15 + A1 against plain bags: one actor with a third of the rows, ties, missing actors and communities."""
    rnd = random.Random(11)
    actors, comms = [f"a{i}" for i in range(12)], [f"c{i}" for i in range(9)]
    who = lambda: "hot" if rnd.random() < 0.34 else None if rnd.random() < 0.05 else rnd.choice(actors)
    history = [(who(), rnd.choice(comms) if rnd.random() < 0.95 else None, rnd.randint(0, 40)) for _ in range(700)]
    probes = [(i, who(), rnd.randint(0, 45), who(), rnd.randint(0, 45), rnd.choice(comms), rnd.choice([*comms, "none", None])) for i in range(300)]
    h = spark.createDataFrame(history, "actor string, community string, t long")
    p = spark.createDataFrame(probes, "id long, p1 string, t1 long, p2 string, t2 long, own string, target string")
    got = {r["id"]: r for r in pair_bag_cosine(h, p, "id", ("p1", "t1"), ("p2", "t2"), extra=("own", "target")).collect()}
    assert len(got) == len(probes)
    bag = lambda a, t: Counter(c for x, c, s in history if a is not None and x == a and c is not None and s < t)
    for i, p1, t1, p2, t2, own, target in probes:
        b1, b2 = bag(p1, t1), bag(p2, t2)
        norm = math.sqrt(sum(v * v for v in b1.values())) * math.sqrt(sum(v * v for v in b2.values()))
        r = got[i]
        assert abs(r["cosine"] - (sum(v * b2[c] for c, v in b1.items()) / norm if norm else 0.0)) < 1e-9
        assert (r["own_n1"], r["own_n2"], r["target_n1"], r["target_n2"]) == (b1[own], b2[own], b1[target], b2[target])

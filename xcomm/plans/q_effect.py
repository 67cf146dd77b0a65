"""Fixture queries: effectiveness label (L1) and the as-of existence joins (J4, J5) on ``orders``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.effect import asof_anti, asof_semi, label_effect
from .fixtures import PRIORITIES, order_activity, order_referrals
from .registry import query, sql_list

ORDER_CTES = f"""
act AS (SELECT o_custkey AS actor, o_orderpriority AS community,
               CAST(epoch(o_orderdate) AS BIGINT) AS t FROM orders),
ref AS (SELECT o_orderkey AS referral_id, o_custkey AS actor, o_orderpriority AS own,
               {sql_list(PRIORITIES)}[(o_orderkey % 5) + 1] AS target,
               CAST(epoch(o_orderdate) AS BIGINT) AS t,
               least(o_totalprice / 400000.0, 1.0) AS score FROM orders)
"""

BEFORE = "EXISTS (SELECT 1 FROM act a WHERE a.actor = r.actor AND a.community = r.target AND a.t < r.t)"
AFTER = "EXISTS (SELECT 1 FROM act a WHERE a.actor = r.actor AND a.community = r.target AND a.t > r.t)"

LABELLED_CTE = f"""
lab AS (SELECT r.*, CASE WHEN NOT {BEFORE} AND {AFTER} THEN 1 ELSE -1 END AS is_effective FROM ref r)
"""


def labelled_orders(spark, sf_dir):
    refs = order_referrals(spark, sf_dir)
    act = order_activity(spark, sf_dir)
    return label_effect(refs, act, ref_actor="actor", ref_target="target", ref_time="t",
                        actor="actor", community="community", time="t", out="is_effective")


@query("label_effect", f"""
WITH {ORDER_CTES}, {LABELLED_CTE}
SELECT referral_id, actor, own, target, t, is_effective FROM lab
""")
def q_label_effect(spark, sf_dir):
    return labelled_orders(spark, sf_dir).select("referral_id", "actor", "own", "target", "t", "is_effective")


@query("label_effect_scored", f"""
WITH {ORDER_CTES}
SELECT referral_id, target, CASE WHEN NOT {BEFORE} AND {AFTER} THEN 1 ELSE -1 END AS is_effective
FROM ref r WHERE score > 0.9
""")
def q_label_effect_scored(spark, sf_dir):
    """L1 with the P13 gate: only referrals whose first-stage score is above 0.9 are labelled."""
    refs = order_referrals(spark, sf_dir)
    act = order_activity(spark, sf_dir)
    return label_effect(refs, act, ref_actor="actor", ref_target="target", ref_time="t",
                        actor="actor", community="community", time="t", score="score", min_score=0.9,
                        out="is_effective").select("referral_id", "target", "is_effective")


@query("asof_anti", f"""
WITH {ORDER_CTES}
SELECT referral_id, actor, target, t FROM ref r WHERE NOT {BEFORE}
""")
def q_asof_anti(spark, sf_dir):
    refs = order_referrals(spark, sf_dir).select("referral_id", "actor", "target", "t")
    return asof_anti(refs, order_activity(spark, sf_dir), "actor", "target", "t")


@query("asof_semi", f"""
WITH {ORDER_CTES}
SELECT referral_id, actor, target, t FROM ref r WHERE {AFTER}
""")
def q_asof_semi(spark, sf_dir):
    refs = order_referrals(spark, sf_dir).select("referral_id", "actor", "target", "t")
    return asof_semi(refs, order_activity(spark, sf_dir), "actor", "target", "t")


@query("effect_summary", f"""
WITH {ORDER_CTES}, {LABELLED_CTE}
SELECT target, CAST(count(*) AS BIGINT) AS n_referrals,
       CAST(sum(CASE WHEN is_effective = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_effective
FROM lab GROUP BY target
""")
def q_effect_summary(spark, sf_dir):
    """Label counts per target community (A11 shape) over the labelled referrals."""
    return labelled_orders(spark, sf_dir).groupBy("target").agg(
        F.count(F.lit(1)).alias("n_referrals"),
        F.sum(F.when(F.col("is_effective") == 1, 1).otherwise(0)).cast("long").alias("n_effective"),
    )

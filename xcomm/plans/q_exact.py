"""Exactness queries: large ids, missing and repeated keys on the plain paths, k nearest neighbours,
and features joined to text vectors."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from ..functions.text import WORD_TOKEN
from ..operators.asof import asof_sums
from ..operators.folds import author_folds, mix_hash
from ..operators.models import FEATURES, LABEL, KNeighbors, make_model
from ..operators.similarity import with_text_cosine
from .fixtures import event_activity, table
from .q_embed import ORACLE_VECTORS, q_idf_weighted_vectors
from .q_eval import AUTHOR_K, labelled_docs
from .q_similarity import REPLY_PAIRS_CTE, _terms_sql, reply_pairs
from .registry import query

BIG = 2**53


@query("asof_big_ids", f"""
WITH e AS (SELECT event_id * 1000003 + {BIG} AS id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE user_id + {BIG} END AS actor,
                  epoch_us(ts) AS t FROM events)
SELECT p.id, p.actor, (SELECT count(*) FROM e h WHERE h.actor = p.actor AND h.t < p.t) AS n_before FROM e p
""")
def q_asof_big_ids(spark, sf_dir):
    """W1 with ids and keys above 2**53 and every seventh key missing (such probes count 0)."""
    e = event_activity(spark, sf_dir).select(
        (F.col("event_id") * 1000003 + BIG).alias("id"),
        F.when(F.col("event_id") % 7 != 0, F.col("actor") + BIG).alias("actor"), "t")
    return asof_sums(e, e, ["actor"], "t", {"n_before": F.lit(1).cast("long")}).select("id", "actor", "n_before")


@query("author_folds_missing", f"""
WITH RECURSIVE x AS (SELECT l.doc_id, CASE WHEN l.doc_id % 5 = 0 THEN NULL ELSE d.source END AS source
                     FROM labels l JOIN documents d USING (doc_id)),
runs AS (SELECT source, count(*) AS n FROM x GROUP BY source),
off AS (SELECT source, coalesce(sum(n) OVER (ORDER BY source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
        AS start, n FROM runs),
tot AS (SELECT sum(n) / {float(AUTHOR_K)} AS step FROM runs),
nxt AS (SELECT o.start AS s, (SELECT min(o2.start) FROM off o2 WHERE o2.start >= o.start + (SELECT step FROM tot)) AS ns
        FROM off o),
chain(s) AS (SELECT CAST(0 AS HUGEINT) UNION ALL SELECT n.ns FROM chain c JOIN nxt n ON n.s = c.s WHERE n.ns IS NOT NULL)
SELECT x.doc_id, x.source, CAST((SELECT count(*) FROM chain c WHERE c.s <= o.start) - 1 AS INTEGER) AS group_number
FROM x JOIN off o ON x.source IS NOT DISTINCT FROM o.source
""")
def q_author_folds_missing(spark, sf_dir):
    """W2 where every fifth author is missing: those rows are one run, the first, and stay."""
    x = labelled_docs(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 5 != 0, F.col("source")).alias("source"))
    return author_folds(x, "source", AUTHOR_K)


@query("similarity_repeated_ids", f"""
WITH {REPLY_PAIRS_CTE}, {_terms_sql(False, WORD_TOKEN)},
agg AS (SELECT conv_id, turn, sum(c1 * c2) AS dot, sum(c1 * c1) AS s1, sum(c2 * c2) AS s2 FROM terms GROUP BY ALL)
SELECT CASE WHEN p.conv_id % 4 = 0 THEN NULL ELSE p.conv_id % 10 END AS pair_id, p.turn,
       round(coalesce(CASE WHEN s1 > 0 AND s2 > 0 THEN dot / (sqrt(s1) * sqrt(s2)) END, 0.0), 6) AS similarity
FROM pairs p LEFT JOIN agg USING (conv_id, turn)
""")
def q_similarity_repeated_ids(spark, sf_dir):
    """F5 + F9 row by row where ids repeat and every fourth is missing: as many rows as came in."""
    pairs = reply_pairs(spark, sf_dir).withColumn("pair_id", F.when(F.col("conv_id") % 4 != 0, F.col("conv_id") % 10))
    return with_text_cosine(pairs, "t1", "t2", out="c").select("pair_id", "turn", F.round("c", 6).alias("similarity"))


KNN_SQL = """
WITH e AS (SELECT vec_id, CASE WHEN label >= 5 THEN 1 ELSE -1 END AS y, embedding::DOUBLE[] AS v,
                  ((vec_id * 2654435761) % 4294967296) % 5 AS fold FROM embeddings),
near AS (SELECT a.vec_id, b.y, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), b.y) AS k
         FROM e a JOIN e b ON a.fold = 0 AND b.fold <> 0)
SELECT vec_id, CASE WHEN sum(y) > 0 THEN 1 ELSE -1 END AS prediction FROM near WHERE k <= 10 GROUP BY vec_id
"""


@query("knn10", KNN_SQL)
def q_knn10(spark, sf_dir):
    """C4: ten nearest neighbours on ``embeddings`` (label >= 5 vs < 5), one fold held out."""
    e = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.when(F.col("label") >= 5, 1).otherwise(-1).alias(LABEL), F.pmod(mix_hash("vec_id"), F.lit(5)).alias("fold"),
        array_to_vector(F.col("embedding").cast("array<double>")).alias(FEATURES))
    model = make_model("KNeighbors").fit(e.where("fold <> 0"))
    return model.predict(e.where("fold = 0")).select("vec_id", F.col("prediction").cast("int"))


@query("knn10_blocks", KNN_SQL)
def q_knn10_blocks(spark, sf_dir):
    """C4 beyond the bound of one matrix (here set to 100 rows): the join of blocks, same result."""
    e = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.when(F.col("label") >= 5, 1).otherwise(-1).alias(LABEL), F.pmod(mix_hash("vec_id"), F.lit(5)).alias("fold"),
        array_to_vector(F.col("embedding").cast("array<double>")).alias(FEATURES))
    model = KNeighbors(k=10, rows=100).fit(e.where("fold <> 0"))
    return model.predict(e.where("fold = 0")).select("vec_id", F.col("prediction").cast("int"))


@query("features_with_text_vectors", f"""
WITH vectors AS ({ORACLE_VECTORS}),
f AS (SELECT l.doc_id, CAST(2 * l.quality - 1 AS INTEGER) AS label, d.n_chars,
             CAST(len(regexp_extract_all(d.text, '{WORD_TOKEN}')) AS BIGINT) AS n_words
      FROM labels l JOIN documents d USING (doc_id))
SELECT f.*, v0, v1, v2 FROM f JOIN vectors USING (doc_id)
""")
def q_features_with_text_vectors(spark, sf_dir):
    """Labelled feature rows joined to the text vectors of the same message, by its id."""
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").select(
        "doc_id", (2 * F.col("quality") - 1).cast("int").alias("label"), F.col("n_chars").cast("long").alias("n_chars"),
        F.size(F.regexp_extract_all("text", F.lit(WORD_TOKEN), 0)).cast("long").alias("n_words"))
    return d.join(q_idf_weighted_vectors(spark, sf_dir), "doc_id")

"""Fixture queries: classifiers under cross-validation (C1–C3, C5–C16, V1, V2), selection
summaries (A13–A16, O2, V8–V12) on labelled documents and on ``embeddings``."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from ..functions.text import WORD_TOKEN
from ..operators.evaluate import grouped_cv, pooled_cv
from ..operators.folds import author_folds, mix_hash, stratified_folds
from ..operators.metrics import binary_metrics
from ..operators.models import FEATURES, LABEL, make_model
from ..operators.select import band_average, band_loop, best_candidate, feature_group_search, fold_means, stepwise
from ..session import staged
from .fixtures import table
from .q_eval import AUTHOR_K
from .registry import query

DOC_COUNTS = ["n_chars", "n_words", "n_lines", "n_upper", "n_digits"]
DOC_FEATURES = [f"log_{c}" for c in DOC_COUNTS]
CV_K = 5
POOLED_K = 100


def doc_features(spark, sf_dir):
    """Labelled feature rows: one per labelled document; label ±1 from quality, author = source,
    numeric text features computed with built-in expressions over the whole text, plus their
    log1p versions (``log_*``) that the classifiers train on."""
    d = table(spark, sf_dir, "documents")
    lab = table(spark, sf_dir, "labels")
    x = lab.join(d, "doc_id", "inner").select(
        "doc_id", "source", "lang", (2 * F.col("quality") - 1).cast("int").alias("IsEfficient"),
        F.col("n_chars").cast("long").alias("n_chars"),
        F.size(F.regexp_extract_all("text", F.lit(WORD_TOKEN), 0)).cast("long").alias("n_words"),
        F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"),
        F.length(F.regexp_replace("text", r"[^\p{Lu}]", "")).cast("long").alias("n_upper"),
        F.length(F.regexp_replace("text", "[^0-9]", "")).cast("long").alias("n_digits"),
        F.coalesce(F.try_divide(F.lit(100.0) * F.length(F.regexp_replace("text", r"[^\p{Lu}]", "")), F.length("text")),
                   F.lit(0.0)).alias("pct_upper"),
    )
    # written once: folds, bands and fits read the numbers again and again, the texts only here
    return staged(x.select("*", *[F.log1p(c).alias(f"log_{c}") for c in DOC_COUNTS]), "doc-features")


def doc_folds(spark, sf_dir, k=CV_K):
    return author_folds(doc_features(spark, sf_dir), "source", k)


def _folds_sql(k: int) -> str:
    """CTEs up to ``feat``: the document features with author-disjoint folds, as DuckDB SQL."""
    return f"""WITH RECURSIVE x AS (SELECT l.doc_id, d.source, 2 * l.quality - 1 AS label, d.n_chars,
                            len(regexp_extract_all(d.text, '{WORD_TOKEN}')) AS n_words,
                            len(string_split(d.text, chr(10))) AS n_lines,
                            length(regexp_replace(d.text, '[^\\p{{Lu}}]', '', 'g')) AS n_upper,
                            length(regexp_replace(d.text, '[^0-9]', '', 'g')) AS n_digits,
                            100.0 * length(regexp_replace(d.text, '[^\\p{{Lu}}]', '', 'g')) / length(d.text) AS pct_upper
                     FROM labels l JOIN documents d USING (doc_id)),
runs AS (SELECT source, count(*) AS n FROM x GROUP BY source),
off AS (SELECT source, n, coalesce(sum(n) OVER (ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
        AS start FROM runs),
tot AS (SELECT sum(n) / {float(k)} AS step FROM runs),
nxt AS (SELECT o.start AS s, (SELECT min(o2.start) FROM off o2 WHERE o2.start >= o.start + (SELECT step FROM tot)) AS ns
        FROM off o),
chain(s) AS (SELECT CAST(0 AS HUGEINT) UNION ALL SELECT n.ns FROM chain c JOIN nxt n ON n.s = c.s WHERE n.ns IS NOT NULL),
feat AS (SELECT x.*, CAST((SELECT count(*) FROM chain c WHERE c.s <= o.start) - 1 AS INTEGER) AS group_number
         FROM x JOIN off o USING (source)),
"""


def _cv_sql(name: str, predicted: str) -> str:
    """Leave-one-fold-out metrics of a closed-form model; ``predicted`` is the CTE ``pred`` over
    ``vals`` (doc_id, fold, label, i, v), ``folds`` and per-fold sums ``part``."""
    vals = " UNION ALL ".join(f"SELECT doc_id, group_number AS fold, label, {i} AS i, ln(1 + {c}) AS v FROM feat"
                              for i, c in enumerate(DOC_COUNTS))
    return f"""{_folds_sql(CV_K)}
vals AS ({vals}),
part AS (SELECT fold, label, i, sum(v) AS sv, sum(CASE WHEN v > 0 THEN 1 ELSE 0 END) AS pos, count(*) AS n,
         min(v) AS lo, max(v) AS hi FROM vals GROUP BY ALL),
train AS (SELECT f.fold, p.label, p.i, sum(p.sv) AS sv, sum(p.pos) AS pos, sum(p.n) AS n
          FROM (SELECT DISTINCT fold FROM vals) f JOIN part p ON p.fold <> f.fold GROUP BY ALL),
{predicted},
m AS (SELECT fold, count(*) AS n, sum(CASE WHEN y = -1 AND p = -1 THEN 1 ELSE 0 END)::BIGINT AS tn,
             sum(CASE WHEN y = -1 AND p = 1 THEN 1 ELSE 0 END)::BIGINT AS fp,
             sum(CASE WHEN y = 1 AND p = -1 THEN 1 ELSE 0 END)::BIGINT AS fn,
             sum(CASE WHEN y = 1 AND p = 1 THEN 1 ELSE 0 END)::BIGINT AS tp FROM pred GROUP BY fold)
SELECT '{name}' AS classifier_name, fold, (tp + tn) / n AS score,
       CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN (tp / (tp + fn) + tn / (tn + fp)) / 2 END AS auc, tn, fp, fn, tp FROM m
"""


CV_SQL = {
    "NearestCentroid": """
dist AS (SELECT v.doc_id, v.fold, v.label AS y, t.label AS p, sum((v.v - t.sv / t.n) * (v.v - t.sv / t.n)) AS d
         FROM vals v JOIN train t USING (fold, i) GROUP BY ALL),
pred AS (SELECT doc_id, fold, y, arg_min(p, [d, p]) AS p FROM dist GROUP BY ALL)""",
    "MultinomialNB": f"""
span AS (SELECT f.fold, p.i, min(p.lo) AS lo, max(p.hi) AS hi
         FROM (SELECT DISTINCT fold FROM vals) f JOIN part p ON p.fold <> f.fold GROUP BY ALL),
scaled AS (SELECT t.fold, t.label, t.i, t.n, CASE WHEN hi > lo THEN (t.sv - t.n * lo) / (hi - lo) ELSE 0.0 END AS sv
           FROM train t JOIN span USING (fold, i)),
sizes AS (SELECT fold, label, max(n) AS n, sum(sv) AS total FROM scaled GROUP BY ALL),
every AS (SELECT fold, sum(n) AS n FROM sizes GROUP BY fold),
score AS (SELECT v.doc_id, v.fold, v.label AS y, t.label AS p,
                 ln(max(s.n) + 0.01) - ln(max(e.n) + 0.02)
                 + sum(CASE WHEN hi > lo THEN least(greatest((v.v - lo) / (hi - lo), 0.0), 1.0) ELSE 0.0 END
                       * (ln(t.sv + 0.01) - ln(s.total + 0.01 * {len(DOC_COUNTS)}))) AS d
          FROM vals v JOIN scaled t USING (fold, i) JOIN span r USING (fold, i)
          JOIN sizes s ON s.fold = t.fold AND s.label = t.label JOIN every e ON e.fold = t.fold GROUP BY ALL),
pred AS (SELECT doc_id, fold, y, arg_max(p, d) AS p FROM score GROUP BY ALL)""",
    "BernoulliNB": """
sizes AS (SELECT fold, label, max(n) AS n FROM train GROUP BY ALL),
every AS (SELECT fold, sum(n) AS n FROM sizes GROUP BY fold),
score AS (SELECT v.doc_id, v.fold, v.label AS y, t.label AS p,
                 ln(max(s.n) + 0.01) - ln(max(e.n) + 0.02)
                 + sum(CASE WHEN v.v > 0 THEN ln(t.pos + 0.01) - ln(t.n + 0.02)
                            ELSE ln(1 - (t.pos + 0.01) / (t.n + 0.02)) END) AS d
          FROM vals v JOIN train t USING (fold, i) JOIN sizes s ON s.fold = t.fold AND s.label = t.label
          JOIN every e ON e.fold = t.fold GROUP BY ALL),
pred AS (SELECT doc_id, fold, y, arg_max(p, d) AS p FROM score GROUP BY ALL)""",
}


def _ridge_sql() -> str:
    """Leave-one-fold-out ridge: the centred normal equations of the other folds, solved by Gaussian elimination, one
    CTE for each column."""
    p, cols = len(DOC_COUNTS), [f"ln(1 + {c})" for c in DOC_COUNTS]
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    base = ", ".join([f"{c} AS x{i}" for i, c in enumerate(cols)])
    sums = ", ".join([f"sum(x{i}) AS s{i}, sum(x{i} * y) AS t{i}" for i in range(p)] + [f"sum(x{i} * x{j}) AS g{i}{j}" for i, j in pairs])
    total = ", ".join([f"sum(s{i}) AS s{i}, sum(t{i}) AS t{i}" for i in range(p)] + [f"sum(g{i}{j}) AS g{i}{j}" for i, j in pairs])
    at = lambda i, j: f"g{min(i, j)}{max(i, j)}"
    first = ", ".join([f"{at(i, j)} - s{i} * s{j} / n{' + 1.0' if i == j else ''} AS a{i}{j}" for i in range(p) for j in range(p)]
                      + [f"t{i} - s{i} * sy / n AS r{i}" for i in range(p)] + [f"s{i} / n AS m{i}" for i in range(p)])
    steps = [f"e0 AS MATERIALIZED (SELECT fold, sy / n AS my, {first} FROM train)"]
    keep = "fold, my, " + ", ".join(f"m{i}" for i in range(p))
    for k in range(p):  # column k is cleared in all other rows
        rows = [f"a{i}{j} - a{i}{k} * a{k}{j} / a{k}{k} AS a{i}{j}" if i != k else f"a{k}{j}" for i in range(p) for j in range(k + 1, p)]
        rhs = [f"r{i} - a{i}{k} * r{k} / a{k}{k} AS r{i}" if i != k else f"r{k}" for i in range(p)]
        diagonal = [f"a{i}{i}" for i in range(k + 1)]
        steps.append(f"e{k + 1} AS MATERIALIZED (SELECT {', '.join([keep, *rows, *rhs, *diagonal])} FROM e{k})")
    raw = " + ".join(["my", *[f"(x{i} - m{i}) * r{i} / a{i}{i}" for i in range(p)]])
    return f"""{_folds_sql(CV_K)}
b AS MATERIALIZED (SELECT doc_id, group_number AS fold, label AS y, {base} FROM feat),
part AS MATERIALIZED (SELECT fold, count(*) AS n, sum(y) AS sy, {sums} FROM b GROUP BY fold),
train AS MATERIALIZED (SELECT f.fold, sum(n) AS n, sum(sy) AS sy, {total} FROM (SELECT DISTINCT fold FROM b) f JOIN part p ON p.fold <> f.fold GROUP BY f.fold),
{", ".join(steps)},
pred AS (SELECT b.fold, b.y, CASE WHEN {raw} > 0 THEN 1 ELSE -1 END AS p FROM b JOIN e{p} e USING (fold)),
m AS (SELECT fold, sum(CASE WHEN y = -1 AND p = -1 THEN 1 ELSE 0 END)::BIGINT AS tn, sum(CASE WHEN y = -1 AND p = 1 THEN 1 ELSE 0 END)::BIGINT AS fp,
             sum(CASE WHEN y = 1 AND p = -1 THEN 1 ELSE 0 END)::BIGINT AS fn, sum(CASE WHEN y = 1 AND p = 1 THEN 1 ELSE 0 END)::BIGINT AS tp FROM pred GROUP BY fold)
SELECT 'RidgeClassifier' AS classifier_name, fold, (tp + tn) / (tp + tn + fp + fn) AS score,
       CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN (tp / (tp + fn) + tn / (tn + fp)) / 2 END AS auc, tn, fp, fn, tp FROM m
"""


def _cv_query(model_name):
    def run(spark, sf_dir):
        res = grouped_cv(doc_folds(spark, sf_dir), DOC_FEATURES, [model_name], "IsEfficient", "group_number",
                         threads=CV_K)
        return res.select("classifier_name", "fold", "score", "auc", "tn", "fp", "fn", "tp")

    run.__doc__ = f"V2 with {model_name}: author-disjoint {CV_K}-fold CV on the labelled document features."
    return run


CV_MODELS = {
    "cv_ridge": "RidgeClassifier",
    "cv_perceptron": "Perceptron",
    "cv_passive_aggressive": "PassiveAggressive",
    "cv_knn": "KNeighbors",
    "cv_forest": "RandomForest",
    "cv_rbf_svm": "SVC_rbf",
    "cv_svm_sqhinge_l1": "LinearSVC_l1",
    "cv_svm_sqhinge_l2": "LinearSVC_l2",
    "cv_svm_hinge": "SGD_l2",
    "cv_sgd_l1": "SGD_l1",
    "cv_sgd_elasticnet": "SGD_elasticnet",
    "cv_nearest_centroid": "NearestCentroid",
    "cv_naive_bayes_multinomial": "MultinomialNB",
    "cv_naive_bayes_bernoulli": "BernoulliNB",
    "cv_logistic": "LogisticRegression",
}
for _name, _model in CV_MODELS.items():
    _sql = _cv_sql(_model, CV_SQL[_model]) if _model in CV_SQL else _ridge_sql() if _model == "RidgeClassifier" else None
    query(_name, _sql)(_cv_query(_model))


@query("pooled_cv_logistic")
def q_pooled_cv_logistic(spark, sf_dir):
    """V1 evaluation: stratified folds (k = 100), pooled out-of-fold predictions, one score."""
    f = stratified_folds(doc_features(spark, sf_dir), "IsEfficient", "doc_id", POOLED_K)
    return pooled_cv(f, DOC_FEATURES, ["LogisticRegression"], "IsEfficient", "fold", threads=8).select(
        "classifier_name", "score", "auc", "tn", "fp", "fn", "tp")


SEARCH_GROUPS = {"length": ["log_n_chars", "log_n_words"], "layout": ["log_n_lines"], "case": ["log_n_upper"],
                 "digits": ["log_n_digits"]}
SEARCH_MODELS = ["NearestCentroid", "RidgeClassifier"]


@query("group_search")
def q_group_search(spark, sf_dir):
    """V8 + V9: every subset of the feature groups that holds the 'length' group, for each model."""
    res = feature_group_search(doc_folds(spark, sf_dir), SEARCH_GROUPS, SEARCH_MODELS, "IsEfficient", "group_number",
                               must_include="length", threads=8)
    return fold_means(res, ["classifier_name", "group_list"]).drop("train_time")


@query("backward_elimination")
def q_backward_elimination(spark, sf_dir):
    """Greedy backward elimination over all document features, best AUC over the models."""
    return stepwise(doc_folds(spark, sf_dir), DOC_FEATURES, SEARCH_MODELS, "IsEfficient", "group_number", "backward",
                    threads=8)


@query("forward_selection")
def q_forward_selection(spark, sf_dir):
    """Greedy forward selection over all document features, best AUC over the models."""
    return stepwise(doc_folds(spark, sf_dir), DOC_FEATURES, SEARCH_MODELS, "IsEfficient", "group_number", "forward",
                    threads=8)


# ---- nearest centroid on embeddings, exact ---------------------------------------------------------

EMB_K = 5


@query("nearest_centroid", f"""
WITH e AS (SELECT vec_id, CASE WHEN label >= 5 THEN 1 ELSE -1 END AS y,
                  ((vec_id * 2654435761) % 4294967296) % {EMB_K} AS fold, embedding FROM embeddings),
d AS (SELECT vec_id, y, fold, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM e),
s AS (SELECT fold, y, i, sum(v) AS sv, count(*) AS n FROM d GROUP BY ALL),
tot AS (SELECT y, i, sum(sv) AS sv, sum(n) AS n FROM s GROUP BY ALL),
folds AS (SELECT DISTINCT fold FROM e),
cen AS (SELECT f.fold, t.y, t.i, (t.sv - coalesce(s.sv, 0)) / (t.n - coalesce(s.n, 0)) AS c
        FROM folds f CROSS JOIN tot t LEFT JOIN s ON s.fold = f.fold AND s.y = t.y AND s.i = t.i),
dist AS (SELECT d.vec_id, c.y, sum((d.v - c.c) * (d.v - c.c)) AS dd FROM d JOIN cen c ON c.fold = d.fold AND c.i = d.i
         GROUP BY ALL)
SELECT vec_id, CAST(arg_min(y, [dd, y]) AS INTEGER) AS prediction FROM dist GROUP BY vec_id
""")
def q_nearest_centroid(spark, sf_dir):
    """Leave-one-fold-out nearest-centroid predictions on ``embeddings`` (label ≥ 5 vs < 5)."""
    e = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.when(F.col("label") >= 5, 1).otherwise(-1).alias(LABEL),
        F.pmod(mix_hash("vec_id"), F.lit(EMB_K)).alias("fold"),
        array_to_vector(F.col("embedding").cast("array<double>")).alias(FEATURES))
    out = None
    for k in range(EMB_K):
        m = make_model("NearestCentroid").fit(e.where(F.col("fold") != k))
        p = m.predict(e.where(F.col("fold") == k)).select("vec_id", F.col("prediction").cast("int"))
        out = p if out is None else out.unionByName(p)
    return out


# ---- rule-candidate result table: band averages and best candidate (A13–A16, O2, V12) -------------

RULES = {"n_chars": 1500, "n_digits": 0, "n_lines": 6, "n_upper": 25, "n_words": 250}
BANDS = [(0.0, 1.25), (1.25, 1.6), (1.6, 100.0)]


def rule_results(spark, sf_dir):
    """Per (band, candidate rule, author fold): metrics of the rule 'feature > threshold ⇒ +1'.
    One scan: each row is fanned out to the bands it lies in (closed, Q18) and to every
    candidate, then one grouped aggregation computes all metrics."""
    f = author_folds(doc_features(spark, sf_dir), "source", AUTHOR_K)
    bands = F.array(*[F.struct(F.lit(d).alias("dn"), F.lit(u).alias("up")) for d, u in BANDS])
    pct = F.col("pct_upper")
    x = f.withColumn("band", F.explode(F.filter(bands, lambda b: (pct >= b["dn"]) & (pct <= b["up"]))))
    cands = F.array(*[F.struct(F.lit(c).alias("candidate"), F.when(F.col(c) > thr, 1).otherwise(-1).alias("prediction"))
                      for c, thr in sorted(RULES.items())])
    x = x.withColumn("r", F.explode(cands)).select(
        F.col("IsEfficient").alias("label"), F.col("r.prediction").alias("prediction"),
        F.col("r.candidate").alias("candidate"), F.col("band.dn").alias("Peff_down_threshold"),
        F.col("band.up").alias("Peff_up_threshold"), "group_number")
    m = binary_metrics(x, ["candidate", "Peff_down_threshold", "Peff_up_threshold", "group_number"])
    return m.select("candidate", "Peff_down_threshold", "Peff_up_threshold", "group_number",
                    F.col("accuracy").alias("score"), "auc")


def _rules_sql() -> str:
    bands = " UNION ALL ".join(f"SELECT CAST({d} AS DOUBLE) AS dn, CAST({u} AS DOUBLE) AS up" for d, u in BANDS)
    rules = " UNION ALL ".join(f"SELECT '{c}' AS candidate, {t} AS thr" for c, t in sorted(RULES.items()))
    vals = " UNION ALL ".join(f"SELECT doc_id, '{c}' AS candidate, CAST({c} AS DOUBLE) AS v FROM feat" for c in sorted(RULES))
    return f"""
{_folds_sql(AUTHOR_K)}vals AS ({vals}),
p AS (SELECT b.dn, b.up, r.candidate, f.group_number, f.label, CASE WHEN v.v > r.thr THEN 1 ELSE -1 END AS prediction
      FROM feat f JOIN ({bands}) b ON f.pct_upper BETWEEN b.dn AND b.up
      JOIN vals v ON v.doc_id = f.doc_id JOIN ({rules}) r ON r.candidate = v.candidate),
m AS (SELECT dn, up, candidate, group_number, count(*) AS n,
             sum(CASE WHEN label = prediction THEN 1 ELSE 0 END) AS n_right,
             sum(CASE WHEN label = -1 AND prediction = -1 THEN 1 ELSE 0 END) AS tn,
             sum(CASE WHEN label = -1 AND prediction = 1 THEN 1 ELSE 0 END) AS fp,
             sum(CASE WHEN label = 1 AND prediction = -1 THEN 1 ELSE 0 END) AS fn,
             sum(CASE WHEN label = 1 AND prediction = 1 THEN 1 ELSE 0 END) AS tp FROM p GROUP BY ALL),
res AS (SELECT candidate, dn AS Peff_down_threshold, up AS Peff_up_threshold, group_number, n_right / n AS score,
               CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN (tp / (tp + fn) + tn / (tn + fp)) / 2 END AS auc FROM m),
band_means AS (SELECT candidate, Peff_down_threshold, Peff_up_threshold, avg(score) AS score, avg(auc) AS auc
               FROM res GROUP BY ALL)
"""


@query("band_average", _rules_sql() + """
SELECT candidate, round(score, 6) AS score, round(auc, 6) AS auc, false AS is_average FROM band_means
UNION ALL
SELECT candidate, round(avg(score), 6), round(avg(auc), 6), true FROM band_means GROUP BY candidate
""")
def q_band_average(spark, sf_dir):
    """A14 + A15 + V12: per band, mean over folds; then mean over bands marked ``is_average``."""
    means = rule_results(spark, sf_dir).groupBy("candidate", "Peff_down_threshold", "Peff_up_threshold").agg(
        F.avg("score").alias("score"), F.avg("auc").alias("auc"))
    out = band_average(means, ["candidate"], ["score", "auc"])
    return out.select("candidate", F.round("score", 6).alias("score"), F.round("auc", 6).alias("auc"), "is_average")


@query("grid_best", _rules_sql() + """
SELECT Peff_down_threshold, Peff_up_threshold, arg_max(candidate, row(auc, candidate)) AS candidate,
       round(max(auc), 6) AS auc
FROM (SELECT * FROM band_means WHERE auc IS NOT NULL) GROUP BY ALL
""")
def q_grid_best(spark, sf_dir):
    """A13 + A16 + O2: per band, the candidate with the best mean AUC (ties → largest name)."""
    means = rule_results(spark, sf_dir).groupBy("candidate", "Peff_down_threshold", "Peff_up_threshold").agg(
        F.avg("score").alias("score"), F.avg("auc").alias("auc")).where(F.col("auc").isNotNull())
    best = best_candidate(means, ["Peff_down_threshold", "Peff_up_threshold"], "candidate", "auc")
    return best.select("Peff_down_threshold", "Peff_up_threshold", "candidate", F.round("auc", 6).alias("auc"))


@query("band_cv")
def q_band_cv(spark, sf_dir):
    """V12 + V13: per history band (on the upper-case share), author-disjoint folds inside the band
    (k = 5, 3 for the top band) and a grouped CV of one model; then the mean over bands."""
    bands = [(d, u, 3 if u >= 100.0 else 5) for d, u in BANDS]
    res = band_loop(doc_features(spark, sf_dir), "pct_upper", bands, DOC_FEATURES, ["NearestCentroid"],
                    "IsEfficient", "source", threads=4)
    means = res.groupBy("classifier_name", "Peff_down_threshold", "Peff_up_threshold").agg(
        F.avg("score").alias("score"), F.avg("auc").alias("auc"))
    return band_average(means, ["classifier_name"], ["score", "auc"])

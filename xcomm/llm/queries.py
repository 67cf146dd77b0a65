"""The registered queries of the training-data operators, one per operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import additive_model, cover_tree, deobfuscation, jaccard_join, licences, line_rules, mixing, packing, pii, sharding, suffix_dedup, va_file, whitening
from .common import staged

QUERIES = {}
ORACLE = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql.strip()
        return fn

    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _rx(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _line_sql() -> str:
    r = line_rules
    n = f"len(regexp_extract_all(l, {_rx(r.WORD)}))"
    runs = f"len(regexp_extract_all(l, {_rx(r.SYMBOL_RUN)}))"
    seps = f"len(regexp_extract_all(l, {_rx(r.SEPARATOR)}))"
    return f"""({n} > 0 AND ({runs} * 100 >= {r.SYMBOL_SHARE} * {n}
        OR ({n} < {r.SHORT} AND NOT regexp_matches(l, {_rx(r.ENDS)}))
        OR ({seps} >= 3 AND {seps} * 4 >= {n}) OR regexp_matches(l, {_rx(r.MENU)})
        OR ({n} <= {r.BOILERPLATE_WORDS} AND regexp_matches(l, {_rx(r.BOILERPLATE)}))))"""


def remainder(key, n: int):
    """crc32 of the key as text, modulo n."""
    return F.pmod(F.crc32(F.encode(F.coalesce(F.col(key).cast("string"), F.lit("")), "UTF-8")), F.lit(n))


@query("op1_deobfuscation")
def op1_deobfuscation(spark, sf_dir):
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = deobfuscation.train_toxicity(docs, labels, remainder("doc_id", 5) != 0)
    scored = deobfuscation.score_toxicity(docs.select("doc_id", "text"), model)
    return scored.select("row.doc_id", "score", "hits", "n_spans").select(
        "doc_id",
        (remainder("doc_id", 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "hits",
        "n_spans",
    )


@query("op2_cover_tree")
def op2_cover_tree(spark, sf_dir):
    linked = cover_tree.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return linked.select("row.vec_id", "n_links", "component_id", "kept")


OP3_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_WORDS} AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
win AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 3),
tri AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS c FROM win),
cov AS (SELECT r, count(DISTINCT i + k) AS n FROM tri, (SELECT unnest([0, 1, 2]) AS k) WHERE c > 1 GROUP BY r),
good AS (SELECT r, len(regexp_extract_all(array_to_string(list_filter(string_split(text, chr(10)), lambda l: NOT {_line_sql()}), chr(10)), '[^\x20\x09-\x0D]+')) AS n FROM d),
base AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words, good.n AS n_good
  FROM d LEFT JOIN cov USING (r) JOIN good USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_good * 100 >= n_words * {line_rules.LEAST_KEPT} AS kept
FROM base
"""


@query("op3_line_rules", OP3_SQL)
def op3_line_rules(spark, sf_dir):
    judged = line_rules.clean_lines(documents(spark, sf_dir))
    return judged.select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query("op4_sharding")
def op4_sharding(spark, sf_dir):
    docs = documents(spark, sf_dir)
    written, manifest = sharding.shuffle_into_shards(docs)
    body = F.coalesce(F.col("row.text"), F.lit(""))
    return written.join(F.broadcast(manifest), ["shard", "bucket"]).select(
        "row.doc_id",
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        (F.col("first_slot") + F.col("pos")).alias("slot"),
        sharding.shard_of(F.col("row.doc_id"), sharding.SHARDS + 1, 7).alias("grown_shard"),
    )


OP5_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, len({_WORDS})::BIGINT AS size,
         ('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, '?') || '|' || md5(coalesce(text, ''))), 1, 13))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rnk FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][rnk % 3 + 1] AS weight, source_size * 2 AS cap, source_size * 2 / [3, 1, 2][rnk % 3 + 1] AS ratio FROM s),
v AS (SELECT *, (sum(source_size) OVER ()) * 1.5::DOUBLE AS total,
             coalesce(sum(cap) OVER (ORDER BY ratio, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps,
             sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY ratio, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS opened FROM w),
l AS (SELECT *, (total - caps) / opened AS lvl, row_number() OVER (ORDER BY ratio, rnk) AS k FROM v),
x AS (SELECT *, (SELECT arg_min(lvl, k) FROM l WHERE lvl <= ratio) AS water FROM l),
t AS (SELECT source, source_size, least(cap::DOUBLE, coalesce(water, ratio) * weight) AS target FROM x),
u AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
c AS (SELECT d.doc_id, d.size, u.source_size, u.target, u.whole, u.target - u.whole * u.source_size AS budget,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h ROWS UNBOUNDED PRECEDING) AS cum
      FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN whole < 2 AND size > 0 AND (cum <= budget OR (cum - size <= budget AND cum - budget < budget - (cum - size))) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c
"""


@query("op5_mixing", OP5_SQL)
def op5_mixing(spark, sf_dir):
    mixed = mixing.mix_sources(documents(spark, sf_dir), keep=("doc_id",))
    return mixed.select("row.doc_id", "size", "source_size", "target", "taken")


@query("op6_suffix_dedup")
def op6_suffix_dedup(spark, sf_dir):
    cut = suffix_dedup.remove_repeats(documents(spark, sf_dir))
    # what is left comes along, so that what was removed can be read
    return cut.select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.col("cleaned").alias("text"))


@query("op7_jaccard_join")
def op7_jaccard_join(spark, sf_dir):
    grouped = jaccard_join.jaccard_components(documents(spark, sf_dir))
    return grouped.select("row.doc_id", "n_shingles", "component_id")


@query("op8_additive_model")
def op8_additive_model(spark, sf_dir):
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = additive_model.train_quality(docs, labels, remainder("doc_id", 3) != 1)
    scored = additive_model.score_quality(docs.select("doc_id", "text"), model)
    return scored.select("row.doc_id", "score").select(
        "doc_id",
        (remainder("doc_id", 3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query("op9_licences")
def op9_licences(spark, sf_dir):
    found = licences.scan_licences(documents(spark, sf_dir))
    return found.select("row.doc_id", "sentence_ids", "licences", "rules", "n_known")


@query("op10_packing")
def op10_packing(spark, sf_dir):
    placed = packing.pack_documents(documents(spark, sf_dir))
    return placed.select("row.doc_id", "piece", "first_word", "n_words", "bin", "start", "capacity", "used")


#: Parameters of the clustering query.
CENTROIDS, ROUNDS, CLUSTER_SEED, DIMS = 8, 10, 3, 64


def _cluster_sql() -> str:
    limit = float(va_file.LIMIT)
    good = f"len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMS}"
    name = f"'{CLUSTER_SEED}:' || coalesce(vec_id::VARCHAR, '')"
    parts = [f"""WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: greatest(least(floor(1024 * x::DOUBLE), {limit}), {-limit})::BIGINT) AS v
  FROM embeddings WHERE {good}),
x AS MATERIALIZED (SELECT r, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM kept),
s AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256({name}), v) - 1 AS c, v FROM kept),
c0 AS MATERIALIZED (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM s WHERE c < {CENTROIDS})"""]
    assign = """d{k} AS MATERIALIZED (SELECT x.r, c.c, sum((x.x - c.x) * (x.x - c.x))::BIGINT AS d FROM x JOIN c{k} c USING (i) GROUP BY ALL),
a{k} AS MATERIALIZED (SELECT r, arg_min(c, [d, c]) AS c, min(d) AS d FROM d{k} GROUP BY r)"""
    move = """n{k} AS MATERIALIZED (SELECT a.c, x.i, sum(x.x)::BIGINT AS s, count(*) AS n FROM x JOIN a{k} a USING (r) GROUP BY ALL),
c{next} AS MATERIALIZED (SELECT o.c, o.i, CASE WHEN n.n IS NULL THEN o.x ELSE (n.s - ((n.s % n.n) + n.n) % n.n) // n.n END AS x
  FROM c{k} o LEFT JOIN n{k} n USING (c, i))"""
    for k in range(ROUNDS):
        parts += [assign.format(k=k), move.format(k=k, next=k + 1)]
    parts.append(assign.format(k=ROUNDS))
    last = f"""h AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS h FROM c{ROUNDS} GROUP BY c)
SELECT kept.vec_id, a.c::INTEGER AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia,
       (sum(a.d) OVER ())::BIGINT AS inertia, h.h AS centroid_sha256
FROM a{ROUNDS} a JOIN kept USING (r) JOIN h ON h.c = a.c"""
    return ",\n".join([*parts, last])


@query("op11_va_file", _cluster_sql())
def op11_va_file(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    assigned, centroids = va_file.cluster_vectors(vectors, CENTROIDS, ROUNDS, CLUSTER_SEED, DIMS)
    return va_file.with_inertia(assigned, centroids).select(
        "row.vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


@query("op12_pii")
def op12_pii(spark, sf_dir):
    found = pii.find_personal_data(documents(spark, sf_dir))
    return found.select(
        "row.doc_id",
        *[f"n_{k}" for k in pii.KINDS],
        F.sha2(pii.listed({k: F.col(f"{k}_base") for k in pii.KINDS}), 256).alias("base_sha256"),
        pii.listed({k: F.col(k) for k in pii.KINDS}).alias("spans"),
    )


@query("op13_whitening")
def op13_whitening(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    model = whitening.fit_whitening(vectors)
    rows = staged(whitening.whiten(vectors, model), "whitened")
    found = 0 if model is None else len(model.directions)
    total = float(model.values.sum()) if found else 1.0
    share = F.array(*[F.lit(float(e) / total) for e in model.values[:found]]) if found else F.array(F.lit(0.0))
    error = whitening.identity_error(rows, found)
    flat = rows.select("row.vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return flat.select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(0 if model is None else model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(share, F.col("at")).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )

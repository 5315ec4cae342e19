"""The operators as registered queries over the tables of a folder, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontamination, hard_negatives, langid, media, mixing, ngram_join, outliers, packing, quality_nbsvm, resampling, token_counts, toxicity, url_filter
from quarry.llm.common import fold, table

VOCABULARY = "word_bpe_49k.json"
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
WEIGHTS, EPOCHS, SEED = [5, 2, 1], 3, 13


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary())


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), fold("doc_id", 5) == 0
    model = quality_nbsvm.learn_quality(docs, table(spark, sf_dir, "labels"), ~held)
    return quality_nbsvm.score_quality(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list stands in for a given one: the canonical forms of the pages' own URLs whose md5 starts with 0 and a digit under 8."""
    pages = table(spark, sf_dir, "pages")
    key = url_filter.canonical(url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url")))
    listed = pages.select(key.alias("k"), url_filter.host_of(F.col("url")).alias("h")).where((F.col("h") != "") & (F.substring(F.md5(F.col("k").cast("binary")), 1, 2) < "08")).select("k")
    return url_filter.judge_urls(pages, listed, RULES)


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(table(spark, sf_dir, "documents"), WEIGHTS, EPOCHS, SEED)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), fold("doc_id", 5) == 0
    profiles = langid.learn_profiles(docs, ~held)
    return langid.identify(docs, profiles).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(table(spark, sf_dir, "documents"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), fold("doc_id", 4) == 2
    net = toxicity.learn_toxicity(docs, table(spark, sf_dir, "labels"), ~held)
    return toxicity.score_toxicity(docs, net).select("doc_id", held.alias("held_out"), "score", "predicted")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary())


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.quality_rules(table(spark, sf_dir, "documents"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), longest=1, buckets=10_000, seed=2024, least_words=20, percent=10)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh vector's label is the next one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("id") % 50 == 0)


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_quality_classifier, op3_url_filter, op4_mix_sources, op5_language_id, op6_media_columns, op7_ngram_jaccard, op8_toxicity, op9_token_counts, op10_quality_rules, op11_importance_resampling, op12_hard_negatives, op13_decontamination, pipeline)}

#: Words of a text as op11 and op13 take them.
WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL = {
    "op3_url_filter": r"""
WITH parts AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), keyed AS (
  SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '(/|\.html)$', '') END AS k FROM parts
), listed AS (
  SELECT DISTINCT k FROM keyed WHERE k IS NOT NULL AND substr(md5(k), 1, 2) < '08'
), ruled AS (
  SELECT keyed.*, listed.k IS NOT NULL AS in_list,
    CASE WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
         WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
         WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
         WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
         WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM keyed LEFT JOIN listed ON keyed.k = listed.k
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN in_list THEN 'block' ELSE 'allow' END AS verdict,
  rule IS NULL AND in_list AS listed
FROM ruled
""",
    "op4_mix_sources": rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':{SEED}:' || coalesce(text, '')), 1, 15))::BIGINT AS o
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, (CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::DOUBLE AS w, source_size * {EPOCHS}::DOUBLE AS cap FROM s
), r AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS rate
  FROM w WINDOW b AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, least(cap, coalesce(w * (SELECT max(rate) FROM r WHERE cap / w >= rate), cap)) AS target FROM r
), p AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t
), q AS (
  SELECT source, o, sum(size)::BIGINT AS s FROM d GROUP BY source, o
), c AS (
  SELECT source, o, s, sum(s) OVER (PARTITION BY source ORDER BY o ROWS UNBOUNDED PRECEDING)::DOUBLE AS upto FROM q
), cut AS (
  SELECT p.source, max(c.o) AS last FROM p JOIN c ON c.source IS NOT DISTINCT FROM p.source
  WHERE upto - s / 2.0::DOUBLE <= target - whole * source_size AND target - whole * source_size > 0 GROUP BY p.source
)
SELECT d.doc_id, d.size, p.source_size, p.target, (d.size * (whole + CASE WHEN d.o <= cut.last THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source LEFT JOIN cut ON cut.source IS NOT DISTINCT FROM d.source
""",
    "op11_importance_resampling": rf"""
WITH bytes AS (
  SELECT list(c ORDER BY b) AS crcs FROM (SELECT b, list_reduce(list_prepend(b::BIGINT, range(8)::BIGINT[]), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) AS c FROM range(256) AS r(b))
), d AS (
  SELECT doc_id, {WORDS} AS w FROM documents
), dw AS (
  SELECT unnest(w) AS w FROM d
), bw AS (
  SELECT unnest({WORDS}) AS w FROM benchmark
), vocabulary AS (
  SELECT DISTINCT w, hex(encode(w)) AS h FROM (SELECT w FROM dw UNION SELECT w FROM bw)
), bucketed AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, (2 * i + 1)::BIGINT, 2))::BIGINT)), lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) % 10000 AS bucket
  FROM vocabulary, bytes
), s AS (
  SELECT bucket, count(*) AS n FROM dw JOIN bucketed USING (w) GROUP BY bucket
), t AS (
  SELECT bucket, count(*) AS n FROM bw JOIN bucketed USING (w) GROUP BY bucket
), gain AS (
  SELECT bucket, floor(1000 * ln(((coalesce(t.n, 0) + 1) * ((SELECT coalesce(sum(n), 0) FROM s) + 10000))::DOUBLE / ((s.n + 1) * ((SELECT coalesce(sum(n), 0) FROM t) + 10000))::DOUBLE))::BIGINT AS g
  FROM s LEFT JOIN t USING (bucket)
), numbered AS (
  SELECT row_number() OVER () AS r, doc_id, w FROM d
), weighed AS (
  SELECT r, sum(g)::BIGINT AS weight FROM (SELECT r, unnest(w) AS w FROM numbered) JOIN bucketed USING (w) JOIN gain USING (bucket) GROUP BY r
), scored AS (
  SELECT r, doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
  FROM numbered LEFT JOIN weighed USING (r)
), placed AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST, n_features) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM scored LEFT JOIN placed USING (r)
""",
    "op12_hard_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS alike, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id))::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT alike AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
""",
    "op13_decontamination": rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents
), b AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, {WORDS} AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item, list_slice(w, k, k + least(10, len(w)) - 1) AS x, least(10, len(w)) AS m
  FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM b WHERE len(w) > 0)
), places AS (
  SELECT r, k, m, list_slice(w, k, k + m - 1) AS x
  FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM d CROSS JOIN (SELECT DISTINCT m FROM windows))
), found AS (
  SELECT DISTINCT r, k, m, item FROM places JOIN windows USING (x, m)
), hit AS (
  SELECT r, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT r, unnest(range(k, k + m)) AS p FROM (SELECT DISTINCT r, k, m FROM found)) GROUP BY r
), items AS (
  SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM found GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
""",
}

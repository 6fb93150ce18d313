"""One query for each operator, over its whole table, and the same in DuckDB's SQL where that can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from . import exact_dedup, media, mixing, pii_surrogates, secret_forest, sentencepiece_topk, simhash, toxicity, url_filter, warc


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_topk.encode(table(spark, sf_dir, "documents"), k=2)


#: The contract's rules; longer ones win.
DOMAIN_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
#: What the method itself blocks where no rule fits: globs over host and path.
GLOBS = ["*casino*/**", "*spam-farm*/**", "*adult*/**", "*free-bets*/**", "*casino*", "*spam-farm*", "*adult*", "*free-bets*"]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [url_filter.domain_rule(r, v) for r, v in DOMAIN_RULES] + [url_filter.Rule(g, g, "block", 0) for g in GLOBS]
    out = url_filter.judge_urls(table(spark, sf_dir, "pages"), rules)
    return out.withColumn("rule", F.when(~F.col("rule").isin(GLOBS), F.col("rule")))


OP2_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN url IS NULL OR position('://' IN url) = 0 THEN NULL ELSE substr(url, position('://' IN url) + 3) END AS rest FROM pages
), p AS (
  SELECT page_id, translate(coalesce(regexp_extract(rest, '^[^/?#]*'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*'), '') AS path FROM u
), r(rule, rhost, rpath, verdict) AS (
  VALUES ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'), ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')
), f AS (
  SELECT p.page_id, p.host, p.path, r.rule, r.verdict FROM p LEFT JOIN r ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath)
), b AS (
  SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM f GROUP BY page_id, host, path
)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN regexp_matches(host, 'casino|spam-farm|adult|free-bets') THEN 'block' ELSE 'allow' END) AS verdict FROM b
"""


#: The setting that holds the secret key of surrogates; without it the query uses a key for demonstration, which hides nothing.
SURROGATE_KEY, DEMONSTRATION = "spark.folioscope.surrogates.key", "not a secret"


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = spark.conf.get(SURROGATE_KEY, None) or DEMONSTRATION
    return pii_surrogates.pseudonymise(table(spark, sf_dir, "documents"), key).select("doc_id", "text", "pii_count", "pii_kinds")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS size, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS h FROM documents),
w AS (SELECT *, first_value(doc_id) OVER (PARTITION BY h ORDER BY size DESC, doc_id NULLS LAST) AS keep_id, count(*) OVER (PARTITION BY h) AS n,
  row_number() OVER (PARTITION BY h ORDER BY size DESC, doc_id NULLS LAST) AS k FROM d)
SELECT doc_id, keep_id, n AS group_size, k = 1 AS kept, h AS text_sha256 FROM w
"""


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = media.text_media(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "bits")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives, folder = warc.archive_pages(table(spark, sf_dir, "pages"))
    out = warc.read_archives(archives, folder)
    return out.select(F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


OP7_SQL = r"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
w AS (SELECT *, max(page_id) OVER (PARTITION BY h, n) AS last FROM p)
SELECT page_id, n AS payload_bytes, h AS payload_digest, CASE WHEN n >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> last THEN last END AS refers_to FROM w
"""


def op8_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source stands for the path of the file a document came from."""
    out = secret_forest.scan(table(spark, sf_dir, "documents"), path_col="source")
    return out.select("doc_id", "nth", "start", "length", "rule", F.sha2("value", 256).alias("value_sha256"), "score", "is_secret")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan_mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP9_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS z FROM d GROUP BY source),
r AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY 2 * z::DOUBLE / w, source NULLS LAST) AS k FROM r),
c AS (SELECT *, (coalesce(sum(z) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS before, (sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS open, (sum(z) OVER ())::BIGINT AS total FROM o),
f AS (SELECT (3 * total - 4 * before)::BIGINT AS over, (2 * open)::BIGINT AS under FROM c WHERE w * (3 * total - 4 * before) <= 2 * z * 2 * open ORDER BY k LIMIT 1),
t AS (SELECT source, z, CASE WHEN r.w * f.over > 2 * r.z * f.under THEN (2 * z)::DOUBLE ELSE (r.w * f.over)::DOUBLE / f.under::DOUBLE END AS target FROM r, f),
m AS (SELECT d.doc_id, d.size, t.z AS source_size, t.target, CASE WHEN t.z > 0 THEN least(t.target / t.z::DOUBLE, 2.0::DOUBLE) ELSE 0.0::DOUBLE END AS rate,
  ('0x' || substr(sha256('mix:' || coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS draw FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, size * (floor(rate)::BIGINT + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS taken FROM m
"""

def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_url_filter, op3_pii_surrogates, op4_exact_dedup, op5_simhash, op6_media, op7_warc, op8_secret_forest, op9_mixing, op10_toxicity)}
SQL = {"op2_url_filter": OP2_SQL, "op4_exact_dedup": OP4_SQL, "op7_warc": OP7_SQL, "op9_mixing": OP9_SQL}

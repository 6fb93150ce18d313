"""Queries over the corpus catalogue, each with its equivalent for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids as I  # noqa: E741
from ..functions import numeric as N
from ..functions import text as T
from ..operators import aggregate as A
from ..operators import catalog as C
from ..sources.tables import CATALOGUE_SQL, FEATURES, TAGGER, UNDETECTABLE, catalogue, license_of, places, table
from .base import registry

QUERIES, SQL, query = registry()


CORPUS = f"WITH {CATALOGUE_SQL} "
SHARE = "CASE WHEN {t} = 0 THEN '–' ELSE (({n} * 1000 + {t} // 2) // {t} // 10)::BIGINT || '.' || (({n} * 1000 + {t} // 2) // {t} % 10)::BIGINT || '%' END"


def share_sql(source: str, key: str, name: str) -> str:
    share = SHARE.format(n="documents", t="total")
    return f"{source}, g AS (SELECT {key} AS {name}, count(*) AS documents FROM corpus GROUP BY 1), t AS (SELECT sum(documents)::BIGINT AS total FROM g) SELECT {name}, documents, {share} AS share FROM g, t"


@query(CORPUS + "SELECT count(*) AS documents, count(features) AS tagged, count(features) AS tagged_current, sum(size)::BIGINT AS total_size, ((sum(size)::BIGINT * 10 + 524288) // 1048576 // 10)::BIGINT || '.' || ((sum(size)::BIGINT * 10 + 524288) // 1048576 % 10)::BIGINT || ' MiB' AS total_text FROM corpus")
def corpus_totals(spark: SparkSession, sf: str) -> DataFrame:
    """A1: documents, tagged, tagged by the current version, total size (saturating)."""
    corpus = catalogue(spark, sf).withColumn("tagger", F.lit(TAGGER))
    out = corpus.agg(F.count("*").alias("documents"), F.count("features").alias("tagged"), F.count_if((F.col("tagger") == TAGGER) & F.col("features").isNotNull()).alias("tagged_current"), F.sum("size").alias("total_size"))
    return out.withColumn("total_text", N.mebibytes(F.col("total_size")))


@query(share_sql(CORPUS.rstrip(), "source", "name"))
def freq_by_source(spark: SparkSession, sf: str) -> DataFrame:
    """Documents by first source, with their share, most first. The flagship."""
    return A.counts(catalogue(spark, sf), F.col("first.source"))


@query(share_sql(CORPUS.rstrip(), "tier", "name"))
def freq_by_tier(spark: SparkSession, sf: str) -> DataFrame:
    return A.counts(catalogue(spark, sf), F.col("tier"))


@query(share_sql(CORPUS.rstrip(), "license", "name"))
def freq_by_license(spark: SparkSession, sf: str) -> DataFrame:
    return A.counts(catalogue(spark, sf), F.col("license"))


@query(share_sql(CORPUS.rstrip(), "lang", "name"))
def freq_by_lang_share(spark: SparkSession, sf: str) -> DataFrame:
    return A.counts(catalogue(spark, sf), F.col("lang"))


@query("WITH corpus AS (SELECT coalesce(nullif(regexp_extract(props, '\"mode\": ?([0-9]+)', 1), ''), '12 (no setting)') AS mode FROM events), g AS (SELECT mode AS name, count(*) AS documents FROM corpus GROUP BY 1), t AS (SELECT sum(documents)::BIGINT AS total FROM g) SELECT name, documents, " + SHARE.format(n="documents", t="total") + " AS share FROM g, t")
def freq_by_mode(spark: SparkSession, sf: str) -> DataFrame:
    """A5: an unset mode is counted under a label of its own."""
    mode = F.regexp_extract("props", '"mode": ?([0-9]+)', 1)
    return A.counts(table(spark, sf, "events"), F.when(mode == "", "12 (no setting)").otherwise(mode))


@query(CORPUS + "SELECT f AS name, count(*) AS documents FROM (SELECT unnest(features) AS f FROM corpus) GROUP BY 1")
def feature_counts(spark: SparkSession, sf: str) -> DataFrame:
    """A3: documents by each feature they have."""
    return catalogue(spark, sf).select(F.explode("features").alias("name")).groupBy("name").agg(F.count("*").alias("documents"))


NAMES = sorted([*FEATURES, *UNDETECTABLE, "Unicorns"])


@query(CORPUS + f", names AS (SELECT unnest({NAMES!r}) AS name), g AS (SELECT f AS name, count(*) AS documents FROM (SELECT unnest(features) AS f FROM corpus) GROUP BY 1) SELECT name, CASE WHEN name IN {UNDETECTABLE!r} THEN NULL ELSE coalesce(documents, 0) END AS documents FROM names LEFT JOIN g USING (name)")
def feature_counts_zero_filled(spark: SparkSession, sf: str) -> DataFrame:
    """Every known feature is listed, with zero where none was found and null where none can be."""
    names = spark.range(1).select(F.explode(F.array(*(F.lit(n) for n in NAMES))).alias("name"))
    return A.zero_filled(feature_counts(spark, sf), names, UNDETECTABLE)


SCRIPT_SQL = ", ".join(f"('{s}', len(regexp_extract_all(text, '\\p{{{s}}}')))" for s in ("Latin", "Greek", "Cyrillic", "Han", "Arabic", "Hebrew"))


@query("WITH m AS (SELECT sha256(text) AS h, any_value(text) AS text FROM documents GROUP BY 1), s AS (SELECT m.h, v.name, v.n FROM m, LATERAL (VALUES " + SCRIPT_SQL + ") AS v(name, n)) SELECT name, count(*) AS documents, sum(n)::BIGINT AS characters FROM s WHERE n > 0 GROUP BY name")
def script_counts(spark: SparkSession, sf: str) -> DataFrame:
    """A4, J11, St13, T2: documents and characters by script."""
    # equal texts have equal counts: these are shuffled, not the texts
    docs = table(spark, sf, "documents").select(F.sha2("text", 256).alias("h"), T.script_counts(F.col("text")).alias("m"))
    counted = docs.groupBy("h").agg(F.first("m").alias("m")).select(F.explode("m").alias("name", "n"))
    return counted.groupBy("name").agg(F.count("*").alias("documents"), F.sum("n").alias("characters")).orderBy(F.desc("documents"), "name")


@query(CORPUS + "SELECT sha256, size, tier, license FROM corpus WHERE list_contains(features, 'Tables') AND len(list_filter(places, lambda p: p.source = 'src1')) > 0")
def list_filter(spark: SparkSession, sf: str) -> DataFrame:
    """documents with a feature and from a source."""
    return C.list_documents(catalogue(spark, sf), feature="Tables", source="src1", known=list(FEATURES), places=places(spark, sf)).select("sha256", "size", "tier", "license")


@query(CORPUS + "SELECT sha256, CASE WHEN tier <> 'T2' THEN source || ':docs/' || places[1].doc_id || '.txt' END AS name FROM corpus")
def public_name(spark: SparkSession, sf: str) -> DataFrame:
    """names of public documents, none of private ones."""
    return catalogue(spark, sf).select("sha256", C.public_name(F.col("tier"), F.col("first")).alias("name"))


@query(CORPUS + "SELECT sha256 FROM corpus WHERE len(places) % 2 = 0 OR size % 5 = 0")
def retag_predicate(spark: SparkSession, sf: str) -> DataFrame:
    """documents without a scan, or with one of another version (stand-ins: an even number of places; a size divisible by five)."""
    tagger = F.when(F.col("places") % 2 != 0, F.when(F.col("size") % 5 == 0, F.lit(TAGGER - 1)).otherwise(F.lit(TAGGER)))
    return C.to_retag(catalogue(spark, sf).withColumn("tagger", tagger), TAGGER).select("sha256")


@query(CORPUS + "SELECT count(*) AS documents FROM corpus WHERE tier <> 'T2'")
def public_tier_guard(spark: SparkSession, sf: str) -> DataFrame:
    """statistics of public documents fail if a private one slips in; here they are filtered before the guard."""
    return C.only_public(catalogue(spark, sf).where("tier <> 'T2'")).agg(F.count("*").alias("documents"))


@query("WITH d AS (SELECT DISTINCT o_custkey AS k FROM orders) SELECT sha256(k::VARCHAR) AS sha256, CASE WHEN k % 5 = 0 THEN 'missing' WHEN k % 7 = 0 THEN 'invalid' ELSE 'present' END AS reference, CASE WHEN k % 3 = 0 THEN 'missing' WHEN k % 11 = 0 THEN 'invalid' ELSE 'present' END AS candidate FROM d")
def availability_join(spark: SparkSession, sf: str) -> DataFrame:
    """Both sides of each document present, missing or invalid."""
    docs = table(spark, sf, "orders").select(F.col("o_custkey").alias("k")).distinct().withColumn("sha256", F.sha2(F.col("k").cast("string"), 256))
    side = lambda gap, bad: docs.where(F.col("k") % gap != 0).select("sha256", (F.col("k") % bad != 0).alias("valid"))
    return C.availability(docs.select("sha256"), side(5, 7), side(3, 11))


@query("WITH x AS (SELECT DISTINCT d.doc_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)) SELECT doc_id, source FROM documents SEMI JOIN x USING (doc_id)")
def exclusion_semi(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold a benchmark passage, the stand-in of the exclusion list."""
    docs, bench = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    return C.excluded(docs.select(F.col("doc_id").alias("sha256"), "source"), held_passages(docs, bench)).withColumnRenamed("sha256", "doc_id")


@query("WITH x AS (SELECT DISTINCT d.doc_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)) SELECT doc_id, source FROM documents ANTI JOIN x USING (doc_id)")
def exclusion_anti(spark: SparkSession, sf: str) -> DataFrame:
    docs, bench = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    return C.admitted(docs.select(F.col("doc_id").alias("sha256"), "source"), held_passages(docs, bench)).withColumnRenamed("sha256", "doc_id")


def held_passages(docs: DataFrame, bench: DataFrame) -> DataFrame:
    return C.holding(docs, bench).withColumnRenamed("doc_id", "sha256")


@query(CORPUS + """, src AS (SELECT DISTINCT source AS name, ['Apache-2.0', 'MIT', 'CC0-1.0', 'CC-BY-4.0'][(regexp_extract(source, '([0-9]+)$', 1)::INT % 4) + 1] AS license FROM documents WHERE source <> 'src13'),
p AS (SELECT sha256, tier, license, generate_subscripts(places, 1) AS pos, unnest(places) AS place FROM corpus)
SELECT sha256, 'source not defined' AS rule FROM (SELECT DISTINCT sha256 FROM p WHERE place.source NOT IN (SELECT name FROM src))
UNION ALL SELECT sha256, 'license differs from source' FROM p JOIN src ON place.source = src.name WHERE pos = 1 AND tier <> 'T2' AND src.license <> p.license
UNION ALL SELECT sha256, 'provenance twice' FROM corpus WHERE tier = 'T2' AND len(list_distinct(list_transform(places, lambda x: x.source))) < len(places)""")
def source_license_check(spark: SparkSession, sf: str) -> DataFrame:
    """Rules that documents of the catalogue break; one source is left undefined on purpose."""
    sources = table(spark, sf, "documents").select(F.col("source").alias("name")).distinct().where("name <> 'src13'")
    return C.violations(catalogue(spark, sf), places(spark, sf), sources.withColumn("license", license_of(F.col("name"))))


@query("SELECT s_name AS name, unnest(list_filter([CASE WHEN s_suppkey % 2 = 0 THEN 'name' END, CASE WHEN s_suppkey % 3 = 0 THEN 'url' END, CASE WHEN s_suppkey % 5 = 0 THEN 'no revision' END, CASE WHEN s_suppkey % 7 = 0 THEN 'license' END, CASE WHEN s_suppkey % 11 = 0 THEN 'no copyright' END, CASE WHEN s_suppkey % 13 = 0 THEN 'no license text' END], lambda x: x IS NOT NULL)) AS rule FROM (SELECT *, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE 'supplier-' || s_suppkey END AS n FROM supplier) t(s_suppkey, old, s_nationkey, s_acctbal, s_name)")
def source_rules(spark: SparkSession, sf: str) -> DataFrame:
    """V1: rules that sources of a manifest break. Stand-in: suppliers, each fault by a remainder of the key."""
    k = F.col("s_suppkey")
    texts = F.array(F.struct(F.lit("LICENSE").alias("path"), F.lit("0").alias("sha256")))
    rows = table(spark, sf, "supplier").select(
        F.when(k % 2 == 0, F.col("s_name")).otherwise(F.concat(F.lit("supplier-"), k.cast("string"))).alias("name"), F.when(k % 3 == 0, "http://x.org").otherwise("https://x.org").alias("url"), F.when(k % 5 == 0, " ").otherwise("r1").alias("revision"),
        F.when(k % 7 == 0, "Other").otherwise("MIT").alias("license"), F.when(k % 11 != 0, "c").alias("copyright"), F.when(k % 13 != 0, texts).alias("license_texts"), F.lit(None).cast("string").alias("notes"),
    )
    return C.source_violations(rows)


@query("SELECT sha256(text) AS sha256, strlen(any_value(text))::BIGINT AS size, arg_min(source, doc_id) AS source, count(*) AS places FROM documents GROUP BY 1")
def dedup_by_hash(spark: SparkSession, sf: str) -> DataFrame:
    """One document for each content, places appended in order of arrival."""
    docs = table(spark, sf, "documents")
    rows = docs.select(F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("size"), "source", F.concat(F.lit("docs/"), F.col("doc_id").cast("string")).alias("path"), F.col("doc_id").alias("seq"))
    return C.deduplicate(rows)[0]


@query("""WITH i AS (SELECT doc_id AS seq, sha256(text) AS h, source, CASE WHEN doc_id % 97 = 0 THEN '../x' ELSE 'p/' || doc_id % 1000 END AS path, CASE WHEN doc_id % 10 = 0 THEN 'T3' ELSE 'T1' END AS tier, doc_id % 89 <> 0 AS readable, doc_id % 31 <> 0 AS scannable FROM documents),
x AS (SELECT DISTINCT h FROM i WHERE seq % 53 = 0), c AS (SELECT h, 'T1' AS tier, source, path FROM i WHERE seq % 4 = 0 AND seq % 97 <> 0),
kt AS (SELECT h, min(tier) AS kt FROM c GROUP BY h), pl AS (SELECT source, path, min(h) AS ph FROM c GROUP BY source, path), hd AS (SELECT h, min(seq) AS s0, arg_min(tier, seq) AS t0 FROM i GROUP BY h)
SELECT decision, count(*) AS n FROM (SELECT CASE WHEN path = '../x' THEN 'bad_path' WHEN NOT readable THEN 'unreadable' WHEN x.h IS NOT NULL THEN 'excluded' WHEN ph <> i.h THEN 'path_conflict'
 WHEN coalesce(kt, CASE WHEN seq > s0 THEN t0 END) <> i.tier THEN 'tier_conflict' WHEN coalesce(kt, CASE WHEN seq > s0 THEN t0 END) IS NOT NULL THEN 'known' WHEN NOT scannable THEN 'scan_refused' ELSE 'added' END AS decision
 FROM i LEFT JOIN x USING (h) LEFT JOIN kt USING (h) LEFT JOIN pl USING (source, path) JOIN hd USING (h)) GROUP BY decision""")
def ingest_decision(spark: SparkSession, sf: str) -> DataFrame:
    """V4: each incoming file's decision, the first rule that applies, counted."""
    docs, i = table(spark, sf, "documents"), F.col("doc_id")
    incoming = docs.select(i.alias("seq"), F.sha2("text", 256).alias("sha256"), "source", F.when(i % 97 == 0, "../x").otherwise(F.concat(F.lit("p/"), (i % 1000).cast("string"))).alias("path"), F.when(i % 10 == 0, "T3").otherwise("T1").alias("tier"), (i % 89 != 0).alias("readable"), (i % 31 != 0).alias("scannable"))
    corpus = incoming.where("seq % 4 = 0 and seq % 97 <> 0").select("sha256", F.lit("T1").alias("tier"), "source", "path")
    return C.ingest(incoming, corpus, incoming.where("seq % 53 = 0")).groupBy("decision").agg(F.count("*").alias("n"))


@query("WITH a AS (SELECT DISTINCT 'objects/' || substr(sha256(text), 1, 2) || '/' || substr(sha256(text), 3, 62) AS path, min(doc_id) AS k FROM documents GROUP BY 1) SELECT path, CASE WHEN k % 3 = 0 THEN 'missing' ELSE 'unexpected' END AS problem FROM a WHERE (k % 3 = 0) <> (k % 5 = 0)")
def store_listing_difference(spark: SparkSession, sf: str) -> DataFrame:
    """Objects that should be in the store and are not, and the reverse."""
    keys = table(spark, sf, "documents").groupBy(I.object_key(F.sha2("text", 256)).alias("path")).agg(F.min("doc_id").alias("k"))
    return C.listing_difference(keys.where("k % 3 = 0"), keys.where("k % 5 = 0"))


@query(CORPUS + "SELECT sha256, 'license' AS rule FROM corpus WHERE tier <> 'T2' AND size % 3 = 0 EXCEPT ALL SELECT sha256, 'license' FROM corpus WHERE tier <> 'T2' AND size % 6 = 0")
def new_problems(spark: SparkSession, sf: str) -> DataFrame:
    """Problems that a change would bring and that were not there before."""
    corpus = catalogue(spark, sf).where("tier <> 'T2'")
    mark = lambda n: corpus.where(F.col("size") % n == 0).select("sha256", F.lit("license").alias("rule"))
    return C.new_problems(mark(6), mark(3))


@query(CORPUS + "SELECT to_json({'sha256': sha256, 'size': size, 'tier': tier}) AS line FROM corpus")
def document_lines(spark: SparkSession, sf: str) -> DataFrame:
    """K2: the catalogue as JSON lines."""
    return catalogue(spark, sf).select(F.to_json(F.struct("sha256", "size", "tier")).alias("line"))

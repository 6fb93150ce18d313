"""The tables of a data folder, and the corpus catalogue that the queries derive from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Tables of long texts, on whose rows most of the work is done where they are read.
TEXTS = ("documents", "pages", "conversations")


def spread(rows: DataFrame) -> DataFrame:
    """rows over as many partitions as there are cores, if a file of one row group would keep all but one idle; else as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows._jdf.queryExecution().toRdd().getNumPartitions() < min(cores, 64) else rows


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread(rows) if name in TEXTS else rows


#: Content features of a text, by pattern: what a tagger of packages finds in markup, a text shows by its characters.
FEATURES = {
    "Bullets": r"(?:^|\n)[*-] ",
    "Emphasis": "!!",
    "Fields": r"[A-Za-z_]+ = \"",
    "Links": "https?://",
    "Mail": r"[A-Za-z0-9._-]+@[A-Za-z0-9.-]+[.][a-z]+",
    "Noise": "(?:%%%|&&&|[$]{3}|###)",
    "Numbers": "[0-9]{4,}",
    "Rights": r"(?:Copyright|All rights reserved|License)",
    "Tables": r" [|] ",
}
#: Features that no scan can detect; statistics show them as unknown, not as zero.
UNDETECTABLE = ("Handwriting", "Watermarks")
LICENSES = ("Apache-2.0", "MIT", "CC0-1.0", "CC-BY-4.0")
PRIVATE_LICENSE = "NOASSERTION"
TAGGER = 3


def license_of(source):
    """A source's licence, by its number."""
    n = F.coalesce(F.regexp_extract(source, "([0-9]+)$", 1).try_cast("int"), F.lit(0))
    return F.element_at(F.array(*(F.lit(x) for x in LICENSES)), F.pmod(n, F.lit(len(LICENSES))) + 1)


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    """documents with sha256, the text's digest, and toxic, the greatest of the row's labels."""
    labels = table(spark, folder, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return table(spark, folder, "documents").join(labels, "doc_id", "left").withColumn("sha256", F.sha2("text", 256))


def place_path(private, ident):
    return F.when(~private, F.concat(F.lit("docs/"), ident.cast("string"), F.lit(".txt")))


def catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each distinct text: sha256, size, tier, license, first, places, features, lang.

    Identity is the text's digest; first is the place (source, path) that came first (doc_id) and decides the licence, places their
    number. The places themselves are rows (see places), so a text of any number of copies is one narrow row, combined map-side.
    A text labelled toxic is private (T2), one labelled otherwise T1, the rest T0.
    """
    tags = F.array(*(F.when(F.col("text").rlike(p), F.lit(n)) for n, p in FEATURES.items()))
    out = labelled(spark, folder).groupBy("sha256").agg(
        F.max(F.octet_length("text")).cast("long").alias("size"),
        F.max("toxic").alias("toxic"),
        F.min(F.struct("doc_id", "source")).alias("head"),
        F.count("*").alias("places"),
        F.first(F.array_compact(tags)).alias("features"),  # equal texts have equal features
        F.min("lang").alias("lang"),
    )
    tier = F.when(F.col("toxic") == 1, F.lit("T2")).when(F.col("toxic") == 0, F.lit("T1")).otherwise(F.lit("T0"))
    private = F.col("tier") == "T2"
    first = F.struct(F.col("head.source").alias("source"), place_path(private, F.col("head.doc_id")).alias("path"))
    license = F.when(private, F.lit(PRIVATE_LICENSE)).otherwise(license_of(F.col("head.source")))
    return out.withColumn("tier", tier).select("sha256", "size", "tier", license.alias("license"), first.alias("first"), "places", "features", "lang")


def places(spark: SparkSession, folder: str) -> DataFrame:
    """(sha256, at, source, path): where each text of the catalogue came from, a row a place, ordered by at; private ones have no path."""
    rows = labelled(spark, folder)
    private = rows.where("toxic = 1").select("sha256", F.lit(True).alias("private")).distinct()
    out = rows.join(private, "sha256", "left")
    return out.select("sha256", F.col("doc_id").alias("at"), "source", place_path(F.coalesce("private", F.lit(False)), F.col("doc_id")).alias("path"))


#: The same in DuckDB's SQL.
CATALOGUE_SQL = (
    "cat AS (SELECT sha256(text) AS sha256, max(strlen(text))::BIGINT AS size, max(toxic) AS toxic, list({'doc_id': doc_id, 'source': source} ORDER BY doc_id) AS places, "
    + "list_filter(["
    + ", ".join(f"max(CASE WHEN regexp_matches(text, '{p}') THEN '{n}' END)" for n, p in FEATURES.items())
    + "], lambda x: x IS NOT NULL) AS features, min(lang) AS lang FROM documents LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id) USING (doc_id) GROUP BY sha256(text)), "
    + "corpus AS (SELECT sha256, size, CASE WHEN toxic = 1 THEN 'T2' WHEN toxic = 0 THEN 'T1' ELSE 'T0' END AS tier, "
    + "CASE WHEN toxic = 1 THEN 'NOASSERTION' ELSE ['Apache-2.0', 'MIT', 'CC0-1.0', 'CC-BY-4.0'][(regexp_extract(places[1].source, '([0-9]+)$', 1)::INT % 4) + 1] END AS license, "
    + "places, features, lang, places[1].source AS source FROM cat)"
)

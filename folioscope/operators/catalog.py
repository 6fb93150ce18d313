"""Operators over a corpus catalogue: filters, names, exclusions, integrity, ingest."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

PUBLIC_LICENSES = ("Apache-2.0", "MIT", "BSD-3-Clause", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "Unlicense")


def places_of(corpus: DataFrame) -> DataFrame:
    """(sha256, at, source, path) of a catalogue that holds its places as an array, such as a manifest."""
    return corpus.select("sha256", F.posexplode("provenance").alias("at", "place")).select("sha256", "at", "place.source", "place.path")


def list_documents(corpus: DataFrame, feature: str | None = None, source: str | None = None, font: str | None = None, script: str | None = None, known: Sequence[str] | None = None, places: DataFrame | None = None) -> DataFrame:
    """Rows that satisfy all given conditions; untagged rows (null arrays) satisfy none. Only the feature is checked against the known ones.

    A source is any of a document's places: a semi-join with `places`, or with the corpus' own array of them.
    """
    if feature is not None and known is not None and feature not in known:
        raise ValueError(f"{feature!r} is not a feature")
    out = corpus
    if feature is not None:
        out = out.where(F.array_contains("features", feature))
    if font is not None:
        out = out.where(F.array_contains("fonts", font))
    if script is not None:
        out = out.where(F.map_contains_key("scripts", script))
    if source is not None:
        found = places_of(corpus) if places is None else places
        out = out.join(found.where(F.col("source") == source).select("sha256"), "sha256", "left_semi")
    return out


def public_name(tier: Column, first: Column) -> Column:
    """`source:path` of the first place, the source alone without a path, null for private documents."""
    return F.when(tier != "T2", F.concat_ws(":", T.printable(first["source"], 100), T.printable(first["path"], 300)))


def to_retag(corpus: DataFrame, version: int, everything: bool = False) -> DataFrame:
    """Documents without a scan or with one of another tagger version."""
    return corpus if everything else corpus.where(F.col("tagger").isNull() | (F.col("tagger") != version))


def only_public(corpus: DataFrame) -> DataFrame:
    """corpus, failing when it is computed if a private document is in it."""
    return corpus.where(F.assert_true(F.col("tier") != "T2", F.lit("a private document is in the corpus")).isNull())


def availability(documents: DataFrame, references: DataFrame, candidates: DataFrame) -> DataFrame:
    """documents (sha256) with the state of both sides (sha256, valid): present, missing or invalid. Each side is one equi-join."""
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select("sha256", F.col("valid").alias(f"__{name}"))

    def state(name: str) -> Column:
        v = F.col(f"__{name}")
        return F.when(v.isNull(), F.lit("missing")).when(v, F.lit("present")).otherwise(F.lit("invalid")).alias(name)

    out = documents.join(side(references, "reference"), "sha256", "left").join(side(candidates, "candidate"), "sha256", "left")
    return out.select(*documents.columns, state("reference"), state("candidate"))


def excluded(documents: DataFrame, exclusions: DataFrame) -> DataFrame:
    return documents.join(exclusions.select("sha256"), "sha256", "left_semi")


def admitted(documents: DataFrame, exclusions: DataFrame) -> DataFrame:
    return documents.join(exclusions.select("sha256"), "sha256", "left_anti")


def listing_difference(expected: DataFrame, listed: DataFrame) -> DataFrame:
    """(path, problem) of what a store lacks and of what it should not have."""
    missing = expected.select("path").join(listed.select("path"), "path", "left_anti").withColumn("problem", F.lit("missing"))
    return missing.unionByName(listed.select("path").join(expected.select("path"), "path", "left_anti").withColumn("problem", F.lit("unexpected")))


def deduplicate(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (sha256, size, source, path, seq) into documents and places: (sha256, size, source, places) and (sha256, at, source, path).

    The first place decides the source; all places are kept, as rows, in order of `at`. Copies of any number combine map-side.
    """
    out = rows.groupBy("sha256").agg(F.max("size").alias("size"), F.min(F.struct("seq", "source")).alias("head"), F.count("*").alias("places"))
    return out.select("sha256", "size", F.col("head.source").alias("source"), "places"), rows.select("sha256", F.col("seq").alias("at"), "source", "path")


#: Characters of passages that are searched for in one pass over the texts; further ones take further passes.
PASSAGE_CHARS = 1 << 20


def holding(docs: DataFrame, passages: DataFrame, id_col: str = "doc_id", text_col: str = "text", passage_col: str = "text", chars: int | None = None) -> DataFrame:
    """(id) of each document that contains one of the passages, character by character, each id once.

    The passages, in blocks of about `chars` characters by their hash, become an automaton that finds all of a block in one pass
    over a text, whatever their lengths; whole texts, linear in their length. Null texts hold nothing, null passages are not
    looked for, and an empty passage is held by every text.
    """
    wanted = passages.select(F.col(passage_col).alias("p")).where("p is not null").distinct()
    size = wanted.agg(F.coalesce(F.sum(F.length("p") + 1), F.lit(0))).first()[0]
    blocks = int(size // (PASSAGE_CHARS if chars is None else chars)) + 1
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).where("t is not null")

    def pass_of(block: list[str]) -> DataFrame:
        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
            for p in block:
                if p:
                    automaton.add_word(p)
            automaton.make_automaton()
            every = "" in block
            for batch in batches:
                hit = [every or (len(automaton) > 0 and next(automaton.iter(t), None) is not None) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(hit, pa.bool_()))], ["id"])

        return texts.mapInArrow(find, f"id {kind}")

    out = None
    for n in range(blocks):
        block = [r.p for r in wanted.where(F.pmod(F.xxhash64("p"), F.lit(blocks)) == n).collect()]  # one block of passages at a time
        found = pass_of(block)
        out = found if out is None else out.unionByName(found)
    return out.distinct().withColumnRenamed("id", id_col)


def ingest(incoming: DataFrame, corpus: DataFrame, exclusions: DataFrame) -> DataFrame:
    """incoming (seq, sha256, source, path, tier, readable, scannable) with a decision, the first that applies:

    bad_path, unreadable, excluded, path_conflict (the place is recorded for other content), tier_conflict, known,
    scan_refused, added. corpus has sha256, tier and places as rows (sha256, tier, source, path). Of several new rows with one
    digest the first (seq) is judged as new, later ones against it.
    """
    marks = exclusions.select("sha256", F.lit(True).alias("is_excluded")).distinct()
    tiers = corpus.groupBy("sha256").agg(F.min("tier").alias("known_tier"))
    places = corpus.where("path is not null").groupBy("source", "path").agg(F.min("sha256").alias("place_sha"))
    first = incoming.groupBy("sha256").agg(F.min(F.struct("seq", "tier")).alias("head"))
    rows = incoming.join(marks, "sha256", "left").join(tiers, "sha256", "left").join(places, ["source", "path"], "left").join(first, "sha256")
    later = F.col("seq") > F.col("head.seq")
    known_tier = F.coalesce("known_tier", F.when(later, F.col("head.tier")))
    decision = (
        F.when(F.col("path").isNotNull() & ~T.is_relative_path(F.col("path")), "bad_path")
        .when(~F.col("readable"), "unreadable")
        .when(F.col("is_excluded"), "excluded")
        .when(F.col("place_sha") != F.col("sha256"), "path_conflict")
        .when(known_tier != F.col("tier"), "tier_conflict")
        .when(known_tier.isNotNull(), "known")
        .when(~F.col("scannable"), "scan_refused")
        .otherwise("added")
    )
    return rows.select(*incoming.columns, decision.alias("decision"))


def violations(corpus: DataFrame, places: DataFrame, sources: DataFrame) -> DataFrame:
    """(sha256, rule) for each rule that a document of the catalogue breaks.

    corpus has a row for each document, places (sha256, at, source, path) one for each of its places, sources name and license.
    Places are combined map-side, first by place and then by document, so documents of any number of places are one narrow row.
    """
    def rule(condition: Column, name: str) -> Column:
        return F.when(condition, F.lit(name))

    by_place = places.groupBy("sha256", "source", "path").agg(F.count("*").alias("n"), F.min("at").alias("at"))
    by_doc = by_place.groupBy("sha256").agg(
        (F.max("n") > 1).alias("repeated"),
        F.bool_or(F.col("path").isNotNull()).alias("has_path"),
        F.bool_or(F.coalesce(~T.is_relative_path(F.col("path")), F.lit(False))).alias("bad_path"),
        F.min(F.struct("at", "source"))["source"].alias("first_source"),
    )
    private = F.col("tier") == "T2"
    sorted_ = lambda c: F.coalesce(F.col(c) == F.array_sort(F.array_distinct(c)), F.lit(True))
    joined = corpus.join(by_doc, "sha256", "left").join(sources.select(F.col("name").alias("first_source"), F.col("license").alias("source_license")), "first_source", "left")
    own = joined.select(
        "sha256",
        F.explode(
            F.array_compact(
                F.array(
                    rule(F.col("size") <= 0, "size"),
                    rule(private & (F.col("license") != "NOASSERTION"), "private license"),
                    rule(private & F.col("has_path"), "private path"),
                    rule(~private & ~F.col("license").isin(*PUBLIC_LICENSES), "license"),
                    rule(F.col("repeated").isNull(), "no provenance"),
                    rule(F.col("repeated"), "provenance twice"),
                    rule(F.col("bad_path"), "path"),
                    rule(F.col("features").isNull(), "not tagged"),
                    rule(~sorted_("features"), "features not sorted"),
                    rule(~private & (F.col("source_license") != F.col("license")), "license differs from source"),
                )
            )
        ).alias("rule"),
    )
    named = by_place.select("sha256", "source").distinct().join(sources.select(F.col("name").alias("source")), "source", "left_anti")
    between = named.select("sha256", F.lit("source not defined").alias("rule")).distinct()
    shared = by_place.where("path is not null").groupBy("source", "path").agg(F.min("sha256").alias("a"), F.max("sha256").alias("sha256")).where("a <> sha256").select("sha256", F.lit("path of two documents").alias("rule")).distinct()
    twice = corpus.groupBy("sha256").agg(F.count("*").alias("n")).where("n > 1").select("sha256", F.lit("document twice").alias("rule"))
    return own.unionByName(between).unionByName(shared).unionByName(twice)


def _broken(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule) of each rule whose condition holds; unknown is not broken. One scan."""
    found = F.array_compact(F.array(*(F.when(condition, F.lit(name)) for name, condition in rules.items())))
    return rows.select(key, F.explode(found).alias("rule"))


def source_violations(sources: DataFrame) -> DataFrame:
    """(name, rule) of the sources of a manifest: name, url, revision, license, copyright, license_texts, notes."""
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    named = F.col("license") != "NOASSERTION"
    return _broken(sources, "name", {
        "name": ~T.is_source_name(F.col("name")), "url": ~F.coalesce(F.col("url").startswith("https://"), F.lit(False)), "no revision": blank("revision"), "license": named & ~F.col("license").isin(*PUBLIC_LICENSES),
        "no copyright": named & blank("copyright"), "no license text": named & (F.coalesce(F.size("license_texts"), F.lit(0)) < 1), "license text path": F.exists("license_texts", lambda t: ~T.is_relative_path(t["path"])), "empty notes": F.trim("notes") == "",
    })


def scan_violations(documents: DataFrame, version: int, known: Sequence[str], undetectable: Sequence[str] = ()) -> DataFrame:
    """(sha256, rule) of what a manifest's documents say of their scan (see sources.files.SCAN), ground truth and notes."""
    scan = lambda c: F.col(f"scan.{c}")
    unsorted = lambda c: c != F.array_sort(F.array_distinct(c))
    truth, build = F.col("ground_truth.status"), F.col("ground_truth.word_build")
    return _broken(documents, "sha256", {
        "tagger version": scan("tagger") != version, "unknown feature": F.exists(scan("features"), lambda f: ~f.isin(*known)), "undetectable feature": F.exists(scan("features"), lambda f: f.isin(*undetectable)) if undetectable else F.lit(False),
        **{f"{n} not sorted": unsorted(scan(n)) for n in ("features", "fonts", "languages", "notes")}, "options not sorted": unsorted(scan("compatibility.options")), "script without characters": F.exists(F.map_values(scan("scripts")), lambda n: n <= 0),
        "ground truth build": (truth == "produced") != build.isNotNull(), "empty notes": F.trim("notes") == "",
    })


def new_problems(before: DataFrame, after: DataFrame) -> DataFrame:
    """What a change would break that was not broken before."""
    return after.exceptAll(before)

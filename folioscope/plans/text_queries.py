"""Queries that apply the scalar text, hash, list and map functions to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids as I  # noqa: E741
from ..functions import text as T
from ..operators import inspection
from ..sources.tables import table
from .base import registry

QUERIES, SQL, query = registry()


@query(r"SELECT doc_id, sha256(translate(regexp_replace(text, '[\x09-\x0D\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{061C}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{2069}\x{FEFF}]', '', 'g'), chr(173) || chr(8208) || chr(8209), '---')) AS form FROM documents")
def comparable_form(spark: SparkSession, sf: str) -> DataFrame:
    """St1: the comparable form of each text, as its digest."""
    return table(spark, sf, "documents").select("doc_id", F.sha2(T.comparable(F.col("text")), 256).alias("form"))


@query("SELECT conv_id, turn, len(regexp_extract_all(text, '[^ \\t-\\r]')) AS kept FROM conversations")
def comparable_positions(spark: SparkSession, sf: str) -> DataFrame:
    """St2: how many characters of a turn are compared, each with its place."""
    return table(spark, sf, "conversations").select("conv_id", "turn", F.size(T.comparable_origins(F.col("text"))).cast("long").alias("kept"))


@query(r"SELECT doc_id, regexp_replace(substr(text, 1, 60), '[\x00-\x1F\x7F]', '?', 'g') AS shown FROM documents")
def printable_text(spark: SparkSession, sf: str) -> DataFrame:
    """St3: the start of a text as messages show it."""
    return table(spark, sf, "documents").select("doc_id", T.printable(F.col("text"), 60).alias("shown"))


@query(r"""SELECT page_id, sha256(regexp_replace(html, '([\\`*_\[\]<>|#])', '\\\1', 'g')) AS markdown, sha256(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) AS escaped, sha256(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS xml FROM pages""")
def escapes(spark: SparkSession, sf: str) -> DataFrame:
    """St4, St5, St24."""
    h = F.col("html")
    return table(spark, sf, "pages").select("page_id", F.sha2(T.markdown_escape(h), 256).alias("markdown"), F.sha2(T.html_escape(h), 256).alias("escaped"), F.sha2(T.xml_escape(h), 256).alias("xml"))


@query("SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[^\\x00-\\x7F]', '*', 'g'), '[A-Z]', 'X', 'g'), '[a-z]', 'x', 'g'), '[0-9]', '0', 'g')) AS masked FROM documents")
def mask_text(spark: SparkSession, sf: str) -> DataFrame:
    """St14."""
    return table(spark, sf, "documents").select("doc_id", F.sha2(T.mask(F.col("text")), 256).alias("masked"))


LANGUAGES = "CASE doc_id % 6 WHEN 0 THEN lang WHEN 1 THEN upper(lang) || '-latn-' || lang WHEN 2 THEN ' ' || lang || '-' || lang || ' ' WHEN 3 THEN lang || '-x-' || upper(source) WHEN 4 THEN lang || '--' ELSE lang || '-419' END"


@query(f"""WITH t AS (SELECT doc_id, {LANGUAGES} AS tag, lang FROM documents), c AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN lang WHEN 1 THEN lang || '-Latn-' || upper(lang) WHEN 2 THEN lang || '-' || upper(lang) WHEN 3 THEN lower(tag) WHEN 4 THEN NULL ELSE lang || '-419' END AS canonical FROM t)
SELECT doc_id, canonical, coalesce(regexp_full_match(canonical, 'x-none|[a-z]{{2,3}}(-[A-Za-z]{{4}})?(-([A-Z]{{2}}|[0-9]{{3}}))?'), false) AS simple FROM c""")
def language_canonical(spark: SparkSession, sf: str) -> DataFrame:
    """St6, St7: language tags in their usual case."""
    d = table(spark, sf, "documents").select("doc_id", F.expr(LANGUAGES).alias("tag"))
    canonical = T.canonical_language(F.col("tag"))
    return d.select("doc_id", canonical.alias("canonical"), F.coalesce(T.is_simple_language(canonical), F.lit(False)).alias("simple"))


@query("WITH e AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN ' Writer_' || event_type || ' {0123abcd-0123-0123-0123-0123456789ab}' WHEN 1 THEN 'Office/7$Linux' WHEN 2 THEN '$' ELSE '- A  B -' END AS t FROM events) SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'Writer_' || regexp_replace(regexp_extract(t, 'Writer_(.*) [{]', 1), '[_ -]+$', '') WHEN 1 THEN 'Office/7' WHEN 2 THEN NULL ELSE 'A B' END AS application FROM e")
def application_names(spark: SparkSession, sf: str) -> DataFrame:
    """St8."""
    raw = "CASE event_id % 4 WHEN 0 THEN concat(' Writer_', event_type, ' {0123abcd-0123-0123-0123-0123456789ab}') WHEN 1 THEN 'Office/7$Linux' WHEN 2 THEN '$' ELSE '- A  B -' END"
    return table(spark, sf, "events").select("event_id", T.application_name(F.expr(raw)).alias("application"))


FIELDS = ["PAGE \\* MERGEFORMAT", " toc \\o", "=SUM(A1)", "REF x \\h", "HYPERLINK \"x\"", "EQ \\o\\ad(\\s\\up 9(a),b)", "nothing", "DATE \\@ \"yyyy\""]
FIELD_RESULT = ["PageFields", "TablesOfContents", "FormulasAndConditions", "CrossReferences", "Hyperlinks", "Ruby", None, "DateAndTimeFields"]


@query("SELECT o_orderkey, [" + ", ".join("NULL" if r is None else f"'{r}'" for r in FIELD_RESULT) + "][o_orderkey % 8 + 1] AS feature, o_orderkey % 8 IN (0, 7) AS switched FROM orders")
def field_features(spark: SparkSession, sf: str) -> DataFrame:
    """St9, St10: features of field instructions (a cycle of eight)."""
    text = F.element_at(F.array(*(F.lit(x) for x in FIELDS)), (F.col("o_orderkey") % 8 + 1).cast("int"))
    return table(spark, sf, "orders").select("o_orderkey", T.classify_field(text).alias("feature"), T.has_formatting_switch(text).alias("switched"))


@query("SELECT p_partkey, regexp_full_match(lower(trim('Heading ' || p_size)), 'heading [1-9]') AS heading, NOT (p_size % 3 = 0) AS is_on, p_size <> 5 AS differs, regexp_full_match(lower(p_brand), '[a-z0-9-]+') AS source_name, p_partkey % 4 <> 1 AS relative FROM part")
def style_predicates(spark: SparkSession, sf: str) -> DataFrame:
    """St11, St12, St18: predicates of styles, switches, names and paths."""
    p = table(spark, sf, "part")
    path = F.when(F.col("p_partkey") % 4 == 1, "a/../b").otherwise("a/b.txt")
    switch = F.when(F.col("p_size") % 3 == 0, "off").when(F.col("p_size") % 3 == 1, "1")
    return p.select("p_partkey", T.is_heading_style(F.concat(F.lit("Heading "), F.col("p_size").cast("string"))).alias("heading"), T.is_on(switch).alias("is_on"), T.differs_from(F.col("p_size"), F.lit(5)).alias("differs"), T.is_source_name(F.lower("p_brand")).alias("source_name"), T.is_relative_path(path).alias("relative"))


@query("SELECT doc_id, length(text) AS characters, length(text) + len(regexp_extract_all(text, '[\\x{10000}-\\x{10FFFF}]')) AS units FROM documents")
def utf16_units(spark: SparkSession, sf: str) -> DataFrame:
    """St23."""
    return table(spark, sf, "documents").select("doc_id", F.length("text").cast("long").alias("characters"), T.utf16_length(F.col("text")).cast("long").alias("units"))


@query("SELECT event_id, split_part(event_type || ':' || user_id, ':', 1) AS family, 'k' || user_id % 10 || ':' || lpad(lower(to_hex(event_id)), 32, '0') AS bound FROM events")
def mark_keys(spark: SparkSession, sf: str) -> DataFrame:
    """St20, St21: families of mark keys, bindings of placeholders."""
    e = table(spark, sf, "events")
    return e.select("event_id", T.mark_family(F.concat_ws(":", "event_type", F.col("user_id").cast("string"))).alias("family"), T.binding(F.concat(F.lit("k"), (F.col("user_id") % 10).cast("string")), F.hex("event_id")).alias("bound"))


MARKER_SQL = ", ".join(f"('{k}', '{p}')" for k, p in inspection.MARKERS.items())


@query("SELECT flag, count(DISTINCT doc_id) AS documents FROM (SELECT doc_id, m.kind AS flag FROM documents, (VALUES " + MARKER_SQL + ") AS m(kind, pattern) WHERE regexp_matches(text, m.pattern)) GROUP BY flag")
def marker_flags(spark: SparkSession, sf: str) -> DataFrame:
    """St15, A19: documents with each kind of marker."""
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.explode(inspection.marker_kinds(F.col("text"))).alias("flag")).groupBy("flag").agg(F.count_distinct("doc_id").alias("documents"))


@query()
def flag_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Documents by every flag of the inspection, most first."""
    return inspection.flag_totals(inspection.findings(table(spark, sf, "documents")))


LUHN_SQL = "(list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN (length(d) - i) % 2 = 1 THEN (substr(d, i, 1)::INT * 2) // 10 + (substr(d, i, 1)::INT * 2) % 10 ELSE substr(d, i, 1)::INT END)) % 10 = 0)"


@query(f"WITH n AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[0-9]{{13,19}}'))) AS d FROM documents) SELECT doc_id, d AS digits, {LUHN_SQL} AS luhn, regexp_matches(d, '^[3-6]') AND NOT regexp_matches(d, '^(30000|40000|50000)') AS prefix FROM n")
def pii_validators(spark: SparkSession, sf: str) -> DataFrame:
    """St16: checksum and prefix of runs of 13 to 19 digits."""
    d = table(spark, sf, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[0-9]{13,19}"), 0))).alias("digits"))
    return d.select("doc_id", "digits", T.luhn(F.col("digits")).alias("luhn"), T.card_prefix(F.col("digits")).alias("prefix"))


@query("WITH i AS (SELECT c_custkey, 'DE' || lpad((98 - (lpad(c_custkey::VARCHAR, 18, '7') || '131400')::HUGEINT % 97 + CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END)::INT::VARCHAR, 2, '0') || lpad(c_custkey::VARCHAR, 18, '7') AS iban FROM customer) SELECT c_custkey, iban, c_custkey % 3 <> 0 AS valid FROM i")
def iban_check(spark: SparkSession, sf: str) -> DataFrame:
    """St16: remainder 97 of account numbers made for the purpose, a third of them wrong."""
    body = F.lpad(F.col("c_custkey").cast("string"), 18, "7")
    number = F.concat(body, F.lit("131400")).cast("decimal(38,0)")
    check = (F.lit(98) - F.pmod(number, F.lit(97).cast("decimal(38,0)")) + F.when(F.col("c_custkey") % 3 == 0, 1).otherwise(0)).cast("int").cast("string")
    iban = F.concat(F.lit("DE"), F.lpad(check, 2, "0"), body)
    return table(spark, sf, "customer").select("c_custkey", iban.alias("iban"), T.iban_valid(iban).alias("valid"))


@query("SELECT doc_id, substr(sha256(text), 1, 12) AS short, 'objects/' || substr(sha256(text), 1, 2) || '/' || substr(sha256(text), 3) AS key, sha256(base64(encode(text))) AS body FROM documents")
def content_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Identities, store keys, the digest of the whole text in base64 (without line breaks)."""
    digest = F.sha2("text", 256)
    return table(spark, sf, "documents").select("doc_id", I.short(digest).alias("short"), I.object_key(digest).alias("key"), F.sha2(F.replace(F.base64(F.col("text").cast("binary")), F.lit("\r\n"), F.lit("")), 256).alias("body"))


@query()
def checksums(spark: SparkSession, sf: str) -> DataFrame:
    """H2, H4, H6: CRC-32, FNV-1a, identifiers that follow from others, digests of a conversation's messages."""
    c = table(spark, sf, "conversations")
    by = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("m"))
    return by.select("conv_id", F.crc32(F.to_json("m")).alias("crc"), I.fnv1a64(F.to_json("m")).alias("fnv"), I.message_digest(F.transform("m", lambda x: x["text"])).alias("digest"), I.derived_id(F.lpad(F.lower(F.hex("conv_id")), 32, "0"), F.lit(1).cast("long")).alias("derived"))


L = "list_sort(list(DISTINCT l_linenumber))"


@query(f"WITH g AS (SELECT l_orderkey AS k, {L} AS a FROM lineitem GROUP BY 1) SELECT k, array_to_string(a[1:1] || [99] || a[2:], ',') AS inserted, array_to_string(a[2:], ',') AS removed, array_to_string(a[2:] || a[1:1], ',') AS moved, list_contains(a, 3) AS has_3 FROM g")
def list_edits(spark: SparkSession, sf: str) -> DataFrame:
    """Insert, remove and move in ordered lists; membership in ranges."""
    g = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_set("l_linenumber")).alias("a"))
    a = F.col("a")
    ranges = F.transform(a, lambda x: F.struct(x.alias("first"), (x + 1).alias("end")))
    return g.select("k", F.array_join(I.list_insert(a, F.lit(1), F.lit(99)), ",").alias("inserted"), F.array_join(I.list_remove(a, F.lit(0)), ",").alias("removed"), F.array_join(I.list_move(a, F.lit(0), F.size("a")), ",").alias("moved"), I.range_agrees(ranges, F.lit(3)).alias("has_3"))


@query("SELECT event_id, CASE WHEN event_type = 'a' THEN 1 ELSE 2 END AS entries, 'v' || user_id AS value, NULL::VARCHAR AS removed FROM events")
def map_edits(spark: SparkSession, sf: str) -> DataFrame:
    """Set, remove and filter entries of maps."""
    m = F.create_map(F.lit("a"), F.lit("x"), "event_type", F.lit("y"))
    base = F.map_from_entries(F.array_distinct(F.array(F.struct(F.lit("a").alias("key"), F.lit("x").alias("value")))))
    del m
    put = I.map_set(base, F.col("event_type"), F.concat(F.lit("v"), F.col("user_id").cast("string")))
    return table(spark, sf, "events").select("event_id", F.size(put).alias("entries"), put[F.col("event_type")].alias("value"), F.try_element_at(I.map_remove(put, F.col("event_type")), F.col("event_type")).alias("removed"))


@query("WITH g AS (SELECT text AS t, item_id AS d FROM benchmark), k AS (SELECT d, substr(t, i, 32) AS gram FROM g, LATERAL (SELECT unnest(range(1, greatest(length(t) - 30, 1))) AS i)), u AS (SELECT d, gram FROM k WHERE length(gram) = 32 GROUP BY d, gram HAVING count(*) = 1) SELECT d, count(*) AS grams FROM u GROUP BY d")
def unique_grams(spark: SparkSession, sf: str) -> DataFrame:
    """H3: runs of 32 characters that occur once in a passage."""
    g = table(spark, sf, "benchmark").select(F.col("item_id").alias("d"), F.col("text").alias("t"))
    grams = g.where("length(t) >= 32").select("d", F.explode(F.transform(F.sequence(F.lit(1), F.length("t") - 31), lambda i: F.substring("t", i, F.lit(32)))).alias("gram"))
    return grams.groupBy("d", "gram").count().where("count = 1").groupBy("d").agg(F.count("*").alias("grams"))


@query("WITH a AS (SELECT item_id AS d, substr(text, i, 32) AS gram, i AS p FROM benchmark, LATERAL (SELECT unnest(range(1, greatest(length(text) - 30, 1))) AS i)), ua AS (SELECT d, gram, min(p) AS p FROM a WHERE length(gram) = 32 GROUP BY 1, 2 HAVING count(*) = 1), b AS (SELECT (d + 1) AS d, gram, p + 7 AS p FROM ua WHERE p % 3 = 0) SELECT ua.d, ua.p AS a, b.p AS b FROM ua JOIN b ON ua.d + 1 = b.d AND ua.gram = b.gram")
def anchor_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Runs that occur once on both sides, joined by the run itself (here a passage and a moved third of it)."""
    g = table(spark, sf, "benchmark").where("length(text) >= 32")
    grams = g.select(F.col("item_id").alias("d"), F.posexplode(F.transform(F.sequence(F.lit(1), F.length("text") - 31), lambda i: F.substring("text", i, F.lit(32)))).alias("p", "gram"))
    once = grams.groupBy("d", "gram").agg(F.min(F.col("p") + 1).alias("p"), F.count("*").alias("n")).where("n = 1").drop("n")
    moved = once.where("p % 3 = 0").select("d", "gram", (F.col("p") + 7).alias("b"))
    return once.join(moved, ["d", "gram"]).select("d", F.col("p").cast("long").alias("a"), F.col("b").cast("long").alias("b"))

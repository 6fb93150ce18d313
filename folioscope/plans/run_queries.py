"""Queries that aggregate comparison runs. Stand-in: a customer is a document, its line items are breaks, its orders pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..operators import aggregate as A
from ..sources.tables import table
from .base import registry

QUERIES, SQL, query = registry()


def distances(n: Column, step: int) -> Column:
    """A histogram of glyph distances as a document has it; here distances i * step, one each, for i below n."""
    value = lambda i: i.cast("long") * step
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), lambda i: F.struct(N.histogram_bin(value(i)).alias("bin"), F.lit(1).cast("long").alias("n"), value(i).alias("most"))))


def outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """One row for each customer with orders. Line items meet orders by their key, then everything is combined by customer."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "N").alias("same"), F.collect_set("l_returnflag").alias("flags"))
    by = orders.join(lines, "o_orderkey", "left").groupBy("o_custkey").agg(
        F.count("*").alias("m2_total"), F.count_if(F.col("o_orderstatus") == "O").alias("m2_agreed"), F.coalesce(F.sum("n"), F.lit(0)).alias("m3_total"), F.coalesce(F.sum("same"), F.lit(0)).alias("m3_agreed"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("flags")))).alias("flags"),
    )
    people = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    k = F.col("c_custkey")
    rows = by.join(people, F.col("o_custkey") == k)
    state = lambda gap, bad: F.when(k % gap == 0, "missing").when(k % bad == 0, "invalid").otherwise("present")
    return rows.select(
        F.sha2(k.cast("string"), 256).alias("sha256"), k.alias("k"), F.when(k % 7 == 0, "T2").otherwise("T1").alias("tier"), F.when(F.col("c_nationkey") % 4 == 0, F.lit(None).cast("int")).otherwise((F.col("c_nationkey") % 4 + 12).cast("int")).alias("mode"),
        F.concat("flags", F.array(F.concat(F.lit("n"), (F.col("c_nationkey") % 5).cast("string")))).alias("features"), F.array("c_mktsegment").alias("scripts"), state(13, 17).alias("reference"), state(11, 19).alias("candidate"),
        F.col("m2_total").alias("pages_reference"), (F.col("m2_total") + k % 3 - 1).alias("pages_candidate"), "m2_total", "m2_agreed", "m3_total", "m3_agreed",
        F.when(k % 6 == 0, "refused").when(k % 2 == 0, "agreement").otherwise("absent").alias("hints_outcome"), F.col("m2_total").alias("m7_total"), F.col("m2_agreed").alias("m7_agreed"),
        F.col("m2_total").alias("m7_pages_reference"), (F.col("m2_total") + k % 3 - 1).alias("m7_pages_candidate"), F.when(k % 23 == 0, "refused").alias("problem"), (k % 29 != 0).alias("complete"),
        F.col("m3_agreed").alias("m4_lines"), (F.col("m3_agreed") * 7).alias("m4_glyphs"), distances(F.col("m3_agreed"), 37).alias("m4_x"), distances(F.col("m3_agreed"), 101).alias("m4_y"),
        (F.col("m3_total") * 10).alias("text_reference"), (F.col("m3_total") * 10 + k % 4).alias("text_candidate"), (F.col("m3_agreed") * 10).alias("text_matched"), (F.col("m2_total") + k % 3 - 1 - F.col("m2_total")).alias("page_difference"),
    )


OUT = """WITH l AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_returnflag = 'N') AS same, list(DISTINCT l_returnflag) AS flags FROM lineitem GROUP BY 1),
b AS (SELECT o_custkey, count(*) AS m2_total, count(*) FILTER (o_orderstatus = 'O') AS m2_agreed, coalesce(sum(n), 0)::BIGINT AS m3_total, coalesce(sum(same), 0)::BIGINT AS m3_agreed, list_distinct(flatten(list(flags))) AS flags FROM orders LEFT JOIN l ON o_orderkey = l_orderkey GROUP BY 1),
o AS (SELECT sha256(c_custkey::VARCHAR) AS sha256, c_custkey AS k, CASE WHEN c_custkey % 7 = 0 THEN 'T2' ELSE 'T1' END AS tier, CASE WHEN c_nationkey % 4 = 0 THEN NULL ELSE c_nationkey % 4 + 12 END AS mode,
 list_append(flags, 'n' || c_nationkey % 5) AS features, c_mktsegment AS script, CASE WHEN k % 13 = 0 THEN 'missing' WHEN k % 17 = 0 THEN 'invalid' ELSE 'present' END AS reference, CASE WHEN k % 11 = 0 THEN 'missing' WHEN k % 19 = 0 THEN 'invalid' ELSE 'present' END AS candidate,
 m2_total AS pages_reference, m2_total + k % 3 - 1 AS pages_candidate, m2_total, m2_agreed, m3_total, m3_agreed, CASE WHEN k % 6 = 0 THEN 'refused' WHEN k % 2 = 0 THEN 'agreement' ELSE 'absent' END AS hints_outcome, m2_total AS m7_total, m2_agreed AS m7_agreed,
 m2_total AS m7_pages_reference, m2_total + k % 3 - 1 AS m7_pages_candidate, CASE WHEN k % 23 = 0 THEN 'refused' END AS problem, k % 29 <> 0 AS complete, m3_agreed AS m4_lines, m3_agreed * 7 AS m4_glyphs,
 m3_total * 10 AS text_reference, m3_total * 10 + k % 4 AS text_candidate, m3_agreed * 10 AS text_matched, k % 3 - 1 AS page_difference FROM b JOIN customer ON o_custkey = c_custkey) """

AGG = """count(*) AS documents, count(problem) AS failed, coalesce(sum(m4_lines) FILTER (c), 0)::BIGINT AS m4_lines, coalesce(sum(m4_glyphs) FILTER (c), 0)::BIGINT AS m4_glyphs, count(*) FILTER (hints_outcome = 'agreement' AND m7_pages_reference = m7_pages_candidate) AS m7_pages_matching, count(*) FILTER (c AND NOT complete) AS text_incomplete, count(*) FILTER (c) AS compared, count(*) FILTER (reference = 'missing') AS without_reference, count(*) FILTER (candidate = 'missing') AS without_candidate,
 count(*) FILTER (c AND pages_reference = pages_candidate) AS m1_matching, coalesce(sum(abs(pages_candidate - pages_reference)) FILTER (c), 0)::BIGINT AS m1_difference,
 coalesce(sum(m2_total) FILTER (c), 0)::BIGINT AS m2_total, coalesce(sum(m2_agreed) FILTER (c), 0)::BIGINT AS m2_agreed, coalesce(sum(m3_total) FILTER (c), 0)::BIGINT AS m3_total, coalesce(sum(m3_agreed) FILTER (c), 0)::BIGINT AS m3_agreed,
 count(*) FILTER (hints_outcome = 'agreement') AS m7_documents, coalesce(sum(m7_total) FILTER (hints_outcome = 'agreement'), 0)::BIGINT AS m7_total, coalesce(sum(m7_agreed) FILTER (hints_outcome = 'agreement'), 0)::BIGINT AS m7_agreed, count(*) FILTER (hints_outcome = 'refused') AS m7_refused,
 coalesce(sum(text_reference) FILTER (c), 0)::BIGINT AS text_reference, coalesce(sum(text_candidate) FILTER (c), 0)::BIGINT AS text_candidate, coalesce(sum(text_matched) FILTER (c), 0)::BIGINT AS text_matched"""
GROUPED = OUT + f""", g AS (SELECT *, reference = 'present' AND candidate <> 'invalid' AS c FROM o),
x AS (SELECT 'overall' AS dimension, '' AS key, * FROM g UNION ALL SELECT 'tier', tier, * FROM g UNION ALL SELECT 'mode', coalesce(mode::VARCHAR, 'not set'), * FROM g UNION ALL SELECT 'script', script, * FROM g UNION ALL SELECT 'feature', f, * EXCLUDE (f) FROM (SELECT *, unnest(features) AS f FROM g))
SELECT dimension, key, {AGG} FROM x """


@query(GROUPED + "GROUP BY dimension, key")
def run_aggregate_by_dimension(spark: SparkSession, sf: str) -> DataFrame:
    """All measures overall and by tier, mode, script and feature."""
    return A.run_aggregate(outcomes(spark, sf))


@query(GROUPED + "WHERE dimension = 'overall' GROUP BY dimension, key")
def run_aggregate_overall(spark: SparkSession, sf: str) -> DataFrame:
    return A.run_aggregate(outcomes(spark, sf)).where("dimension = 'overall'")


@query(GROUPED.split("SELECT dimension, key")[0] + """, v AS (SELECT dimension, key, a.axis, i * a.step AS d FROM x, (VALUES ('x', 37), ('y', 101)) AS a(axis, step), LATERAL (SELECT unnest(range(m3_agreed)) AS i) WHERE c),
p AS (SELECT dimension, key, axis, count(*) AS count, quantile_disc(d, 0.5) AS median, quantile_disc(d, 0.95) AS p95, max(d) AS max FROM v GROUP BY dimension, key, axis),
f AS (SELECT *, CASE WHEN median < 2048 THEN median ELSE median >> (length(bin(median)) - 11)::INT << (length(bin(median)) - 11)::INT END AS m, CASE WHEN p95 < 2048 THEN p95 ELSE p95 >> (length(bin(p95)) - 11)::INT << (length(bin(p95)) - 11)::INT END AS q FROM p)
SELECT dimension, key, axis, count, m AS median, q AS p95, max FROM f""")
def run_glyph_spreads(spark: SparkSession, sf: str) -> DataFrame:
    """Spreads of glyph distances by group, from the documents' merged histograms."""
    return A.run_spreads(outcomes(spark, sf))


@query(OUT + "SELECT sha256, CASE WHEN m3_total > 0 THEN (((m3_total - m3_agreed) * 1000 + m3_total // 2) // m3_total)::BIGINT END AS disagreement FROM o")
def disagreement_share(spark: SparkSession, sf: str) -> DataFrame:
    """Thousandths of breaks that disagree."""
    return outcomes(spark, sf).select("sha256", A.disagreement(F.col("m3_total"), F.col("m3_agreed")).alias("disagreement"))


@query(OUT + """, d AS (SELECT features, (((m3_total - m3_agreed) * 1000 + m3_total // 2) // m3_total)::BIGINT AS d FROM o WHERE m3_total > 0), w AS (SELECT count(*) AS n, sum(d)::HUGEINT AS s, sum(d * d)::HUGEINT AS q FROM d),
e AS (SELECT f AS feature, count(*) AS k, sum(d)::HUGEINT AS t FROM (SELECT d, unnest(list_distinct(features)) AS f FROM d) GROUP BY 1),
r AS (SELECT feature, k, n, s, t, n * t - k * s AS num, (k * (n - k))::HUGEINT * (n * q - s * s) AS den FROM e, w WHERE k >= 5 AND n - k >= 5 AND n * q > s * s),
z AS (SELECT *, num::HUGEINT * num::HUGEINT * 1000000 // den::HUGEINT AS sq FROM r), y AS (SELECT *, floor(sqrt(sq::DOUBLE))::HUGEINT AS rt FROM z)
SELECT feature, k AS "with", n - k AS without, ((2 * t + k) // (2 * k))::BIGINT AS disagreement_with, ((2 * (s - t) + (n - k)) // (2 * (n - k)))::BIGINT AS disagreement_without, least(CASE WHEN sq > rt * rt + rt THEN rt + 1 ELSE rt END, 1000)::BIGINT AS correlation
FROM y WHERE num > 0 AND sq >= 1 ORDER BY correlation DESC, feature LIMIT 20""")
def feature_correlation(spark: SparkSession, sf: str) -> DataFrame:
    """Features that go with disagreement, strongest first."""
    rows = outcomes(spark, sf).select("features", A.disagreement(F.col("m3_total"), F.col("m3_agreed")).alias("d")).where("d is not null")
    return A.correlations(rows)


@query(OUT + "SELECT sha256, m3_total, m3_agreed, m2_total, m2_agreed, page_difference FROM o WHERE tier <> 'T2' AND m3_total > 0 ORDER BY m3_agreed / m3_total, m2_agreed / m2_total, abs(page_difference) DESC, sha256 LIMIT 20")
def worst_k(spark: SparkSession, sf: str) -> DataFrame:
    """The public documents whose line breaks agree least."""
    return A.worst(outcomes(spark, sf)).select("sha256", "m3_total", "m3_agreed", "m2_total", "m2_agreed", "page_difference")


@query(OUT + "SELECT sha256, m7_total, m7_agreed FROM o WHERE tier <> 'T2' AND hints_outcome = 'agreement' ORDER BY m7_agreed / m7_total, m7_total DESC, sha256 LIMIT 20")
def worst_hints(spark: SparkSession, sf: str) -> DataFrame:
    """T4."""
    return A.worst_hints(outcomes(spark, sf)).select("sha256", "m7_total", "m7_agreed")


BIN = "CASE WHEN v < 2048 THEN v ELSE (length(bin(v)) - 1 - 11) * 1024 + (v >> (length(bin(v)) - 1 - 10)) - 1024 + 2048 END"
VALUES = "SELECT l_returnflag AS g, round(l_extendedprice * 100)::BIGINT AS v FROM lineitem"


def values(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("g"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("v"))


@query(f"WITH x AS ({VALUES}) SELECT g, ({BIN})::BIGINT AS bin, count(*) AS n, max(v) AS most FROM x GROUP BY 1, 2")
def histogram_bins(spark: SparkSession, sf: str) -> DataFrame:
    """A10, Nu14: mergeable histograms."""
    return A.histogram(values(spark, sf), ["g"], "v")


@query(f"WITH x AS ({VALUES}), b AS (SELECT g, ({BIN})::BIGINT AS bin, v FROM x), s AS (SELECT g, bin, CASE WHEN bin < 2048 THEN bin ELSE ((bin - 2048) % 1024 + 1024) << ((bin - 2048) // 1024 + 1) END AS low, v FROM b) SELECT g, count(*) AS count, quantile_disc(low, 0.5)::BIGINT AS median, quantile_disc(low, 0.95)::BIGINT AS p95, max(v) AS max FROM s GROUP BY g")
def nearest_rank_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Nearest-rank percentiles of merged histograms."""
    parts = A.histogram(values(spark, sf).withColumn("part", F.col("v") % 7), ["g", "part"], "v")
    return A.percentiles(A.merge_histograms(parts, ["g"]), ["g"], {"median": 500, "p95": 950})


BREAKS = "SELECT l_orderkey AS doc, l_linenumber AS idx, l_returnflag <> 'R' AS agrees FROM lineitem"


def breaks(spark: SparkSession, sf: str) -> DataFrame:
    """The line numbers of an order as break indexes, the first row of a number only."""
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("idx")).agg((F.max("l_returnflag") != "R").alias("agrees"))


B = "WITH br AS (SELECT l_orderkey AS doc, l_linenumber AS idx, max(l_returnflag) <> 'R' AS agrees FROM lineitem GROUP BY 1, 2) "


@query(B + "SELECT doc, count(*) AS total, count(*) FILTER (agrees) AS agreed, min(idx) FILTER (NOT agrees) AS first_difference FROM br GROUP BY doc")
def first_difference(spark: SparkSession, sf: str) -> DataFrame:
    """A15."""
    return A.first_difference(breaks(spark, sf), "doc")


@query(B + ", i AS (SELECT doc, idx, idx - row_number() OVER (PARTITION BY doc ORDER BY idx) AS island FROM br WHERE agrees) SELECT doc, min(idx) AS first, max(idx) + 1 AS \"end\" FROM i GROUP BY doc, island")
def agreed_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Agreed breaks as ranges."""
    return A.compress(breaks(spark, sf).where("agrees"), "doc")


@query("WITH a AS (SELECT l_orderkey AS doc, l_linenumber AS i FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1, 2), b AS (SELECT l_orderkey AS doc, l_linenumber AS i FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1, 2) SELECT a.doc, count(*) FILTER (b.i IS NULL) AS outside FROM a LEFT JOIN b ON a.doc = b.doc AND a.i = b.i GROUP BY a.doc")
def interval_difference(spark: SparkSession, sf: str) -> DataFrame:
    """How many agreed breaks of one run are not agreed in another, from ranges."""
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("idx"), "l_returnflag", "l_linestatus")
    return A.outside(A.compress(lines.where("l_returnflag <> 'R'").select("doc", "idx").distinct(), "doc"), A.compress(lines.where("l_linestatus = 'F'").select("doc", "idx").distinct(), "doc"), "doc")


@query("WITH v AS (SELECT l_orderkey AS doc, l_quantity::BIGINT AS y, count(*) AS votes FROM lineitem GROUP BY 1, 2) SELECT doc, arg_min(y, (-votes, y)) AS y, max(votes) AS votes FROM v GROUP BY doc")
def mode_with_tie(spark: SparkSession, sf: str) -> DataFrame:
    """The most frequent value, the smaller on a tie."""
    return A.common_value(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_quantity").cast("long").alias("y")), "doc", "y")


def entries(spark: SparkSession, sf: str, late: bool) -> DataFrame:
    """A run's entries by customer: orders' numbers by their state; the two runs differ by what they take for agreed."""
    o = table(spark, sf, "orders").where(F.col("o_custkey") % (9 if late else 10) != 0)
    ok = F.col("o_orderstatus") == "O"
    take = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("o_orderkey"))))
    more = F.col("o_orderkey") % 5 == 0
    return o.groupBy(F.col("o_custkey").cast("string").alias("sha256")).agg(
        F.when(F.max("o_custkey") % 8 != 0, (F.max("o_custkey") % (4 if late else 3)).cast("string")).alias("digest"), (F.count("*") % (3 if late else 4) != 0).alias("pages_match"),
        take(ok & more if late else ok).alias("m2"), take(ok | more).alias("m3") if late else take(ok).alias("m3"), take(more).alias("m7"),
    )


def entries_sql(late: bool) -> str:
    more = "o_orderkey % 5 = 0"
    m2 = f"o_orderstatus = 'O' AND {more}" if late else "o_orderstatus = 'O'"
    m3 = f"o_orderstatus = 'O' OR {more}" if late else "o_orderstatus = 'O'"
    take = "coalesce(list(DISTINCT o_orderkey) FILTER ({}), [])"
    return f"SELECT o_custkey::VARCHAR AS sha256, CASE WHEN max(o_custkey) % 8 <> 0 THEN (max(o_custkey) % {4 if late else 3})::VARCHAR END AS digest, count(*) % {3 if late else 4} <> 0 AS pages_match, {take.format(m2)} AS m2, {take.format(m3)} AS m3, {take.format(more)} AS m7 FROM orders WHERE o_custkey % {9 if late else 10} <> 0 GROUP BY o_custkey"


_gone = lambda a, c, m: f"len(list_filter({a}.{m}, lambda x: NOT list_contains({c}.{m}, x)))"
_keep = lambda a, c, m: f"CASE WHEN b.sha256 IS NOT NULL AND n.sha256 IS NOT NULL THEN CASE WHEN coalesce(n.digest <> b.digest, false) THEN 0 ELSE {_gone(a, c, m)} END END"
_hint = lambda a, c: f"CASE WHEN b.sha256 IS NOT NULL AND n.sha256 IS NOT NULL THEN {_gone(a, c, 'm7')} END"


@query(f"""WITH n AS ({entries_sql(True)}), b AS ({entries_sql(False)}), j AS (SELECT coalesce(n.sha256, b.sha256) AS sha256, b.sha256 IS NULL AS is_new, n.sha256 IS NULL AS is_old, b.sha256 IS NOT NULL AND n.sha256 IS NOT NULL AND coalesce(n.digest <> b.digest, false) AS rebaselined, n.pages_match AS np, b.pages_match AS bp,
 ({_keep('b', 'n', 'm2')})::INT AS page_breaks_lost, ({_keep('n', 'b', 'm2')})::INT AS page_breaks_gained, ({_keep('b', 'n', 'm3')})::INT AS line_breaks_lost, ({_keep('n', 'b', 'm3')})::INT AS line_breaks_gained, ({_hint('b', 'n')})::INT AS hints_lost, ({_hint('n', 'b')})::INT AS hints_gained FROM n FULL JOIN b ON n.sha256 = b.sha256)
SELECT sha256, CASE WHEN is_new THEN 'added' WHEN is_old THEN 'missing' WHEN (NOT rebaselined AND bp AND NOT np) OR page_breaks_lost > 0 OR line_breaks_lost > 0 OR hints_lost > 0 THEN 'regressed' WHEN (NOT rebaselined AND np AND NOT bp) OR page_breaks_gained > 0 OR line_breaks_gained > 0 OR hints_gained > 0 THEN 'improved' ELSE 'unchanged' END AS status,
 rebaselined, page_breaks_lost, page_breaks_gained, line_breaks_lost, line_breaks_gained, hints_lost, hints_gained FROM j""")
def baseline_diff(spark: SparkSession, sf: str) -> DataFrame:
    """J2, AL10: a run against its baseline."""
    return A.baseline_diff(entries(spark, sf, True), entries(spark, sf, False))


@query("WITH e AS (SELECT event_type AS probe, user_id % 4 AS env, (value * 100)::BIGINT % 3 AS v FROM events), g AS (SELECT probe, v, list_sort(list(DISTINCT env)) AS envs FROM e GROUP BY 1, 2) SELECT probe, v AS value, array_to_string(envs, ',') AS environments, count(*) OVER (PARTITION BY probe) = 1 AS agree FROM g")
def environment_agreement(spark: SparkSession, sf: str) -> DataFrame:
    """Environments by the value they give for a probe; they agree if there is one."""
    e = table(spark, sf, "events").select(F.col("event_type").alias("probe"), (F.col("user_id") % 4).alias("env"), (F.round(F.col("value") * 100).cast("long") % 3).alias("value"))
    by = e.groupBy("probe", "value").agg(F.array_join(F.array_sort(F.collect_set("env")), ",").alias("environments"))
    from pyspark.sql import Window

    return by.withColumn("agree", F.count("*").over(Window.partitionBy("probe")) == 1)



"""Queries that apply exact arithmetic to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..sources.tables import table
from .base import registry

QUERIES, SQL, query = registry()

V = "((l_orderkey * 37 + l_linenumber * 11) % 4001 - 2000)"
D = "(l_partkey % 9 - 4)"


@query(f"""WITH x AS (SELECT DISTINCT {V} AS v, {D} AS d0 FROM lineitem), y AS (SELECT v, d0, CASE WHEN d0 < 0 THEN -v * 5 ELSE v * 5 END AS n, abs(d0) AS d FROM x WHERE d0 <> 0), z AS (SELECT *, ((n % d) + d) % d AS r FROM y), q AS (SELECT *, (n - r) // d AS f FROM z)
SELECT v, d0 AS d, f AS floor, f + (r > 0)::INT AS ceiling, f + (r > 0 AND n < 0)::INT AS toward_zero, f + (2 * r >= d)::INT AS half_up, f + (2 * r > d OR (2 * r = d AND f % 2 <> 0))::INT AS half_even, f + (2 * r > d OR (2 * r = d AND n > 0))::INT AS half_away FROM q""")
def rounding_modes(spark: SparkSession, sf: str) -> DataFrame:
    """Nu1, Nu2: 5 v / d in all six modes; rows with a zero denominator are null and left out."""
    x = table(spark, sf, "lineitem").select(F.expr(V).alias("v"), F.expr(D).alias("d")).distinct()
    out = x.select("v", "d", *(N.scale(F.col("v"), 5, F.col("d"), m).alias(m) for m in N.MODES))
    return out.where("floor is not null")


@query("SELECT p_partkey, " + ", ".join(f"(p_size * {n})::BIGINT AS {u}" for u, n in N.UNITS.items()) + ", (p_size * 1000 * 1270 + 12700) // 25400 AS points FROM part")
def units_convert(spark: SparkSession, sf: str) -> DataFrame:
    """Nu3, Nu12: lengths in every unit; thousandths of twips to points."""
    p = table(spark, sf, "part")
    return p.select("p_partkey", *(N.to_units(F.col("p_size"), u).alias(u) for u in N.UNITS), N.scale(F.col("p_size").cast("long") * 1000, N.UNITS["twip"], N.UNITS["point"], "half_up").alias("points"))


M = "CASE p_partkey % 7 WHEN 0 THEN p_size || '.5in' WHEN 1 THEN '-' || p_size || 'mm' WHEN 2 THEN p_size || '.0001mm' WHEN 3 THEN p_size || 'pc' WHEN 4 THEN p_size || '.in' WHEN 5 THEN 'x' ELSE p_size || '.25pt' END"


@query("SELECT p_partkey, (CASE p_partkey % 7 WHEN 0 THEN p_size * 1828800 + 914400 WHEN 1 THEN -p_size * 72000 WHEN 2 THEN p_size * 72000 + 7 WHEN 3 THEN p_size * 304800 WHEN 6 THEN p_size * 25400 + 6350 END)::BIGINT AS measure, (CASE WHEN p_partkey % 2 = 0 THEN -p_size * 1270 END)::BIGINT AS twips FROM part")
def measure_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Nu5, Nu6: attributes with and without a unit; malformed ones are null."""
    twips = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("-"), F.col("p_size").cast("string"))).otherwise("1.5")
    return table(spark, sf, "part").select("p_partkey", N.parse_measure(F.expr(M.replace("||", "||")), "half_up").alias("measure"), N.parse_whole(twips, "twip").alias("twips"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 9223372036854775000 + o_orderkey % 3 * 10 END::BIGINT AS checked, least(9223372036854775000::HUGEINT + o_orderkey % 3 * 10 + CASE WHEN o_orderkey % 3 = 0 THEN 10000 ELSE 0 END, 9223372036854775807)::BIGINT AS saturated, (o_orderkey % 100 * 20)::BIGINT AS thousandths, ((o_orderkey * (o_orderkey % 100) * 2000 + 50000) // 100000)::BIGINT AS part FROM orders")
def checked_arithmetic(spark: SparkSession, sf: str) -> DataFrame:
    """Nu4, Nu7: additions that may overflow, percentages."""
    k = F.col("o_orderkey")
    big, more = F.lit(9223372036854775000), k % 3 * 10 + F.when(k % 3 == 0, F.lit(10000)).otherwise(F.lit(0))
    return table(spark, sf, "orders").select("o_orderkey", N.checked_add(big, more).alias("checked"), N.saturating_add(big, more).alias("saturated"), N.fiftieths(k % 100).alias("thousandths"), N.percentage_of(k % 100 * 2000, k, "half_up").alias("part"))


@query("SELECT s_suppkey, ((s_suppkey * 4294967296::HUGEINT * 2 + 7) // 14)::BIGINT AS ratio, ((((s_suppkey * 4294967296::HUGEINT * 2 + 7) // 14) * 14 * 2 + 4294967296) // 8589934592)::BIGINT AS back, (((s_suppkey - 50) * 700001 % 21600000 + 21600000) % 21600000)::BIGINT AS angle FROM supplier")
def fixed_point(spark: SparkSession, sf: str) -> DataFrame:
    """Nu8, Nu9: fixed-point ratios and products, angles within a turn."""
    k = F.col("s_suppkey")
    ratio = N.fixed_ratio(k, F.lit(7), "half_up")
    return table(spark, sf, "supplier").select("s_suppkey", ratio.alias("ratio"), N.fixed_mul(ratio, F.lit(14), "half_up").alias("back"), N.normal_angle((k - 50) * 700001).alias("angle"))


@query()
def fixed_trigonometry(spark: SparkSession, sf: str) -> DataFrame:
    """Nu9, Nu10: correctly rounded sines and cosines, points turned by them."""
    k = F.col("s_suppkey") * 216_000
    s = table(spark, sf, "supplier").select("s_suppkey", N.fixed_sin(k).alias("sin"), N.fixed_cos(k).alias("cos"))
    x, y = N.affine([F.col("cos"), F.col("sin"), -F.col("sin"), F.col("cos"), F.lit(0).cast("long"), F.lit(0).cast("long")], F.lit(25_400_000).cast("long"), F.lit(0).cast("long"))
    return s.select("*", x.alias("x"), y.alias("y"))


@query("""WITH r AS (SELECT l_orderkey AS k, l_linenumber AS n, (l_partkey % 50)::BIGINT AS x0, (l_suppkey % 50)::BIGINT AS y0, (l_partkey % 50 + l_quantity)::BIGINT AS x1, (l_suppkey % 50 + 20)::BIGINT AS y1 FROM lineitem), a AS (SELECT * FROM r WHERE n = 1), b AS (SELECT * FROM r WHERE n = 2), j AS (SELECT a.k, greatest(a.x0, b.x0) AS x0, greatest(a.y0, b.y0) AS y0, least(a.x1, b.x1) AS x1, least(a.y1, b.y1) AS y1, least(a.x0, b.x0) AS ux0, greatest(a.x1, b.x1) AS ux1, a.x0 + 5 < a.x1 - 5 AS keeps, b.x0 >= a.x0 AND b.x0 < a.x1 AND b.y0 >= a.y0 AND b.y0 < a.y1 AS holds FROM a JOIN b USING (k))
SELECT k, CASE WHEN x0 < x1 AND y0 < y1 THEN (x1 - x0) * (y1 - y0) END AS area, ux1 - ux0 AS width, keeps, holds, count(*) AS n FROM j GROUP BY ALL""")
def rect_intersection(spark: SparkSession, sf: str) -> DataFrame:
    """Nu11: rectangles: common part, hull, inset, containment."""
    q = F.col("l_quantity").cast("long")
    r = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber", N.rect(F.col("l_partkey") % 50, F.col("l_suppkey") % 50, F.col("l_partkey") % 50 + q, F.col("l_suppkey") % 50 + 20).alias("r"))
    j = r.where("l_linenumber = 1").select("k", F.col("r").alias("a")).join(r.where("l_linenumber = 2").select("k", F.col("r").alias("b")), "k")
    c, u = N.intersection(F.col("a"), F.col("b")), N.union(F.col("a"), F.col("b"))
    out = j.select("k", ((c["x1"] - c["x0"]) * (c["y1"] - c["y0"])).alias("area"), (u["x1"] - u["x0"]).alias("width"), N.inset(F.col("a"), F.lit(5)).isNotNull().alias("keeps"), N.contains(F.col("a"), F.col("b.x0"), F.col("b.y0")).alias("holds"))
    return out.groupBy(*out.columns).agg(F.count("*").alias("n"))


@query("SELECT event_id, epoch_ms(ts::TIMESTAMP) // 86400000 AS days FROM events")
def civil_days(spark: SparkSession, sf: str) -> DataFrame:
    """Nu15: days since 1970 of RFC 3339 times."""
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return table(spark, sf, "events").select("event_id", N.days_of(stamp).cast("long").alias("days"))

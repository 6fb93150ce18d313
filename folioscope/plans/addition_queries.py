"""Relational queries beyond the reference: joins of every kind, grouping sets, windows, set operations, as-of and range joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import table
from .base import registry

QUERIES, SQL, query = registry()


def cents(c):
    """Money as whole cents in decimals, so that sums do not depend on their order."""
    return F.sum(c.cast("decimal(18,4)"))


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity::DECIMAL(18,4))::DOUBLE AS quantity, sum(l_extendedprice::DECIMAL(18,4))::DOUBLE AS price, sum((l_extendedprice * (1 - l_discount))::DECIMAL(18,4))::DOUBLE AS discounted, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def pricing_summary(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(cents(F.col("l_quantity")).cast("double").alias("quantity"), cents(F.col("l_extendedprice")).cast("double").alias("price"), cents(F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("double").alias("discounted"), F.count("*").alias("n"))


@query("SELECT n_name, sum((l_extendedprice * (1 - l_discount))::DECIMAL(18,4))::DOUBLE AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY 1")
def local_supplier_volume(spark: SparkSession, sf: str) -> DataFrame:
    t = lambda n: table(spark, sf, n)
    places = t("nation").join(t("region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name")
    suppliers = t("supplier").join(places, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_nationkey", "n_name")
    sold = t("customer").select("c_custkey", "c_nationkey").join(t("orders").select("o_orderkey", "o_custkey"), F.col("c_custkey") == F.col("o_custkey"))
    lines = t("lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice", "l_discount").join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    out = lines.join(sold, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
    return out.groupBy("n_name").agg(cents(F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("double").alias("revenue"))


@query("SELECT l_orderkey, sum((l_extendedprice * (1 - l_discount))::DECIMAL(18,4))::DOUBLE AS revenue, o_orderpriority FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1, 3 ORDER BY revenue DESC, l_orderkey LIMIT 10")
def top_orders(spark: SparkSession, sf: str) -> DataFrame:
    t = lambda n: table(spark, sf, n)
    o = t("customer").where("c_mktsegment = 'BUILDING'").select("c_custkey").join(t("orders").select("o_orderkey", "o_custkey", "o_orderpriority"), F.col("c_custkey") == F.col("o_custkey"))
    out = t("lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_orderkey", "o_orderpriority").agg(cents(F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("double").alias("revenue"))
    return out.orderBy(F.desc("revenue"), "l_orderkey").limit(10)


@query("SELECT n_regionkey, c_mktsegment, count(*) AS n, grouping(n_regionkey)::INT AS region_total, grouping(c_mktsegment)::INT AS segment_total FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY CUBE (n_regionkey, c_mktsegment)")
def rollup_cube(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.cube("n_regionkey", "c_mktsegment").agg(F.count("*").alias("n"), F.grouping("n_regionkey").cast("int").alias("region_total"), F.grouping("c_mktsegment").cast("int").alias("segment_total"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
def grouping_sets(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupingSets([["l_returnflag"], ["l_linestatus"], []], "l_returnflag", "l_linestatus").agg(F.count("*").alias("n")).select("l_returnflag", "l_linestatus", "n")


@query("SELECT o_custkey, o_orderkey, row_number() OVER w AS rn, rank() OVER w AS rk, dense_rank() OVER w AS dr, ntile(4) OVER w AS quarter, sum(o_totalprice::DECIMAL(18,4)) OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)::DOUBLE AS three FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)")
def rank_window(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey")
    return table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("rn"), F.rank().over(w).alias("rk"), F.dense_rank().over(w).alias("dr"), F.ntile(4).over(w).alias("quarter"), F.sum(F.col("o_totalprice").cast("decimal(18,4)")).over(w.rowsBetween(-2, 0)).cast("double").alias("three"))


@query("SELECT c_nationkey, c_custkey, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS k FROM customer) WHERE k <= 3")
def top_k_per_group(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return table(spark, sf, "customer").withColumn("k", F.row_number().over(w)).where("k <= 3").select("c_nationkey", "c_custkey", "c_acctbal")


@query("SELECT k, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier UNION ALL SELECT n_nationkey FROM nation EXCEPT ALL SELECT s_nationkey FROM supplier) GROUP BY k")
def set_operations(spark: SparkSession, sf: str) -> DataFrame:
    c, s, n = table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf, "supplier"), table(spark, sf, "nation").select("n_nationkey")
    both = c.intersect(s.select("s_nationkey")).unionAll(n)
    return both.exceptAll(s.select("s_nationkey")).groupBy("k").agg(F.count("*").alias("n"))


@query("SELECT count(*) FILTER (c_custkey IS NOT NULL AND o_custkey IS NOT NULL) AS both, count(*) FILTER (o_custkey IS NULL) AS customers_only, count(*) FILTER (c_custkey IS NULL) AS orders_only FROM (SELECT DISTINCT c_custkey FROM customer) FULL JOIN (SELECT DISTINCT o_custkey FROM orders) ON c_custkey = o_custkey")
def outer_join(spark: SparkSession, sf: str) -> DataFrame:
    c, o = table(spark, sf, "customer").select("c_custkey"), table(spark, sf, "orders").select("o_custkey").distinct()
    j = c.join(o, F.col("c_custkey") == F.col("o_custkey"), "full_outer")
    return j.agg(F.count_if(F.col("c_custkey").isNotNull() & F.col("o_custkey").isNotNull()).alias("both"), F.count_if(F.col("o_custkey").isNull()).alias("customers_only"), F.count_if(F.col("c_custkey").isNull()).alias("orders_only"))


@query("SELECT e.event_id, p.event_id AS before FROM events e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts > p.ts WHERE e.event_type = 'click'")
def asof_join(spark: SparkSession, sf: str) -> DataFrame:
    """Each click with its user's last purchase before it: both are one ordered sequence, so a running last value suffices; no pairs are made."""
    e = table(spark, sf, "events").where("event_type in ('click', 'purchase')")
    ordered = e.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    w = Window.partitionBy("user_id").orderBy("us").rangeBetween(Window.unboundedPreceding, -1)
    before = F.max(F.when(F.col("event_type") == "purchase", F.struct("us", "event_id"))).over(w)
    return ordered.withColumn("b", before).where("event_type = 'click'").select("event_id", F.col("b.event_id").alias("before"))


@query("SELECT p_partkey, count(*) AS n FROM part JOIN lineitem ON l_partkey = p_partkey AND l_quantity BETWEEN p_size - 2 AND p_size + 2 GROUP BY 1")
def range_join(spark: SparkSession, sf: str) -> DataFrame:
    p, li = table(spark, sf, "part").select("p_partkey", "p_size"), table(spark, sf, "lineitem").select("l_partkey", "l_quantity")
    return li.join(p, (F.col("l_partkey") == F.col("p_partkey")) & F.col("l_quantity").between(F.col("p_size") - 2, F.col("p_size") + 2)).groupBy("p_partkey").agg(F.count("*").alias("n"))


@query("SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS \"F\", count(*) FILTER (o_orderstatus = 'O') AS \"O\", count(*) FILTER (o_orderstatus = 'P') AS \"P\" FROM orders GROUP BY 1")
def pivoted(spark: SparkSession, sf: str) -> DataFrame:
    out = table(spark, sf, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))
    return out.na.fill(0)


@query("SELECT event_type, count(DISTINCT user_id) AS users, quantile_disc(value, 0.5) AS median, min(value) AS least, max(value) AS most FROM events GROUP BY 1")
def distinct_and_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY value)").alias("median"), F.min("value").alias("least"), F.max("value").alias("most"))


@query()
def approx_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.01).alias("parts"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts::TIMESTAMP) AS start, event_type, count(*) AS n, sum(value::DECIMAL(18,4))::DOUBLE AS total FROM events GROUP BY 1, 2")
def tumbling_counts(spark: SparkSession, sf: str) -> DataFrame:
    out = table(spark, sf, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("total"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")

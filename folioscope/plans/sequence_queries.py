"""Queries over ordered rows. Stand-ins: an order is a document and its line items its lines; events by user are a story."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import sequence as S
from ..sources.tables import table
from .base import registry

QUERIES, SQL, query = registry()


@query("SELECT conv_id, turn, coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM conversations")
def running_offsets(spark: SparkSession, sf: str) -> DataFrame:
    """Where each turn begins in the whole conversation."""
    return table(spark, sf, "conversations").select("conv_id", "turn", S.running_start(F.length("text") + 1, "conv_id", "turn").alias("start"))


@query("SELECT conv_id, turn, start, start + size AS \"end\" FROM (SELECT conv_id, turn, length(regexp_replace(text, '[^a-z]', '', 'g')) AS size, coalesce(sum(length(regexp_replace(text, '[^a-z]', '', 'g'))) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM conversations) WHERE size > 0")
def stream_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Spans of what is kept of each turn; empty ones take no part."""
    c = table(spark, sf, "conversations").withColumn("size", F.length(F.regexp_replace("text", "[^a-z]", "")))
    return c.withColumn("start", S.running_start(F.col("size"), "conv_id", "turn")).where("size > 0").select("conv_id", "turn", "start", (F.col("start") + F.col("size")).alias("end"))


E = "SELECT user_id AS doc, event_id AS seq, event_type AS mark FROM events"


@query(f"WITH e AS ({E}), c AS (SELECT *, CASE WHEN mark IS NOT DISTINCT FROM lag(mark) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS c FROM e WINDOW w AS (PARTITION BY doc ORDER BY seq)), g AS (SELECT *, sum(c) OVER (PARTITION BY doc ORDER BY seq) AS g FROM c) SELECT doc, g::BIGINT AS seq, any_value(mark) AS mark, string_agg(seq % 10, '' ORDER BY seq) AS text, count(*) AS parts FROM g GROUP BY doc, g")
def merge_adjacent(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbours with equal marks become one run."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("doc"), F.col("event_id").alias("o"), F.col("event_type").alias("mark"), (F.col("event_id") % 10).cast("string").alias("text"))
    return S.merge_adjacent(e, "doc", "o", "mark", "text")


@query("WITH x AS (SELECT o_custkey, o_orderkey, o_totalprice, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS previous FROM orders) SELECT o_custkey, o_orderkey FROM x WHERE o_totalprice <= previous")
def not_ascending(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that break an ascending order."""
    return S.not_ascending(table(spark, sf, "orders"), "o_custkey", "o_orderkey", "o_totalprice").select("o_custkey", "o_orderkey")


@query("SELECT user_id, event_id, first_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS paragraph FROM events")
def containing_item(spark: SparkSession, sf: str) -> DataFrame:
    """The first end at or after each item."""
    e = table(spark, sf, "events")
    return e.select("user_id", "event_id", S.containing(e, "user_id", "event_id", F.col("event_type") == "purchase", "event_id").alias("paragraph"))


@query("SELECT l_orderkey, l_suppkey, min(l_linenumber) AS l_linenumber FROM lineitem GROUP BY 1, 2")
def first_wins_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Of repeated identifiers the first in document order stays."""
    return S.first_wins(table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber"), ["l_orderkey", "l_suppkey"], "l_linenumber")


P = "SELECT user_id AS doc, event_id // 7 AS id, event_id AS pos, CASE WHEN event_type IN ('click', 'view') THEN 'start' WHEN event_type = 'purchase' THEN 'end' ELSE 'other' END AS kind FROM events"


@query(f"WITH p AS ({P}), g AS (SELECT doc, id, min(pos) FILTER (kind = 'start') AS first, max(pos) FILTER (kind = 'end') AS last FROM p GROUP BY 1, 2) SELECT doc, id, first, CASE WHEN last > first THEN last ELSE first END AS \"end\" FROM g WHERE first IS NOT NULL")
def range_pairing(spark: SparkSession, sf: str) -> DataFrame:
    """Ends count only after their start; a start alone is an empty range."""
    t = F.col("event_type")
    p = table(spark, sf, "events").select(F.col("user_id").alias("doc"), F.floor(F.col("event_id") / 7).alias("id"), F.col("event_id").alias("pos"), F.when(t.isin("click", "view"), "start").when(t == "purchase", "end").otherwise("other").alias("kind"))
    return S.pair_ranges(p, "doc", "id", "pos", "kind")


K = "CASE event_type WHEN 'purchase' THEN 'end' WHEN 'click' THEN 'block' ELSE 'text' END"


@query(f"WITH k AS (SELECT user_id, event_id, {K} AS kind FROM events), l AS (SELECT *, lag(kind) OVER (PARTITION BY user_id ORDER BY event_id) AS last FROM k) SELECT user_id, event_id, 0 AS part, 'end' AS kind, true AS inserted FROM l WHERE kind = 'block' AND last NOT IN ('end', 'block') UNION ALL SELECT user_id, event_id, CASE WHEN kind = 'block' AND last NOT IN ('end', 'block') THEN 1 ELSE 0 END, kind, false FROM l")
def block_split(spark: SparkSession, sf: str) -> DataFrame:
    """A paragraph end before blocks that lack one."""
    return S.split_blocks(table(spark, sf, "events").select("user_id", "event_id", F.expr(K).alias("kind")), "user_id", "event_id", "kind")


@query("SELECT user_id, event_id, event_type <> 'click' AND coalesce(max(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS inherits FROM events")
def section_inheritance(spark: SparkSession, sf: str) -> DataFrame:
    """Sections without references after one that has them."""
    return table(spark, sf, "events").select("user_id", "event_id", S.inherited(F.col("event_type") == "click", "user_id", "event_id").alias("inherits"))


FILL = "SELECT user_id, event_id, coalesce(last_value(s IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id), first_value(s IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 'Latin') AS script FROM (SELECT user_id, event_id, CASE WHEN event_type IN ('click', 'purchase') THEN event_type END AS s FROM events)"


def filled(spark: SparkSession, sf: str) -> DataFrame:
    s = F.when(F.col("event_type").isin("click", "purchase"), F.col("event_type"))
    return table(spark, sf, "events").select("user_id", "event_id", S.fill(s, "user_id", "event_id", F.lit("Latin")).alias("script"))


@query(FILL)
def script_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Open scripts take that before, then that after them."""
    return filled(spark, sf)


@query(f"WITH f AS ({FILL}), c AS (SELECT *, CASE WHEN script = lag(script) OVER (PARTITION BY user_id ORDER BY event_id) THEN 0 ELSE 1 END AS c FROM f), g AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS run FROM c) SELECT user_id, run, min(event_id) AS first, max(event_id) + 1 AS \"end\", any_value(script) AS script FROM g GROUP BY user_id, run")
def itemised_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of one script."""
    return S.itemize(filled(spark, sf), "user_id", "event_id", ["script"])


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, sum(1) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) * 10 AS hi FROM orders) SELECT o_custkey, o_orderkey, ((n - 1) * 10)::BIGINT AS lo, hi::BIGINT AS hi FROM r WHERE (n - 1) * 10 < 35 AND hi > 15")
def runs_in_range(spark: SparkSession, sf: str) -> DataFrame:
    """F8: runs that overlap a range of positions (each order ten characters, from 15 to 35)."""
    o = table(spark, sf, "orders").withColumn("lo", S.running_start(F.lit(10), "o_custkey", "o_orderkey"))
    return o.select("o_custkey", "o_orderkey", "lo", (F.col("lo") + 10).alias("hi")).where("lo < 35 and hi > 15")


@query(r"""WITH RECURSIVE c AS (SELECT conv_id, turn, list_filter(regexp_extract_all(text, '[^ \n]*(?: +|\n|$)'), lambda w: w <> '') AS w FROM conversations),
s AS (SELECT conv_id, turn, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM c),
g AS (SELECT conv_id, turn, i, sum(length(w)) OVER (PARTITION BY conv_id, turn ORDER BY i) AS e, length(replace(w, chr(10), '')) AS width, length(replace(w, chr(10), '')) - length(rtrim(replace(w, chr(10), ''), ' ')) AS hang, ends_with(w, chr(10)) AS must FROM s),
f AS (SELECT conv_id, turn, 1::BIGINT AS i, CASE WHEN must THEN 0 ELSE width END AS width, CASE WHEN NOT must THEN e END AS last, CASE WHEN must THEN [e] ELSE [] END AS ends FROM g WHERE i = 1
 UNION ALL SELECT g.conv_id, g.turn, g.i, CASE WHEN g.must THEN 0 WHEN f.last IS NOT NULL AND f.width + g.width - g.hang > 60 THEN g.width ELSE f.width + g.width END, CASE WHEN NOT g.must THEN g.e END,
 CASE WHEN f.last IS NOT NULL AND f.width + g.width - g.hang > 60 THEN list_append(f.ends, f.last) ELSE f.ends END || CASE WHEN g.must THEN [g.e] ELSE [] END FROM f JOIN g ON f.conv_id = g.conv_id AND f.turn = g.turn AND g.i = f.i + 1),
z AS (SELECT conv_id, turn, arg_max(CASE WHEN last IS NULL THEN ends ELSE list_append(ends, last) END, i) AS ends FROM f GROUP BY conv_id, turn)
SELECT conv_id, turn, coalesce(array_to_string(ends, ','), '') AS ends FROM conversations LEFT JOIN z USING (conv_id, turn)""")
def first_fit_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Ends of greedy lines of 60 characters of each turn, folded in the JVM."""
    ends = S.first_fit(S.segments(F.col("text")), F.lit(60).cast("long"))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(ends, ",").alias("ends"))


@query("""WITH RECURSIVE r AS (SELECT l_orderkey AS doc, l_linenumber AS line, round(l_extendedprice / 100)::BIGINT AS b, l_quantity::BIGINT AS s FROM lineitem), k AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY line, b, s) AS k FROM r),
f AS (SELECT doc, line, k, b, s, 0::BIGINT AS part FROM k WHERE k = 1 UNION ALL SELECT k.doc, k.line, k.k, CASE WHEN 2 * abs(k.b - f.b) <= greatest(k.s, f.s) AND k.s <= f.s THEN f.b ELSE k.b END, CASE WHEN 2 * abs(k.b - f.b) <= greatest(k.s, f.s) AND k.s <= f.s THEN f.s ELSE k.s END,
 CASE WHEN 2 * abs(k.b - f.b) <= greatest(k.s, f.s) THEN f.part ELSE f.part + 1 END FROM f JOIN k ON k.doc = f.doc AND k.k = f.k + 1) SELECT doc, line, part FROM f""")
def joined_line_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Lines whose baselines nearly agree become one, by a fold within each page (an order)."""
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("line"), F.round(F.col("l_extendedprice") / 100).cast("long").alias("baseline"), F.col("l_quantity").cast("long").alias("size"))

    def group(page: list[tuple]) -> list[tuple]:
        parts = S.joined_lines([r[1] for r in page], [r[2] for r in page])
        return [(r[0], p) for r, p in zip(page, parts, strict=True)]

    return S.fold(lines, "doc", "line", ["baseline", "size"], group, "line int, part long")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, CASE event_type WHEN 'click' THEN 'begin' WHEN 'view' THEN 'separate' WHEN 'purchase' THEN 'end' ELSE 'text' END AS kind, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
f AS (SELECT user_id, 0::BIGINT AS k, []::STRUCT(b BIGINT, s BIGINT)[] AS open, NULL::STRUCT(b BIGINT, s BIGINT) AS shut, NULL::BIGINT AS e FROM e WHERE k = 1
 UNION ALL SELECT e.user_id, e.k, CASE WHEN kind = 'begin' THEN list_append(open, {'b': event_id, 's': NULL::BIGINT}) WHEN kind = 'separate' AND len(open) > 0 AND open[-1].s IS NULL THEN list_append(open[:-2], {'b': open[-1].b, 's': event_id}) WHEN kind = 'end' AND len(open) > 0 THEN open[:-2] ELSE open END,
 CASE WHEN kind = 'end' AND len(open) > 0 THEN open[-1] END, CASE WHEN kind = 'end' AND len(open) > 0 THEN event_id END FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1),
m AS (SELECT shut.b AS event_id, shut.b AS field FROM f WHERE e IS NOT NULL UNION ALL SELECT shut.s, shut.b FROM f WHERE e IS NOT NULL AND shut.s IS NOT NULL UNION ALL SELECT e, shut.b FROM f WHERE e IS NOT NULL)
SELECT user_id, event_id, field FROM e LEFT JOIN m USING (event_id)""")
def field_brackets(spark: SparkSession, sf: str) -> DataFrame:
    """Field delimiters matched by a stack within each story (a user's events)."""
    kinds = F.expr("CASE event_type WHEN 'click' THEN 'begin' WHEN 'view' THEN 'separate' WHEN 'purchase' THEN 'end' ELSE 'text' END")
    e = table(spark, sf, "events").select("user_id", "event_id", kinds.alias("kind"))
    return S.fold_rows(e, "user_id", "event_id", ["kind"], S.matched_fields, "event_id long, field long")


@query()
def longest_increasing(spark: SparkSession, sf: str) -> DataFrame:
    """The longest ascending chain of each customer's order totals."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.round(F.col("o_totalprice")).cast("long").alias("v"))
    return S.fold(o, "o_custkey", "o_orderkey", ["v"], lambda rows: [rows[i] for i in S.increasing([r[1] for r in rows])], "o_orderkey long, v long")


@query("WITH x AS (SELECT l_orderkey AS doc, l_linenumber AS a, l_linenumber + (l_linenumber // 3) * 5 AS b FROM lineitem GROUP BY ALL), i AS (SELECT *, a - b AS diagonal, a - row_number() OVER (PARTITION BY doc, a - b ORDER BY a) AS island FROM x) SELECT doc, min(a) AS a, min(b) AS b, count(*) AS length FROM i GROUP BY doc, diagonal, island")
def diagonal_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Anchors on one diagonal that touch become a block."""
    n = F.col("l_linenumber")
    x = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc"), n.alias("a"), (n + F.floor(n / 3) * 5).alias("b")).distinct()
    w = Window.partitionBy("doc", F.col("a") - F.col("b")).orderBy("a")
    out = x.withColumn("island", F.col("a") - F.row_number().over(w)).groupBy("doc", (F.col("a") - F.col("b")).alias("diagonal"), "island").agg(F.min("a").alias("a"), F.min("b").alias("b"), F.count("*").alias("length"))
    return out.select("doc", "a", "b", "length")

"""Queries of comparison, normalization, operation logs and streams over stand-ins from the tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..operators import alignment as AL
from ..operators import model as M
from ..sources.tables import table
from ..streaming import oplog, windows
from .base import registry

QUERIES, SQL, query = registry()


def layout_of(rows: DataFrame, text: Column, cut: str, lines_a_page: int = 6) -> DataFrame:
    """A turn of a conversation as a layout: its parts between `cut` are lines, some lines a page."""
    parts = rows.select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("doc"), F.split(text, cut).alias("parts"))
    count = F.ceil(F.size("parts") / lines_a_page).cast("int")
    out = parts.select("doc", count.alias("page_count"), F.posexplode("parts").alias("n", "text"))
    return out.select("doc", "page_count", F.floor(F.col("n") / lines_a_page).cast("int").alias("page"), "n", "text").select("doc", "page_count", "page", F.col("n").alias("line"), (F.col("n") * 12_000).cast("long").alias("baseline"), F.lit(10_000).cast("long").alias("size"), "text")


def two_sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf, "conversations")
    return layout_of(c, F.col("text"), "[.] "), layout_of(c, F.regexp_replace(F.regexp_replace("text", " of ", " off "), "(?<=[a-z]), ", "­ "), "[.] |­ ")


@query()
def align_documents(spark: SparkSession, sf: str) -> DataFrame:
    """J9, AL1 to AL6: two renderings of each turn aligned, their page and line breaks matched."""
    return AL.compare_layouts(*two_sides(spark, sf))


def with_glyphs(lines: DataFrame, shift: int = 0) -> DataFrame:
    """A glyph for each character, 6 points wide, moved to the right by `shift` thousandths of a point."""
    place = lambda i: F.struct(i.alias("offset"), F.lit(1).alias("length"), (i.cast("long") * 6000 + shift).alias("x"), F.col("baseline").alias("y"))
    return lines.withColumn("glyphs", F.when(F.length("text") > 0, F.transform(F.sequence(F.lit(0), F.length("text") - 1), place)))


LINES_SQL = """WITH l AS (SELECT conv_id || ':' || turn AS doc, unnest(string_split(text, '. ')) AS line, generate_subscripts(string_split(text, '. '), 1) - 1 AS i FROM conversations),
n AS (SELECT doc, i, i // 6 AS page, length(regexp_replace(line, '[ \t-\r]', '', 'g')) AS n, max(i) OVER (PARTITION BY doc) AS last FROM l) """


@query(LINES_SQL + """SELECT doc, count(DISTINCT page) AS pages, count(DISTINCT page) FILTER (n > 0) AS m2_agreed, count(*) FILTER (n > 0) AS m3_agreed, count(*) FILTER (n > 0) AS m4_lines, sum(n)::BIGINT AS m4_glyphs,
CASE WHEN sum(n) > 0 THEN 500 END AS x_median, CASE WHEN sum(n) > 0 THEN 500 END AS x_most, CASE WHEN sum(n) > 0 THEN 0 END AS y_most, sum(n)::BIGINT AS text_matched FROM n GROUP BY doc""")
def compared_with_itself(spark: SparkSession, sf: str) -> DataFrame:
    """AL1 to AL6, AL8, J10: each turn against itself, glyphs half a point to the right: all breaks agree and all glyphs are measured."""
    lines = layout_of(table(spark, sf, "conversations"), F.col("text"), "[.] ")
    out = AL.compare_layouts(with_glyphs(lines), with_glyphs(lines, 500))
    return out.where("m2_total = m2_agreed and m3_total = m3_agreed and hunks <= 1").select("doc", F.col("pages_candidate").alias("pages"), "m2_agreed", "m3_agreed", "m4_lines", "m4_glyphs", "x_median", "x_most", "y_most", "text_matched")


@query(LINES_SQL + """SELECT doc, count(*) FILTER (n > 0) AS m3_total, count(*) FILTER (n > 0 AND i < last) AS m3_agreed, count(*) FILTER (n > 0 AND i < last) AS m4_lines, sum(n)::BIGINT AS text_reference, coalesce(sum(n) FILTER (i < last), 0)::BIGINT AS text_matched FROM n GROUP BY doc HAVING max(last) > 0""")
def compared_without_last_line(spark: SparkSession, sf: str) -> DataFrame:
    """AL1 to AL6: each turn against itself without its last line: what is left agrees, the last line's break does not."""
    lines = with_glyphs(layout_of(table(spark, sf, "conversations"), F.col("text"), "[.] "))
    last = lines.groupBy("doc").agg(F.max("line").alias("last")).where("last > 0")
    rest = lines.join(last, "doc").where("line < last").drop("last")
    out = AL.compare_layouts(lines.join(last.select("doc"), "doc", "left_semi"), rest)
    return out.select("doc", "m3_total", "m3_agreed", "m4_lines", "text_reference", "text_matched")


@query("SELECT conv_id || ':' || turn AS doc, length(regexp_replace(text, '[ \\t-\\r]', '', 'g')) - length(text) + length(replace(text, '. ', ' ')) AS kept FROM conversations")
def aligned_reference_length(spark: SparkSession, sf: str) -> DataFrame:
    """Stream: characters of the reference's side that are compared; the full stops at which lines are cut are no text."""
    return AL.compare_layouts(*two_sides(spark, sf)).select("doc", F.col("text_reference").alias("kept"))


@query()
def hint_agreement(spark: SparkSession, sf: str) -> DataFrame:
    """AL7: hinted page breaks, every 200 displayed characters, against the pages of the other rendering."""
    reference, candidate = two_sides(spark, sf)
    measure = lambda x, y: AL.hint_agreement(x.text, list(range(200, len(x.text), 200)), y)
    return AL.paired(reference, candidate, measure, "total long, agreed long, pages_reference long, pages_candidate long")


@query()
def visual_difference(spark: SparkSession, sf: str) -> DataFrame:
    """Visible differences of two grey rasters: a vector's, eight wide, and its own turned by one pixel."""
    @F.pandas_udf(StringType())
    def measure(vectors: pd.Series) -> pd.Series:
        def one(v: np.ndarray) -> str:
            a = np.clip(np.asarray(v, np.float64) * 400 + 128, 0, 255).astype(np.uint8)
            a = a[: len(a) // 8 * 8].reshape(-1, 8)
            b = np.roll(a, 1, axis=1)
            pixels, visible = AL.visual_difference(a, b)
            c = AL.image_comparison(a, b)
            return f"{pixels}:{visible}:{c['differing']}:{c['beyond_64']}:{c['largest']}"

        return vectors.map(one)

    return table(spark, sf, "embeddings").select("vec_id", measure("embedding").alias("difference"))


def raw_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Events as the runs of raw documents: a user's are a document of three stories; types become placeholders."""
    text = F.when(F.col("event_type") == "purchase", "\u0001").when(F.col("event_type") == "click", F.concat(F.lit("ab\u0005"), F.lit("c"))).when(F.col("event_type") == "view", "x\u0006\u0008y").otherwise("\u0004z\u0007")
    marks = F.create_map(F.lit("bind"), (F.col("event_id") % 40).cast("string"), F.lit("bold:1"), F.when(F.col("event_id") % 2 == 0, "on"), F.concat(F.lit("comment:"), (F.col("event_id") % 7).cast("string")), F.lit("on"))
    return table(spark, sf, "events").select(F.col("user_id").cast("string").alias("doc"), (F.col("event_id") % 3).cast("string").alias("story"), F.col("event_id").alias("seq"), text.alias("text"), marks.alias("marks"))


def registries(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    users = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("doc")).distinct()
    objects = users.select("doc", F.lit("object").alias("kind"), F.explode(F.sequence(F.lit(0), F.lit(29)).cast("array<string>")).alias("id"))
    return objects, users.select("doc", F.explode(F.array(F.lit("1"), F.lit("3"), F.lit("5"))).alias("id"))


@query("SELECT CASE WHEN event_type = 'purchase' THEN 'paragraph' WHEN event_type = 'click' THEN 'field_begin' WHEN event_type = 'view' THEN 'field_separate' ELSE 'object' END AS kind, count(*) AS n FROM events GROUP BY 1 UNION ALL SELECT 'field_end', count(*) FILTER (event_type NOT IN ('purchase', 'click', 'view')) FROM events UNION ALL SELECT 'text', (count(*) FILTER (event_type = 'click') * 3 + count(*) FILTER (event_type = 'view') * 2 + count(*) FILTER (event_type NOT IN ('purchase', 'click', 'view')))::BIGINT FROM events")
def decoded_items(spark: SparkSession, sf: str) -> DataFrame:
    """M2: raw runs decoded into items, by kind; stray control characters vanish."""
    return M.items(raw_runs(spark, sf)).groupBy("kind").agg(F.count("*").alias("n"))


@query()
def normalise_documents(spark: SparkSession, sf: str) -> DataFrame:
    """What normalization repaired in each document."""
    objects, comments = registries(spark, sf)
    return M.normalise(raw_runs(spark, sf), objects, comments)[1]


@query("SELECT NULL::VARCHAR AS doc, NULL::VARCHAR AS invariant WHERE false")
def broken_invariants(spark: SparkSession, sf: str) -> DataFrame:
    """M6: invariants that a normalized document breaks; there are none."""
    objects, comments = registries(spark, sf)
    return M.invariants(M.normalise(raw_runs(spark, sf), objects, comments)[0], objects)


@query()
def story_texts(spark: SparkSession, sf: str) -> DataFrame:
    """St25: the plain text of each normalized story, fields by their results."""
    objects, comments = registries(spark, sf)
    return M.plain_text(M.normalise(raw_runs(spark, sf), objects, comments)[0])


@query("SELECT p_partkey::VARCHAR AS doc, p_brand AS id, CASE WHEN p_size > 25 THEN 11906 ELSE p_size * 100 END::BIGINT AS width, 16838::BIGINT AS height, CASE WHEN p_size % 2 = 0 THEN 1440 ELSE p_size END::BIGINT AS margin_left, 1440::BIGINT AS margin_right, 1440::BIGINT AS margin_top, 1440::BIGINT AS margin_bottom FROM part")
def section_defaults(spark: SparkSession, sf: str) -> DataFrame:
    """M5: section properties that are missing or out of range take their default."""
    size = F.col("p_size")
    props = F.create_map(F.lit("width"), F.when(size > 25, "-1").otherwise((size * 100).cast("string")), F.lit("height"), F.lit("tall"), F.lit("margin_left"), F.when(size % 2 == 0, F.lit(None)).otherwise(size.cast("string")))
    return M.sections(table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("doc"), F.col("p_brand").alias("id"), props.alias("props")))


@query("WITH c AS (SELECT l_orderkey AS doc, l_suppkey AS row, min((l_partkey, l_linenumber)) AS x FROM lineitem GROUP BY 1, 2) SELECT l_orderkey AS doc, count(DISTINCT l_suppkey) AS rows FROM lineitem GROUP BY 1")
def tables_kept(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of tables that keep a cell (an order is a table, its suppliers rows, its lines cells)."""
    lines = table(spark, sf, "lineitem")
    rows = lines.groupBy(F.col("l_orderkey").alias("doc"), F.col("l_suppkey").cast("string").alias("child")).agg(F.min("l_linenumber").alias("pos")).withColumn("parent", F.lit("t"))
    cells = lines.select(F.col("l_orderkey").alias("doc"), F.col("l_suppkey").cast("string").alias("parent"), F.col("l_linenumber").alias("pos"), F.concat_ws("-", "l_suppkey", "l_partkey", "l_linenumber").alias("child"))
    return M.tables(rows.select("doc", "parent", "pos", "child"), cells)[0].groupBy("doc").agg(F.count("*").alias("rows"))


@query()
def edited_stories(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's events as edits of a story, folded in order."""
    e, k = table(spark, sf, "events"), F.col("event_id")
    op = F.element_at(F.array(*(F.lit(x) for x in ("insert", "insert", "insert", "delete", "format", "split", "merge", "move", "clear", "unknown"))), (k % 10 + 1).cast("int"))
    return M.edited(e.select(F.col("user_id").alias("story"), k.alias("seq"), op.alias("op"), (k % 23).cast("int").alias("at"), (k % 23 + k % 5).cast("int").alias("to"), F.when(k % 10 == 7, "2").otherwise(F.concat(F.lit("bold"), (k % 3).cast("string"))).alias("value")))


def log(spark: SparkSession, sf: str) -> DataFrame:
    return oplog.changes(table(spark, sf, "events").select("user_id", "event_id"), "user_id", "event_id")


LOG = "WITH log AS (SELECT user_id AS peer, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS counter FROM events), half AS (SELECT peer, max(counter) AS known FROM log WHERE event_id % 1000 < 500 AND peer % 3 <> 0 GROUP BY peer) "


def half_vector(spark: SparkSession, sf: str) -> DataFrame:
    return oplog.version_vector(log(spark, sf).where("event_id % 1000 < 500 and peer % 3 <> 0"))


@query(LOG + "SELECT peer, max(counter) AS counter FROM log GROUP BY peer")
def version_vector(spark: SparkSession, sf: str) -> DataFrame:
    """SS1, A23."""
    return oplog.version_vector(log(spark, sf))


@query(LOG + "SELECT log.peer, event_id, counter FROM log LEFT JOIN half USING (peer) WHERE counter > coalesce(known, -1)")
def updates_since(spark: SparkSession, sf: str) -> DataFrame:
    """SS1, K9: what a replica lacks."""
    return oplog.updates_since(log(spark, sf), half_vector(spark, sf))


@query(LOG + "SELECT log.peer, event_id, counter FROM log JOIN half USING (peer) WHERE counter <= known")
def checkout_version(spark: SparkSession, sf: str) -> DataFrame:
    """SS5: the log as it was."""
    return oplog.checkout(log(spark, sf), half_vector(spark, sf))


@query(LOG + "SELECT peer, event_id, counter FROM log")
def merged_logs(spark: SparkSession, sf: str) -> DataFrame:
    """SS3: two overlapping logs, in whichever order, make one."""
    all_ = log(spark, sf)
    return oplog.merged(all_.where("event_id % 3 <> 0"), all_.where("event_id % 2 = 0 or event_id % 3 = 0"))


@query(LOG + ", inc AS (SELECT * FROM log WHERE event_id % 7 <> 0), have AS (SELECT peer, max(counter) AS k FROM log WHERE counter < 5 GROUP BY peer), f AS (SELECT inc.*, coalesce(k, -1) AS k FROM inc LEFT JOIN have USING (peer) WHERE counter > coalesce(k, -1)), j AS (SELECT peer, counter = k + row_number() OVER (PARTITION BY peer ORDER BY counter) AS ready FROM f) SELECT peer, count(*) FILTER (ready) AS applied, count(*) FILTER (NOT ready) AS pending FROM j GROUP BY peer")
def pending_changes(spark: SparkSession, sf: str) -> DataFrame:
    """SS2: imported changes that can be applied, and those that wait for a missing one."""
    all_ = log(spark, sf)
    applied, pending = oplog.importable(all_.where("counter < 5"), all_.where("event_id % 7 <> 0"))
    rows = applied.select("peer", F.lit(1).alias("a"), F.lit(0).alias("p")).unionByName(pending.select("peer", F.lit(0).alias("a"), F.lit(1).alias("p")))
    return rows.groupBy("peer").agg(F.sum("a").alias("applied"), F.sum("p").alias("pending"))


@query(LOG + "SELECT peer, event_id, counter FROM log WHERE peer = 7 ORDER BY counter DESC LIMIT 1000")
def undo_steps(spark: SparkSession, sf: str) -> DataFrame:
    """SS6: a peer's own last steps."""
    return oplog.undo_stack(log(spark, sf), 7)


@query(LOG + "SELECT peer AS path, count(*) AS entries, min(event_id) FILTER (event_id % 101 = 0) AS first_difference FROM log GROUP BY peer")
def replay_first_difference(spark: SparkSession, sf: str) -> DataFrame:
    """SS7: the first entry of each recording whose digest a replay does not give."""
    from ..sources.files import replay_difference

    entries = log(spark, sf).select(F.col("peer").alias("path"), F.col("event_id").alias("seq"), F.sha2(F.col("event_id").cast("string"), 256).alias("digest"))
    return replay_difference(entries, entries.withColumn("digest", F.when(F.col("seq") % 101 == 0, "other").otherwise(F.col("digest"))))


@query("WITH f AS (SELECT *, lead(role) OVER w AS nr, lead(turn) OVER w AS nt FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, turn, CASE WHEN nr = 'assistant' THEN nt END AS reply FROM f WHERE role = 'user'")
def request_replies(spark: SparkSession, sf: str) -> DataFrame:
    """SS10: requests with their answers."""
    return oplog.replies(table(spark, sf, "conversations"))


@query()
def session_protocol_state(spark: SparkSession, sf: str) -> DataFrame:
    """SS8, SS4: turns that a session's state machine accepts, as a stream with state by session."""
    return windows.run_to_end(oplog.sessions(windows.stream_of(spark, f"{sf}/conversations.parquet")))


@query("SELECT user_id AS peer, count(*) AS applied FROM events GROUP BY 1")
def stream_delivery(spark: SparkSession, sf: str) -> DataFrame:
    """SS2, SS9: changes that arrive out of order, each applied once its peer's earlier ones are; state by peer."""
    at = windows.folder(spark)
    out = log(spark, sf).select("peer", "counter").orderBy(F.xxhash64("event_id"))
    out.write.parquet(f"{at}/in")
    stream = windows.stream_of(spark, f"{at}/in/")
    return windows.run_to_end(oplog.delivered(stream)).where("status = 'applied'").groupBy("peer").agg(F.count("*").alias("applied"))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts::TIMESTAMP) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING start + INTERVAL 1 DAY <= (SELECT max(ts)::TIMESTAMP FROM events) - INTERVAL 2 HOUR")
def stream_tumbling_counts(spark: SparkSession, sf: str) -> DataFrame:
    """SS11: counts by day and type of a stream; a day is given out once the watermark has passed it."""
    out = windows.run_to_end(windows.tumbling(windows.stream_of(spark, f"{sf}/events.parquet"), "1 day", "2 hours", "event_type"))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("WITH l AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM l) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS \"end\", count(*) AS n FROM s GROUP BY user_id, s")
def session_windows(spark: SparkSession, sf: str) -> DataFrame:
    """SS11: sessions of each user, apart by pauses of six hours."""
    return windows.by_session(table(spark, sf, "events"), "6 hours", "1 hour", "user_id")


@query("""WITH RECURSIVE e AS (SELECT user_id AS peer, event_id AS seq, CASE event_type WHEN 'click' THEN 'undo' WHEN 'view' THEN 'redo' ELSE 'edit' END AS kind, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
f AS (SELECT peer, 0::BIGINT AS k, NULL::BIGINT AS seq, NULL::BIGINT AS step, []::BIGINT[] AS done, []::BIGINT[] AS undone FROM e WHERE k = 1
 UNION ALL SELECT e.peer, e.k, e.seq, CASE WHEN kind = 'edit' THEN e.seq WHEN kind = 'undo' AND len(done) > 0 THEN done[-1] WHEN kind = 'redo' AND len(undone) > 0 THEN undone[-1] END,
 CASE WHEN kind = 'edit' THEN list_append(done, e.seq) WHEN kind = 'undo' AND len(done) > 0 THEN done[:-2] WHEN kind = 'redo' AND len(undone) > 0 THEN list_append(done, undone[-1]) ELSE done END,
 CASE WHEN kind = 'edit' THEN [] WHEN kind = 'undo' AND len(done) > 0 THEN list_append(undone, done[-1]) WHEN kind = 'redo' AND len(undone) > 0 THEN undone[:-2] ELSE undone END FROM f JOIN e ON e.peer = f.peer AND e.k = f.k + 1)
SELECT peer, seq, step, len(done) AS can_undo, len(undone) AS can_redo FROM f WHERE k > 0""")
def undo_redo_steps(spark: SparkSession, sf: str) -> DataFrame:
    """SS6: steps done, undone and redone by each peer (a user's clicks undo, views redo, the rest are edits)."""
    kind = F.expr("CASE event_type WHEN 'click' THEN 'undo' WHEN 'view' THEN 'redo' ELSE 'edit' END")
    return oplog.undo_redo(table(spark, sf, "events").select(F.col("user_id").alias("peer"), F.col("event_id").alias("seq"), kind.alias("kind")))


@query("SELECT c_custkey AS seed, 60::BIGINT AS edits, '' AS broken FROM customer")
def simulated_documents(spark: SparkSession, sf: str) -> DataFrame:
    """A document under sixty random edits for each customer's key; no invariant may break."""
    out = M.simulated(table(spark, sf, "customer").select(F.col("c_custkey").alias("seed")), 60)
    return out.select("seed", (F.col("applied") + F.col("refused")).alias("edits"), "broken")

"""File sources and sinks of the catalogue: manifest, exclusions, layouts, words, recordings, summaries, content store."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ids as I  # noqa: E741
from ..functions import text as T

PLACE = "struct<source:string,path:string>"
SCAN = "struct<tagger:int,features:array<string>,fonts:array<string>,languages:array<string>,scripts:map<string,bigint>,compatibility:struct<mode:int,options:array<string>>,application:string,pages_hint:int,notes:array<string>>"
DOCUMENT = f"struct<sha256:string,size:bigint,tier:string,license:string,provenance:array<{PLACE}>,scan:{SCAN},page_count:int,ground_truth:struct<status:string,word_build:string>,notes:string>"
SOURCE = "struct<url:string,revision:string,license:string,copyright:string,license_texts:array<struct<path:string,sha256:string>>,notes:string>"
MANIFEST = f"format string, version int, sources map<string,{SOURCE}>, documents array<{DOCUMENT}>"


def read_manifest(spark: SparkSession, path: str, version: int = 1) -> tuple[DataFrame, DataFrame]:
    """(documents, sources) of a manifest. Malformed JSON, another format or version, and unknown fields fail when read."""
    whole = spark.read.text(path, wholetext=True)
    parsed = whole.select(F.from_json("value", MANIFEST, {"mode": "FAILFAST"}).alias("m"), F.json_object_keys("value").alias("keys"))
    known = {"format", "version", "sources", "documents"}
    right = (F.col("m.format") == "corpus-manifest") & (F.col("m.version") == version) & F.forall("keys", lambda k: k.isin(*known))
    checked = parsed.where(F.assert_true(right, F.lit("not a manifest of this version")).isNull())
    documents = checked.select(F.explode("m.documents").alias("d")).select("d.*")
    sources = checked.select(F.explode("m.sources").alias("name", "s")).select("name", "s.*")
    return documents, sources


def write_manifest(documents: DataFrame, sources: DataFrame, path: str, version: int = 1) -> None:
    """The same catalogue always gives the same bytes: documents by digest, lists sorted, two spaces, a final line feed.

    A manifest is one file by its format, so its rows come to the driver; they are streamed, not held at once.
    """
    with open(path, "w", encoding="utf-8") as out:
        named = {r["name"]: json.loads(r["j"]) for r in sources.select("name", F.to_json(F.struct(*(c for c in sources.columns if c != "name"))).alias("j")).toLocalIterator()}
        head = json.dumps({"format": "corpus-manifest", "version": version, "sources": dict(sorted(named.items()))}, indent=2, ensure_ascii=False)
        out.write(head[: head.rindex("}")].rstrip() + ',\n  "documents": [')
        for i, row in enumerate(documents.orderBy("sha256").select(F.to_json(F.struct(*documents.columns)).alias("j")).toLocalIterator()):
            text = json.dumps(json.loads(row["j"]), indent=2, ensure_ascii=False)
            out.write((",\n" if i else "\n") + "\n".join("    " + line for line in text.splitlines()))
        out.write("\n  ]\n}\n")


def read_exclusions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(exclusions, problems) of a TSV list: sha256, source, path, reason; problems have the line and what is wrong with it."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", "\n$", ""), "\n")).alias("at", "line"))
    header = "sha256\tsource\tpath\treason"
    parts = F.split("line", "\t")
    rows = lines.select((F.col("at") + 1).alias("number"), "line", parts.alias("p"))
    body = rows.where("number > 1")
    order = Window.orderBy("number")  # one file of exclusions, written and read by hand
    keyed = body.withColumn("before", F.lag(F.col("p")[0]).over(order))
    wrong = F.when(F.col("line").contains("\r"), "carriage return").when(F.size("p") != 4, "not four fields").when(~F.col("p")[0].rlike("^[0-9a-f]{64}$"), "no digest").when(F.col("p")[0] == F.col("before"), "twice").when(F.col("p")[0] < F.col("before"), "not sorted")
    problems = keyed.select("number", wrong.alias("problem")).where("problem is not null")
    head = rows.where((F.col("number") == 1) & (F.col("line") != header)).select("number", F.lit("header").alias("problem"))
    good = body.where(F.size("p") == 4).select(*(F.col("p")[i].alias(n) for i, n in enumerate(header.split("\t"))))
    return good, problems.unionByName(head)


LAYOUT = "doc string, source string, producer string, text_offsets string, line_coverage string, pages array<struct<width:double,height:double,lines:array<struct<start:bigint,`end`:bigint,text:string,direction:string,baseline:double,glyphs:array<struct<offset:int,length:int,x:double,y:double,advance:double,font:int,size:double,gid:int>>>>>>"


def read_layouts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(lines, glyphs) of layouts as JSON lines; lengths become thousandths of a point, exactly as written to three decimals."""
    raw = spark.read.schema(LAYOUT).json(path, mode="FAILFAST")
    milli = lambda c: F.round(c * 1000).cast("long")
    pages = raw.select("doc", "source", F.size("pages").alias("page_count"), F.posexplode("pages").alias("page", "p"))
    lines = pages.select("doc", "source", "page_count", "page", F.posexplode("p.lines").alias("line", "l"))
    glyphs = lines.select("doc", "source", "page", "line", F.posexplode("l.glyphs").alias("idx", "g")).select("doc", "source", "page", "line", "idx", "g.offset", "g.length", milli(F.col("g.x")).alias("x"), milli(F.col("g.y")).alias("y"), milli(F.col("g.advance")).alias("advance"), "g.font", milli(F.col("g.size")).alias("size"), "g.gid")
    largest = milli(F.array_max(F.transform("l.glyphs", lambda g: g["size"])))
    return lines.select("doc", "source", "page_count", "page", "line", "l.start", F.col("l.end").alias("end"), "l.text", "l.direction", milli(F.col("l.baseline")).alias("baseline"), largest.alias("size")), glyphs


def layout_violations(lines: DataFrame, glyphs: DataFrame) -> DataFrame:
    """(doc, page, line, rule): lines that do not follow each other, glyphs that reach beyond their text or are not in its order."""
    from ..operators.sequence import running_start

    numbered = lines.withColumn("order", F.col("page") * 1_000_000 + F.col("line"))
    expected = numbered.withColumn("expected", running_start(F.coalesce(F.length("text"), F.lit(0)) + 1, "doc", "order"))
    offsets = expected.where("start is not null and start <> expected").select("doc", "page", "line", F.lit("start").alias("rule"))
    ends = expected.where("start is not null and text is not null and `end` <> start + length(text)").select("doc", "page", "line", F.lit("end").alias("rule"))
    size = F.length("text")
    own = glyphs.join(lines.select("doc", "page", "line", "text"), ["doc", "page", "line"])
    beyond = own.where((F.col("offset") < 0) | (F.col("length") < 1) | (F.col("offset") + F.col("length") > size)).select("doc", "page", "line", F.lit("glyph beyond text").alias("rule"))
    order = Window.partitionBy("doc", "page", "line").orderBy("idx")
    unordered = glyphs.withColumn("before", F.lag("offset").over(order)).where("offset < before").select("doc", "page", "line", F.lit("glyphs not in order").alias("rule"))
    flat = own.where("size <= 0 or advance < 0").select("doc", "page", "line", F.lit("size").alias("rule"))
    return offsets.unionByName(ends).unionByName(beyond).unionByName(unordered).unionByName(flat).distinct()


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """(page, x_min, x_max, word) of a tab-separated list of word positions."""
    return spark.read.csv(path, sep="\t", quote="", schema="page int, x_min double, x_max double, word string")


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """(name, value, unit) of lines `metric name value unit`; other lines are not metrics."""
    p = F.split("value", " ")
    rows = spark.read.text(path).where("value like 'metric %'").select(p.alias("p")).where("size(p) = 4")
    return rows.select(F.col("p")[1].alias("name"), F.col("p")[2].try_cast("double").alias("value"), F.col("p")[3].alias("unit"))


ENTRY = "array<struct<seq:bigint,t_ms:bigint,kind:string,text:string,base64:string,width:int,height:int,digest:string>>"


def read_recordings(spark: SparkSession, path: str, most_bytes: int = 64 << 20, most_entries: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """(entries, refused) of session recordings, one JSON file each; beyond the limits a recording is refused with a reason, not cut."""
    files = spark.read.format("binaryFile").load(path).select("path", "length", F.decode("content", "UTF-8").alias("text"))
    parsed = files.withColumn("r", F.from_json("text", f"format string, entries {ENTRY}"))
    reason = F.when(F.col("length") > most_bytes, "too long").when(F.col("r.entries").isNull(), "not a recording").when(F.size("r.entries") > most_entries, "too many entries")
    judged = parsed.withColumn("reason", reason)
    entries = judged.where("reason is null").select("path", F.explode("r.entries").alias("e")).select("path", "e.*")
    return entries, judged.where("reason is not null").select("path", "reason")


def replay_difference(recorded: DataFrame, replayed: DataFrame, key: str = "path") -> DataFrame:
    """(key, entries, first_difference): the least seq whose digest differs or is missing on a side, null if none."""
    both = recorded.select(key, "seq", F.col("digest").alias("a")).join(replayed.select(key, "seq", F.col("digest").alias("b")), [key, "seq"], "full_outer")
    return both.groupBy(key).agg(F.count("a").alias("entries"), F.min(F.when(~F.col("a").eqNullSafe(F.col("b")), F.col("seq"))).alias("first_difference"))


SUMMARY = "version int, title string, documents array<struct<sha256:string,digest:string,pages_match:boolean,m2:array<array<bigint>>,m3:array<array<bigint>>,m7:array<array<bigint>>>>"


def read_summary(spark: SparkSession, path: str, version: int = 1) -> tuple[DataFrame, DataFrame]:
    """(documents, problems) of a baseline summary: unknown version, documents twice, ranges that are empty or touch."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", SUMMARY, {"mode": "FAILFAST"}).alias("s"))
    docs = raw.select(F.explode("s.documents").alias("d")).select("d.*")

    def formed(name: str) -> Column:
        r = F.col(name)
        own = F.forall(r, lambda x: (F.size(x) == 2) & (x[0] < x[1]))
        apart = F.forall(F.transform(r, lambda x, i: (i == 0) | (F.try_element_at(r, i)[1] < x[0])), lambda ok: F.coalesce(ok, F.lit(False)))
        return F.coalesce(own & apart, F.lit(True))

    version_ = raw.where(F.col("s.version") != version).select(F.lit(None).cast("string").alias("sha256"), F.lit("version").alias("problem"))
    twice = docs.groupBy("sha256").count().where("count > 1").select("sha256", F.lit("twice").alias("problem"))
    ranges = docs.where(~(formed("m2") & formed("m3") & formed("m7"))).select("sha256", F.lit("ranges").alias("problem"))
    spread = lambda n: F.flatten(F.transform(n, lambda x: F.sequence(x[0], x[1] - 1))).alias(n)
    return docs.select("sha256", "digest", "pages_match", spread("m2"), spread("m3"), spread("m7")), version_.unionByName(twice).unionByName(ranges)


#: Bytes of content in a batch that leaves Python; one object may be more.
BATCH_BYTES = 8 << 20


def read_store(spark: SparkSession, root: str, most_bytes: int = 512 << 20) -> DataFrame:
    """(sha256, path, length, content) of a content store's objects, empty ones too; a few at a time in a task."""
    import pyarrow as pa

    def read(batches):
        files, base = store_filesystem(root)
        for batch in batches:
            at, held = 0, []
            for i, path in enumerate(batch.column(1).to_pylist()):
                with files.open_input_stream(f"{base}/{path[len(root) + 1 :]}", compression=None) as stream:
                    held.append(stream.read())
                if i + 1 == batch.num_rows or sum(map(len, held)) > BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([*batch.slice(at, len(held)).columns, pa.array(held, pa.binary())], ["sha256", "path", "length", "content"])
                    at, held = i + 1, []

    keyed = list_store(spark, root).where(F.col("length") <= most_bytes).select(I.key_digest(F.col("path")).alias("sha256"), "path", "length")
    return keyed.where("sha256 is not null").mapInArrow(read, "sha256 string, path string, length long, content binary")


def list_store(spark: SparkSession, root: str) -> DataFrame:
    """(path, length) of every object, empty ones too, without reading content: each folder of objects is listed by a task.

    Spark's own file sources leave out files without bytes.
    """
    import pyarrow as pa
    from pyspark.sql.types import StringType, StructField, StructType

    def find(batches):
        from pyarrow import fs

        files, base = store_filesystem(root)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                found = [i for i in files.get_file_info(fs.FileSelector(f"{base}/{folder}", recursive=True)) if i.type == fs.FileType.File and i.base_name[0] not in "._"]
                yield pa.RecordBatch.from_arrays([pa.array([f"{root}/{i.path.removeprefix(base).lstrip('/')}" for i in found], pa.string()), pa.array([i.size for i in found], pa.int64())], ["path", "length"])

    from pyarrow import fs

    files, base = store_filesystem(root)
    inside = files.get_file_info(fs.FileSelector(f"{base}/objects", allow_not_found=True))
    folders = [(f"objects/{i.base_name}",) for i in inside if i.type == fs.FileType.Directory]
    rows = spark.createDataFrame(folders, StructType([StructField("folder", StringType())]))
    return rows.repartition(max(1, min(len(folders), 4 * spark.sparkContext.defaultParallelism))).mapInArrow(find, "path string, length long")


def store_problems(spark: SparkSession, root: str, expected: DataFrame) -> DataFrame:
    """(sha256, problem) of a store against the documents expected (sha256, size): missing, unexpected, wrong size, wrong content."""
    have = read_store(spark, root).select("sha256", "length", F.sha2("content", 256).alias("found"))
    both = expected.select("sha256", "size").join(have, "sha256", "full_outer")
    problem = F.when(F.col("found").isNull(), "missing").when(F.col("size").isNull(), "unexpected").when(F.col("length") != F.col("size"), "size").when(F.col("found") != F.col("sha256"), "content")
    return both.select("sha256", problem.alias("problem")).where("problem is not null")


def store_filesystem(root: str):
    """(file system, path) of a store's root: a path, or a URI of file, hdfs or s3."""
    from pyarrow import fs

    if root.startswith("file:"):
        return fs.LocalFileSystem(), "/" + root[5:].lstrip("/")
    return fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)


def put_objects(objects: DataFrame, root: str) -> DataFrame:
    """Write (content) into a store that all executors share, by path or URI, and give (sha256, written); null content is left out.

    An object appears whole or not at all: a new file is renamed into place, and object stores show a finished upload only. The
    same content written twice, by a task that runs again or by two at once, is the same object.
    """
    import pyarrow as pa

    def write(batches):
        import hashlib

        from pyarrow import fs

        files, base = store_filesystem(root)
        for batch in batches:
            done = []
            for content in batch.column(0).to_pylist():
                if content is None:
                    continue
                digest = hashlib.sha256(content).hexdigest()
                folder, target = f"{base}/objects/{digest[:2]}", f"{base}/objects/{digest[:2]}/{digest[2:]}"
                new = files.get_file_info(target).type == fs.FileType.NotFound
                if new:
                    files.create_dir(folder, recursive=True)
                    direct = isinstance(files, fs.S3FileSystem)
                    place = target if direct else f"{base}/new-{uuid.uuid4().hex}"
                    with files.open_output_stream(place, compression=None) as out:
                        out.write(content)
                    if not direct:
                        files.move(place, target)
                done.append((digest, new))
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in done]), pa.array([n for _, n in done])], ["sha256", "written"])

    return objects.select("content").mapInArrow(write, "sha256 string, written boolean")


def write_layouts(lines: DataFrame, glyphs: DataFrame, path: str) -> None:
    """Layouts as JSON lines, the form that read_layouts reads: one document a line, lengths in points to three decimals, nulls left out.

    A document's lines and glyphs meet by equi-joins and become one row, as its layout is one object.
    """
    points = lambda c: (F.col(c) / F.lit(1000)).alias(c)
    glyph = F.struct("idx", "offset", "length", points("x"), points("y"), points("advance"), "font", points("size"), "gid")
    by_line = glyphs.groupBy("doc", "source", "page", "line").agg(F.transform(F.array_sort(F.collect_list(glyph)), lambda g: g.dropFields("idx")).alias("glyphs"))
    joined = lines.drop("size").join(by_line, ["doc", "source", "page", "line"], "left")
    line = F.struct("line", "start", "end", "text", "direction", points("baseline"), "glyphs")
    pages = joined.groupBy("doc", "source", "page").agg(F.max("page_count").alias("n"), F.transform(F.array_sort(F.collect_list(line), lambda a, b: F.when(a["line"] < b["line"], -1).otherwise(1)), lambda x: x.dropFields("line")).alias("lines"))
    docs = pages.groupBy("doc", "source").agg(F.max("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("page", F.struct("lines")))).alias("by"))
    empty = F.struct(F.filter(F.map_values("by")[0]["lines"], lambda x: F.lit(False)).alias("lines"))
    whole = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.coalesce(F.try_element_at("by", i), empty))
    docs.select(F.to_json(F.struct("doc", "source", whole.alias("pages"))).alias("value")).write.mode("overwrite").text(path)


def write_recordings(entries: DataFrame, path: str) -> None:
    """Session recordings (session, seq, t_ms, kind, text, base64, width, height, digest), one JSON object a line and session, entries in order."""
    entry = F.struct("seq", "t_ms", "kind", "text", "base64", "width", "height", "digest")
    rows = entries.groupBy("session").agg(F.array_sort(F.collect_list(entry), lambda a, b: F.when(a["seq"] < b["seq"], -1).otherwise(1)).alias("entries"))
    rows.select(F.to_json(F.struct(F.lit("recording").alias("format"), "session", "entries")).alias("value")).write.mode("overwrite").text(path)


def stats_json(tables: dict[str, DataFrame]) -> str:
    """Statistics as one JSON object: an array of rows for each table, which are as long as there are names, not documents."""
    return json.dumps({name: [json.loads(r["j"]) for r in df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("j")).collect()] for name, df in tables.items()}, indent=2, ensure_ascii=False) + "\n"


def markdown_report(stats: DataFrame, title: str) -> str:
    """A table of (name, documents, share), which is as long as there are names."""
    rows = stats.select(T.markdown_escape(F.col("name")).alias("name"), "documents", "share").collect()
    lines = [f"# {title}", "", "| Name | Documents | Share |", "|---|---:|---:|", *(f"| {r['name']} | {'–' if r['documents'] is None else r['documents']} | {r['share']} |" for r in rows)]
    return "\n".join(lines) + "\n"


def html_report(tables: dict[str, DataFrame]) -> str:
    """Tables of a summary as a page; every value is escaped."""
    parts = ["<!DOCTYPE html><html><head><meta charset=\"utf-8\"><title>Summary</title></head><body>"]
    for title, df in tables.items():
        shown = df.select(*(T.html_escape(F.coalesce(F.col(c).cast("string"), F.lit("–"))).alias(c) for c in df.columns)).collect()
        parts.append(f"<h2>{title}</h2><table><tr>" + "".join(f"<th>{c}</th>" for c in df.columns) + "</tr>")
        parts += ["<tr>" + "".join(f"<td>{r[c]}</td>" for c in df.columns) + "</tr>" for r in shown]
        parts.append("</table>")
    return "".join(parts) + "</body></html>\n"

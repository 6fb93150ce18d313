"""File and package sources on small, hand-made inputs, hostile ones among them."""

import hashlib
import io
import json
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from folioscope.sources import files, packages


def archive(parts, **kw):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts.items():
            z.writestr(name, data, **kw)
    return out.getvalue()


TYPES = '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="main"/></Types>'
RELS = '<Relationships xmlns="r"><Relationship Id="a" Type="http://x/officeDocument" Target="word/document.xml"/><Relationship Id="b" Type="http://x/hyperlink" Target="http://e.org" TargetMode="External"/></Relationships>'
INNER = '<Relationships xmlns="r"><Relationship Id="c" Type="http://x/image" Target="../media/i.png"/><Relationship Id="d" Type="http://x/bad" Target="../../out"/></Relationships>'
W = packages.W
BODY = f'<w:document xmlns:w="{W}"><w:body><w:p><w:r><w:t>One two</w:t></w:r><w:del><w:r><w:delText>gone</w:delText></w:r></w:del><w:r><w:lastRenderedPageBreak/><w:t>three</w:t></w:r><w:r><w:rPr><w:vanish/></w:rPr><w:t>hidden</w:t></w:r></w:p></w:body></w:document>'
CORE = '<c:coreProperties xmlns:c="c" xmlns:dc="d"><dc:title>T</dc:title><dc:creator>Me</dc:creator></c:coreProperties>'
GOOD = {"[Content_Types].xml": TYPES, "_rels/.rels": RELS, "word/document.xml": BODY, "word/_rels/document.xml.rels": INNER, "media/i.png": b"\x89PNG", "docProps/core.xml": CORE}


@pytest.fixture(scope="module")
def store(spark):
    rows = [("good", archive(GOOD)), ("junk", b"no archive"), ("outside", archive({"../x": b"1"})), ("twins", archive({"a.xml": b"1", "A.xml": b"2"})), ("bomb", archive({"z": b"\0" * 5_000_000})), ("null", None)]
    return spark.createDataFrame(rows, "path string, content binary")


def test_parts_and_refusals(store):
    got = packages.parts(store).collect()
    assert {r.part for r in got if r.doc == "good"} == set(GOOD)
    problems = {r.doc: r.problem for r in got if r.problem}
    assert problems == {"junk": "not an archive", "outside": "a name outside the package", "twins": "two names that mean the same", "bomb": "a part expands too much", "null": "not an archive"}


def test_types_edges_and_properties(store):
    parts = packages.parts(store).where("problem is null")
    events = packages.xml_events(parts.where("part like '%.xml' or part like '%.rels'"))
    types = {r.part: r.content_type for r in packages.content_types(parts, events).collect()}
    assert types["word/document.xml"] == "main" and types["docProps/core.xml"] == "application/xml" and types["media/i.png"] is None
    edges = packages.relationships(events)
    got = {(r.source, r.id): (r.type, r.target, r.external) for r in edges.collect()}
    assert got == {("", "a"): ("officeDocument", "word/document.xml", False), ("", "b"): ("hyperlink", "http://e.org", True), ("word/document.xml", "c"): ("image", "media/i.png", False), ("word/document.xml", "d"): ("bad", None, False)}
    assert {r.part for r in packages.reachable(edges).collect()} == {"word/document.xml", "media/i.png"}
    assert packages.of_type(edges, "image").count() == 1
    assert packages.core_properties(parts).first().creator == "Me"


def test_xml_rules():
    read = lambda x, known=frozenset(): [(e[0], e[3]) for e in packages.Reader(known).read(x.encode())]
    mc = packages.Reader.COMPATIBILITY
    choice = f'<r xmlns:m="{mc}" xmlns:a="urn:a" xmlns:b="urn:b"><m:AlternateContent><m:Choice Requires="a"><x/></m:Choice><m:Choice Requires="b"><y/></m:Choice><m:Fallback><z/></m:Fallback></m:AlternateContent></r>'
    assert ("start", "z") in read(choice) and ("start", "y") in read(choice, frozenset({"urn:b"})) and ("start", "x") in read(choice, frozenset({"urn:a", "urn:b"}))
    assert ("start", "x") in read(choice.replace("urn:a", "urn:b"), frozenset({"urn:b"}))  # another prefix, the same namespace
    hidden = f'<r xmlns:m="{mc}" xmlns:n="urn:n" m:Ignorable="n" m:ProcessContent="n:open" n:q="1" k="2"><n:shut><x/></n:shut><n:open><y/></n:open><z/></r>'
    assert [n for k, n in read(hidden) if k == "start"] == ["r", "y", "z"] and packages.Reader().read(hidden.encode())[0][4] == {"k": "2"}
    assert [n for k, n in read(hidden, frozenset({"urn:n"})) if k == "start"] == ["r", "shut", "x", "open", "y", "z"]
    must = hidden.replace("m:Ignorable", "m:MustUnderstand")
    with pytest.raises(packages.Refused):
        read(must)
    read(must, frozenset({"urn:n"}))
    with pytest.raises(packages.Refused):
        read(f'<r xmlns:m="{mc}" m:Ignorable="nowhere"/>')
    whole = packages.Reader(whole=True).read(b"<r><!--c--><?p d?><![CDATA[t]]></r>")
    assert [(e[0], e[3], e[5]) for e in whole] == [("start", "r", ""), ("comment", "", "c"), ("instruction", "p", "d"), ("cdata", "", ""), ("text", "", "t"), ("cdata end", "", ""), ("end", "r", "")]
    for bad in ("<!DOCTYPE r><r/>", "<r>", "<r>" + "<a>" * 300 + "</a>" * 300 + "</r>"):
        with pytest.raises(packages.Refused):
            read(bad)
    assert packages.canonical_xml(b'<a:r xmlns:a="n" q="1" b="2"/>') == packages.canonical_xml(b'<r xmlns="n" b="2" q="1"></r>')
    text, breaks = packages.read_hints(packages.Reader().read(BODY.encode()))
    assert (text, breaks) == ("Onetwothree", [6])


def test_decoding_and_filters(spark):
    rows = [("é".encode("utf-16"),), ("\ufeffé".encode(),), ("é".encode(),), ("\ufeffé".encode("utf-16-be"),)]
    df = spark.createDataFrame(rows, "b binary")
    assert {r[0] for r in df.select(packages.decode_xml(F.col("b"))).collect()} == {"é"}
    data = b"hello hello"
    assert packages.pdf_filters(zlib.compress(data), ["FlateDecode"]) == data
    assert packages.pdf_filters(b"68656C6c6f>", ["ASCIIHexDecode"]) == b"hello"
    assert packages.pdf_filters(b"\x02abc\xfed\x80", ["RunLengthDecode"]) == b"abcddd"
    rows = bytes([2, 1, 1, 2, 1, 1])
    assert packages.pdf_filters(zlib.compress(rows), ["FlateDecode"], 12, 2) == bytes([1, 1, 2, 2])
    assert packages.pdf_filters(zlib.compress(bytes([1, 1, 1, 5, 250, 10])), ["FlateDecode"], 2, 3) == bytes([1, 2, 3, 5, 255, 9])
    assert packages.pdf_filters(zlib.compress(bytes(range(8))), ["FlateDecode"], most=8) == bytes(range(8))
    with pytest.raises(packages.Refused):  # one byte over the limit is refused, not cut
        packages.pdf_filters(zlib.compress(bytes(range(9))), ["FlateDecode"], most=8)
    with pytest.raises(packages.Refused):
        packages.compound_streams(b"x" * 600)


def test_long_ways_are_followed_to_their_end(spark):
    chain = [("d", "" if i == 0 else f"p{i}", f"p{i + 1}", False) for i in range(40)] + [("d", "p40", "p3", False), ("d", "lone", "x", False), ("e", "", "p1", True), (None, "", "y", False), ("f", "", None, False)]
    edges = spark.createDataFrame(chain, "doc string, source string, target string, external boolean")
    assert {(r.doc, r.part) for r in packages.reachable(edges).collect()} == {("d", f"p{i}") for i in range(1, 41)}


def test_targets_fold_in_the_row(spark):
    rows = [("word/document.xml", "../media/i.png", "media/i.png"), ("word/document.xml", "/a/./b", "a/b"), ("word/document.xml", "../../out", None), ("x", "y//z", "y/z"), ("", "..", None), ("a/b", "../", None), (None, "x", None)]
    df = spark.createDataFrame(rows, "base string, target string, want string")
    assert all(r.got == r.want for r in df.select("want", packages.resolve_target(F.col("base"), F.col("target")).alias("got")).collect())


def test_packages_are_written_and_read_back(spark):
    rows = spark.createDataFrame([(1, "<a/>", b"x"), (2, "<b/>", None), (None, None, None)], "k int, text string, data binary")
    made = packages.packages_of(rows, "k", {"a/b.xml": "text", "c.bin": "data"}).collect()
    assert [dict(packages.read_parts(r.content)) for r in made] == [{"a/b.xml": b"<a/>", "c.bin": b"x"}, {"a/b.xml": b"<b/>"}, {}]
    assert dict(packages.read_parts(packages.write_parts({"a": b"x" * 5_000_000}))) == {"a": b"x" * 5_000_000}
    assert packages.write_parts({"b": b"1", "a": b"2"}) == packages.write_parts({"a": b"2", "b": b"1"})


def manifest(documents):
    return {"format": "corpus-manifest", "version": 1, "sources": {"s": {"url": "https://x", "revision": "1", "license": "MIT", "copyright": "c", "license_texts": []}}, "documents": documents}


def test_manifest_round_trip(spark, tmp_path):
    docs = [{"sha256": d * 64, "size": 3, "tier": "T1", "license": "MIT", "provenance": [{"source": "s", "path": f"{d}.txt"}]} for d in "ba"]
    (tmp_path / "m.json").write_text(json.dumps(manifest(docs)))
    documents, sources = files.read_manifest(spark, f"{tmp_path}/m.json")
    assert documents.count() == 2 and sources.first().license == "MIT"
    files.write_manifest(documents, sources, f"{tmp_path}/n.json")
    text = (tmp_path / "n.json").read_text()
    assert text.endswith("}\n") and [d["sha256"][0] for d in json.loads(text)["documents"]] == ["a", "b"]
    again = files.read_manifest(spark, f"{tmp_path}/n.json")
    files.write_manifest(*again, f"{tmp_path}/o.json")
    assert (tmp_path / "o.json").read_text() == text
    (tmp_path / "bad.json").write_text(json.dumps(manifest(docs) | {"version": 9}))
    with pytest.raises(Exception, match="not a manifest"):
        files.read_manifest(spark, f"{tmp_path}/bad.json")[0].collect()
    (tmp_path / "odd.json").write_text(json.dumps(manifest(docs) | {"extra": 1}))
    with pytest.raises(Exception, match="not a manifest"):
        files.read_manifest(spark, f"{tmp_path}/odd.json")[0].collect()


def test_exclusions(spark, tmp_path):
    good = ["a" * 64 + "\ts\tp\tr", "b" * 64 + "\ts\tp\tr"]
    (tmp_path / "x.tsv").write_text("sha256\tsource\tpath\treason\n" + "\n".join(good) + "\n")
    rows, problems = files.read_exclusions(spark, f"{tmp_path}/x.tsv")
    assert rows.count() == 2 and problems.count() == 0
    (tmp_path / "y.tsv").write_text("sha\n" + "\n".join([good[1], good[0], good[0], "short", "Z\ts\tp\tr"]) + "\n")
    got = {(r.number, r.problem) for r in files.read_exclusions(spark, f"{tmp_path}/y.tsv")[1].collect()}
    assert got == {(1, "header"), (3, "not sorted"), (4, "twice"), (5, "not four fields"), (6, "no digest")}


def test_store(spark, tmp_path):
    root = str(tmp_path / "store")
    objects = spark.createDataFrame([(b"one",), (b"two",)], "content binary")
    assert {r.written for r in files.put_objects(objects, root).collect()} == {True}
    assert {r.written for r in files.put_objects(objects, root).collect()} == {False}
    digest = lambda b: hashlib.sha256(b).hexdigest()
    assert {r.sha256 for r in files.read_store(spark, root).collect()} == {digest(b"one"), digest(b"two")}
    (tmp_path / "store/objects" / digest(b"one")[:2] / digest(b"one")[2:]).write_bytes(b"0ne")
    expected = spark.createDataFrame([(digest(b"one"), 3), (digest(b"three"), 5)], "sha256 string, size long")
    got = {r.sha256: r.problem for r in files.store_problems(spark, root, expected).collect()}
    assert got == {digest(b"one"): "content", digest(b"two"): "unexpected", digest(b"three"): "missing"}
    assert files.list_store(spark, root).count() == 2


def test_layouts(spark, tmp_path):
    page = {"width": 10, "height": 10, "lines": [{"start": 0, "end": 3, "text": "one", "baseline": 1.2345, "glyphs": [{"offset": 0, "length": 3, "x": 1.001, "y": 2, "advance": 1, "font": 0, "size": 10}]}, {"start": 5, "end": 8, "text": "two", "baseline": 2, "glyphs": [{"offset": 2, "length": 2, "x": 1, "y": 2, "advance": 1, "font": 0, "size": 10}]}]}
    (tmp_path / "l.json").write_text(json.dumps({"doc": "d", "source": "pdf", "pages": [page]}) + "\n")
    lines, glyphs = files.read_layouts(spark, f"{tmp_path}/l.json")
    assert {(r.line, r.baseline, r["size"]) for r in lines.collect()} == {(0, 1234, 10000), (1, 2000, 10000)} or {(r.line, r.baseline) for r in lines.collect()} == {(0, 1235), (1, 2000)}
    assert glyphs.where("line = 0").first().x == 1001
    assert {(r.line, r.rule) for r in files.layout_violations(lines, glyphs).collect()} == {(1, "start"), (1, "glyph beyond text")}


def test_recordings_words_metrics_and_reports(spark, tmp_path):
    for name, entries in (("a", [{"seq": 0, "digest": "x"}, {"seq": 1, "digest": "y"}]), ("b", None)):
        (tmp_path / "rec").mkdir(exist_ok=True)
        (tmp_path / "rec" / f"{name}.json").write_text(json.dumps({"format": "r", "entries": entries}))
    entries, refused = files.read_recordings(spark, f"{tmp_path}/rec")
    assert entries.count() == 2 and refused.first().reason == "not a recording"
    assert files.read_recordings(spark, f"{tmp_path}/rec", most_entries=1)[1].count() == 2
    other = entries.withColumn("digest", F.when(F.col("seq") == 1, "z").otherwise(F.col("digest")))
    assert files.replay_difference(entries, other).first().first_difference == 1
    (tmp_path / "w.tsv").write_text("1\t1.5\t2.5\tword\n")
    assert files.read_words(spark, f"{tmp_path}/w.tsv").first().word == "word"
    (tmp_path / "m.txt").write_text("metric load 2.5 ms\nnoise\n")
    assert tuple(files.read_metrics(spark, f"{tmp_path}/m.txt").first()) == ("load", 2.5, "ms")
    stats = spark.createDataFrame([("a|b", 2, "50.0%"), ("<x>", None, "–")], "name string, documents long, share string")
    assert "a\\|b | 2 | 50.0%" in files.markdown_report(stats, "T")
    assert "&lt;x&gt;" in files.html_report({"S": stats}) and "<x>" not in files.html_report({"S": stats})


def test_summary(spark, tmp_path):
    doc = lambda s, r: {"sha256": s, "digest": "d", "pages_match": True, "m2": r, "m3": r, "m7": []}
    (tmp_path / "s.json").write_text(json.dumps({"version": 2, "title": "t", "documents": [doc("a", [[0, 2], [3, 4]]), doc("a", [[0, 1]]), doc("b", [[0, 2], [2, 3]]), doc("c", [[1, 1]])]}))
    documents, problems = files.read_summary(spark, f"{tmp_path}/s.json")
    assert {(r.sha256, r.problem) for r in problems.collect()} == {(None, "version"), ("a", "twice"), ("b", "ranges"), ("c", "ranges")}
    assert [r.m2 for r in documents.where("sha256 = 'a'").orderBy(F.desc(F.size("m2"))).collect()][0] == [0, 1, 3]


def test_layouts_and_recordings_are_written_and_read_back(spark, tmp_path):
    layout = {"doc": "d", "source": "pdf", "pages": [{"lines": [{"start": 0, "end": 2, "text": "ab", "direction": "ltr", "baseline": 100.5, "glyphs": [{"offset": 0, "length": 1, "x": 1.25, "y": 100.5, "advance": 6.0, "font": 0, "size": 10.0, "gid": 3}, {"offset": 1, "length": 1, "x": 7.25, "y": 100.5, "advance": 6.0, "font": 0, "size": 10.0}]}, {"start": 3, "end": 3, "text": ""}]}, {"lines": []}, {"lines": [{"start": 4, "end": 5, "text": "c"}]}]}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps(layout) + "\n")
    lines, glyphs = files.read_layouts(spark, str(tmp_path / "in"))
    files.write_layouts(lines, glyphs, str(tmp_path / "out"))
    again = files.read_layouts(spark, str(tmp_path / "out"))
    for a, b in zip((lines, glyphs), again, strict=True):
        assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))
    rows = [("s1", 1, 10, "message", "hi", None, None, None, "x"), ("s1", 0, 5, "tile", None, "AA==", 2, 3, "y"), ("s2", 0, 1, "message", "z", None, None, None, "q")]
    files.write_recordings(spark.createDataFrame(rows, "session string, seq long, t_ms long, kind string, text string, base64 string, width int, height int, digest string").repartition(2, "session"), str(tmp_path / "rec"))
    texts = [json.loads(x) for p in (tmp_path / "rec").glob("part-*") for x in p.read_text().splitlines()]
    assert {(t["session"], tuple(e["seq"] for e in t["entries"])) for t in texts} == {("s1", (0, 1)), ("s2", (0,))}
    stats = json.loads(files.stats_json({"by": spark.createDataFrame([("a", 1), ("b", None)], "name string, documents int")}))
    assert stats == {"by": [{"name": "a", "documents": 1}, {"name": "b", "documents": None}]}


def test_objects_by_uri(spark, tmp_path):
    data = spark.createDataFrame([(b"one",), (b"two",), (b"one",), (None,)], "content binary").coalesce(1)
    for root in (f"file://{tmp_path}/a", str(tmp_path / "b")):
        got = [tuple(r) for r in files.put_objects(data, root).collect()]
        assert len(got) == 3 and sum(n for _, n in got) == 2
        assert {r.sha256 for r in files.read_store(spark, root).collect()} == {hashlib.sha256(x).hexdigest() for x in (b"one", b"two")}
        assert not any(n for _, n in files.put_objects(data, root).collect())


def test_rules_of_scans_and_sources(spark):
    from folioscope.operators import catalog as C

    scan = {"tagger": 3, "features": ["A", "B"], "fonts": ["F"], "languages": [], "scripts": {"Latin": 1}, "compatibility": {"mode": 15, "options": []}, "application": None, "pages_hint": None, "notes": []}
    truth = {"status": "none", "word_build": None}
    rows = [("good", scan, truth, None), ("raw", None, truth, None), ("old", scan | {"tagger": 2}, truth, None), ("odd", scan | {"features": ["A", "Z"]}, truth, None), ("never", scan | {"features": ["N"]}, truth, " "), ("order", scan | {"fonts": ["b", "a"], "languages": ["x", "x"]}, truth, None), ("script", scan | {"scripts": {"Latin": 0}}, truth, None), ("built", scan, {"status": "produced", "word_build": None}, None), ("early", scan, {"status": "none", "word_build": "16"}, None)]
    df = spark.createDataFrame(rows, f"sha256 string, scan {files.SCAN}, ground_truth struct<status:string,word_build:string>, notes string")
    got = {(r.sha256, r.rule) for r in C.scan_violations(df, 3, ["A", "B", "N"], ["N"]).collect()}
    assert got == {("old", "tagger version"), ("odd", "unknown feature"), ("never", "undetectable feature"), ("never", "empty notes"), ("order", "fonts not sorted"), ("order", "languages not sorted"), ("script", "script without characters"), ("built", "ground truth build"), ("early", "ground truth build")}
    text = [{"path": "L", "sha256": "0"}]
    sources = [("ok", "https://x", "1", "MIT", "c", text, None), ("none", "https://x", "1", "NOASSERTION", None, None, None), ("Bad Name", "ftp://x", "", "Odd", " ", [], " "), ("path", "https://x", "1", "MIT", "c", [{"path": "../L", "sha256": "0"}], None)]
    df = spark.createDataFrame(sources, "name string, url string, revision string, license string, copyright string, license_texts array<struct<path:string,sha256:string>>, notes string")
    got = {(r.name, r.rule) for r in C.source_violations(df).collect()}
    assert got == {("Bad Name", r) for r in ("name", "url", "no revision", "license", "no copyright", "no license text", "empty notes")} | {("path", "license text path")}


def test_empty_and_null_texts_in_a_store(spark, sf, tmp_path):
    import duckdb

    from folioscope.plans import package_queries as P
    from folioscope.sources import files

    objects = spark.createDataFrame([(b"",), (b"x",), (None,)], "content binary")
    root = f"file://{tmp_path}/objects-and-more"
    assert sum(r.written for r in files.put_objects(objects, root).collect()) == 2
    (tmp_path / "objects-and-more" / "new-left-by-a-lost-task").write_bytes(b"part")
    assert sorted(r.length for r in files.list_store(spark, root).collect()) == [0, 1]
    assert sorted(bytes(r.content) for r in files.read_store(spark, root).collect()) == [b"", b"x"]
    rows = [(1, "", "en", "s", 0), (2, None, "en", "s", 0), (3, "é", "en", "s", 1), (4, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    theirs = con.execute(P.SQL["store_round_trip"]).fetchall()
    assert sorted(map(repr, (tuple(r) for r in P.QUERIES["store_round_trip"](spark, str(tmp_path)).collect()))) == sorted(map(repr, theirs))


def test_packages_are_held_a_few_at_a_time():
    import pyarrow as pa

    from folioscope.operators import tagger as G

    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array([b"x"] * 1000)], ["doc", "content"])
    got = list(packages.pieces(iter([batch, batch.slice(0, 0)])))
    assert max(b.num_rows for b in got) <= packages.FEW and [v for b in got for v in b.column(0).to_pylist()] == list(range(1000))
    for data in (b"", b"a" * 500, b"a" * 600, b"a" * 100_000, bytes(range(256)) * 300, bytes(range(256)) + b"b" * 90_000, b"c" * 90_000 + bytes(range(256))):
        import zlib

        assert packages.expands(data) == (len(data) > 50 * len(zlib.compress(data)))
    types = b'<Types xmlns="t"><Default Extension="XML" ContentType="x"/><Override PartName="/A/b.xml" ContentType="y"/></Types>'
    assert G.stated_types(types) == {"a/b.xml": "y", ".xml": "x"} and G.stated_types(types + b" " * 5000) == {"a/b.xml": "y", ".xml": "x"}

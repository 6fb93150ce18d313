"""Normalization of damaged documents, edits, operation logs and streams."""

import random

import pytest
from pyspark.sql import functions as F

from folioscope.operators import inspection
from folioscope.operators import model as M
from folioscope.streaming import oplog, windows

RUNS = "doc string, story string, seq long, text string, marks map<string,string>"


@pytest.fixture(scope="module")
def documents(spark):
    rng = random.Random(2)
    chars = "ab\n\t\u0008" + "".join(M.ATOMS)
    rows = [(str(d), str(s), i, "".join(rng.choice(chars) for _ in range(rng.randint(0, 6))), {"bind": str(rng.randint(0, 9)), "bold:1": rng.choice(["on", None]), f"comment:{rng.randint(0, 3)}": "on"}) for d in range(8) for s in range(3) for i in range(6)]
    registry = spark.createDataFrame([(str(d), k, str(i)) for d in range(8) for k in ("object", "bookmark", "note") for i in range(6)], "doc string, kind string, id string")
    comments = spark.createDataFrame([(str(d), "1") for d in range(8)], "doc string, id string")
    return spark.createDataFrame(rows, RUNS), registry, comments


def test_normalized_documents_keep_the_invariants(documents):
    runs, registry, comments = documents
    assert M.invariants(M.items(runs), registry).count() > 0
    rows, repairs = M.normalise(runs, registry, comments)
    rows = rows.cache()
    assert M.invariants(rows, registry).count() == 0
    assert {r.rule for r in repairs.collect()} <= {"unregistered", "used twice", "unmatched field", "closing paragraph"}
    assert rows.where(F.exists(F.map_keys("marks"), lambda k: (k == "bind") | ((F.substring_index(k, ":", 1) == "comment") & (k != "comment:1")))).count() == 0


def test_normalizing_again_changes_nothing(documents):
    runs, registry, comments = documents
    rows, _ = M.normalise(runs, registry, comments)
    back = rows.select("doc", "story", F.col("pos").cast("long").alias("seq"), F.col("char").alias("text"), F.when(F.col("entity").isNull(), F.col("marks")).otherwise(F.map_concat("marks", F.create_map(F.lit("bind"), "entity"))).alias("marks"))
    again, repairs = M.normalise(back, registry, comments)
    assert repairs.count() == 0
    key = lambda df: sorted((r.doc, r.story, r.pos, r.kind, r.char) for r in df.collect())
    assert key(again) == key(rows)


def test_plain_text_and_runs(spark):
    rows = spark.createDataFrame([("d", "0", 0, "ab\u0005code\u0006result\u0007\u0001", {"bold:1": "on"})], RUNS)
    items = M.items(rows)
    assert M.plain_text(items).first().text == "abresult\n"
    runs = sorted((r.run, r.text) for r in M.merged_runs(items).collect())
    assert [t for _, t in runs] == ["ab", "\u0005", "code", "\u0006", "result", "\u0007", "\u0001"]


def test_edits(spark):
    ops = [(1, "insert", 0, 0, "hello"), (2, "format", 0, 2, "bold"), (3, "split", 3, 0, ""), (4, "delete", 0, 1, ""), (5, "merge", 0, 0, ""), (6, "move", 0, 1, "3"), (7, "insert", 99, 0, "x"), (8, "unknown", 0, 0, "")]
    df = spark.createDataFrame([("s", *o) for o in ops], "story string, seq long, op string, at int, to int, value string")
    r = M.edited(df).first()
    assert (r.text, r.marked, r.refused, r.operations) == ("lloe", 1, 2, 8)


def test_delivery_in_any_order(spark, tmp_path):
    rng = random.Random(5)
    rows = [(p, c) for p in range(4) for c in range(30)] + [(0, 3), (1, 7)]
    rng.shuffle(rows)
    for i in range(0, len(rows), 25):
        spark.createDataFrame(rows[i : i + 25], "peer long, counter long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    out = windows.run_to_end(oplog.delivered(windows.stream_of(spark, f"{tmp_path}/in/"))).collect()
    applied = [(r.peer, r.counter) for r in out if r.status == "applied"]
    assert sorted(applied) == [(p, c) for p in range(4) for c in range(30)]
    assert sum(r.status == "repeated" for r in out) == 2


def test_a_bad_change_poisons_its_peer_only(spark, tmp_path):
    for i, rows in enumerate(([(1, 0), (2, 0)], [(1, -1)], [(1, 1), (2, 1)])):
        spark.createDataFrame(rows, "peer long, counter long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    out = {(r.peer, r.counter, r.status) for r in windows.run_to_end(oplog.delivered(windows.stream_of(spark, f"{tmp_path}/in/"))).collect()}
    assert (1, -1, "refused") in out and (2, 0, "applied") in out and (2, 1, "applied") in out


def test_merging_is_idempotent_and_commutative(spark):
    a = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "peer long, counter long")
    b = spark.createDataFrame([(1, 1), (3, 0)], "peer long, counter long")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(oplog.merged(a, b)) == rows(oplog.merged(b, a)) == rows(oplog.merged(oplog.merged(a, b), b))
    assert rows(oplog.updates_since(oplog.merged(a, b), oplog.version_vector(a))) == [(3, 0)]


def test_late_events_are_dropped(spark, tmp_path):
    for day in (1, 10, 2, 20):
        spark.sql(f"SELECT timestamp_ntz'2024-01-{day:02d} 12:00:00' ts, 'a' k, 1.0D value").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    out = windows.run_to_end(windows.tumbling(windows.stream_of(spark, f"{tmp_path}/in/"), "1 day", "2 days", "k")).collect()
    assert 1 <= len(out) <= 3 and all(r.n == 1 for r in out)


def test_inspection(spark):
    rows = [(1, "Copyright 2020 by x. Mail jane.roe@gmail.com, j@firm.com, someone@x.org, a@example.com. Card 4539 1488 0343 6467. C:\\Users\\jane\\x"), (2, "IBAN DE89 3704 0044 0532 0130 00 GNU and confidential"), (3, None), (4, "")]
    found = inspection.findings(spark.createDataFrame(rows, "doc_id int, text string"))
    got = {(r.doc_id, r.flag, r.shown) for r in found.collect()}
    assert (1, "personal mail", "xxxx.xxx@xxxxx.xxx") in got and (1, "mail address", "x@firm.com") in got
    assert (1, "card number", "0000 0000 0000 0000") in got and (1, "user folder", "xxxx") in got and (2, "bank account", "XX00 0000 0000 0000 0000 00") in got
    assert {r[1] for r in got if r[0] == 2} == {"bank account", "license", "confidential"} and not {r for r in got if r[0] > 2}
    totals = [(r.flag, r.documents) for r in inspection.flag_totals(found).collect()]
    assert totals == sorted(totals, key=lambda x: (-x[1], x[0]))


def test_binaries(spark):
    df = spark.createDataFrame([(b"\x89PNG\r\n\x1a\n", 1), (b"MZ\x00 printable!\x01\x02" + "wide text".encode("utf-16-le"), 2), (b"", 3), (None, 4)], "b binary, i int")
    got = {r.i: (r.k, r.s) for r in df.select("i", inspection.kind_of_binary(F.col("b")).alias("k"), inspection.binary_strings(F.col("b")).alias("s")).collect()}
    assert got[1][0] == "png" and got[2][0] == "program" and got[2][1] == " printable!\nwide text" and got[3][0] is None


def test_document_edits():
    from folioscope.operators.model import Document, Refusal

    d = Document()
    m = d.main
    d.insert_text(m, 0, "one two")
    d.format(m, 0, 3, "r:b")
    d.format(m, 4, 7, "link")
    d.insert_text(m, 3, "!")
    d.insert_text(m, 8, "?")
    marks = [set(c[1]) for c in d.stories[m]]
    assert marks[3] == {"r:b"} and marks[8] == set() and d.text() == "one! two?\n"  # formatting goes on, a link does not
    first = d.split_paragraph(m, 4)
    d.set_paragraph_property(first, "align", "right")
    assert d.text() == "one!\n two?\n" and d.entities[first]["align"] == "right"
    t = d.insert_table(m, 5, 2, 2)
    d.insert_text(d.tables[t][0][1], 0, "cell")
    assert d.text() == "one!\n\ncell\n\n\n two?\n"
    refused = [
        ("not a block position", lambda: d.insert_text(m, 5, "x")), ("block structure", lambda: d.merge_paragraph(m, 4)), ("block structure", lambda: d.delete(m, 3, 5)), ("not a block position", lambda: d.insert_table(m, 2, 1, 1)), ("last row or column", lambda: d.insert_table(m, 0, 0, 1)),
        ("position", lambda: d.delete(m, 0, 99)), ("text", lambda: d.insert_text(m, 0, "\x02")), ("no such table", lambda: d.insert_row("x", 0)), ("position", lambda: d.delete_column(t, 2)), ("no such paragraph", lambda: d.set_paragraph_property("x", "a", "b")), ("no such story", lambda: d.insert_text("x", 0, "a")),
        ("would create a cycle", lambda: d.move_range(m, 5, 6, d.tables[t][0][0], 0)), ("not a paragraph end", lambda: d.merge_paragraph(m, 0)), ("position", lambda: d.move_range(m, 0, 3, m, 2)), ("not a block position", lambda: d.insert_object(m, 5)),
    ]
    before = (d.text(), d.count)
    for why, edit in refused:
        try:
            edit()
        except Refusal as error:
            assert str(error) == why, why
        else:
            raise AssertionError(why)
    assert d.text() == before[0]
    d.insert_row(t, 1)
    d.insert_column(t, 0)
    d.move_row(t, 0, 2)
    assert [len(r) for r in d.tables[t]] == [3, 3, 3] and d.text(d.tables[t][2][2]) == "cell\n"
    d.delete_column(t, 0)
    d.delete_row(t, 0)
    assert [len(r) for r in d.tables[t]] == [2, 2]
    f = d.insert_field(m, 0, "PAGE", "7")
    assert d.text().startswith("7one!") and d.entities[f]["code"] == "PAGE"
    for edit in (lambda: d.move_range(m, 0, 3, m, 9), ):
        try:
            edit()
        except Refusal as error:
            assert str(error) == "would unbalance"
    c = d.add_comment(m, 8, 10, "why")
    assert d.text(d.entities[c]["story"]) == "why\n" and f"cmt:{c}" in d.stories[m][8][1]
    d.insert_bookmark(m, 8, 9, "here")
    d.insert_object(m, 0)
    assert not d.broken()


def test_simulations_keep_the_structure():
    from folioscope.operators import model

    assert sum(model.WEIGHTS.values()) == 100
    kinds = set()
    for seed in range(60):
        edits = model.plan(seed, 120)
        assert edits == model.plan(seed, 120)
        doc, stats = model.simulate(edits)
        assert not doc.broken() and sum(stats.values()) == 120
        kinds |= set(stats)
    assert {"applied", "position", "block structure", "not a block position"} <= kinds
    assert model.shrink(list(range(100)), lambda x: {3, 77} <= set(x)) == [3, 77]


def test_simulations_are_spread_and_the_same_for_each_seed(spark):
    from folioscope.operators import model

    seeds = spark.range(300).coalesce(1).withColumnRenamed("id", "seed")
    out = model.simulated(seeds, 30)
    assert out.rdd.getNumPartitions() > 4
    rows = {r.seed: r for r in out.collect()}
    assert len(rows) == 300 and model.plans([7, -3, 299], 30) == [model.plan(7, 30), model.plan(-3, 30), model.plan(299, 30)]
    assert model.plan(0, 1) == [("delete", [0x6E789E6AA1B965F4, 0x06C45D188009454F, 0xF88BB8A8724C81EC, 0x1B39896A51A8749B, 0x53CB9F0C747EA2EA])]  # SplitMix64 of 0
    for seed in (0, 41, 299):
        doc, stats = model.simulate(model.plan(seed, 30))
        assert (rows[seed].applied, rows[seed].stories) == (stats["applied"], len(doc.stories)) and rows[seed].broken == ""


def test_undo_and_redo(spark):
    from folioscope.streaming import oplog

    actions = ["undo", "edit", "edit", "undo", "undo", "redo", "edit", "redo", "undo"]
    df = spark.createDataFrame([("p", i, a) for i, a in enumerate(actions)], "peer string, seq long, kind string")
    assert [r.step for r in oplog.undo_redo(df).orderBy("seq").collect()] == [None, 1, 2, 2, 1, 1, 6, None, 6]
    few = spark.createDataFrame([("p", i, "edit" if i < 5 else "undo") for i in range(9)], "peer string, seq long, kind string")
    assert [r.step for r in oplog.undo_redo(few, 3).orderBy("seq").collect()][5:] == [4, 3, 2, None]


def test_protocol():
    from folioscope.functions import protocol as P

    ok = P.parse_envelope('{"v":1,"id":3,"type":"x","payload":{"a":{"b":1}},"more":2}')
    assert ok == {"id": 3, "type": "x", "payload": '{"a":{"b":1}}', "error": None}
    for text, why in ((None, "invalid"), ("", "invalid"), ('{"v":1.0,"id":1,"type":"x"}', "invalid"), ('{"v":true,"id":1,"type":"x"}', "invalid"), ('{"v":1,"id":1,"type":"x","payload":{"a":1,"a":2}}', "invalid"), ('{"v":9,"id":1,"type":"x"}', "version"), ('{"v":1,"id":NaN,"type":"x"}', "invalid"), ("[" * 100_000, "invalid"), ('"' + "x" * P.MOST_BYTES + '"', "too_large")):
        assert P.parse_envelope(text)["error"] == why
    assert [P.json_error(t) for t in ("{}", "", "[1,", "[1}", "NaN", '"a', "{\"a\" 1}")] == [None, "end", "end", "syntax", "number", "end", "syntax"]


def test_depths_and_names(spark):
    from folioscope.functions import protocol as P

    values = [("1", 1), ("[]", 1), ("[1]", 2), ('{"a":[1,{"b":"[[[["}]}', 4), ('"x"', 1), ("[[],[[]]]", 3), ('{"a":1,"b":[2]}', 3)]
    got = spark.createDataFrame(values, "v string, want int").select("v", "want", P.depth(F.col("v")).alias("d")).collect()
    assert all(r.d == r.want for r in got), got
    names = [("/a/b.xml", None), ("a", "no slash"), (None, "no slash"), ("/", "empty segment"), ("/a//b", "empty segment"), ("/a/", "empty segment"), ("/a/..", "dot"), ("/a./b", "dot"), ("/a%2fb", "escape"), ("/a%41", "escape"), ("/a%", "escape"), ("/a b", "character"), ("/é", None), ("/a%20b", None)]
    got = spark.createDataFrame(names, "n string, want string").select("n", "want", P.part_name_problem(F.col("n")).alias("p")).collect()
    assert all(r.p == r.want for r in got), got


def test_people_and_nested_paragraphs(spark):
    from folioscope.sources import packages

    w = packages.W
    body = f'<w:document xmlns:w="{w}"><w:p><w:r><w:t>a</w:t></w:r><w:r><w:pict><w:txbxContent><w:p><w:r><w:t>in</w:t><w:tab/></w:r></w:p></w:txbxContent></w:pict></w:r><w:r><w:t>b</w:t></w:r></w:p></w:document>'
    assert packages.paragraph_texts(packages.Reader().read(body.encode())) == ["in\t", "ab"]
    people = '<w15:people xmlns:w15="x"><w15:person w15:author="A"><w15:presenceInfo w15:providerId="None"/></w15:person><w15:person w15:author="B"><w15:presenceInfo w15:providerId="AD"/></w15:person><w15:person w15:author="A"/></w15:people>'
    parts = spark.createDataFrame([("d", "word/people.xml", people.encode()), ("d", "bad", b"<a>")], "doc string, part string, bytes binary")
    authors, providers = packages.people(packages.xml_events(parts))
    assert [tuple(r) for r in authors.collect()] == [("d", 2)] and {tuple(r) for r in providers.collect()} == {("d", "None", 1), ("d", "AD", 1)}
    assert packages.paragraphs(parts).count() == 0


def test_nested_tables_and_virtual_stories():
    stories = {"main": ["t1", "t2", "t1", "gone"], "s1": ["t3"], "s3": []}
    found, counts = M.normal_tables("main", stories, {"t1": ["r1", "r2", "r1", None], "t2": ["r3"], "t3": ["r4"]}, {"r1": ["c1", "c2"], "r2": [], "r3": ["c1", "nothing"], "r4": ["c4"]}, {"c1": "s1", "c2": "s1", "c4": "s3"})
    kept = [(k, i, p, d) for k, i, p, d, _ in found]
    assert kept == [("table", "t1", "main", 1), ("row", "r1", "t1", 1), ("cell", "c1", "r1", 1), ("table", "t3", "s1", 2), ("row", "r4", "t3", 2), ("cell", "c4", "r4", 2), ("cell", "c2", "r1", 1)]
    assert counts == {"twice": 3, "missing": 3, "empty": 3, "virtual_story": 1}
    virtual = next(s for k, i, _, _, s in found if i == "c2")
    assert len(virtual) == 32 and virtual not in stories
    deep = M.normal_tables("s0", {f"s{i}": [f"t{i}"] for i in range(40)}, {f"t{i}": [f"r{i}"] for i in range(40)}, {f"r{i}": [f"c{i}"] for i in range(40)}, {f"c{i}": f"s{i + 1}" for i in range(40)})
    assert max(d for *_, d, _ in deep[0]) == 32 and deep[1] == {"too_deep": 1}
    loop = M.normal_tables("a", {"a": ["t"], "b": ["t"]}, {"t": ["r"]}, {"r": ["c"]}, {"c": "a"})
    assert [x[1] for x in loop[0]] == ["t", "r", "c"] and loop[1] == {"virtual_story": 1}  # the main story has no cell for an owner


def test_markers_hold_their_keys(spark):
    """Each alternative of each pattern, spelled out, is found: what is searched for first is in all of them."""
    samples = {
        "rights": ["Copyright 2020", "all, All rights reserved.", "All Rights Reserved", "Alle Rechte", "Todos los derechos", "Tous droits", "© x", "(c) 1999", "(C)2001"],
        "confidential": ["confidential", "Confidential", "CONFIDENTIAL", "do not distribute", "Do Not Distribute", "Internal use only", "Proprietary", "Trade secret"],
        "license": ["AGPL", "Apache License", "BSD", "CC-BY", "CC BY", "Creative Commons", "GNU", "LGPL", "GPL", "MIT License", "Mozilla Public", "Public License", "ShareAlike"],
        "news or pictures": ["AFP", "Associated Press", "Getty", "Reuters", "Shutterstock", "Wikimedia", "Wikipedia", "iStock"],
        "publisher": ["Cambridge University Press", "Elsevier", "Hachette", "Macmillan", "McGraw-Hill", "Oxford University Press", "Pearson", "Penguin", "Springer", "Wiley"],
        "standard": ["ANSI", "DIN EN", "ECMA-376", "IEEE Std", "ISO/IEC 29500", "ITU-T", "RFC 5321"],
    }
    rows = [(k, t) for k, texts in samples.items() for t in texts] + [(None, "nothing of note, rightsx"), (None, None)]
    got = spark.createDataFrame(rows, "want string, text string").select("want", "text", inspection.marker_kinds(F.col("text")).alias("k")).collect()
    assert all((r.want in r.k) if r.want else not r.k for r in got), [r for r in got if r.want and r.want not in r.k]


def test_folds_hold_no_array_of_a_key(spark):
    from folioscope.operators import model
    from folioscope.operators import sequence as S

    rows = spark.createDataFrame([("a" if i % 3 else None, i % 50, f"v{i}") for i in range(30_000)], "k string, o long, v string")

    def run(own):
        first = next(iter(own))
        yield first[0], first[1], 1  # before the rest is read
        for n, (o, v) in enumerate(own, 2):
            yield o, v, n

    out = S.fold_rows(rows, "k", "o", ["v"], run, "o long, v string, n long")
    assert "collect_list" not in out._jdf.queryExecution().toString()
    got = [tuple(r) for r in out.collect()]
    for key in ("a", None):
        own = sorted((i % 50, f"v{i}") for i in range(30_000) if ("a" if i % 3 else None) == key)
        assert [r[1:] for r in got if r[0] == key] == [(*r, n) for n, r in enumerate(own, 1)]
    ops = [("s", i, op, at, to, v) for i, (op, at, to, v) in enumerate([("insert", 0, 0, "abcd"), ("format", 1, 3, "b"), ("delete", 0, 1, None), ("delete", 9, 9, None)])]
    edited = model.edited(spark.createDataFrame(ops, "story string, seq long, op string, at int, to int, value string"))
    assert "collect_list" not in edited._jdf.queryExecution().toString()
    assert [tuple(r) for r in edited.collect()] == [("s", 4, "bcd", 2, 1)]


def test_fields_are_matched_as_they_end():
    import random

    from folioscope.operators import sequence as S

    given = []

    def delimiters():
        for row in [(5, "separate"), (6, "begin"), (7, "begin"), (8, "end"), (9, "separate"), (10, "separate")]:
            given.append(row[0])
            yield row

    out = S.matched_fields(delimiters())
    assert next(out) == (5, None) and given == [5]
    assert [next(out), next(out)] == [(7, 7), (8, 7)] and given == [5, 6, 7, 8]
    assert list(out) == [(10, None), (6, None), (9, None)]
    draw = random.Random(3)
    for _ in range(200):
        kinds = draw.choices(["begin", "separate", "end", "text"], k=12)
        stack, want = [], [None] * 12
        for i, kind in enumerate(kinds):
            if kind == "begin":
                stack.append([i])
            elif kind == "separate" and stack and len(stack[-1]) == 1:
                stack[-1].append(i)
            elif kind == "end" and stack:
                own = [*stack.pop(), i]
                for j in own:
                    want[j] = own[0]
        assert S.match_fields(kinds) == want


def test_undo_of_a_peer_with_many_actions(spark):
    from folioscope.streaming import oplog

    kinds = ["edit", "undo", "redo", "edit", "edit", "undo", "undo"]
    rows = [("p", i, kinds[i * 5 % 7]) for i in range(21_000)]
    out = oplog.undo_redo(spark.createDataFrame(rows, "peer string, seq long, kind string"), 3)
    assert "collect_list" not in out._jdf.queryExecution().toString()
    done, undone, want = [], [], []
    for _, seq, kind in rows:
        step = None
        if kind == "edit":
            step, done, undone = seq, [*done, seq][-3:], []
        elif kind == "undo" and done:
            undone.append(step := done.pop())
        elif kind == "redo" and undone:
            done.append(step := undone.pop())
        want.append((seq, step, len(done), len(undone)))
    assert [tuple(r)[1:] for r in out.orderBy("seq").collect()] == want


def test_tables_of_many_documents_cross_together(spark):
    from folioscope.operators import model

    rows = [(d, *part) for d in ("a", "b", None) for part in (("main", "m", ["t"], None), ("table", "t", ["r", "none"], None), ("row", "r", ["c"], None), ("cell", "c", None, None))]
    out = model.nested_tables(spark.createDataFrame(rows, "doc string, kind string, id string, children array<string>, story string"))
    assert "FlatMapGroupsInArrow" not in out._jdf.queryExecution().toString()
    got = [(r.doc, r.kind, r.id) for r in out.collect()]
    one = [("table", "t"), ("row", "r"), ("cell", "c"), ("count:missing", "1"), ("count:virtual_story", "1")]
    assert sorted(got, key=repr) == sorted(((d, *x) for d in ("a", "b", None) for x in one), key=repr)

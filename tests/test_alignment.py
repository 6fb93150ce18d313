"""Alignment against a longest-common-subsequence table, and layouts with hand-computed measures."""

from hypothesis import given, settings
from hypothesis import strategies as st

from folioscope.operators import alignment as AL
from folioscope.operators import sequence as S


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


def check(a, b, hunks):
    x = y = 0
    for p, q, r, s, equal in hunks:
        assert (p, r) == (x, y) and (not equal or a[p:q] == b[r:s]) and (q > p or s > r)
        x, y = q, s
    assert (x, y) == (len(a), len(b))
    assert all(h[4] != g[4] for h, g in zip(hunks, hunks[1:]))


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=40), st.text("abc", max_size=40))
def test_short_texts_align_best(a, b):
    hunks = AL.Aligner(AL.codes(a), AL.codes(b)).hunks()
    check(a, b, hunks)
    assert sum(q - p for p, q, _, _, equal in hunks if equal) == lcs(a, b)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("abcd ", min_size=20, max_size=60), max_size=8), st.data())
def test_longer_texts_are_covered(parts, data):
    other = [p for p in parts if data.draw(st.booleans())]
    a, b = "".join(parts), "".join(other)
    hunks = AL.Aligner(AL.codes(a), AL.codes(b)).hunks()
    check(a, b, hunks)
    breaks = sorted(data.draw(st.sets(st.integers(0, len(a)), max_size=8)))
    check(a, b, AL.slide(hunks, AL.codes(a), breaks))


def test_a_missing_line_slides_to_its_breaks():
    a, b = "onetwothree", "onethree"
    hunks = AL.slide(AL.Aligner(AL.codes(a), AL.codes(b)).hunks(), AL.codes(a), [0, 3, 6])
    assert hunks == [(0, 3, 0, 3, True), (3, 6, 3, 3, False), (6, 11, 3, 8, True)]
    a, b = "Section one.Section two.", "Section two."
    hunks = AL.slide(AL.Aligner(AL.codes(a), AL.codes(b)).hunks(), AL.codes(a), [0, 12])
    assert hunks == [(0, 12, 0, 0, False), (12, 24, 0, 12, True)]


def test_a_budget_stops_the_work():
    a = AL.Aligner(AL.codes("ab" * 400), AL.codes("ba" * 300 + "c"), work=10)
    assert not a.complete
    check("ab" * 400, "ba" * 300 + "c", a.hunks())


def stream(*pages):
    return AL.Stream([(p, i, 12_000 * i, 10_000, t) for p, lines in enumerate(pages) for i, t in enumerate(lines)], len(pages))


def glyphs(text, baseline=0, x=72_000):
    return [(i, 1, x + 6000 * i, baseline) for i in range(len(text))]


def drawn(*pages, page_count=None):
    """Pages of (text, baseline in points, first column) with a glyph for each character."""
    rows = [(p, i, 1000 * b, 10_000, t, glyphs(t, 1000 * b, 72_000 + 6000 * (c[0] if c else 0))) for p, lines in enumerate(pages) for i, (t, b, *c) in enumerate(lines)]
    return rows, page_count or len(pages)


def compared(a, b):
    return AL.compare(AL.Stream(*a), AL.Stream(*b))


def some(found, *names):
    return tuple(found[n] for n in names)


M = ("m2_total", "m2_agreed", "m3_total", "m3_agreed", "m4_lines", "m4_glyphs")
SPREADS = ("x_median", "x_p95", "x_most", "y_median", "y_p95", "y_most")


def test_measures():
    pages = ([("Alpha beta gamma", 100), ("delta epsilon", 114)], [("zeta eta", 100)])
    same = compared(drawn(*pages), drawn(*pages))
    assert some(same, *M) == (2, 2, 3, 3, 3, 33 - 0) and some(same, *SPREADS) == (0,) * 6 and same["text_matched"] == 33
    a = drawn([("One two three", 100), ("four five six", 114), ("seven eight", 128)], [("nine ten", 100), ("eleven", 114)])
    b = drawn([("One two three", 100), ("four five six", 114)], [("seven eight", 100), ("nine ten", 114), ("eleven", 128)])
    shifted = compared(a, b)
    assert some(shifted, *M) == (2, 1, 5, 5, 2, 22) and shifted["m2_first_difference"] == 1 and shifted["m3_first_difference"] is None
    changed = compared(drawn([("The quick brown fox", 100), ("jumps over the lazy dog", 114), ("Next paragraph", 128)]), drawn([("The quick brown", 100), ("fox jumps over the lazy dog", 114), ("Next paragraph", 128)]))
    assert some(changed, *M) == (1, 1, 3, 2, 1, 13) and changed["m3_first_difference"] == 1 and changed["text_matched"] == changed["text_reference"]
    missing = compared(drawn([("one", 100), ("two", 114), ("three", 128)]), drawn([("one", 100), ("three", 128)]))
    assert some(missing, "m3_total", "m3_agreed", "text_matched") == (3, 2, 8)
    nothing = compared(drawn([("one", 100), ("two", 114)]), ([], 0))
    assert some(nothing, "m3_total", "m3_agreed", "text_candidate", "m4_lines", "x_median") == (2, 0, 0, 0, None)
    assert AL.compare(stream(["of\ufb01ce"]), stream(["office"]))["text_matched"] == 6


def test_glyphs_that_are_offset():
    """Fifteen distances of 0, four of half a point and one of two points to the right; one a quarter point down."""
    a, (rows, n) = drawn([("abcdefghij", 100), ("klmnopqrst", 114)]), drawn([("abcdefghij", 100), ("klmnopqrst", 114)])
    for g in range(4):
        rows[0][5][g] = (g, 1, rows[0][5][g][2] + 500, rows[0][5][g][3])
    rows[1][5][9] = (9, 1, rows[1][5][9][2] + 2000, rows[1][5][9][3] + 250)
    found = compared(a, (rows, n))
    assert some(found, *M) == (1, 1, 2, 2, 2, 20) and some(found, *SPREADS) == (0, 500, 2000, 0, 0, 250)


def test_cells_on_one_baseline_are_one_line():
    row = drawn([("Alpha1 Beta1 Gamma1", 100), ("After the table", 130)])
    cells = drawn([("Alpha1", 100, 0), ("Beta1", 100, 7), ("Gamma1", 100, 13), ("After the table", 130)])
    found = compared(row, cells)
    assert some(found, *M) == (1, 1, 2, 2, 2, 30) and found["x_most"] == 0


def test_a_ligature_against_letters_is_not_measured():
    rows = [(0, 0, 100_000, 10_000, "fine", [(0, 2, 72_000, 100_000), (2, 1, 84_000, 100_000), (3, 1, 90_000, 100_000)])]
    found = compared((rows, 1), drawn([("fine", 100)]))
    assert some(found, "m3_total", "m3_agreed", "m4_glyphs", "x_most") == (1, 1, 2, 0)
    two = [(0, 0, 100_000, 10_000, "fine", [(0, 2, 72_000, 100_000), (0, 2, 75_000, 100_000), (2, 1, 84_000, 100_000), (3, 1, 90_000, 100_000)])]
    assert compared((rows, 1), (two, 1))["m4_glyphs"] == 2  # clusters with another number of glyphs are left out


def test_histograms_are_those_of_columns(spark):
    from folioscope.functions import numeric as N

    values = [0, 1, 2047, 2048, 2049, 4095, 4096, 5000, 123_456_789, 10**13]
    got = spark.createDataFrame([(v,) for v in values], "v long").select("v", N.histogram_bin(N.F.col("v")).alias("bin")).collect()
    assert {r.v: r.bin for r in got} == {v: AL.bins([v])[0]["bin"] for v in values}
    starts = spark.createDataFrame([(AL.bins([v])[0]["bin"], AL.spread(AL.bins([v]))[0]) for v in values], "bin long, start long")
    assert all(r.start == min(r.want, AL.MOST_MILLI) for r in starts.select("start", N.bin_start(N.F.col("bin")).alias("want")).collect())
    assert AL.spread(AL.bins([10**13])) == (AL.MOST_MILLI,) * 3 and AL.spread([]) == (None,) * 3


def test_joined_baselines_make_one_line():
    assert S.joined_lines([0, 4, 20], [10, 6, 10]) == [0, 0, 1]
    assert S.joined_lines([0, None, 1], [10, 10, 10]) == [0, 1, 2]
    assert S.joined_lines([0, 5, 10], [10, 10, 10]) == [0, 0, 1]


def test_fields_and_chains():
    assert S.match_fields(["begin", "separate", "begin", "end", "end"]) == [0, 0, 2, 2, 0]
    assert S.match_fields(["separate", "end", "begin"]) == [None, None, None]
    assert S.match_fields(["begin", "separate", "separate", "end"]) == [0, 0, None, 0]
    assert S.increasing([3, 1, 2, 5, 4]) == [1, 2, 4]
    assert S.increasing([]) == []


def test_breaks_pair_strong_first():
    assert AL.match_breaks([(0, 5, False), (3, 5, True)], [4]) == [None, 0]
    assert AL.match_breaks([(0, 5, False), (3, 5, True)], [2, 4]) == [0, 1]
    assert AL.ranges_of([True, False, True, True]) == [(0, 1), (2, 4)]


def test_glyphs_and_rasters():
    import numpy as np

    a = np.zeros((5, 5), np.uint8)
    b = a.copy()
    b[2, 2] = 255
    assert AL.visual_difference(a, b) == (25, 0)
    b[1:4, 1:4] = 255
    assert AL.visual_difference(a, b)[1] == 21
    assert AL.image_comparison(a, b) == {"pixels": 25, "differing": 9, "beyond_2": 9, "beyond_64": 9, "largest": 255}


def sides(spark, glyphs=False):
    rows = [(d, 1, 0, i, 12_000 * i, 10_000, t) for d, texts in (("a", ["one two", "three"]), ("b", ["four"]), (None, ["five"])) for i, t in enumerate(texts)]
    lines = spark.createDataFrame(rows, "doc string, page_count int, page int, line int, baseline long, size long, text string")
    if glyphs:
        lines = lines.selectExpr("*", "transform(sequence(0, length(text) - 1), i -> named_struct('offset', i, 'length', 1, 'x', i * 6000L, 'y', baseline)) AS glyphs")
    return lines, lines.where("doc = 'a' or doc is null")


def test_comparisons_cross_line_by_line(spark):
    reference, candidate = sides(spark, True)
    out = AL.compare_layouts(reference, candidate)
    plan = out._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "Join" not in plan
    got = sorted((r.doc or "", r.pages_reference, r.pages_candidate, r.m3_total, r.m3_agreed, r.m4_glyphs, r.text_matched) for r in out.collect())
    assert got == [("", 0, 1, 0, 0, 0, 0), ("", 1, 0, 1, 0, 0, 0), ("a", 1, 1, 2, 2, 11, 11), ("b", 1, 0, 1, 0, 0, 0)]
    many = spark.createDataFrame([(str(d), 1, 0, 0, 0, 10_000, "x" * 9) for d in range(900)], reference.columns[:7])
    assert {(r.m3_agreed, r.text_matched) for r in AL.compare_layouts(many, many).collect()} == {(1, 9)} and AL.compare_layouts(many, many).count() == 900


def test_length_of_a_reference_of_many_lines(spark):
    lines = spark.range(30_000).selectExpr("string(id % 2) AS doc", "1 AS page_count", "0 AS page", "int(id) AS line", "id * 12000 AS baseline", "10000L AS size", "'a b' AS text")
    out = AL.compare_layouts(lines, lines)
    assert "collect_list" not in out._jdf.queryExecution().toString()
    assert [tuple(r) for r in out.select("doc", "text_reference", "m3_agreed").orderBy("doc").collect()] == [("0", 30_000, 15_000), ("1", 30_000, 15_000)]


def test_a_candidate_without_its_last_line_meets_all_lines_in_one_shuffle(spark):
    reference, _ = sides(spark, True)
    out = AL.compare_layouts(reference.where("doc = 'a'"), reference.where("doc = 'a' and line = 0"))
    assert "collect_list" not in out._jdf.queryExecution().toString()
    assert [(r.m3_total, r.m3_agreed, r.m4_lines, r.m4_glyphs, r.text_reference, r.text_matched) for r in out.collect()] == [(2, 1, 1, 6, 11, 6)]


def test_hints_of_documents_cross_line_by_line(spark):
    reference, candidate = sides(spark)
    out = AL.paired(reference, candidate, lambda x, y: AL.hint_agreement(x.text, [3], y), "total long, agreed long, pages_reference long, pages_candidate long")
    assert "collect_list" not in out._jdf.queryExecution().toString()
    assert sorted((r.doc or "", r.total, r.pages_candidate) for r in out.collect()) == [("", 1, 0), ("", 1, 1), ("a", 1, 1), ("b", 1, 0)]

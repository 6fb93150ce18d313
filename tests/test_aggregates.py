"""Golden values of run aggregation, correlations, baselines and ranges."""

from pyspark.sql import functions as F

from folioscope.operators import aggregate as A
from folioscope.operators import catalog as C


def test_correlations(spark):
    rows = [([n for n, ok in (("F", i < 5), ("H", i in (0, 1, 2, 5, 6)), ("G", i == 0)) if ok], 1000 if i < 5 else 0) for i in range(10)]
    got = {r.feature: r for r in A.correlations(spark.createDataFrame(rows, "features array<string>, d long")).collect()}
    assert set(got) == {"F", "H"}
    assert got["F"].correlation == 1000 and got["H"].correlation == 200
    assert (got["H"]["disagreement_with"], got["H"]["disagreement_without"]) == (600, 400)


def test_nothing_correlates_without_spread(spark):
    rows = [(["F"] if i < 5 else [], 7) for i in range(10)]
    assert A.correlations(spark.createDataFrame(rows, "features array<string>, d long")).count() == 0


def test_percentiles(spark):
    df = spark.createDataFrame([("a", v) for v in (1, 2, 3, 4)] + [("b", 5000)], "g string, v long")
    got = {r.g: r for r in A.percentiles(A.histogram(df, ["g"], "v"), ["g"], {"median": 500, "p95": 950}).collect()}
    assert (got["a"].median, got["a"].p95, got["a"].max) == (2, 4, 4)
    assert (got["b"].median, got["b"].max) == (5000 // 4 * 4, 5000)


def test_baseline(spark):
    schema = "sha256 string, digest string, pages_match boolean, m2 array<long>, m3 array<long>, m7 array<long>"
    before = [("same", "d", True, [0], [0, 1], None), ("lost", "d", True, [0], [0, 1], [3]), ("won", "d", False, [], [0], None), ("both", "d", True, [0], [0], None), ("new layout", "d", True, [0], [0], [1]), ("gone", "d", True, [], [], None), ("pages", "d", True, [], [], None), ("came", None, None, None, None, None)]
    now = [("same", "d", True, [0], [0, 1], None), ("lost", "d", True, [0], [0], [3]), ("won", "d", True, [], [0, 2], None), ("both", "d", True, [1], [0], None), ("new layout", "e", False, [], [], [1, 2]), ("fresh", "d", True, [], [], None), ("pages", "d", False, [], [], None), ("came", "x", True, [0], [0], None)]
    got = {r.sha256: (r.status, r.rebaselined) for r in A.baseline_diff(spark.createDataFrame(now, schema), spark.createDataFrame(before, schema)).collect()}
    assert got == {"same": ("unchanged", False), "lost": ("regressed", False), "won": ("improved", False), "both": ("regressed", False), "new layout": ("improved", True), "gone": ("missing", False), "fresh": ("added", False), "pages": ("regressed", False), "came": ("improved", False)}


def test_run_aggregate(spark):
    schema = "sha256 string, tier string, mode int, features array<string>, scripts array<string>, reference string, candidate string, pages_reference long, pages_candidate long, m2_total long, m2_agreed long, m3_total long, m3_agreed long, hints_outcome string, m7_total long, m7_agreed long, text_reference long, text_candidate long, text_matched long, problem string, complete boolean, m4_lines long, m4_glyphs long, m7_pages_reference long, m7_pages_candidate long"
    rows = [
        ("a", "T1", 15, ["Tables", "Fields", "Fields"], ["Latin"], "present", "present", 1, 1, 1, 1, 3, 3, "absent", None, None, 60, 60, 60, None, True, 3, 51, None, None),
        ("b", "T1", None, ["Tables"], ["Latin", "Hebrew"], "present", "present", 2, 1, 1, 0, 3, 2, "absent", None, None, 50, 50, 36, None, False, 1, 10, None, None),
        ("c", "T2", 14, ["Fields"], ["Latin"], "present", "missing", 1, 1, 1, 1, 3, 0, "absent", None, None, 34, 0, 0, None, True, 0, 0, None, None),
        ("d", "T1", 15, ["Footnotes"], ["Latin"], "missing", "missing", None, None, None, None, None, None, "agreement", 4, 2, None, None, None, "no store", None, None, None, 3, 3),
        ("e", "T2", None, [], [], "missing", "missing", None, None, None, None, None, None, "refused", None, None, None, None, None, None, None, None, None, None, None),
    ]
    got = {(r.dimension, r.key): r for r in A.run_aggregate(spark.createDataFrame(rows, schema)).collect()}
    all_ = got["overall", ""]
    assert (all_.documents, all_.compared, all_.without_reference, all_.without_candidate) == (5, 3, 2, 3)
    assert (all_.m3_total, all_.m3_agreed, all_.m2_total, all_.m2_agreed, all_.m1_matching, all_.m1_difference) == (9, 5, 3, 2, 2, 1)
    assert (all_.m7_documents, all_.m7_total, all_.m7_agreed, all_.m7_refused, all_.text_reference, all_.text_matched) == (1, 4, 2, 1, 144, 96)
    assert (all_.failed, all_.text_incomplete, all_.m4_lines, all_.m4_glyphs, all_.m7_pages_matching) == (1, 1, 4, 61, 1)
    assert (got["feature", "Tables"].m3_total, got["feature", "Tables"].m3_agreed) == (6, 5)
    assert got["script", "Hebrew"].m3_agreed == 2 and got["feature", "Fields"].documents == 2
    assert got["mode", "not set"].documents == 2


def test_ranges(spark):
    df = spark.createDataFrame([("d", i) for i in (1, 2, 3, 7, 9, 10)], "doc string, idx long")
    assert sorted((r.first, r.end) for r in A.compress(df, "doc").collect()) == [(1, 4), (7, 8), (9, 11)]
    other = spark.createDataFrame([("d", 2, 8)], "doc string, first long, end long")
    assert A.outside(A.compress(df, "doc"), other, "doc").first().outside == 3


def test_worst_hides_private_documents(spark):
    df = spark.createDataFrame([("a", "T1", 4, 4, 1, 1, 0), ("b", "T1", 4, 2, 1, 1, 0), ("c", "T2", 4, 0, 1, 1, 0), ("d", "T1", 0, 0, 1, 1, 0), ("e", "T1", 8, 4, 1, 1, -3)], "sha256 string, tier string, m3_total long, m3_agreed long, m2_total long, m2_agreed long, page_difference long")
    assert [r.sha256 for r in A.worst(df).collect()] == ["e", "b", "a"]


def test_violations(spark):
    schema = "sha256 string, size long, tier string, license string, provenance array<struct<source:string,path:string>>, features array<string>"
    rows = [("ok", 1, "T1", "MIT", [("s", "a")], ["A", "B"]), ("zero", 0, "T1", "MIT", [("s", "b")], ["A"]), ("priv", 1, "T2", "MIT", [("s", "c")], ["A"]), ("lic", 1, "T1", "GPL-3.0", [("s", "d")], []), ("none", 1, "T1", "MIT", [], []), ("twice", 1, "T1", "MIT", [("s", "e"), ("s", "e")], []), ("path", 1, "T1", "MIT", [("s", "../x")], []), ("undef", 1, "T1", "MIT", [("t", "f")], []), ("order", 1, "T1", "MIT", [("s", "g")], ["B", "A"]), ("raw", 1, "T1", "MIT", [("s", "a")], None)]
    corpus = spark.createDataFrame(rows, schema)
    got = {(r.sha256, r.rule) for r in C.violations(corpus, C.places_of(corpus), spark.createDataFrame([("s", "MIT")], "name string, license string")).collect()}
    assert got == {("zero", "size"), ("priv", "private license"), ("priv", "private path"), ("lic", "license"), ("lic", "license differs from source"), ("none", "no provenance"), ("twice", "provenance twice"), ("path", "path"), ("undef", "source not defined"), ("order", "features not sorted"), ("raw", "not tagged"), ("raw", "path of two documents")}


def test_public_guard(spark):
    import pytest

    df = spark.createDataFrame([("T1",), ("T2",)], "tier string")
    with pytest.raises(Exception, match="private"):
        C.only_public(df).collect()
    assert C.only_public(df.where("tier = 'T1'")).count() == 1
    assert F.lit(1) is not None


def test_held_passages_of_any_length_and_number(spark):
    """One block of passages or many give what a search in each text gives; nulls, empty passages, repeats and long texts too."""
    texts = ["the quick brown fox jumps", "short", "", None, "a passage of thirteen and more", "x" * 50_000 + "needle" + "y" * 50_000, "Ünï 😀 cödé", "short"]
    bench = ["brown fox", "short", None, "needle", "passage of thirteen and more words", "😀 c", "short", "quick brown fox jumps over"]
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)] + [(None, "brown fox", "z")], "doc_id int, text string, p string")
    for extra in ([], [""]):
        passages = spark.createDataFrame([(p,) for p in bench + extra], "text string")
        want = {i for i, t in [*enumerate(texts), (None, "brown fox")] if t is not None and any(p in t for p in bench + extra if p is not None)}
        for chars in (None, 8, 1):
            got = [r.doc_id for r in C.holding(docs, passages, chars=chars).collect()]
            assert len(got) == len(set(got)) and set(got) == want
    assert C.holding(docs, spark.createDataFrame([], "text string")).count() == 0


def test_deduplicate_keeps_places_as_rows(spark):
    rows = spark.createDataFrame([("a", 1, "s2", "p2", 2), ("a", 1, "s1", "p1", 1), ("b", 3, "s1", None, 3)], "sha256 string, size long, source string, path string, seq int")
    documents, places = C.deduplicate(rows)
    assert {tuple(r) for r in documents.collect()} == {("a", 1, "s1", 2), ("b", 3, "s1", 1)}
    assert {tuple(r) for r in places.collect()} == {("a", 2, "s2", "p2"), ("a", 1, "s1", "p1"), ("b", 3, "s1", None)}


def test_correlation_is_exact_in_integers():
    """Against fractions, on sums far beyond what doubles hold."""
    from fractions import Fraction
    from math import isqrt

    for n, s, q, k, t in ((10, 5000, 5_000_000, 5, 5000), (10, 5000, 5_000_000, 5, 3000), (10**9, 3 * 10**11, 2 * 10**14, 10**6 + 3, 4 * 10**8 + 7), (10, 5000, 2_500_000, 5, 2500), (4, 8, 24, 1, 0)):
        spread = n * q - s * s
        if not spread:
            assert A.point_biserial(n, s, q, k, t) is None
            continue
        top = n * t - k * s
        square = Fraction(top * top * 10**6, k * (n - k) * spread)
        root = min(1000, next(r for r in range(isqrt(int(square)), 1002) if int(square) <= r * r + r))
        assert A.point_biserial(n, s, q, k, t) == (root if top >= 0 else -root)


def test_ranges_outside_others_without_a_join(spark):
    kind = "doc string, first int, `end` int"
    a = spark.createDataFrame([("a", 0, 5), ("a", 8, 9), ("b", 2, 4), (None, 1, 3), ("d", 0, 9)], kind)
    b = spark.createDataFrame([("a", 1, 2), ("a", 4, 8), ("c", 0, 9), (None, 0, 9), ("d", 0, 4), ("d", 4, 9)], kind)
    out = A.outside(a, b, "doc")
    assert "Join" not in out._jdf.queryExecution().toString()
    assert {tuple(r) for r in out.collect()} == {("a", 4), ("b", 2), (None, 2), ("d", 0)}

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from folioscope.llm import queries, url_filter
from folioscope.llm.url_filter import ShiftAnd


def regex(glob):
    out, i = "", 0
    while i < len(glob):
        if glob[i] == "*":
            n = i
            while i < len(glob) and glob[i] == "*":
                i += 1
            out += ".*" if i - n > 1 else "[^/]*"
            continue
        out += "[^/]" if glob[i] == "?" else re.escape(glob[i])
        i += 1
    return re.compile(out, re.S)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab/*?", max_size=9), min_size=1, max_size=30), st.lists(st.text("ab/", max_size=12), min_size=1, max_size=8))
def test_automaton_against_regex(globs, urls):
    got = ShiftAnd(globs).run([u.encode() for u in urls])
    assert got.tolist() == [[bool(regex(g).fullmatch(u)) for g in globs] for u in urls]


def test_contract_cases(spark):
    urls = ["https://example.org/en/1", "https://a.example.org/en/12?x", "http://EXAMPLE.org/es/", "http://example.org/en/2", "http://myorg/", "http://x.com/fr/1", "http://x.com/de/", "http://x.com/", "http://x.org", "http://casino.net/x", None, "nothing", "", "http://foo.net/x.org/", "http://x.org?/org/", "://org/", "http://ORG/a#b"]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)] + [(None, urls[0], "h", "r"), (0, urls[0], "h", "r")], "page_id long, url string, host string, rule string")
    rules = [url_filter.domain_rule(r, v) for r, v in queries.DOMAIN_RULES] + [url_filter.Rule("*casino*/**", "*casino*/**", "block", 0)]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, rules).collect()}
    assert got[0] == got[None] == ("example.org", "/en/1", "example.org/en/1", "block")
    assert got[1] == ("a.example.org", "/en/12", "example.org/en/1", "block")
    assert got[2] == ("example.org", "/es/", "example.org/es/", "block")
    assert got[3][2:] == ("org/", "allow") and got[4][2:] == (None, "allow")
    assert got[5][2:] == ("com/fr/", "allow") and got[6][2:] == ("com/de/", "block") and got[7][2:] == (None, "allow")
    assert got[8] == ("x.org", "", None, "allow") and got[9][2:] == ("*casino*/**", "block")
    assert got[10] == got[11] == got[12] == ("", "", None, "allow")
    assert got[13][2] is None and got[14] == ("x.org", "", None, "allow") and got[15][:3] == ("org", "/", "org/") and got[16][:3] == ("org", "/a", "org/")


def test_long_urls_and_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://x.org/" + "a" * 200_000), (2, "http://x.org/")], "page_id long, url string")
    rules = [url_filter.domain_rule("org/", "block")]
    assert {r.verdict for r in url_filter.judge_urls(pages, rules).collect()} == {"block"}
    assert url_filter.judge_urls(pages.where("false"), rules).count() == 0
    assert url_filter.allowed(pages, rules).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(pages, []).collect()} == {"allow"}

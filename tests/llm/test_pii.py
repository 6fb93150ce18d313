import re

import pytest
from pyspark.sql import functions as F

from folioscope.llm import pii_surrogates as P

KEY = "a key of the tests"
TEXTS = [
    "Mail bob.23@mail3.example.com or BOB.23@MAIL3.EXAMPLE.COM.",
    "Mr. John Smith met Mary Smith; Mrs. SMITH and Ms Jones left. Frau Müller, г-н Иван Петров, κ. Γιώργος Παππάς.",
    "Cards 4111 1111 1111 1111 and 4111111111111111 and 4111111111111112.",
    "IBAN DE89370400440532013000 or DE89 3704 0044 0532 0130 00.",
    "Call +1 (017) 555-7713 or +10175557713, ssn 123-45-6789, host 10.1.2.3.",
    None, "", "No entity at all: 12 apples, v1.2.3, Of Of The End.", "a@b.co a@b.co c@b.co",
]


@pytest.fixture(scope="module")
def out(spark):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(TEXTS)] + [(None, TEXTS[0], 2, "y")], "doc_id int, text string, pii_count int, __pii_n string")
    got = P.pseudonymise(docs, KEY)
    assert got.columns == ["doc_id", "text", "__pii_n", "pii_count", "pii_kinds"]
    return {r.doc_id: r for r in got.collect()}


def test_nothing_of_the_entities_is_left(out):
    for word in ("bob", "mail3.example", "Smith", "SMITH", "John", "Mary", "Jones", "Müller", "Петров", "Иван", "Παππάς", "4111 1111", "41111111", "3704", "555-7713", "5557713", "123-45", "10.1.2.3"):
        assert not any(word.lower() in (r.text or "").lower() for r in out.values()), word
    assert out[5].text is None and out[5].pii_count == 0 and out[6].text == "" and out[7].text == TEXTS[7] and out[7].pii_kinds == []


def test_format_type_and_coreference(out):
    a, b = re.findall(r"\S+@\S+[a-zA-Z]", out[0].text)
    assert b == a.upper() and re.fullmatch(r"[a-z]{3}\.\d\d@[a-z]{4}\d\.[a-z]{7}\.com", a) and out[None].text == out[0].text
    m = re.fullmatch(r"Mr\. (\S+) (\S+) met (\S+) (\S+); Mrs\. (\S+) and Ms (\S+) left\. Frau (\S+), г-н (\S+) (\S+), κ\. (\S+) (\S+)\.", out[1].text).groups()
    assert m[1] == m[3] and m[4] == m[1].upper() and m[5] not in m[:2]
    assert m[0] in P.GIVEN["latin", "m"] and m[2] in P.GIVEN["latin", "f"] and m[7] in P.GIVEN["cyrillic", "m"] and m[9] in P.GIVEN["greek", "m"]
    assert re.fullmatch("[А-я]+", m[8]) and re.fullmatch("[Α-ω]+", m[10])
    x, y, z = re.findall(r"(?:\d ?){16}", out[2].text)
    assert x.strip().replace(" ", "") == y.strip() and re.fullmatch(r"\d{4} \d{4} \d{4} \d{4}", x.strip())

    def luhn(n):
        return sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(n))) % 10 == 0

    assert luhn(y.strip()) and not luhn(z.strip())
    p, q = re.findall(r"DE[0-9 ]+\d", out[3].text)
    assert q.replace(" ", "") == p and int(p[4:] + "1314" + p[2:4]) % 97 == 1
    assert re.fullmatch(r"Call \+1 \(\d{3}\) \d{3}-\d{4} or \+1\d{10}, ssn \d{3}-\d\d-\d{4}, host \d+\.\d+\.\d+\.\d+\.", out[4].text)
    assert out[4].pii_kinds == ["ip", "phone", "ssn"] and out[4].pii_count == 4
    a, b, c = out[8].text.split()
    assert a == b != c and a.split("@")[1] == c.split("@")[1]


def test_other_keys_give_other_surrogates(spark, out):
    docs = spark.createDataFrame([(0, TEXTS[0])], "doc_id int, text string")
    assert P.pseudonymise(docs, key="other").first().text != out[0].text
    assert P.pseudonymise(docs, KEY).first().text == out[0].text


def test_collisions_are_resolved(spark):
    """One-letter local parts leave 26 surrogates: all must stay distinct, and none may be another's value."""
    names = [f"{c}@d.example.org" for c in "abcdefghijklmnopqrstuvwxyz"] + [f"{i:03d}-{i % 90 + 10:02d}-{i:04d}" for i in range(300)]
    docs = spark.createDataFrame([(i % 50, n) for i, n in enumerate(names)], "doc_id int, text string")
    known = P.keep(P.values(docs, "text"))
    assert P.exceptions(known, KEY).count() > 0
    got = [r.text for r in P.pseudonymise(docs, KEY).collect()]
    assert len(set(got)) == len(names) and not set(got) & set(names)


def test_more_persons_than_names_of_four_syllables(spark, monkeypatch):
    """Two syllables leave 16 names at first; all of 60 persons must get one of their own, in few rounds."""
    monkeypatch.setitem(P.SYLLABLES, "latin", ["ba", "do"] * 8)
    kept, calls = P.keep, []

    def counted(df):
        calls.append(1)
        assert len(calls) < 30, "rounds without end"
        return kept(df)

    monkeypatch.setattr(P, "keep", counted)
    names = [f"Q{a}{b}" for a in "abcdef" for b in "ghijklmnop"] + ["Badobado"]
    got = [r.text for r in P.pseudonymise(spark.createDataFrame([(i, f"Mr {n}") for i, n in enumerate(names)], "doc_id int, text string"), KEY).collect()]
    assert len(set(got)) == len(names) and not {g.lower() for g in got} & {f"mr {n}".lower() for n in names}
    assert all(re.fullmatch("Mr (?:ba|do){4,}", g, re.I) for g in got)


def test_main_path_is_native(spark):
    docs = spark.createDataFrame([(0, TEXTS[0])], "doc_id int, text string")
    plan = P.pseudonymise(docs, KEY)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_empty(spark):
    assert P.pseudonymise(spark.createDataFrame([], "doc_id int, text string"), KEY).count() == 0
    assert P.GIVEN and F


def test_a_key_is_required_and_enters_by_hmac(spark):
    import hashlib
    import hmac

    docs = spark.createDataFrame([(0, TEXTS[0])], "doc_id int, text string")
    with pytest.raises((ValueError, TypeError)):
        P.pseudonymise(docs, "")
    with pytest.raises(TypeError):
        P.pseudonymise(docs)
    for key in ("k", "x" * 64, "y" * 65, "ключ"):
        got = docs.select(P.hmac_hex(key, F.col("text"))).first()[0]
        assert got == hmac.new(key.encode(), TEXTS[0].encode(), hashlib.sha256).hexdigest()


def test_names_by_label_and_surname_addresses_and_numbers_of_other_countries(spark):
    texts = ["Dr Иванов wrote to г-жа Иванова, г-н Достоевский to г-жа Достоевская; Ms Nováková and Mr Novák.", "We met Chen Wei. Name: Zoltan Kodaly said 姓名：王小明 so", "Mail jörg@bücher.de or ящик@почта.рф", "Ring 0171 23456789 or 01 23 45 67 89.", "No name: Of The End, at 12:30, Room: 5, ratio 01.02.2020, item 0171-2."]
    got = [r.text for r in P.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), KEY).orderBy("doc_id").collect()]
    a, b, c, d, e, f = re.fullmatch(r"Dr (\w+) wrote to г-жа (\w+), г-н (\w+) to г-жа (\w+); Ms (\w+) and Mr (\w+)\.", got[0]).groups()
    assert b == a + "а" and a.endswith("ов") and c.endswith("ский") and d == c[:-2] + "ая" and e == f + "ová" and not {"Иванов", "Достоевский", "Novák"} & {a, c, f}
    x, y, z, han = re.fullmatch(r"We met (\w+) (\w+)\. Name: (\w+ \w+) said 姓名：(\w+) so", got[1]).groups()
    assert (x, y) != ("Chen", "Wei") and z != "Zoltan Kodaly" and re.fullmatch("[一-鿿]{2,}", han) and han != "王小明"
    assert re.fullmatch(r"Mail [a-z]{4}@[a-z]{6}\.de or [а-я]{4}@[а-я]{5}\.рф", got[2]) and "ö" not in got[2] and "ящик" not in got[2]
    assert re.fullmatch(r"Ring \d{4} \d{8} or \d\d \d\d \d\d \d\d \d\d\.", got[3]) and "23456789" not in got[3]
    assert got[4] == texts[4]


def test_awkward_rows(docs, rows):
    """The shared table: nulls, repeats, a very long text and clashing names; only texts may change, the same text always alike."""
    out = P.pseudonymise(docs, KEY)
    assert out.columns == [*docs.columns, "pii_count", "pii_kinds"]
    got = out.collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((r[0] is None, r[0] or 0) for r in rows)
    want = {r[1] for r in rows}
    assert all(r.text in want and r.pii_count == 0 for r in got)


def brute(texts):
    """Places of entities, found by the same patterns in another engine."""
    import regex

    # \\p{IsHan} of the JVM is \\p{Han}; the engine knows lookbehind of any length
    return [[(m.start(), m.end()) for m in regex.finditer(P.ALL.replace("IsHan", "Han"), t or "")] for t in texts]


def test_what_lies_between_entities_is_untouched(spark, sf):
    """All documents against an own search: the number of entities, and every character outside them."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = {r.doc_id: r for r in P.pseudonymise(docs, KEY).collect()}
    rows = docs.collect()
    long = spark.createDataFrame([(1, "word " * 100_000 + "mail a.b@c.example.org " + "x" * 100_000)], "doc_id int, text string")
    assert P.pseudonymise(long, KEY).first().pii_count == 1
    hits = 0
    for r, spans in zip(rows, brute([r.text for r in rows]), strict=True):
        new, at = out[r.doc_id].text, 0
        assert out[r.doc_id].pii_count == len(spans)
        last = 0
        for i, (a, b) in enumerate(spans):
            assert new[at : at + a - last] == r.text[last:a]
            at += a - last
            follows = r.text[b : spans[i + 1][0] if i + 1 < len(spans) else len(r.text)]
            end = new.find(follows, at + 1) if follows else len(new)
            assert end > at and new[at:end] != r.text[a:b]
            at, last, hits = end, b, hits + 1
        assert new[at:] == r.text[last:]
    assert hits > 0


def test_collisions_by_text_and_not_by_id(spark, monkeypatch):
    """Null ids and many copies of a text that needs attempts: each row is rewritten alike, also where nothing is broadcast."""
    names = [f"{c}@d.example.org" for c in "abcdefghijklmnopqrstuvwxyz"]
    rows = [(None, n) for n in names] * 2 + [(1, names[0] + " " + names[1])] * 300
    docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(3)
    want = sorted(map(tuple, P.pseudonymise(docs, KEY).select("text", "pii_count").collect()))
    assert len({t for t, n in want if n == 1}) == 26
    from folioscope.llm import common

    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, P.pseudonymise(docs, KEY).select("text", "pii_count").collect())) == want

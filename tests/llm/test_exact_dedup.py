import hashlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from folioscope.llm import common, exact_dedup
from folioscope.llm.exact_dedup import CountingQuotientFilter

WHITE = dict.fromkeys(map(ord, " \t\n\x0b\x0c\r"))


def expected(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[(r[1] or "").translate(WHITE)].append((-len(r[1] or ""), r[0] is None, r[0] or 0, r[0]))
    out = Counter()
    for text, members in groups.items():
        members.sort()
        for i, m in enumerate(members):
            out[(m[3], members[0][3], len(members), i == 0, hashlib.sha256(text.encode()).hexdigest())] += 1
    return out


def test_against_brute_force(docs, rows):
    got = Counter(tuple(r) for r in exact_dedup.exact_groups(docs).collect())
    assert got == expected(rows)


def test_shuffled_paths_agree(docs, rows, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    got = Counter(tuple(r) for r in exact_dedup.exact_groups(docs).collect())
    assert got == expected(rows)
    kept = Counter((r.text or "").translate(WHITE) for r in exact_dedup.drop_copies(docs).collect())
    assert set(kept.values()) == {1}


def test_drop_copies_keeps_one_of_each(docs, rows):
    out = exact_dedup.drop_copies(docs)
    assert out.columns == docs.columns
    got = Counter((r.text or "").translate(WHITE) for r in out.collect())
    assert set(got.values()) == {1} and set(got) == {(r[1] or "").translate(WHITE) for r in rows}


def test_empty(empty):
    assert exact_dedup.exact_groups(empty).count() == 0
    assert exact_dedup.drop_copies(empty).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 50), max_size=60), min_size=1, max_size=5))
def test_filters_merge_losslessly(parts):
    filters = [CountingQuotientFilter.build(0, np.array(p, np.uint64)) for p in parts]
    again = [CountingQuotientFilter.from_bytes(f.to_bytes()) for f in filters]
    prints, counts = CountingQuotientFilter.merge_all(0, again).items()
    assert prints.tolist() == sorted(set(prints.tolist()))
    assert dict(zip(prints.tolist(), counts.tolist(), strict=True)) == dict(Counter(x for p in parts for x in p))


def test_filters_follow_what_they_hold():
    """Bytes a distinct fingerprint of one partition of 200,000, of 500 partitions (10^8 rows) and of 50,000 (10^10)."""
    prints = np.random.default_rng(4).integers(0, 2**64, 200_000, dtype=np.uint64)
    for rows, most in ((10**8, 6.5), (10**10, 7.5)):
        cut = exact_dedup.shard_filters(prints, exact_dedup.shard_bits(rows))
        assert sum(8 + len(blob) for _, blob in cut) / len(prints) < most
        assert rows / 2 ** exact_dedup.shard_bits(rows) <= exact_dedup.SHARD_ROWS


def test_a_merge_holds_two_runs_at_a_time(monkeypatch):
    rng = np.random.default_rng(5)
    parts = [rng.integers(0, 50_000, 1000, dtype=np.uint64) for _ in range(64)]
    most, made = [0], CountingQuotientFilter.items
    live = []

    def items(self):
        live.append(len(self))
        most[0] = max(most[0], len(self))
        return made(self)

    monkeypatch.setattr(CountingQuotientFilter, "items", items)
    merged = CountingQuotientFilter.merge_all(0, (CountingQuotientFilter.build(0, p) for p in parts))
    assert len(live) == 2 * 63 and most[0] <= len(merged)  # each merge unpacks two, none larger than the result
    values, counts = made(merged)
    assert dict(zip(values.tolist(), counts.tolist(), strict=True)) == Counter(int(x) for p in parts for x in p)


def test_repeated_fingerprints(spark, monkeypatch):
    df = spark.createDataFrame([(i % 700 - 350,) for i in range(1000)], "fp long").repartition(5)
    want = {x: n for x, n in Counter(i % 700 - 350 for i in range(1000)).items() if n > 1}
    for rows in (1000, 5_000_000, 10**10):  # one shard, a few, thousands
        assert {r.fp: r.n for r in exact_dedup.repeated_fingerprints(df, rows).collect()} == want

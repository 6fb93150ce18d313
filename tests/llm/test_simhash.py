import random
from collections import Counter, defaultdict

import numpy as np
import xxhash

from folioscope.llm import common, simhash


def brute_print(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate({9: 32, 10: 32, 11: 32, 12: 32, 13: 32}).split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    all_ = sorted(prints)
    for i, a in enumerate(all_):
        for b in all_[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    return {p: find(p) for p in prints}


def test_against_brute_force(docs, rows):
    got = Counter((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash.near_groups(docs).collect())
    prints = [brute_print(r[1]) for r in rows]
    comp = brute_components(set(prints))
    least = defaultdict(list)
    for r, p in zip(rows, prints, strict=True):
        if r[0] is not None:
            least[comp[p]].append(r[0])
    assert got == Counter((r[0], p, min(least[comp[p]], default=None)) for r, p in zip(rows, prints, strict=True))


def clusters(n, seed):
    rng = random.Random(seed)
    out = set()
    for _ in range(n):
        base = rng.getrandbits(64)
        out.add(base)
        for _ in range(rng.randint(0, 12)):
            x = base
            for b in rng.sample(range(64), rng.randint(1, 5)):
                x ^= 1 << b
            out.add(x)
            base = rng.choice([base, x])
    return out


def linked_components(spark, prints, limit):
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    edges = simhash.linked(spark.createDataFrame(signed, "fp long").repartition(3), limit).collect()
    for e in edges:
        assert ((e.u ^ e.v) & (2**64 - 1)).bit_count() <= 3
    root = {p[0]: p[0] for p in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for e in edges:
        root[find(e.u)] = find(e.v)
    groups = defaultdict(set)
    for p in signed:
        groups[find(p[0])].add(p[0] & (2**64 - 1))
    return {frozenset(g) for g in groups.values()}


def wanted(prints):
    groups = defaultdict(set)
    for p, r in brute_components(prints).items():
        groups[r].add(p)
    return {frozenset(g) for g in groups.values()}


def test_links_of_random_clusters(spark):
    prints = clusters(60, 5)
    assert linked_components(spark, prints, simhash.BLOCK_ROWS) == wanted(prints)


def test_blocks_above_the_limit_lose_nothing(spark):
    rng = random.Random(8)
    base = rng.getrandbits(64)
    prints = {base ^ sum(1 << b for b in rng.sample(range(40), rng.randint(0, 6))) for _ in range(300)} | clusters(10, 6)
    assert linked_components(spark, prints, 8) == wanted(prints)


def test_a_hot_key_of_many_prints_is_split(spark, monkeypatch):
    """200,000 prints of one key: no task holds more rows of a key than the limit, and the components are those of brute force."""
    rng = np.random.default_rng(2)
    head = 0xABCDEF << 40
    prints = np.unique(rng.integers(0, 1 << 40, 200_000, dtype=np.uint64)) | np.uint64(head)
    planted = [(int(p), int(p) ^ 1 << 3 ^ 1 << 17 ^ 1 << 39) for p in prints[::20_000]]
    every = sorted({int(p) for p in prints} | {b for _, b in planted})
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in every], "fp long").repartition(4).checkpoint()
    limit, most = 2000, []
    plain = simhash.compare

    def watched(batches):
        from itertools import groupby

        held = [b for b in batches if b.num_rows]
        sizes = [len(list(g)) for _, g in groupby(k for b in held for k in b.column(0).to_pylist())]
        assert max(sizes, default=0) <= 2000, max(sizes)
        return plain(iter(held))

    monkeypatch.setattr(simhash, "compare", watched)
    edges = [(r.u & (2**64 - 1), r.v & (2**64 - 1)) for r in simhash.linked(df, limit).collect()]
    assert all(0 < (a ^ b).bit_count() <= 3 for a, b in edges)
    want = set()
    bits = [1 << i for i in range(40)]
    known = set(every)
    for p in every[:: len(every) // 3000]:  # all neighbours within two bits of a few thousand prints, and the planted ones at three
        for i, x in enumerate(bits):
            want |= {(p, q) for q in (p ^ x, *(p ^ x ^ y for y in bits[:i])) if q in known}
    root = {p: p for p in every}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        root[find(a)] = find(b)
    assert planted and all(find(a) == find(b) for a, b in [*want, *planted])


def test_a_star_of_many_edges(spark, monkeypatch):
    """100,000 edges of one hub and a chain, with every table too large to broadcast."""
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    edges = spark.range(1, 100_001).selectExpr("500000L as u", "id as v").unionByName(spark.range(600_000, 600_020).selectExpr("id as u", "id + 1 as v"))
    got = {r.node: r.root for r in common.components(edges).collect()}
    assert got == {i: 1 for i in [*range(1, 100_001), 500_000]} | {i: 600_000 for i in range(600_000, 600_021)}


def test_shuffled_paths_agree(docs, rows, monkeypatch):
    want = Counter(tuple(r) for r in simhash.near_groups(docs).collect())
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    assert Counter(tuple(r) for r in simhash.near_groups(docs).collect()) == want


def test_every_pair_within_three_bits_shares_a_chain():
    rng = np.random.default_rng(1)
    for _ in range(3000):
        diff = np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False)))
        turned = simhash.rotate(np.full(4, diff), np.arange(4))
        first_equal = (turned >> np.uint64(48)) == 0
        assert any(first_equal[i] and len(simhash.chain(turned[i : i + 1])) for i in range(4))


def test_one_of_each_group_stays(docs):
    out = simhash.drop_near_copies(docs.where("doc_id is not null").dropDuplicates(["doc_id"]))
    assert out.columns == docs.columns
    groups = {r.doc_id: r.component_id for r in simhash.near_groups(docs).collect()}
    assert sorted(r.doc_id for r in out.collect()) == sorted({v for k, v in groups.items() if k is not None})


def test_one_row_of_each_group_stays_with_null_and_repeated_ids(docs, rows):
    """By rows: of each group one, that of the smallest id, or one without an id if none has one."""
    extra = docs.sparkSession.createDataFrame([(None, "p q r s t u"), (None, "p q r s t u"), (7, "quite another text of its own"), (8, "p2 q2 r2 s2"), (8, "p2 q2 r2 s2")], "doc_id long, text string")
    whole = docs.select("doc_id", "text").unionByName(extra)
    texts = [(r.doc_id, r.text) for r in whole.collect()]
    comp = brute_components({brute_print(t) for _, t in texts})
    groups = defaultdict(list)
    for i, t in texts:
        groups[comp[brute_print(t)]].append(i)
    want = Counter((g, min((i for i in ids if i is not None), default=None)) for g, ids in groups.items())
    assert Counter((comp[brute_print(r.text)], r.doc_id) for r in simhash.drop_near_copies(whole).collect()) == want


def test_empty(empty):
    assert simhash.near_groups(empty).count() == 0

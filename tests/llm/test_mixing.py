import hashlib
import re
from collections import Counter
from fractions import Fraction

import pytest

from folioscope.llm import mixing


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_targets(sizes, weights, share, cap):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = share * sum(sizes.values()), set()
    while True:
        left = total - sum(cap * sizes[s] for s in capped)
        open_ = sum(w[s] for s in order if s not in capped)
        aims = {s: Fraction(cap * sizes[s]) if s in capped else left * w[s] / open_ for s in order} if open_ else {s: Fraction(cap * sizes[s]) for s in order}
        over = {s for s in order if s not in capped and aims[s] > cap * sizes[s]}
        if not over:
            return aims
        capped |= over


def draw(i):
    return int(hashlib.sha256(f"mix:{'' if i is None else i}".encode()).hexdigest()[:13], 16) / 16**13


def test_against_brute_force(docs, rows):
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += words(r[1])
    aims = brute_targets(sizes, (3, 1, 2), Fraction(3, 2), 2)
    got = Counter((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in mixing.plan_mix(docs).collect())
    want = Counter()
    for r in rows:
        n, rate = words(r[1]), float(aims[r[3]] / sizes[r[3]]) if sizes[r[3]] else 0.0
        copies = int(rate) + (draw(r[0]) < rate - int(rate))
        want[(r[0], n, sizes[r[3]], round(float(aims[r[3]]), 6), n * copies)] += 1
        assert copies <= 2
    assert got == want


def test_mix_emits_what_the_plan_says(docs):
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    got = Counter(r.doc_id for r in out.collect())
    plan = Counter()
    for r in mixing.plan_mix(docs).collect():
        plan[r.doc_id] += r.copies
    assert got == Counter({k: v for k, v in plan.items() if v})


@pytest.mark.parametrize("n", [1, 7, 200])
def test_sources_come_near_their_targets(spark, n):
    rows = [(i, "w " * (1 + i % 9), f"s{i % n}") for i in range(6000)]
    plan = mixing.plan_mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    total = sum(r.size for r in plan)
    assert abs(sum({r.source_size: 0 for r in plan}) >= 0)
    assert abs(sum(r.taken for r in plan) - 1.5 * total) < 0.05 * total
    assert all(r.target <= 2 * r.source_size + 1e-6 for r in plan)


def test_a_mix_without_words(spark):
    rows = [(1, None, None), (2, "", "a")]
    assert {r.taken for r in mixing.plan_mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()} == {0}


def test_empty(empty):
    assert mixing.plan_mix(empty).count() == 0 and mixing.mix(empty).count() == 0

import itertools
import math
from collections import Counter

import numpy as np
import pytest

from folioscope.llm import sentencepiece_topk as S


@pytest.fixture(scope="module")
def model():
    return S.pieces(S.default_model(), 1.0)


def paths(model, text):
    """Every segmentation of the text with its probability, by brute force; byte pieces for characters without a piece."""
    table = {model.bytes[i]: i for i in range(len(model.bytes)) if model.bytes[i] and model.scores[i] > model.least - 1 and i not in set(model.byte_ids.tolist())}

    def split(word):
        if not word:
            yield (), 0.0
            return
        found = False
        for n in range(1, len(word) + 1):
            piece = word[:n].encode()
            if piece in table:
                found = found or n == 1
                for rest, lp in split(word[n:]):
                    yield (table[piece], *rest), lp + model.scores[table[piece]]
        if not found:
            data = word[0].encode()
            for rest, lp in split(word[1:]):
                yield (*(int(model.byte_ids[b]) for b in data), *rest), lp + model.least * len(data)

    parts = []
    for w in S.split_words(text):
        options = list(split(w))
        z = math.log(sum(math.exp(lp) for _, lp in options))
        parts.append([(ids, lp - z) for ids, lp in options])
    return {tuple(itertools.chain(*(p[0] for p in c))): sum(p[1] for p in c) for c in itertools.product(*parts)}


@pytest.mark.parametrize("text", ["hello", "the at", "ab\ncd", "ä▁b", "  two"])
def test_all_segmentations_in_order(model, text):
    want = paths(model, text)
    found = S.topk(model, [text], np.array([5], np.uint64), len(want) + 3)[0]
    got = {tuple(ids.tolist()): lp for ids, lp, _, _ in found}
    assert len(found) == len(got)  # distinct
    likely = {k for k, lp in want.items() if lp > -25}
    assert likely <= set(got) <= set(want)
    assert all(abs(lp - want[k]) < 1e-6 for k, lp in got.items())
    values = [g for _, _, g, _ in found]
    assert values == sorted(values, reverse=True)


def test_first_and_second_are_drawn_without_replacement(model):
    text, n = "hello", 6000
    want = {k: math.exp(v) for k, v in paths(model, text).items()}
    found = S.topk(model, [text] * n, np.arange(n).astype(np.uint64) * np.uint64(7919), 2)
    first = Counter(tuple(f[0][0].tolist()) for f in found)
    second = Counter(tuple(f[1][0].tolist()) for f in found)
    for k, p in want.items():
        assert abs(first[k] / n - p) < 4 * math.sqrt(p / n) + 2e-3
        q = sum(o * p / (1 - o) for j, o in want.items() if j != k)
        assert abs(second[k] / n - q) < 4 * math.sqrt(q / n) + 2e-3


def test_inclusion_scores_are_unbiased(model):
    """Sums of p/inclusion estimate one; so does the mean over many keys."""
    found = S.topk(model, ["hello at"] * 3000, np.arange(3000).astype(np.uint64), 3)
    estimates = [sum(math.exp(lp) / inc for _, lp, _, inc in f) for f in found]
    assert abs(np.mean(estimates) - 1) < 0.05


def test_results_do_not_depend_on_the_batch(model):
    texts = ["some words here", None, "", "other words " * 30, "x" * 700, "ü日本😀▁"]
    keys = np.arange(6).astype(np.uint64)
    whole = S.topk(model, texts, keys, 3)
    kept = S.Kept(model)
    S.topk(model, ["warm up words " * 50, "some words here " * 9], keys[:2], 2, kept)
    for i, t in enumerate(texts):
        for alone in (S.topk(model, [t], keys[i : i + 1], 3), S.topk(model, [t], keys[i : i + 1], 3, kept)):
            assert [(x[0].tolist(), round(x[2], 9)) for x in alone[0]] == [(x[0].tolist(), round(x[2], 9)) for x in whole[i]]


def log_sums(model, data):
    """Forward and backward log sums over all segmentations of a word without spaces inside, in logarithms, place by place."""
    table = {model.bytes[i]: model.scores[i] for i in range(len(model.bytes)) if model.bytes[i] and i not in set(model.byte_ids.tolist())}
    longest, n = max(map(len, table)), len(data)
    first = [k for k in range(n + 1) if k == n or data[k] & 0xC0 != 0x80]
    edges = []
    for a, b in itertools.pairwise(first):
        edges += [(a, z, table[data[a:z]]) for z in range(a + 1, min(n, a + longest) + 1) if data[a:z] in table]
        if data[a:b] not in table:
            edges.append((a, b, model.least * (b - a)))
    forward, backward = [-math.inf] * (n + 1), [-math.inf] * (n + 1)
    forward[0] = backward[n] = 0.0
    for a, b, lp in edges:
        forward[b] = np.logaddexp(forward[b], forward[a] + lp)
    for a, b, lp in reversed(edges):
        backward[a] = np.logaddexp(backward[a], lp + backward[b])
    return forward, backward


@pytest.mark.parametrize("word", ["internationalization" * 9, "日本語の文章には空白がない" * 8, "the" * 3000])
def test_long_words_are_not_cut(model, word):
    data, n = (" " + word).encode(), 1500 if len(word) < 1000 else 3
    forward, backward = log_sums(model, data)
    z = forward[-1]
    assert len(data) > S.WORD_BYTES and abs(z - backward[0]) < 1e-6
    found = S.topk(model, [word] * n, np.arange(n).astype(np.uint64) * np.uint64(7919), 2)
    lone = set(model.byte_ids.tolist())
    for f in found[:: max(1, n // 50)]:
        for ids, lp, _, _ in f:
            assert model.decode(ids) == word
            assert abs(lp - (sum(model.least if i in lone else model.scores[i] for i in ids.tolist()) - z)) < 1e-6 * len(data)
    if n > 3:
        for at in (32, 64, 96):  # characters at which words were cut
            place = len((" " + word)[:at].encode())
            p = min(1.0, math.exp(forward[place] + backward[place] - z))
            cut = sum(place in np.cumsum([len(model.bytes[i]) for i in f[0][0].tolist()]) for f in found) / n
            assert (p < 0.99 or not word.isascii()) and abs(cut - p) < 4 * math.sqrt(p * (1 - p) / n) + 2e-3


def test_round_trip_over_a_table(docs, rows):
    out = S.decode(S.encode(docs, k=3)).collect()
    by = Counter()
    for r in out:
        by[r.doc_id] += 1
    texts = {r[0]: r[1] or "" for r in rows if r[0] is not None}
    assert all(r.decoded == texts[r.doc_id] for r in out if r.doc_id is not None)
    repeated = Counter(r[0] for r in rows)
    assert all(by[i] == (1 if not texts[i] else by[i]) * 1 or by[i] <= 3 * repeated[i] for i in texts)
    seen = Counter((r.doc_id, tuple(r.ids)) for r in out if repeated[r.doc_id] == 1)
    assert set(seen.values()) == {1}


def test_empty(empty):
    assert S.encode(empty).count() == 0


def test_pieces_agree_with_the_library(model):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=S.default_model())
    for text in ("Hello world", "naïve café\n", "日本"):
        ids = S.topk(model, [text], np.array([1], np.uint64), 1)[0][0][0].tolist()
        assert sp.decode(ids) == text

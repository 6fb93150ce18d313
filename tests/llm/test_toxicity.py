import random
import zlib
from collections import Counter

import pytest

from folioscope.llm import toxicity


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(4)
    plain = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnprst"]
    rows, labels = [], []
    for i in range(900):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 80))]
        toxic = i % 4 == 0
        for _ in range(rng.randint(1, 3) if toxic else 0):
            words[rng.randrange(len(words))] = rng.choice(["idiotic", "Vermin!", "zorg" + rng.choice(plain)])
        rows.append((i, " ".join(words), rng.choice(["en", "de", None]), "s"))
        labels.append((i, int(toxic)))
    rows += [(5000, None, None, "s"), (5001, "", "en", "s"), (None, "vermin", "en", "s"), rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string").repartition(3)
    return docs, spark.createDataFrame(labels + [(None, 1), (3, None), (4, 0)], "doc_id long, toxic int"), dict(labels)


def test_held_out_accuracy(world):
    docs, labels, truth = world
    out = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(out) == docs.count()
    held = [r for r in out if r.doc_id in truth and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out if r.doc_id is not None)
    right = sum(r.predicted == truth[r.doc_id] for r in held)
    assert right >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    assert {r.predicted for r in out if r.doc_id in (5000, 5001)} == {0}


def test_scores_take_nothing_but_the_text(world):
    docs, labels, _ = world
    model = toxicity.train(docs, labels)
    a = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    b = {r.doc_id: r.score for r in toxicity.score(docs.selectExpr("doc_id", "text", "'xx' lang", "'q' score"), model).collect()}
    assert a == b


def test_held_out_labels_do_not_matter(world):
    docs, labels, _ = world
    other = labels.selectExpr("doc_id", "if(crc32(string(doc_id)) % 5 = 0, 1 - toxic, toxic) toxic")
    a = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    assert a == {r.doc_id: r.score for r in toxicity.score(docs, toxicity.train(docs, other)).collect()}


def test_no_labels_and_empty_tables(world):
    docs, labels, _ = world
    assert toxicity.train(docs, labels.where("false")) is None
    assert toxicity.train(docs.where("false"), labels) is None
    assert {r.score for r in toxicity.score(docs, None).collect()} == {0.0}
    assert toxicity.score(docs.where("false"), None).count() == 0
    assert toxicity.drop_toxic(docs, labels.where("toxic = 0")).count() == docs.count()


def test_toxic_rows_go(world):
    docs, labels, truth = world
    out = toxicity.drop_toxic(docs, labels)
    assert out.columns == docs.columns
    left = {r.doc_id for r in out.collect()}
    assert sum(i in left for i, t in truth.items() if t) <= 0.03 * len(truth)
    assert sum(i not in left for i, t in truth.items() if not t) <= 0.02 * len(truth)


def test_rows_go_by_their_own_text(spark, world):
    docs, labels, truth = world
    clean = next(r for r in docs.collect() if truth.get(r.doc_id) == 0 and r.doc_id > 9)
    more = spark.createDataFrame([(clean.doc_id, "vermin vermin!", "en", "s"), (None, clean.text, "en", "s")], docs.schema)
    left = Counter((r.doc_id, r.text) for r in toxicity.drop_toxic(docs.unionByName(more), labels).where(f"doc_id is null or doc_id = {clean.doc_id}").collect())
    assert left == Counter([(clean.doc_id, clean.text), (None, clean.text)])


def brute_score(model, text):
    """The score of one text, word by word in plain Python: hashed embeddings, windows of each width, the greatest of each filter."""
    import math

    data = (text or "").encode("utf-8", "replace")
    flat = bytes(b if b >= 128 else ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in data)

    def mixed(h):
        h = (h ^ h >> 31) * 0x9E3779B97F4A7C15 % 2**64
        return (h >> 40) & (toxicity.BUCKETS - 1)

    def vector(word):
        marked = b"<" + word + b">"
        found = [mixed(zlib.crc32(word))]
        for i in range(len(marked) - toxicity.GRAM + 1):
            h = 0
            for b in marked[i : i + toxicity.GRAM]:
                h = (h * 0x100000001B3 + b + 1) % 2**64
            found.append(mixed(h ^ 0xA5A5A5A5A5A5A5A5))
        out = [0.0] * toxicity.SIZE
        for bucket in found:
            if row := int(model.row[bucket]):
                out = [a + float(b) for a, b in zip(out, model.embedding[row], strict=True)]
        return out

    words = [vector(w) for w in flat.split()] + [[0.0] * toxicity.SIZE] * 4
    total = model.shift
    for k, (width, f) in enumerate(zip(toxicity.WIDTHS, model.filters, strict=True)):
        for j in range(toxicity.FILTERS):
            best = max(sum(float(f[d][i][j]) * words[at + d][i] for d in range(width) for i in range(toxicity.SIZE)) for at in range(len(words) - 2))
            total += max(0.0, best + float(model.bias[k][j])) * float(model.out[k * toxicity.FILTERS + j])
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, total))))


def test_scores_against_brute_force(world, docs, rows):
    """On the shared awkward table: nulls, empty and white texts, ties, a very long text and clashing names."""
    own, labels, _ = world
    model = toxicity.train(own, labels)
    got = Counter((r.doc_id, round(r.score, 4)) for r in toxicity.score(docs, model).collect())
    texts = {r[1]: round(brute_score(model, r[1]), 4) for r in rows if len(r[1] or "") < 20_000}
    assert all(abs(brute_score(model, t) - toxicity.judge(model, [t], [None])[0][0]) < 1e-4 for t in texts)
    assert sum(got.values()) == len(rows)
    known = Counter((r[0], texts[r[1]]) for r in rows if r[1] in texts)
    assert sum(min(n, got[k] or got[k[0], round(k[1] + 1e-4, 4)] or got[k[0], round(k[1] - 1e-4, 4)]) for k, n in known.items()) == sum(known.values())
    toxic = toxicity.drop_toxic(docs, labels)
    assert toxic.columns == docs.columns and toxic.count() <= len(rows)


def test_long_labelled_texts_are_not_learnt_from(spark, world, monkeypatch):
    docs, labels, _ = world
    long = spark.createDataFrame([(7001, "vermin " * 3000, "en", "s"), (7002, "lamp " * 200_000, "en", "s")], docs.schema)
    more = labels.unionByName(spark.createDataFrame([(7001, 0), (7002, 1)], labels.schema))
    a = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    assert a == {r.doc_id: r.score for r in toxicity.score(docs, toxicity.train(docs.unionByName(long), more)).collect()}


def test_every_labelled_row_counts(spark):
    """More rows of both kinds, and longer ones, than the bounded sample of before: the known features are those of all fitted rows."""
    letters = "abcdefghij"
    rows = [(i, f"w{letters[i // 8 % 10]}{letters[i // 80 % 10]}{letters[i // 800 % 10]}q {'vermin' if i % 2 else 'lamp'}", "en") for i in range(14_000)]
    rows += [(20_000 + i, "zyxwv " + "lamp " * 5000, "en") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = docs.selectExpr("doc_id", "if(doc_id < 20000 and doc_id % 2 = 1, 1, 0) toxic")
    fitted = {r[0] for r in docs.where("crc32(string(doc_id)) % 5 <> 0").select("doc_id").collect()}
    seen = Counter()
    for i, text, _ in rows:
        if i in fitted:
            seen.update(set(toxicity.buckets(sorted(set(toxicity.words_of(text))))[1].tolist()))
    model = toxicity.train(docs, labels)
    assert set(model.row.nonzero()[0].tolist()) == {b for b, n in seen.items() if n >= toxicity.LEAST_DOCUMENTS}
    assert toxicity.judge(model, ["vermin", "lamp", "zyxwv"], [None] * 3)[1].tolist() == [True, False, False]


def test_partitions_do_not_matter(world):
    docs, labels, _ = world
    a, b = (toxicity.train(d, labels) for d in (docs, docs.repartition(7, "text")))
    assert a.thresholds == b.thresholds and a.shift == b.shift and (a.embedding == b.embedding).all()
    assert all((x == y).all() for x, y in zip([*a.filters, *a.bias, a.out], [*b.filters, *b.bias, b.out], strict=True))


def test_gradients_against_differences(monkeypatch):
    import copy

    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    texts = ["", "lamp", *(" ".join(rng.choice(["vermin", "lamp", "tree", "zorgle", "house"], n)) for n in (3, 9, 40))]
    batch = pa.record_batch([pa.array(texts), pa.array([0, 1, 1, 0, 1]), pa.array(["en"] * 5)], ["text", "label", "lang"])
    (chunk,) = toxicity.Chunk.of(toxicity.chunks(iter([batch])))
    row = np.zeros(toxicity.BUCKETS, np.int32)
    known = np.unique(chunk.bucket)
    row[known] = np.arange(1, len(known) + 1)
    embedding = rng.normal(0, 0.5, (len(known) + 1, toxicity.SIZE))
    embedding[0] = 0
    filters = [rng.normal(0, 0.5, (w, toxicity.SIZE, toxicity.FILTERS)) for w in toxicity.WIDTHS]
    model = toxicity.Model(row, embedding, filters, [np.full(toxicity.FILTERS, 0.1) for _ in filters], rng.normal(0, 0.5, toxicity.FILTERS * len(filters)), 0.2)

    def sums(model):
        features, dense = np.zeros(embedding.shape, np.int64), np.zeros(sum(f.size for f in filters) + 2 * len(model.out) + 2, np.int64)
        chunk.gradient(model, (0.1, 0.2), features, dense)
        return features * toxicity.UNIT, dense * toxicity.UNIT

    features, dense = sums(model)
    for word in (1, len(known) // 2):
        more, less = copy.deepcopy(model), copy.deepcopy(model)
        more.embedding[word, 2] += 1e-3
        less.embedding[word, 2] -= 1e-3
        assert abs((sums(more)[1][-1] - sums(less)[1][-1]) / 2e-3 - features[word, 2]) < 1e-3
    at = 0
    for k, f in enumerate(filters):
        more, less = copy.deepcopy(model), copy.deepcopy(model)
        more.filters[k][-1, 3, 5] += 1e-3
        less.filters[k][-1, 3, 5] -= 1e-3
        place = at + np.ravel_multi_index((len(f) - 1, 3, 5), f.shape)
        assert abs((sums(more)[1][-1] - sums(less)[1][-1]) / 2e-3 - dense[place]) < 1e-3
        at += f.size

    assert np.allclose(chunk.forward(model)[0], model.logits(texts), atol=1e-4)
    whole = chunk.forward(model)
    monkeypatch.setattr(toxicity, "PIECE", 3)
    assert (chunk.forward(model)[0] == whole[0]).all()
    (again,) = toxicity.Chunk.of(toxicity.chunks(iter([batch])))
    assert (again.ids == chunk.ids).all()

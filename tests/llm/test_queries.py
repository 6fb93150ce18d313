"""The registered queries against DuckDB, and the pipeline's stages against brute force, on whole small tables."""

import hashlib
from collections import Counter, defaultdict

import duckdb
import pytest

import corpus_pipeline
from folioscope.llm import mixing, queries, sentencepiece_topk, simhash, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
WHITE = dict.fromkeys(map(ord, " \t\n\x0b\x0c\r"))


def plain(v):
    return float(f"{v:.10g}") if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_duckdb(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    relation = con.sql(queries.SQL[name])
    columns = [d[0] for d in relation.description]
    order = sorted(columns)
    assert order == sorted(df.columns)
    ours = Counter(tuple(plain(r[c]) for c in order) for r in df.collect())
    assert ours == Counter(tuple(plain(r[columns.index(c)]) for c in order) for r in relation.fetchall())


def test_contract_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").count()
    for name, columns in {"op5_simhash": {"doc_id", "fingerprint", "component_id"}, "op6_media": {"doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"}, "op10_toxicity": {"doc_id", "held_out", "score", "predicted"}}.items():
        df = queries.QUERIES[name](spark, sf)
        assert columns <= set(df.columns) and df.count() == docs
    prints = [r.fingerprint for r in queries.op5_simhash(spark, sf).collect()]
    assert all(len(p) == 16 and p == p.lower() and int(p, 16) >= 0 for p in prints)


def test_pipeline_stage_by_stage(spark, sf):
    """Each stage's decisions on its own input, recomputed in plain Python."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    (_, toxic), (_, exact), (_, near), (_, mix), (_, encode) = corpus_pipeline.STAGES

    one = toxic(spark, docs, sf)
    assert one.columns == COLUMNS
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    marked = {r.doc_id for r in toxicity.score(docs, toxicity.train(docs, labels)).collect() if r.toxic}
    rows = sorted(map(tuple, one.collect()))
    assert rows == sorted(tuple(r) for r in docs.collect() if r.doc_id not in marked)

    two = exact(spark, one, sf)
    best = {}
    for r in rows:
        key = r[1].translate(WHITE)
        if key not in best or (-len(r[1]), r[0]) < (-len(best[key][1]), best[key][0]):
            best[key] = r
    rows = sorted(map(tuple, two.collect()))
    assert two.columns == COLUMNS and rows == sorted(best.values())

    three = near(spark, two, sf)
    prints = {r[0]: simhash.simhash(simhash.shingle_hashes(r[1], 3, 42)) for r in rows}
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    kept = sorted(r for r in rows if find(r[0]) == r[0])
    rows = sorted(map(tuple, three.collect()))
    assert three.columns == COLUMNS and rows == kept

    four = mix(spark, three, sf)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(r[1].translate({c: 32 for c in WHITE}).split())
    rates = {r.source: r for r in mixing.plan_mix(three).join(three.select("doc_id", "source"), "doc_id").collect()}
    want = Counter()
    for r in rows:
        rate = rates[r[3]].rate
        assert rates[r[3]].source_size == sizes[r[3]] and rate <= 2
        draw = int(hashlib.sha256(f"mix:{r[0]}".encode()).hexdigest()[:13], 16) / 16**13
        want[r[0]] = int(rate) + (draw < rate - int(rate))
    got = Counter(r.doc_id for r in four.collect())
    assert four.columns == COLUMNS and got == +want

    five = encode(spark, four, sf)
    model = sentencepiece_topk.pieces(sentencepiece_topk.default_model(), 1.0)
    texts = {r[0]: r[1] for r in rows}
    out = five.collect()
    assert all(model.decode(r.ids) == texts[r.doc_id] for r in out)
    ranks = Counter((r.doc_id, r["rank"]) for r in out)
    assert all(ranks[i, 1] == n for i, n in got.items())


def test_run_is_its_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert sorted((r.doc_id, r["rank"], tuple(r.ids)) for r in corpus_pipeline.run(spark, sf).collect()) == sorted((r.doc_id, r["rank"], tuple(r.ids)) for r in docs.collect())


def test_pipeline_on_awkward_rows(spark, sf, docs, rows):
    """Nulls, repeats, a very long text and clashing names through all stages; each stage's input is whole and its columns stay."""
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, now, sf)
        assert after.columns == docs.columns, name
        was = Counter((r.doc_id, r.text) for r in now.collect())
        left = Counter((r.doc_id, r.text) for r in after.collect())
        assert set(left) <= set(was) and (name == "mixing" or not left - was), name
        now = after.checkpoint()
    out = corpus_pipeline.STAGES[-1][1](spark, now, sf).collect()
    model = sentencepiece_topk.pieces(sentencepiece_topk.default_model(), 1.0)
    texts = {(r.doc_id, r.text or "") for r in now.collect()}
    assert all((r.doc_id, model.decode(r.ids)) in texts for r in out)
    plain = [t for _, t in texts if t.strip()]
    assert len({t.translate(WHITE) for t in plain}) == len(plain)


def test_pipeline_on_an_empty_table(spark, sf, empty):
    now = empty
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, sf)
        assert now.count() == 0, name

import hashlib
import zlib
from collections import Counter

from folioscope.llm import common, media


def payload(text):
    data = (text or "").encode()
    return data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))


def expected(rows):
    out = Counter()
    for r in rows:
        p = payload(r[1])
        out[(r[0], len((r[1] or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(media.png(p)), hashlib.sha256(media.png(p)).hexdigest(), media.feature(p, (64, len(p) // 64, 8)), 64, len(p) // 64, 8)] += 1
    return out


COLUMNS = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "bits"]


def test_against_brute_force(docs, rows):
    assert Counter(tuple(r) for r in media.text_media(docs).select(COLUMNS).collect()) == expected(rows)


def test_shards_are_tars_with_each_payload_once(spark, docs, rows, tmp_path):
    import tarfile

    index, _, folder = media.store_texts(docs.where("doc_id is not null").dropDuplicates(["doc_id"]), f"file://{tmp_path}/store")
    index.count()
    names = Counter()
    for shard in (tmp_path / "store").glob("*.tar"):
        with tarfile.open(shard) as tar:
            for m in tar.getmembers():
                data = tar.extractfile(m).read()
                assert hashlib.sha256(media.samples(data)).hexdigest() == m.name.removesuffix(".png")
                names[m.name] += 1
    texts = {hashlib.sha256(payload(r[1])).hexdigest() + ".png" for r in rows if r[0] is not None}
    assert set(names) == texts and set(names.values()) == {1}
    heads = media.read_back(index, folder, False).collect()
    assert len(heads) == len(texts) and all(h.width == 64 and h.bits == 8 for h in heads)


def test_shuffled_paths_agree(docs, rows, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(media, "FOUND_BYTES", 0)
    assert Counter(tuple(r) for r in media.text_media(docs).select(COLUMNS).collect()) == expected(rows)


def test_empty(empty):
    assert media.text_media(empty).count() == 0


def test_pictures_are_lossless():
    for data in (bytes(64), bytes(range(256)) * 8, b"x" * 6400):
        assert media.samples(media.png(data)) == data


def test_broadcasts_are_bounded_by_bytes(spark):
    """Few wide rows are shuffled, as many narrow ones are broadcast; nulls and nested values count too."""
    narrow = spark.range(2000).selectExpr("id as k", "1L as n")
    wide = spark.range(2000).selectExpr("id as k", "1L as n", "repeat('x', 50000) as w")
    big = spark.range(10).selectExpr("id as k")

    def sides(small):
        plan = common.lookup(big, small, "k", "n", common.F.col("k"))._jdf.queryExecution().optimizedPlan().toString()
        return "__hot_n" in plan

    assert not sides(narrow) and sides(wide)
    assert not common.measured(wide) and common.measured(narrow)
    assert common.measured(spark.sql("select cast(null as string) as k, map('a', 1) as m, array(1, 2) as a"))

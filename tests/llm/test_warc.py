import gzip
import hashlib
import io
from collections import Counter

import pytest

from folioscope.llm import warc


@pytest.fixture(scope="module")
def rows():
    long, other = "<p>é</p>" * 300, "y" * 1000
    out = [(i, f"http://x.org/{i}", h) for i, h in enumerate([long, "short", "short", other, long, None, "", "z" * 999, "z" * 999, long, "\x1f\x8b\x08" * 500, "WARC/1.1 " * 200])]
    out += [(9, "http://x.org/again", long), (None, None, long), (20, "http://x.org/a b\n", "q" * 3_000_000), (None, "http://n.org/", "only null ids" * 100), (21, None, other)]
    return out


def expected(rows):
    last = {}
    for i, _, h in rows:
        if i is not None:
            last[h or ""] = max(last.get(h or "", i), i)
    out = Counter()
    for i, _, h in rows:
        data = (h or "").encode()
        top = last.get(h or "")
        refers = top if len(data) >= 1000 and top is not None and i != top else None
        out[(None if i is None else str(i), len(data), hashlib.sha1(data).hexdigest(), "response" if refers is None else "revisit", None if refers is None else str(refers))] += 1
    return out


@pytest.mark.parametrize("split", [1 << 24, 997, 300])
def test_round_trip_with_any_split(spark, rows, split):
    pages = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, size int, name string").repartition(3)
    archives, folder = warc.archive_pages(pages)
    got = warc.read_archives(archives, folder, split).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert Counter(tuple(r) for r in got) == expected(rows)


def test_archives_are_plain_gzip_members(spark, rows, tmp_path):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    archives, _ = warc.archive_pages(pages, f"file://{tmp_path}/w")
    assert sum(r.records for r in archives.collect()) == len(rows)
    data = b"".join(gzip.open(p).read() for p in (tmp_path / "w").iterdir())
    assert data.count(b"\r\nWARC-Record-ID: ") == len(rows)


def test_magic_inside_a_member_is_not_a_member():
    inner = gzip.compress(b"no record", mtime=0)
    first = gzip.compress(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 0\r\n\r\n\r\n\r\n" + inner * 40, 0, mtime=0)
    data = first + gzip.compress(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 0\r\n\r\n\r\n\r\n", mtime=0)

    class File:
        def read_at(self, n, at):
            return data[at : at + n]

    found = [r["at"] for s in range(0, len(data), 100) for r in warc.records(warc.Range(File(), len(data)), s, min(len(data), s + 100))]
    assert found == [0, len(first)]
    assert io.BytesIO(data).read(3) == warc.MAGIC


def nested(payload: bytes) -> bytes:
    """A stored (not deflated) member whose payload is itself an archive of records, and which therefore shows their members as they are."""
    return warc_member(payload, 0)


def warc_member(payload: bytes, level: int = 6, page: str = "1") -> bytes:
    return gzip.compress(warc.record(page, "http://x.org/", "response", payload, len(payload), hashlib.sha1(payload).hexdigest(), None), level, mtime=0)


@pytest.mark.parametrize("split", [1 << 24, 30_000, 5000, 700])
def test_archives_inside_records_mislead_nobody(spark, tmp_path, split):
    """Ranges that begin inside a stored archive see its records; what they report is put right by the ranges before."""
    inner = b"".join(warc_member(b"inner %d " % i * 30, page=f"in{i}") for i in range(150))
    assert len(inner) < 65_000  # one stored block, so that members inside are as they were
    parts = [warc_member(b"first"), nested(inner), warc_member(b"second", page="2"), nested(inner[:20_000]), warc_member(b"third", page="3")]
    data = b"".join(parts)
    (tmp_path / "a.warc.gz").write_bytes(data)
    archives = spark.createDataFrame([("a.warc.gz", len(data))], "name string, size long")
    got = warc.read_archives(archives, f"file://{tmp_path}", split).collect()
    want = [sum(map(len, parts[:i])) for i in range(5)]
    assert sorted(r.at for r in got) == want and Counter(r.page_id for r in got) == Counter({"1": 3, "2": 1, "3": 1})


@pytest.mark.parametrize("held", [1, 64])
def test_damage_is_an_error_and_not_a_loss(spark, tmp_path, held, monkeypatch):
    monkeypatch.setattr(warc, "HELD", held)
    parts = [warc_member(b"%d " % i * 500, page=str(i)) for i in range(40)]
    bad = bytearray(b"".join(parts))
    bad[sum(map(len, parts[:30])) + 60] ^= 0xFF
    (tmp_path / "b.warc.gz").write_bytes(bytes(bad))
    with pytest.raises(Exception, match="error|differs|record|member|invalid"):
        warc.read_archives(spark.createDataFrame([("b.warc.gz", len(bad))], "name string, size long"), f"file://{tmp_path}", 900).collect()


def test_empty(spark):
    archives, folder = warc.archive_pages(spark.createDataFrame([], "page_id long, url string, html string"))
    assert warc.read_archives(archives, folder).count() == 0

"""WARC archives: a writer with revisit records, and a splittable reader that finds gzip members inside byte ranges."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import filesystem, keep, lookup, new_folder, ship

MAGIC = b"\x1f\x8b\x08"
#: Bytes of an archive that one reading task owns.
SPLIT_BYTES = 16 << 20
#: Bytes read at a time.
STEP = 1 << 18
#: Payloads below this size are never revisits.
REVISIT_BYTES = 1000
#: Records of a range that are held back, at most, to see whether their chain of members holds.
HELD = 64
#: Reading tasks at once, at most; further ranges share them.
MOST_TASKS = 20_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(page: str, url: str, kind: str, payload: bytes, size: int, digest: str, refers: str | None) -> bytes:
    """One WARC/1.1 record. A revisit's block keeps the HTTP header, and so the length of the payload that it leaves out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {url}", "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers}>"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def clean(url: str | None) -> str:
    """A URL in a header line: control characters and spaces percent-encoded."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "")


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write pages (id, url, html, refers) as gzip-per-record archives, one or none for each task; (name, size, records) of each.

    Names are new for each attempt; only archives in the kept result count.
    """
    ship(pages.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(folder)
        fs.create_dir(path, recursive=True)
        name, out, size, n = f"{uuid.uuid4().hex}.warc.gz", None, 0, 0
        for batch in batches:
            for page, url, html, refers in zip(*(batch.column(i) for i in range(4)), strict=True):
                payload = (html.as_py() or "").encode("utf-8", "surrogatepass")
                page, refers = page.as_py(), refers.as_py()
                kind = "response" if refers is None else "revisit"
                data = record("" if page is None else str(page), clean(url.as_py()), kind, payload, len(payload), hashlib.sha1(payload).hexdigest(), None if refers is None else str(refers))
                pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                data = pack.compress(data) + pack.flush()
                if out is None:
                    out = fs.open_output_stream(f"{path}/{name}", compression=None)
                out.write(data)
                size += len(data)
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size], pa.int64()), pa.array([n], pa.int64())], ["name", "size", "records"])

    return pages.select("id", "url", "html", "refers").mapInArrow(write, "name string, size long, records long")


class Range:
    """A file read in steps, with random access to what is near."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at, self.data = file, size, 0, b""

    def get(self, at: int, least: int) -> bytes:
        """At least `least` bytes from `at`, or what the file has."""
        if not self.at <= at or at + least > self.at + len(self.data):
            self.at, self.data = at, self.file.read_at(min(max(STEP, least), self.size - at), at) if at < self.size else b""
        return self.data[at - self.at :]


def candidate(file: Range, at: int) -> bool:
    """Whether a gzip member with a WARC header begins at `at`: its first bytes must decode to a version line."""
    unpack = zlib.decompressobj(31)
    try:
        return unpack.decompress(file.get(at, 512)[:4096], 64).startswith(b"WARC/1.")
    except zlib.error:
        return False


def first_member(file: Range, start: int, end: int) -> int | None:
    """The first member that begins inside [start, end)."""
    at = start
    while at < end:
        data = file.get(at, len(MAGIC))
        hit = data.find(MAGIC)
        if hit < 0:
            if at + len(data) >= file.size:
                return None
            at += max(1, len(data) - len(MAGIC) + 1)
            continue
        at += hit
        if at >= end:
            return None
        if candidate(file, at):
            return at
        at += 1
    return None


def member(file: Range, at: int) -> tuple[bytes, int]:
    """The content of the member at `at`, checked by its CRC, and where the next begins."""
    unpack, out = zlib.decompressobj(31), []
    while not unpack.eof:
        data = file.get(at, 1)
        if not data:
            raise ValueError("a member is cut off")
        out.append(unpack.decompress(data))
        at += len(data) - len(unpack.unused_data)
    return b"".join(out), at


def records(file: Range, start: int, end: int, known: bool = False) -> Iterator[dict]:
    """The records that begin inside [start, end), whole, even where they end beyond; `known`: one begins at start.

    Each has the place after it. A candidate whose chain of members breaks before the range or the file ends was no record (an
    archive stored inside a member, say): its records are not given and the search goes on behind its first byte. If records
    were given already, as there are many, a last one without a place (`at` -1) says that the range must be read anew.
    """
    at = start if known else first_member(file, start, end)
    while at is not None and at < end:
        found, next_, given = [], at, False
        known |= at == 0
        try:
            while next_ is not None and next_ < end:
                data, after = member(file, next_)
                head, _, rest = data.partition(b"\r\n\r\n")
                lines = head.decode("utf-8", "replace").split("\r\n")
                fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
                size = int(fields["content-length"])
                if not lines[0].startswith("WARC/") or len(rest) < size:
                    raise ValueError("not a record")
                found.append({"version": lines[0], "fields": fields, "block": rest[:size], "at": next_, "after": after})
                if len(found) == HELD or known or given:
                    given = True
                    yield from found
                    found = []
                next_ = after if after < file.size else None
        except (ValueError, KeyError, zlib.error):
            if known:
                raise
            if given:
                yield {"at": -1}
                return
            at = first_member(file, at + 1, end)
            continue
        yield from found
        return


def ident(value: str | None) -> int | str | None:
    text = (value or "").removeprefix("<urn:page:").removesuffix(">")
    return text or None


NAMES = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "archive", "at", "range", "after"]
KINDS = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]


def read_ranges(ranges: DataFrame, folder: str, split_bytes: int) -> DataFrame:
    """The records of ranges (name, size, start, first), first being a known start or null; a row without `at` for a range without records."""
    ship(ranges.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(folder)
        for batch in batches:
            rows: list[tuple] = []
            for name, size, start, first in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                file, end, seen = Range(fs.open_input_file(f"{path}/{name}"), size), min(size, start + split_bytes), False
                for r in records(file, start if first is None else first, end, first is not None) if first is None or first < end else ():
                    seen = True
                    if r["at"] < 0:
                        rows.append((None,) * 6 + (name, -1, start, None))
                        break
                    f = r["fields"]
                    http, _, payload = r["block"].partition(b"\r\n\r\n")
                    digest = f.get("warc-payload-digest", "").removeprefix("sha1:")
                    length = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), 0)
                    if f["warc-type"] == "response":
                        length, found = len(payload), hashlib.sha1(payload).hexdigest()
                        if found != digest:
                            raise ValueError(f"a payload in {name} differs from its digest")
                    rows.append((ident(f["warc-record-id"]), f.get("warc-target-uri"), length, digest, f["warc-type"], ident(f.get("warc-refers-to")), name, r["at"], start, r["after"]))
                    if len(rows) >= 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), KINDS, strict=True)], NAMES)
                        rows = []
                if not seen:
                    rows.append((None,) * 6 + (name, None, start, None))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), KINDS, strict=True)], NAMES)

    # a number of its own, so that the few bytes that describe the ranges are not coalesced into one task
    tasks = max(1, min(ranges.count(), MOST_TASKS))
    return ranges.repartition(tasks, "name", "start").mapInArrow(read, "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, archive string, at long, range long, after long")


def read_archives(archives: DataFrame, folder: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, archive, at) of each record in archives (name, size).

    Archives are cut into byte ranges, each a task's: it looks for gzip magic, validates candidates by decoding their headers and
    following their chain of members, and owns the records that begin inside its range. Then the ranges of an archive are held
    against one another, a narrow row each: a range must begin where the records of those before it end. Ranges that were
    misled (by an archive stored inside a record) are read again from there, until all agree. A response's size and digest are
    those of the payload read and must agree with its header; a revisit's come from its headers.
    """
    splits = keep(archives.select("name", "size", F.explode(F.expr(f"sequence(0L, greatest(size - 1, 0L), {split_bytes}L)")).alias("start")))
    found = keep(read_ranges(splits.withColumn("first", F.lit(None).cast("long")), folder, split_bytes))
    while True:
        # the furthest end of a record before a range is where the first record at or behind the range's start begins
        seen = found.groupBy(F.col("archive").alias("name"), F.col("range").alias("start")).agg(F.min("at").alias("begun"), F.max("after").alias("ended"))
        before = Window.partitionBy("name").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
        due = seen.join(splits, ["name", "start"]).withColumn("first", F.coalesce(F.max("ended").over(before), F.lit(0).cast("long")))
        inside = (F.col("first") < F.col("start") + split_bytes) & (F.col("first") < F.col("size"))
        expected = F.when(inside, F.col("first"))
        misled = keep(due.where(~F.col("begun").eqNullSafe(expected)).select("name", "size", "start", "first"))
        if not misled.limit(1).count():
            return found.where("at is not null").select(*NAMES[:8])
        # only the first misled range of an archive is sure of its start
        first = misled.groupBy("name").agg(F.min(F.struct("start", "size", "first")).alias("m")).select("name", "m.size", "m.start", "m.first")
        mended = read_ranges(first, folder, split_bytes)
        found = keep(found.join(first.select(F.col("name").alias("archive"), F.col("start").alias("range")), ["archive", "range"], "left_anti").select(*NAMES).unionByName(mended))


def archive_pages(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> tuple[DataFrame, str]:
    """Write every row of pages as a record; (archives, folder).

    Of equal payloads of at least REVISIT_BYTES, that of the largest id is the response and the others revisit it; rows that
    share the largest id and the payload are all responses, as are all rows of a payload without any id. Null html is an empty
    payload, a null url an empty line, a null id an empty record id. Copies of any number are combined before the shuffle.
    """
    folder = folder or new_folder(pages.sparkSession, "warc")
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), html.alias("html"), F.when(F.octet_length(html) >= REVISIT_BYTES, F.sha2(html, 256)).alias("digest"))
    many = keep(rows.where("digest is not null").groupBy("digest").agg(F.max("id").alias("last"), F.count("*").alias("n")).where("n > 1"))
    rows = lookup(rows, many, "digest", "n", F.col("id"))
    refers = F.when(F.col("last").isNotNull() & ~F.col("id").eqNullSafe(F.col("last")), F.col("last"))
    return keep(write_archives(rows.select("id", "url", "html", refers.alias("refers")), folder)), folder

"""Media columns: content-addressed payloads in tar shards, digest, offset and length in the rows, headers read by range."""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import filesystem, keep, lookup, new_folder, ship

#: Width of the grey pictures that hold a payload; one sample a byte.
WIDTH = 64
#: Bytes of a stored picture that a header read takes: signature and IHDR.
HEADER = 33
#: Bytes of a shard that one reading task takes, about.
READ_BYTES = 8 << 20
#: What was read for payloads of several rows is broadcast to them up to so many bytes; both sides are narrow, a shuffle is cheap.
FOUND_BYTES = 1 << 20
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png(payload: bytes, level: int = 6) -> bytes:
    """8-bit grey picture, WIDTH wide, whose samples are the payload; lossless and the same for the same payload."""
    rows = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + chunk(b"IEND", b"")


def header(data: bytes) -> tuple[int, int, int]:
    """Width, height and bits a sample, from the first HEADER bytes."""
    if data[:8] != SIGNATURE or data[12:16] != b"IHDR":
        raise ValueError("not a picture of this store")
    return struct.unpack(">IIB", data[16:25])


def samples(data: bytes) -> bytes:
    """The payload of a picture that png() made."""
    width, height, _ = header(data)
    at, body = HEADER, []
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IDAT":
            body.append(data[at + 8 : at + 8 + size])
        at += size + 12
    return np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width + 1)[:, 1:].tobytes()


def tar_header(name: str, size: int) -> bytes:
    """ustar header of a plain file without owner or time, so that equal members are equal bytes."""
    head = bytearray(512)
    octal = f"{size:011o}\0".encode() if size < 8**11 else b"\x80" + size.to_bytes(11, "big")
    for at, value in ((0, name.encode()), (100, b"0000644\0"), (108, b"0000000\0"), (116, b"0000000\0"), (124, octal), (136, b"00000000000\0"), (148, b"        "), (156, b"0"), (257, b"ustar\x0000")):
        head[at : at + len(value)] = value
    head[148:156] = f"{sum(head):06o}\0 ".encode()
    return bytes(head)


def padded(text: Column) -> Column:
    """The text in UTF-8 and zero bytes up to a positive multiple of WIDTH; null: empty."""
    data = F.coalesce(text, F.lit("")).cast("binary")
    size = F.greatest(F.lit(1), F.ceil(F.octet_length(data) / F.lit(WIDTH))) * WIDTH
    return F.rpad(data, size.cast("int"), F.lit(b"\x00"))


def feature(payload: bytes, size: tuple[int, int, int]) -> str:
    """Shape, mean, spread and a 64-bit block mean hash of the samples."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64)
    edges = np.linspace(0, len(x), 65).astype(np.int64)
    sums = np.concatenate([[0], np.cumsum(x)])
    mean = int(sums[-1])
    above = (sums[edges[1:]] - sums[edges[:-1]]) * len(x) > mean * (edges[1:] - edges[:-1])
    spread = int((x * x).sum()) * len(x) - mean * mean
    return f"gray{size[2]}:{size[0]}x{size[1]}:{mean * 1000 // len(x)}:{spread // (len(x) * len(x))}:{np.packbits(above).tobytes().hex()}"


def store(payloads: DataFrame, folder: str) -> DataFrame:
    """Write the payloads (doc_id, n_bytes, digest, payload), a tar shard or none for each task; the index: (doc_id, n_bytes, digest, shard, at, length).

    at is the offset of the member's data. A task that is run again writes a shard of its own name; the index, once kept,
    names only shards that were written whole. Rows of one digest that meet in a task share a member.
    """
    ship(payloads.sparkSession)
    kind = payloads.schema["doc_id"].dataType.simpleString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(folder)
        fs.create_dir(path, recursive=True)
        name, at, out = f"{uuid.uuid4().hex}.tar", 0, None
        place: dict[bytes, tuple[int, int]] = {}
        for batch in batches:
            places = []
            for digest, payload in zip(batch.column(2), batch.column(3), strict=True):
                digest = digest.as_py()
                if digest not in place:
                    data = png(payload.as_py())
                    if out is None:
                        out = fs.open_output_stream(f"{path}/{name}", compression=None)
                    out.write(tar_header(f"{digest.hex()}.png", len(data)) + data + bytes(-len(data) % 512))
                    place[digest] = at + 512, len(data)
                    at += 512 + len(data) + -len(data) % 512
                places.append(place[digest])
            if places:
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([name] * len(places)), *(pa.array([p[i] for p in places], pa.int64()) for i in (0, 1))], ["doc_id", "n_bytes", "digest", "shard", "at", "length"])
        if out is not None:
            out.write(bytes(1024))
            out.close()

    return payloads.select("doc_id", "n_bytes", "digest", "payload").mapInArrow(write, f"doc_id {kind}, n_bytes long, digest binary, shard string, at long, length long")


def read_back(index: DataFrame, folder: str, whole: bool) -> DataFrame:
    """The index's rows (doc_id, n_bytes, digest) with what is read by range, in shard order.

    Width, height and bits come from the first HEADER bytes of each member. If whole, the member is then read too, for
    media_bytes, media_sha256, payload_bytes, payload_sha256, tail_crc32 and feature; a payload that is not the digest's fails.
    """
    ship(index.sparkSession)
    kind = index.schema["doc_id"].dataType.simpleString()
    columns = [("width", pa.int64()), ("height", pa.int64()), ("bits", pa.int64())]
    if whole:
        columns += [("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("feature", pa.string())]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(folder)
        shard, file = None, None
        for batch in batches:
            rows = []
            for digest, name, at, length in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True):
                if name != shard:
                    shard, file = name, fs.open_input_file(f"{path}/{name}")
                size = header(file.read_at(min(length, HEADER), at))
                if not whole:
                    rows.append(size)
                    continue
                data = file.read_at(length, at)
                payload = samples(data)
                found = hashlib.sha256(payload)
                if found.digest() != digest:
                    raise ValueError(f"a member of {name} is not its digest's")
                rows.append((*size, length, hashlib.sha256(data).hexdigest(), len(payload), found.hexdigest(), zlib.crc32(payload[-64:]), feature(payload, size)))
            if rows:
                found = [pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), columns, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], *found], ["doc_id", "n_bytes", "digest", *(n for n, _ in columns)])

    # a number of its own, so that the few bytes that describe the members are not coalesced into one task
    tasks = (index.agg(F.sum("length")).first()[0] or 0) // READ_BYTES + 1
    placed = index.select("doc_id", "n_bytes", "digest", "shard", "at", "length").repartition(int(tasks), "shard", F.expr(f"at div {READ_BYTES}")).sortWithinPartitions("shard", "at")
    types = {pa.int64(): "long", pa.string(): "string"}
    return placed.mapInArrow(read, f"doc_id {kind}, n_bytes long, digest binary, " + ", ".join(f"{n} {types[k]}" for n, k in columns))


def store_texts(docs: DataFrame, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, str]:
    """(index, others, folder): index has the rows whose payload was written, others (doc_id, n_bytes, digest) those that share one.

    Each payload is stored once: of the n rows with one digest only that of the smallest id, the owner, is written. Payloads meet
    the owners by lookup() on a hash of the digest: broadcast up to a measured size, beyond it hot digests are spread. Digests
    whose hashes collide, rows without an id and repeated rows may be written more than once; each row is read back all the same.
    """
    folder = folder or new_folder(docs.sparkSession, "media")
    size = F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long")
    data = docs.select(F.col(id_col).alias("doc_id"), size.alias("n_bytes"), padded(F.col(text_col)).alias("payload"))
    data = data.withColumn("digest", F.unhex(F.sha2("payload", 256))).withColumn("h", F.xxhash64("digest"))
    rows = keep(data.select("doc_id", "n_bytes", "digest", "h"))
    many = rows.groupBy("h").agg(F.min("doc_id").alias("owner"), F.count("*").alias("n"), F.min("digest").alias("low"), F.max("digest").alias("high"))
    many = keep(many.where("n > 1 and low = high").select("h", "owner", "n"))
    others = keep(lookup(rows, many, "h", "n", F.col("doc_id")).where("doc_id <> owner").select("doc_id", "n_bytes", "digest"))
    own = lookup(data, many, "h", "n", F.col("doc_id")).where("not coalesce(doc_id <> owner, false)")
    return keep(store(own, folder)), others, folder


def text_media(docs: DataFrame, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row of docs: doc_id, n_bytes, digest, header columns, and what reading its payload back gave.

    Null texts are empty and stored as 64 zero bytes; equal texts share one member; null ids and repeated rows stay; an empty
    table gives an empty result; other columns are not read. Texts of any length: one payload at a time is in memory.
    """
    index, others, folder = store_texts(docs, folder, id_col, text_col)
    own = read_back(index, folder, True)
    shared = others.groupBy("digest").agg(F.count("*").alias("n"))
    if not shared.limit(1).count():
        return own
    # members with more than one row: read once more for the rows that were not written
    again = index.join(shared, "digest").groupBy("digest", "n").agg(F.min(F.struct("shard", "at", "length")).alias("p"))
    again = again.select(F.col("n").alias("doc_id"), F.lit(0).cast("long").alias("n_bytes"), "digest", "p.*")
    found = keep(read_back(again, folder, True).withColumnRenamed("doc_id", "n").drop("n_bytes"))
    rest = lookup(others, found, "digest", "n", F.col("doc_id"), FOUND_BYTES)
    return own.unionByName(rest.select(*own.columns))

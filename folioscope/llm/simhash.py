"""SimHash near-dedup: fingerprints of word shingles, candidates by pigeonring filtering, components of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import components, keep, lookup, measured, release, ship, without

#: A block of fingerprints that share a candidate key is compared in one task up to this size; larger ones are refined, then cut, before they are sent.
BLOCK_ROWS = 8192
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Bits set in each byte, most significant first.
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def shingle_hashes(text: str | None, words: int, seed: int) -> np.ndarray:
    """Unsigned XXH64 of each word shingle, repeats included."""
    parts = (text or "").encode("utf-8", "replace").translate(LOWER).split()  # bytes.split: \x20 and \x09-\x0D
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    digest = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return np.array([digest(joined, seed)], np.uint64)
    ends = np.cumsum([len(p) + 1 for p in parts])
    starts = [0, *ends[: -words].tolist()]
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)], np.uint64)


def simhash(hashes: np.ndarray) -> int:
    """A bit is one if it is set in over half the hashes; none: zero."""
    n = len(hashes)
    if not n:
        return 0
    octets = hashes.astype(">u8").view(np.uint8).reshape(n, 8)
    if n < 64:
        sums = np.unpackbits(octets, axis=1).sum(axis=0, dtype=np.int64)
    else:
        sums = np.concatenate([np.bincount(octets[:, i], minlength=256) @ BITS for i in range(8)])
    return int.from_bytes(np.packbits(2 * sums > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp bigint) of each row of docs."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([simhash(shingle_hashes(t.as_py(), words, seed)) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["doc_id", "fp"])
            release()

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"doc_id {kind}, fp long")


# Pigeonring. The 64 bits are a ring of four segments of 16 bits. If two fingerprints differ in at most 3 bits, then some segment
# i begins a chain of which every prefix keeps its proportional budget: segment i differs in floor(3/4) = 0 bits, i and i+1
# together in floor(6/4) = 1, i to i+2 in floor(9/4) = 2. With at most one difference in segment i+1, one of its halves is equal;
# so segment i and that half, 24 bits, make an exact key, eight keys a fingerprint.
SEGMENT, BUDGETS = 16, (0, 1, 2, 3)


def rotate(prints: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Segment `start` first."""
    by = (start.astype(np.uint64) * np.uint64(SEGMENT)) % np.uint64(64)
    back = (np.uint64(64) - by) % np.uint64(64)
    return np.where(by == 0, prints, prints << by | prints >> back)


TWO, THREE = np.uint64(0x0000FFFF00000000), np.uint64(0x0000FFFFFFFF0000)


def chain(differences: np.ndarray) -> np.ndarray:
    """Indexes of the differences (rotated, the first segment equal) that keep the chain's budgets, then the full Hamming check."""
    at = np.flatnonzero(np.bitwise_count(differences & TWO) <= BUDGETS[1])
    at = at[np.bitwise_count(differences[at] & THREE) <= BUDGETS[2]]
    return at[np.bitwise_count(differences[at]) <= BUDGETS[3]]


def links(prints: np.ndarray) -> list[tuple[int, int]]:
    """Edges that span the components of the links among prints (rotated, one block): index pairs, fewer than there are prints.

    Breadth-first: each print reached is held against those not reached yet, so prints known to hang together are not paired.
    """
    out, left = [], np.arange(len(prints))
    while len(left):
        front, left = [int(left[0])], left[1:]
        while front and len(left):
            at = front.pop()
            hit = chain(prints[left] ^ prints[at])
            if len(hit):
                found = left[hit]
                out += [(at, int(x)) for x in found]
                front += found.tolist()
                left = np.delete(left, hit)
    return out


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, start, fp) sorted by key, into edges (u, v); the rows of one key are held together."""
    held: list[np.ndarray] = []

    def block(rows: np.ndarray) -> pa.RecordBatch:
        """rows: whole keys; key, start, fp."""
        key, prints = rows[:, 0], rows[:, 2].view(np.uint64)
        begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(begin, len(key)))
        turned = rotate(prints, rows[:, 1])
        a, b = [], []
        same = np.repeat(np.arange(len(size)), size)
        for step in range(1, 16):  # blocks of up to 16 prints, all at once
            i = np.flatnonzero((same[step:] == same[:-step]) & (size[same[step:]] <= 16)) if len(same) > step else np.zeros(0, np.int64)
            if not len(i):
                break
            i = i[chain(turned[i] ^ turned[i + step])]
            a.append(prints[i].view(np.int64))
            b.append(prints[i + step].view(np.int64))
        for f, n in zip(begin[size > 16].tolist(), size[size > 16].tolist(), strict=True):
            if pairs := links(turned[f : f + n]):
                x, y = np.array(pairs).T
                a.append(prints[f + x].view(np.int64))
                b.append(prints[f + y].view(np.int64))
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["u", "v"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], axis=1)
        change = np.flatnonzero(rows[1:, 0] != rows[:-1, 0])
        if held and rows[0, 0] != held[-1][-1, 0]:
            yield block(np.concatenate(held))
            held = []
        if len(change):
            cut = int(change[-1]) + 1
            yield block(np.concatenate([*held, rows[:cut]]))
            held = [rows[cut:]]
        else:
            held.append(rows)
    if held:
        yield block(np.concatenate(held))


def candidate_keys(prints: DataFrame) -> DataFrame:
    """(key, start, fp): eight rows a fingerprint."""
    rows = []
    for i in range(4):
        turned = F.col("fp") if not i else F.shiftleft("fp", 16 * i).bitwiseOR(F.shiftrightunsigned("fp", 64 - 16 * i))
        segment = F.shiftrightunsigned(turned, 48)
        for half in range(2):
            part = F.shiftrightunsigned(turned, 40 - 8 * half).bitwiseAND(F.lit(0xFF))
            key = F.lit((2 * i + half) << 24).cast("long") + segment * 256 + part
            rows.append(F.struct(key.alias("key"), F.lit(i).cast("long").alias("start")))
    return prints.select("fp", F.explode(F.array(*rows)).alias("k")).select("k.key", "k.start", "fp")


def hot_keys(keys: DataFrame, limit: int) -> DataFrame | None:
    """(key, n) of the keys with more than `limit` rows, kept; None without any.

    Rows are counted map-side, first by the key's upper part (2^19 groups at most for candidate_keys, whatever the input). Only
    where such a part holds more than the limit are its keys counted, again map-side; the table of parts is broadcast if it is
    small enough, as measured.
    """
    part = F.shiftright("key", 8)
    heavy = keep(keys.groupBy(part.alias("part")).agg(F.count("*").alias("rows")).where(F.col("rows") > limit).select("part"))
    if not heavy.limit(1).count():
        return None
    inside = keys.select("key", part.alias("part"))
    if measured(heavy):
        inside = inside.join(F.broadcast(heavy), "part", "left_semi")
    hot = keep(inside.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > limit))
    return hot if hot.limit(1).count() else None


def refined_keys(hot: DataFrame) -> DataFrame:
    """Rows (key, start, fp) of hot keys, cut further: the 40 bits outside the key hold at most three differences, so one of their four tenths is equal."""
    turned = F.when(F.col("start") == 0, F.col("fp"))
    for i in range(1, 4):
        turned = turned.when(F.col("start") == i, F.shiftleft("fp", 16 * i).bitwiseOR(F.shiftrightunsigned("fp", 64 - 16 * i)))
    half = F.shiftrightunsigned("key", 24).bitwiseAND(F.lit(1))  # which half of the second segment is in the key
    other = F.when(half == 0, F.shiftrightunsigned(turned, 32)).otherwise(F.shiftrightunsigned(turned, 40)).bitwiseAND(F.lit(0xFF))
    rest = F.shiftleft(other, 32).bitwiseOR(turned.bitwiseAND(F.lit(0xFFFFFFFF)))
    rows = [F.struct(F.lit(j).alias("j"), F.shiftrightunsigned(rest, 30 - 10 * j).bitwiseAND(F.lit(0x3FF)).alias("part")) for j in range(4)]
    out = hot.select("key", "start", "fp", F.explode(F.array(*rows)).alias("k"))
    return out.select((F.col("key") * 4096 + F.col("k.j") * 1024 + F.col("k.part")).alias("key"), "start", "fp")


def block_pairs(hot: DataFrame, limit: int) -> DataFrame:
    """Rows (key, start, fp, n), n being the key's rows: each pair of cells of a key becomes a key of its own, so every pair of prints meets in some task."""
    rows = hot.withColumn("cells", F.ceil(F.col("n") * 2 / F.lit(limit))).withColumn("cell", F.pmod(F.xxhash64("fp"), F.col("cells")))
    other = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1)))
    return other.select(F.xxhash64("key", F.least("cell", "other"), F.greatest("cell", "other")).alias("key"), "start", "fp")


def linked(prints: DataFrame, limit: int = BLOCK_ROWS) -> DataFrame:
    """(u, v): edges that span the components of distinct fingerprints (column fp, kept) linked at three or fewer differing bits.

    Keys with more than `limit` rows are known by their counts before any row is sent, so no task gets one whole: their rows are
    cut finer, and what is still above the limit goes in pairs of cells of half a limit each, about.
    """
    ship(prints.sparkSession)

    def meet(keys: DataFrame) -> DataFrame:
        return keys.select("key", "start", "fp").repartition("key").sortWithinPartitions("key").mapInArrow(compare, "u long, v long")

    def split(keys: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """(rows of other keys, rows of hot ones with n)."""
        hot = hot_keys(keys, limit)
        if hot is None:
            return keys, None
        marked = lookup(keys, hot, "key", "n", F.col("fp"))
        return marked.where("n is null"), marked.where("n is not null")

    plain, hot = split(candidate_keys(prints))
    edges = meet(plain)
    if hot is not None:
        plain, hot = split(keep(refined_keys(hot)))
        edges = edges.unionByName(meet(plain))
        if hot is not None:
            edges = edges.unionByName(meet(block_pairs(hot, limit)))
    return edges


def near_components(base: DataFrame, limit: int) -> DataFrame:
    """(fp, n, root, component_id) of the fingerprints of rows (doc_id, fp) that are not alone in their component."""
    own = keep(base.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    roots = keep(components(linked(own.select("fp"), limit)))
    joined = own.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("all"))
    least = keep(least.where("all > 1"))
    return keep(lookup(joined, least, "root", "all", F.col("fp")).where("all is not null").select("fp", "n", "root", "component_id"))


def near_groups(docs: DataFrame, words: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", limit: int = BLOCK_ROWS) -> DataFrame:
    """(doc_id, fp bigint, component_id) for each row of docs, whole texts.

    Documents whose fingerprints differ in at most three bits are linked; component_id is the smallest id reachable. Equal
    fingerprints collapse to one before candidates are sought, so copies, empty texts and nulls (fingerprint zero) cost nothing.
    Rows without an id have their own null component unless linked to rows that have one. Repeated rows each get a row; an
    empty table gives an empty result; other columns are not read.
    """
    base = keep(fingerprints(docs, words, seed, id_col, text_col))
    groups = near_components(base, limit).drop("root")
    out = lookup(base, groups, "fp", "n", F.col("doc_id"))
    return out.select("doc_id", "fp", F.coalesce("component_id", "doc_id").alias("component_id"))


def drop_near_copies(docs: DataFrame, words: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs but for near copies: one row of each group stays, all its columns untouched.

    That of the smallest id stays, then of the smallest fingerprint and text; rows without an id come last. A row is known by
    its id and fingerprint, so rows without an id and ids of several rows are judged each by their own text. Only their
    fingerprints are computed again; other rows go by their id.
    """
    base = keep(fingerprints(docs, words, seed, id_col, text_col).withColumnRenamed(id_col, "doc_id"))
    groups = near_components(base, BLOCK_ROWS)
    in_group = lookup(base, groups, "fp", "n", F.col("doc_id")).where("root is not null")
    own = in_group.groupBy("root", "doc_id", "fp").agg(F.count("*").alias("ties"))
    first = keep(own.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp", "ties")).alias("first"), F.count("*").alias("all")))
    groups = keep(lookup(groups, first.select("root", "first", "all"), "root", "all", F.col("fp")).select("fp", "n", "root", F.col("first.doc_id").alias("keep_id"), F.col("first.fp").alias("keep_fp"), F.col("first.ties").alias("ties")))
    unclear = keep(base.groupBy("doc_id").agg(F.count("*").alias("times")).where("times > 1 or doc_id is null").select("doc_id"))
    gone = lookup(base, groups, "fp", "n", F.col("doc_id")).where("root is not null and not (doc_id <=> keep_id and fp = keep_fp)").select("doc_id")
    gone = keep(gone.unionByName(unclear).where("doc_id is not null").distinct().select(F.col("doc_id").alias(id_col)))
    if not unclear.limit(1).count():
        return without(docs, gone, id_col)

    @F.arrow_udf(LongType())
    def print_of(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([simhash(shingle_hashes(t, words, seed)) for t in texts.to_pylist()], np.uint64).view(np.int64))

    clear = without(docs.where(F.col(id_col).isNotNull()), gone, id_col)
    again = unclear.where("doc_id is not null").select(F.col("doc_id").alias(id_col))
    rest = docs.join(again, id_col, "left_semi").unionByName(docs.where(F.col(id_col).isNull()))
    small = groups.select(*(F.col(c).alias(f"__near_{c}") for c in groups.columns))
    rest = lookup(rest.withColumn("__near_fp", print_of(F.col(text_col))), small, "__near_fp", "__near_n", F.col(id_col))
    rest = rest.where(F.col("__near_root").isNull() | (F.col(id_col).eqNullSafe(F.col("__near_keep_id")) & (F.col("__near_fp") == F.col("__near_keep_fp"))))
    tied = rest.where("__near_ties > 1").groupBy("__near_root").agg(F.min_by(F.struct(*(F.col(c) for c in docs.columns)), F.coalesce(F.col(text_col), F.lit(""))).alias("__near_one"))
    rest = rest.where("__near_ties is null or __near_ties = 1").select(*docs.columns).unionByName(tied.select("__near_one.*"))
    return clear.select(*docs.columns).unionByName(rest)

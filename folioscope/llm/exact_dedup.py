"""Exact dedup: counting quotient filters per partition, merged by sorted remainders, then byte verification."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep, lookup, measured, ship

#: Fingerprints in a filter shard after the merge, at most about; a shard is what one merging task holds, about 7 bytes each.
SHARD_ROWS = 1 << 22
#: A partition's filter is emitted whenever it holds so many fingerprints, and another begun.
FLUSH_ROWS = 1 << 21
#: Fingerprints in a batch that a merging task hands on.
OUT_ROWS = 1 << 16
HEAD = struct.Struct("<BBQII")


class CountingQuotientFilter:
    """A quotient filter with counters over 64-bit fingerprints of which the top `skip` bits are the same (the shard).

    The next bits, as many as the number of fingerprints has, are the quotient, the rest the remainder; so a filter's size follows
    what it holds, about rbits / 8 + 3/8 bytes a fingerprint. Slots hold the remainders sorted within the run of their quotient;
    `occupied` has a bit for each quotient with a run and `runend` one for each slot that ends a run; counts above one are kept
    for their slots only. Slots enumerate in fingerprint order, and a wider quotient only moves bits from the remainders, so
    filters of any two sizes merge losslessly.
    """

    def __init__(self, skip: int, prints: np.ndarray, counts: np.ndarray):
        """prints: sorted, distinct, unsigned; counts: of each."""
        self.skip, self.qbits = skip, min(64 - skip, max(1, len(prints).bit_length()))
        self.rbits = 64 - skip - self.qbits
        self.top = int(prints[0]) >> (64 - skip) if skip and len(prints) else 0
        body = prints & np.uint64((1 << (64 - skip)) - 1)
        quotients = (body >> np.uint64(self.rbits)).astype(np.int64)
        self.remainders = body & np.uint64((1 << self.rbits) - 1)
        self.occupied = np.zeros(1 << self.qbits, bool)
        self.occupied[quotients] = True
        self.runend = np.append(quotients[1:] != quotients[:-1], True) if len(prints) else np.zeros(0, bool)
        self.many = np.flatnonzero(counts > 1).astype(np.uint32)
        self.extra = counts[self.many].astype(np.uint64)

    def __len__(self) -> int:
        return len(self.remainders)

    @classmethod
    def build(cls, skip: int, prints: np.ndarray) -> CountingQuotientFilter:
        values, counts = np.unique(prints, return_counts=True)
        return cls(skip, values, counts)

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints in order, and their counts."""
        run = np.concatenate([[0], np.cumsum(self.runend)[:-1]]) if len(self.runend) else np.zeros(0, np.int64)
        quotients = np.flatnonzero(self.occupied)[run].astype(np.uint64)
        prints = np.uint64(self.top << (64 - self.skip) if self.skip else 0) | quotients << np.uint64(self.rbits) | self.remainders
        counts = np.ones(len(prints), np.uint64)
        counts[self.many] = self.extra
        return prints, counts

    def merge(self, other: CountingQuotientFilter) -> CountingQuotientFilter:
        """Both, as one sorted run; counts of what is in both add up."""
        prints, counts = (np.concatenate(x) for x in zip(self.items(), other.items(), strict=True))
        order = np.argsort(prints, kind="stable")  # two sorted runs: a merge
        prints, counts = prints[order], counts[order]
        first = np.flatnonzero(np.append(True, prints[1:] != prints[:-1])) if len(prints) else np.zeros(0, np.int64)
        return CountingQuotientFilter(self.skip, prints[first], np.add.reduceat(counts, first) if len(first) else counts)

    @classmethod
    def merge_all(cls, skip: int, filters: Iterable[CountingQuotientFilter]) -> CountingQuotientFilter:
        """Filters as they come, two at a time, like with like: what is held is never more than twice what the merged filter holds."""
        held: list[CountingQuotientFilter] = []
        for one in filters:
            while held and len(held[-1]) <= len(one):
                one = held.pop().merge(one)
            held.append(one)
        while len(held) > 1:
            one = held.pop()
            held.append(held.pop().merge(one))
        return held[0] if held else cls(skip, np.zeros(0, np.uint64), np.zeros(0, np.uint64))

    def to_bytes(self) -> bytes:
        width = -(-self.rbits // 8)
        packed = self.remainders.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
        head = HEAD.pack(self.skip, self.qbits, self.top, len(self.remainders), len(self.many))
        return b"".join((head, np.packbits(self.occupied).tobytes(), np.packbits(self.runend).tobytes(), packed, self.many.tobytes(), self.extra.tobytes()))

    @classmethod
    def from_bytes(cls, data: bytes) -> CountingQuotientFilter:
        self, at = cls.__new__(cls), HEAD.size
        self.skip, self.qbits, self.top, n, many = HEAD.unpack_from(data)
        self.rbits = 64 - self.skip - self.qbits
        width = -(-self.rbits // 8)

        def take(size: int) -> bytes:
            nonlocal at
            at += size
            return data[at - size : at]

        self.occupied = np.unpackbits(np.frombuffer(take(-(-(1 << self.qbits) // 8)), np.uint8), count=1 << self.qbits).astype(bool)
        self.runend = np.unpackbits(np.frombuffer(take(-(-n // 8)), np.uint8), count=n).astype(bool)
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :width] = np.frombuffer(take(n * width), np.uint8).reshape(n, width)
        self.remainders = wide.reshape(-1).view("<u8").astype(np.uint64)
        self.many = np.frombuffer(take(4 * many), np.uint32)
        self.extra = np.frombuffer(take(8 * many), np.uint64)
        return self


def shard_bits(rows: int) -> int:
    """Top bits that name a shard, so that none of `rows` distinct fingerprints' shards holds more than about SHARD_ROWS."""
    return max(0, (max(1, rows) // SHARD_ROWS).bit_length())


def shard_filters(prints: np.ndarray, skip: int) -> list[tuple[int, bytes]]:
    """(shard, filter) of one partition's fingerprints, in any order and with repeats."""
    prints = np.sort(prints)
    tops = prints >> np.uint64(64 - skip) if skip else np.zeros(len(prints), np.uint64)
    cut = np.flatnonzero(np.append(True, tops[1:] != tops[:-1]))
    return [(int(t), CountingQuotientFilter.build(skip, x).to_bytes()) for t, x in zip(tops[cut], np.split(prints, cut[1:]), strict=True)]


def repeated_fingerprints(prints: DataFrame, rows: int) -> DataFrame:
    """(fp, n) of the fingerprints (column fp, bigint) that occur more than once among about `rows` rows.

    Each partition builds its filters, cut by the fingerprints' top bits into shards; the shards' filters meet by a shuffle
    (a hot fingerprint only once a partition) and merge two at a time as they arrive. A partition of 200,000 distinct
    fingerprints sends 6.3 bytes for each of them at 10^8 rows and 6.8 at 10^10 (tests/llm/test_exact_dedup.py).
    """
    ship(prints.sparkSession)
    skip = shard_bits(rows)

    def emit(parts: list[np.ndarray]) -> pa.RecordBatch:
        shards, blobs = zip(*shard_filters(np.concatenate(parts), skip), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(shards, pa.int64()), pa.array(blobs, pa.binary())], ["shard", "filter"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            if batch.num_rows:
                parts.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
                held += batch.num_rows
            if held >= FLUSH_ROWS:
                yield emit(parts)
                parts, held = [], 0
        if parts:
            yield emit(parts)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrived = (CountingQuotientFilter.from_bytes(x.as_py()) for b in batches for x in b.column("filter"))
        values, counts = CountingQuotientFilter.merge_all(skip, arrived).items()
        more = counts > 1
        values, counts = values[more].view(np.int64), counts[more].astype(np.int64)
        for at in range(0, len(values), OUT_ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(values[at : at + OUT_ROWS]), pa.array(counts[at : at + OUT_ROWS])], ["fp", "n"])

    return prints.select("fp").mapInArrow(build, "shard long, filter binary").groupBy("shard").applyInArrow(merge, "fp long, n long")


def normal(text: Column) -> Column:
    """Without the characters of [\\x20\\x09-\\x0D]; null is empty."""
    out = F.coalesce(text, F.lit(""))
    for c in " \n\t\r\x0b\x0c":
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(base, groups): base has a row for each of docs (id, size, text_sha256, row), groups one for each text that occurs more than once.

    groups: text_sha256, keep_id, keep_size, keep_row (the first of the keeper's rows in base), group_size, ties (rows that share
    the keeper's id and size).
    """
    text = normal(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("size"), text.alias("plain"))
    base = keep(rows.select("doc_id", "size", F.sha2("plain", 256).alias("text_sha256"), F.xxhash64("plain").alias("fp"), F.monotonically_increasing_id().alias("row")))
    many = keep(repeated_fingerprints(base, base.count()))
    few = measured(many)
    only = F.broadcast(many.select("fp")) if few else many.select("fp")
    # Byte verification: equal texts collapse where they are read, before the shuffle; what remains above one is equal byte by byte.
    routed = rows.select("doc_id", "plain", F.xxhash64("plain").alias("fp"))
    if few:
        routed, mine = routed.join(only, "fp", "left_semi"), base.join(only, "fp", "left_semi")
    else:  # only hot fingerprints, at most a thousand, are broadcast
        routed, mine = (lookup(x, many, "fp", "n", F.col("doc_id")).where("n is not null").drop("n") for x in (routed, base))
    equal = routed.groupBy("plain").agg(F.count("*").alias("group_size")).where("group_size > 1").select(F.sha2("plain", 256).alias("text_sha256"), "group_size")
    own = mine.groupBy("text_sha256", "size", "doc_id").agg(F.count("*").alias("ties"), F.min("row").alias("row"))
    first = F.min(F.struct((-F.col("size")).alias("less"), F.col("doc_id").isNull().alias("none"), "doc_id", "row", "ties")).alias("first")
    keepers = own.groupBy("text_sha256").agg(first)
    groups = equal.join(keepers, "text_sha256").select(
        "text_sha256", F.col("first.doc_id").alias("keep_id"), (-F.col("first.less")).alias("keep_size"), F.col("first.row").alias("keep_row"), "group_size", F.col("first.ties").alias("ties")
    )
    return base.drop("fp"), keep(groups)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for each row of docs, whole texts.

    Texts are equal when identical without white space; of equal texts the one with the most code points, then the smallest
    id stays (null ids last). Null texts count as empty; empty texts are equal to one another. Of rows repeated with the same
    id and text exactly one is kept. An empty table gives an empty result; other columns are not read. Groups of any size:
    copies collapse in map-side aggregation, and the join back spreads hot groups.
    """
    base, groups = classes(docs, id_col, text_col)
    out = lookup(base, groups.drop("ties"), "text_sha256", "group_size", F.col("doc_id"))
    lone = F.col("group_size").isNull()
    keeper, size = F.when(lone, F.col("doc_id")).otherwise(F.col("keep_id")), F.coalesce("group_size", F.lit(1)).cast("long")
    return out.select("doc_id", keeper.alias("keep_id"), size.alias("group_size"), (lone | (F.col("row") == F.col("keep_row"))).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, all their columns untouched; same rules as exact_groups, clashing names included.

    Of rows that repeat the keeper's id and text any one stays, whole; they are combined before the shuffle.
    """
    _, groups = classes(docs, id_col, text_col)
    names = docs.columns
    small = groups.select(*(F.col(c).alias(f"__dedup_{c}") for c in groups.columns if c != "keep_row"))
    big = docs.withColumns({"__dedup_text_sha256": F.sha2(normal(F.col(text_col)), 256), "__dedup_size": F.length(F.coalesce(F.col(text_col), F.lit("")))})
    out = lookup(big, small, "__dedup_text_sha256", "__dedup_group_size", F.col(id_col))
    out = out.where(F.col("__dedup_group_size").isNull() | (F.col(id_col).eqNullSafe(F.col("__dedup_keep_id")) & (F.col("__dedup_size") == F.col("__dedup_keep_size"))))
    if groups.where("ties > 1").limit(1).count():
        tied = out.where("__dedup_ties > 1").groupBy("__dedup_text_sha256").agg(F.min_by(F.struct(*(F.col(c) for c in names)), F.col("__dedup_size")).alias("__dedup_one")).select("__dedup_one.*")
        out = out.where("__dedup_ties is null or __dedup_ties = 1").select(*names).unionByName(tied)
    return out.select(*names)

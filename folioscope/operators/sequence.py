"""Ordered-sequence operators: running positions, islands, folds over one document's ordered rows."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type


def running_start(size: Column, key: str, order: str) -> Column:
    """Where each row begins when rows are laid end to end: the sum of the sizes before it."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(size).over(before), F.lit(0)).cast("long")


def merge_adjacent(rows: DataFrame, key: str, order: str, mark: str, text: str) -> DataFrame:
    """Runs of equal marks (null equals null) become one, texts joined: (key, seq, mark, text, parts)."""
    w = Window.partitionBy(key).orderBy(order)
    change = F.when(F.col(mark).eqNullSafe(F.lag(mark).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    island = F.sum("__change").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = rows.withColumn("__change", change).withColumn("seq", island)
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(text, F.lit("")).alias("t"))))
    return out.groupBy(key, "seq").agg(F.first(mark).alias(mark), F.array_join(F.transform(parts, lambda p: p["t"]), "").alias(text), F.count("*").alias("parts"))


def not_ascending(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Rows whose value is not above the one before."""
    return rows.withColumn("previous", F.lag(value).over(Window.partitionBy(key).orderBy(order))).where(F.col(value) <= F.col("previous"))


def containing(rows: DataFrame, key: str, order: str, is_end: Column, ident: str) -> Column:
    """For each row the identifier of the first end at or after it; null after the last."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return F.first(F.when(is_end, F.col(ident)), ignorenulls=True).over(w)


def first_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key, by order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("__n = 1").drop("__n")


def pair_ranges(rows: DataFrame, key: str, ident: str, position: str, kind: str) -> DataFrame:
    """(key, ident, first, end) from start and end rows: an end counts only after its start; a start without one is empty."""
    start = F.min(F.when(F.col(kind) == "start", F.col(position)))
    end = F.max(F.when(F.col(kind) == "end", F.col(position)))
    out = rows.groupBy(key, ident).agg(start.alias("first"), end.alias("last")).where("first is not null")
    return out.select(key, ident, "first", F.when(F.col("last") > F.col("first"), F.col("last")).otherwise(F.col("first")).alias("end"))


def split_blocks(rows: DataFrame, key: str, order: str, kind: str) -> DataFrame:
    """A paragraph end is put before each block that follows neither a paragraph end nor a block: rows (key, order, kind, inserted)."""
    last = F.lag(kind).over(Window.partitionBy(key).orderBy(order))
    needed = (F.col(kind) == "block") & F.coalesce(~last.isin("end", "block"), F.lit(False))
    own = F.struct(F.col(kind).alias("kind"), F.lit(False).alias("inserted"))
    put = F.struct(F.lit("end").alias("kind"), F.lit(True).alias("inserted"))
    out = rows.withColumn("__r", F.when(needed, F.array(put, own)).otherwise(F.array(own)))
    return out.select(key, order, F.posexplode("__r").alias("part", "r")).select(key, order, "part", "r.kind", "r.inserted")


def inherited(has: Column, key: str, order: str) -> Column:
    """Whether a row without the property follows one that has it."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return ~has & F.coalesce(F.max(has).over(before), F.lit(False))


def fill(value: Column, key: str, order: str, otherwise: Column) -> Column:
    """Nulls take the value before them, those at the start the one after, none: `otherwise`."""
    w = Window.partitionBy(key).orderBy(order)
    before = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.first(value, ignorenulls=True).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    return F.coalesce(before, after, otherwise)


def itemize(rows: DataFrame, key: str, order: str, properties: list[str]) -> DataFrame:
    """(key, run, first, end, properties): maximal runs of rows whose properties are all the same."""
    w = Window.partitionBy(key).orderBy(order)
    same = F.lit(True)
    for p in properties:
        same = same & F.col(p).eqNullSafe(F.lag(p).over(w))
    change = F.when(same & (F.row_number().over(w) > 1), 0).otherwise(1)
    out = rows.withColumn("__c", change).withColumn("run", F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return out.groupBy(key, "run").agg(F.min(order).alias("first"), (F.max(order) + 1).alias("end"), *(F.first(p).alias(p) for p in properties))


def first_fit(segments: Column, measure: Column) -> Column:
    """Line ends of greedy line breaking: an array of the ends of segments that close a line.

    segments: array of (end, width, hang, mandatory). A segment goes to the next line if with it, but for what may hang over, the
    line is wider than the measure. One document is one array, folded in the JVM.
    """
    start = F.struct(F.lit(0).cast("long").alias("width"), F.lit(None).cast("long").alias("last"), F.array().cast("array<long>").alias("ends"))

    def step(acc: Column, s: Column) -> Column:
        over = acc["last"].isNotNull() & (acc["width"] + s["width"] - s["hang"] > measure)
        ends = F.when(over, F.concat(acc["ends"], F.array(acc["last"]))).otherwise(acc["ends"])
        width = F.when(over, F.lit(0).cast("long")).otherwise(acc["width"]) + s["width"]
        return F.struct(
            F.when(s["mandatory"], F.lit(0).cast("long")).otherwise(width).alias("width"),
            F.when(s["mandatory"], F.lit(None).cast("long")).otherwise(s["end"]).alias("last"),
            F.when(s["mandatory"], F.concat(ends, F.array(s["end"]))).otherwise(ends).alias("ends"),
        )

    return F.aggregate(segments, start, step, lambda acc: F.when(acc["last"].isNull(), acc["ends"]).otherwise(F.concat(acc["ends"], F.array(acc["last"]))))


def segments(text: Column, hang_spaces: bool = True) -> Column:
    """Words with the space after them, lines feeds as mandatory breaks, widths in characters: the input of first_fit."""
    words = F.regexp_extract_all(text, F.lit(r"[^ \n]*(?: +|\n|$)"), 0)
    words = F.filter(words, lambda w: w != "")
    ends = F.aggregate(
        words,
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<end:bigint,width:bigint,hang:bigint,mandatory:boolean>>").alias("out")),
        lambda acc, w: F.struct(
            (acc["at"] + F.length(w)).alias("at"),
            F.concat(acc["out"], F.array(F.struct((acc["at"] + F.length(w)).alias("end"), F.length(F.regexp_replace(w, "\n", "")).cast("long").alias("width"), (F.length(F.regexp_replace(w, "\n", "")) - F.length(F.rtrim(F.regexp_replace(w, "\n", "")))).cast("long").alias("hang"), w.endswith("\n").alias("mandatory")))).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return ends


#: Rows that a batch of a fold's results holds; a key's own results are never cut by function, only sent in pieces.
BATCH_ROWS = 4096


def fold(rows: DataFrame, key: str, order: str, values: list[str], function: Callable[[list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """(key, order, ...) of function over each key's rows in order: tuples (order, values...) in, tuples (order, ...) out.

    For folds whose step depends on what was folded, and that need all of a key's rows at once: Python holds one key at a time.
    """
    return fold_rows(rows, key, order, values, lambda key_rows: function(list(key_rows)), schema)


def fold_rows(rows: DataFrame, key: str, order: str, values: list[str], function: Callable[[Iterator[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """fold() by a function that takes a key's rows one after the other and may give each result as soon as it is known.

    Rows are sorted by key and order where they are shuffled to, which spills, and cross to Python as narrow rows; a key may go
    over any number of batches. Python holds a batch, what function keeps, and a batch of results, however many rows there are.
    schema names what comes after the key.
    """
    kind = rows.schema[key].dataType.simpleString()
    narrow = rows.select(key, order, *values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        held_keys, held = [], []

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held_keys, key_type), *(pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True))], [key, *labels])
            held_keys.clear()
            held.clear()
            return out

        for k, group in groupby(each(), key=itemgetter(0)):
            found = function(r[1:] for r in group)
            for row in found:
                held_keys.append(k)
                held.append(row)
                if len(held) == BATCH_ROWS:
                    yield flush()
        if held:
            yield flush()

    parts = [x.strip().split() for x in schema.split(",")]
    labels = [p[0] for p in parts]
    types = [{"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64()}[p[1]] for p in parts]
    key_type = to_arrow_type(rows.schema[key].dataType)
    return narrow.repartition(key).sortWithinPartitions(key, order, *values).mapInArrow(run, f"`{key}` {kind}, {schema}")


def joined_lines(baselines: list[int | None], sizes: list[int | None]) -> list[int]:
    """Group number of each line: a line joins the group before if its baseline is within half an em of the group's largest glyph.

    A line without a baseline or glyphs is a group of its own, and the next starts anew. The greater of both sizes is the em; the
    group's line with the largest glyph, the first of equal ones, is what others are held against.
    """
    out: list[int] = []
    held: tuple[int, int] | None = None
    for base, size in zip(baselines, sizes, strict=True):
        own = None if base is None or size is None else (base, size)
        near = own is not None and held is not None and 2 * abs(own[0] - held[0]) <= max(own[1], held[1])
        if near and out:
            out.append(out[-1])
            if own[1] > held[1]:
                held = own
        else:
            out.append(out[-1] + 1 if out else 0)
            held = own
    return out


def matched_fields(delimiters: Iterable[tuple]) -> Iterator[tuple]:
    """(ident, begin) of the field delimiters (ident, kind: begin, separate, end) in order, each once that is known: null where unmatched.

    A separator belongs to the innermost open field and only once; delimiters of fields never ended are unmatched. Only open
    fields are held.
    """
    open_: list[list] = []
    for ident, kind in delimiters:
        if kind == "begin":
            open_.append([ident])
        elif kind == "separate" and open_ and len(open_[-1]) == 1:
            open_[-1].append(ident)
        elif kind == "end" and open_:
            own = [*open_.pop(), ident]
            yield from ((i, own[0]) for i in own)
        else:
            yield ident, None
    yield from ((i, None) for own in open_ for i in own)


def match_fields(kinds: list[str]) -> list[int | None]:
    """matched_fields() of a list: the index of each one's begin."""
    out = dict(matched_fields(enumerate(kinds)))
    return [out[i] for i in range(len(kinds))]


def increasing(seconds: list[int]) -> list[int]:
    """Indexes of a longest strictly increasing subsequence; of equally long ones, that with the smallest last value."""
    tails: list[int] = []
    values: list[int] = []
    back = [-1] * len(seconds)
    for i, v in enumerate(seconds):
        k = bisect_left(values, v)
        back[i] = tails[k - 1] if k else -1
        tails[k : k + 1] = [i]
        values[k : k + 1] = [v]
    out, at = [], tails[-1] if tails else -1
    while at >= 0:
        out.append(at)
        at = back[at]
    return out[::-1]

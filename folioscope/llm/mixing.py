"""Mixing sources to target weights: repetition rates from token counts, then whole copies and one hash-seeded Bernoulli copy."""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, keep, lookup

#: Bits of the hash that the Bernoulli draw takes, as hexadecimal digits; 13 digits fit a double exactly.
DIGITS = 13


def words(text: Column) -> Column:
    """Number of words; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def numbered(sources: DataFrame) -> DataFrame:
    """sources (column source) with rank, from 0, by code point, null last: ranked within sorted ranges, ranges offset by their sizes."""
    by = F.col("source").asc_nulls_last()
    ranged = keep(sources.repartitionByRange(by).withColumn("part", F.spark_partition_id()))
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n"))  # a row for each shuffle partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy(by)) - 1 + F.col("before")
    return ranged.join(F.broadcast(offsets), "part").withColumn("rank", rank.cast("long")).drop("part", "before")


def targets(sizes: DataFrame, weights: Sequence[int], share: Fraction, cap: int) -> DataFrame:
    """sizes (source, source_size, n) with target: the sources share `share` of all sizes by weight, none above cap times its size.

    Water filling: the excess of those above their cap is reshared by weight among the rest until none is above. Each round is
    one small aggregate over the table of sources; a round fixes at least one source, so rounds end.
    """
    cycle = F.array(*(F.lit(int(w)).cast("long") for w in weights))
    ranked = keep(numbered(sizes).withColumn("weight", F.element_at(cycle, (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))))
    num, den = share.numerator, share.denominator
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    # level = over / under: a source is capped if its weight times the level is above cap times its size
    over, under = 0, 1
    fixed = -1
    while True:
        capped = F.col("weight").cast("decimal(38,0)") * F.lit(over) > F.col("source_size").cast("decimal(38,0)") * F.lit(cap * under)
        row = ranked.agg(F.count_if(capped), F.coalesce(F.sum(F.when(capped, F.col("source_size"))), F.lit(0)), F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0))).first()
        if row[0] == fixed or not row[2]:
            break
        fixed = row[0]
        over, under = num * total - den * cap * row[1], den * row[2]  # (share - what the capped take) / weights of the rest
    level = F.when(capped, (F.col("source_size") * cap).cast("double")).otherwise((F.col("weight") * F.lit(over).cast("long")).cast("double") / F.lit(float(under)))
    return ranked.select("source", "source_size", "n", level.alias("target"))


def source_key(source: Column) -> Column:
    """Null sources get a key of their own, others a prefix, so that joins need no null-safe comparison."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source))


def rates(sizes: DataFrame, weights: Sequence[int], share: Fraction, cap: int) -> DataFrame:
    """(key, source_size, n, target, rate) of each source, from sizes (key, source_size, n)."""
    named = sizes.select(F.when(F.col("key") != "n", F.expr("substr(key, 2)")).alias("source"), "source_size", "n")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(cap)))).otherwise(F.lit(0.0))
    return keep(targets(named, weights, share, cap).select(source_key(F.col("source")).alias("key"), "source_size", "n", "target", rate.alias("rate")))


def copies(rate: Column, ident: Column, seed: str) -> Column:
    """floor(rate) and one more if the id's draw, the first DIGITS hexadecimal digits of sha256(seed:id), is below the fraction."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit("")))
    draw = F.conv(F.substring(F.sha2(name, 256), 1, DIGITS), 16, 10).cast("double") / F.lit(float(16**DIGITS))
    return (F.floor(rate) + F.when(draw < rate - F.floor(rate), F.lit(1)).otherwise(F.lit(0))).cast("long")


def plan_mix(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: Fraction = Fraction(3, 2), cap: int = 2, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, rate, copies, taken) for each row of docs.

    rate is target / source_size, at most cap. Reruns agree, and repeated rows of one id draw alike. Null texts have size 0;
    null sources are a source of their own, ordered last; a null id draws as the empty string; a source without words has
    rate 0. An empty table gives an empty result; other columns are not read. Sources of any share of the rows: sizes are
    combined before the shuffle, and rates come back by a broadcast of checked size or a join that spreads hot sources.
    """
    base = keep(docs.select(F.col(id_col).alias("doc_id"), source_key(F.col(source_col)).alias("key"), words(F.col(text_col)).alias("size")))
    sizes = base.groupBy("key").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    both = lookup(base, rates(sizes, weights, share, cap), "key", "n", F.col("doc_id"))
    both = both.withColumn("copies", copies(F.col("rate"), F.col("doc_id"), seed))
    return both.select("doc_id", "size", "source_size", "target", "rate", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: Fraction = Fraction(3, 2), cap: int = 2, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs with each row as often as plan_mix says, all its columns untouched, clashing names included.

    Copies are made where the row is read: texts are not shuffled while the table of sources can be broadcast.
    """
    sizes = docs.select(source_key(F.col(source_col)).alias("key"), words(F.col(text_col)).alias("size")).groupBy("key").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    small = rates(sizes, weights, share, cap).select(F.col("key").alias("__mix_key"), F.col("rate").alias("__mix_rate"), F.col("n").alias("__mix_n"))
    both = lookup(docs.withColumn("__mix_key", source_key(F.col(source_col))), small, "__mix_key", "__mix_n", F.col(id_col))
    times = copies(F.col("__mix_rate"), F.col(id_col), seed).cast("int")
    return both.withColumn("__mix_copy", F.explode(F.array_repeat(F.lit(1), times))).select(*docs.columns)

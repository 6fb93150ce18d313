"""What the operators of this subpackage share: the shared folder, size-checked joins, connected components."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Small sides of joins are broadcast up to so many bytes, measured; beyond it they are shuffled.
BROADCAST_BYTES = 32 << 20
#: What a broadcast row takes besides its values: pointers, key and hash slots.
ROW_BYTES = 32
#: A key is hot if it holds at least one row in HOT_SHARE; so there are at most HOT_SHARE hot keys, whatever the input.
HOT_SHARE = 1000

WHITE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package even if the driver was started from another folder."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH")) if x)


def release() -> None:
    """Give memory that a worker has freed back to the system; workers live on between tasks."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a local master gets one of its own if it is unset."""
    sc = spark.sparkContext
    set_to = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    set_to = set_to or sc.getCheckpointDir()
    if not set_to:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        set_to = "file://" + tempfile.mkdtemp(prefix="folioscope-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(set_to)
    return set_to


def new_folder(spark: SparkSession, what: str) -> str:
    """URI of a folder of its own in the shared folder; made by whoever writes first."""
    return f"{shared_dir(spark).rstrip('/')}/folioscope-{what}-{uuid.uuid4().hex}"


def filesystem(uri: str):
    """pyarrow file system and path of a URI; usable on executors for file, hdfs and s3 alike."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def keep(df: DataFrame) -> DataFrame:
    """Compute once and cut the lineage: a reliable checkpoint in the shared folder, which lost executors don't harm."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def measured(df: DataFrame, limit: int | None = None) -> bool:
    """Whether df, as rows of a broadcast relation, takes at most `limit` bytes (BROADCAST_BYTES), by its rows and the width of their values."""
    widths = [F.lit(ROW_BYTES)]
    for name, kind in df.dtypes:
        col = F.col(f"`{name}`")
        if kind in ("string", "binary"):
            widths.append(F.lit(8) + F.coalesce(F.octet_length(col), F.lit(0)))
        elif kind.startswith(("array", "map", "struct")):
            widths.append(F.lit(8) + F.coalesce(F.octet_length(F.to_json(F.struct(col))) * 2, F.lit(0)))
        else:
            widths.append(F.lit(16 if kind.startswith("decimal") else 8))
    width = widths[0]
    for w in widths[1:]:
        width = width + w
    size = df.agg(F.coalesce(F.sum(width.cast("long")), F.lit(0))).first()[0]
    return size <= (BROADCAST_BYTES if limit is None else limit)


def lookup(big: DataFrame, small: DataFrame, key: str, weight: str, salt: Column, limit: int | None = None) -> DataFrame:
    """Left join of big with small on key, which is unique and not null in small; null keys of big match nothing.

    weight is small's column with the number of rows of big that share the key. Small sides of at most `limit` bytes
    (BROADCAST_BYTES) are broadcast. Else only the hot keys, at most HOT_SHARE of them, are broadcast, and the rows they match are
    spread over the shuffle by `salt`, so that no key of whatever size lands in one task. small is read several times: keep it.
    """
    if measured(small, limit):
        return big.join(F.broadcast(small), key, "left")
    names = [c for c in small.columns if c != key]
    text = F.hex(key) if dict(small.dtypes)[key] == "binary" else F.col(key).cast("string")
    total = small.agg(F.sum(weight)).first()[0]
    bound = max(10_000, total // HOT_SHARE + 1)
    hot = small.where(F.col(weight) >= bound).select(key, *(F.col(c).alias(f"__hot_{c}") for c in names))
    cold = small.where(F.col(weight) < bound).select(F.concat(F.lit("c"), text).alias("__key"), *(F.col(c).alias(f"__cold_{c}") for c in names))
    hit = F.col(f"__hot_{weight}").isNotNull()
    both = big.join(F.broadcast(hot), key, "left")
    both = both.withColumn("__key", F.when(hit | F.col(key).isNull(), F.concat(F.lit("h"), F.xxhash64(salt).cast("string"))).otherwise(F.concat(F.lit("c"), text)))
    both = both.join(cold, "__key", "left")
    return both.select(*big.columns, *(F.coalesce(f"__hot_{c}", f"__cold_{c}").alias(c) for c in names))


def without(docs: DataFrame, dropped: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """docs but for those whose key is in dropped (keys). Broadcast up to `limit` bytes (BROADCAST_BYTES), else shuffled by key."""
    return docs.join(F.broadcast(dropped) if measured(dropped, limit) else dropped, key, "left_anti")


def star(edges: DataFrame, large: bool) -> DataFrame:
    """One large-star or small-star operation on edges (u, v) with u > v.

    The least neighbour of each node is a map-side combined minimum, kept with the node's degree; the edges meet it by lookup(),
    which broadcasts small tables and hubs and spreads a hub's edges over the shuffle by their other end.
    """
    both = edges.select("u", "v")
    if large:
        both = both.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = keep(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
    met = lookup(both, least, "u", "n", F.col("v"))
    if large:
        out = met.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
    else:
        out = met.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected edges (u, v): root is the least node of its component.

    Alternating large-star and small-star rounds over checkpointed edges. Minima are combined map-side and hubs, however many
    edges they have, are spread over the shuffle (see star); nothing is gathered.
    """
    now = keep(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark or not seen[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        mark = tuple(seen)
        now = keep(star(keep(star(now, True)), False))

"""Event-time windows over streams, and how a bounded stream is run to its end. Additions: the reference has no event time."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """A new folder in the shared folder that the session names; only local sessions get one of their own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="folioscope-")
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def stream_of(spark: SparkSession, path: str) -> DataFrame:
    """A stream over a table's files, one file a batch."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path + "*")


def run_to_end(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that a bounded stream gives, written to the shared folder with its checkpoint, so a restart goes on where it stopped."""
    spark = stream.sparkSession
    at = folder(spark)
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).format("parquet").start(f"{at}/out")
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def tumbling(events: DataFrame, width: str, late: str, *keys: str) -> DataFrame:
    """(start, keys, n, total) by windows; rows later than `late` behind the newest are dropped by the watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def by_session(events: DataFrame, gap: str, late: str, key: str) -> DataFrame:
    """(key, start, end, n) of runs of events with no longer pause than `gap`."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")

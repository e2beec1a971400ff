"""Structured Streaming: a store that grows as Turtle files arrive, and event counts by time and session."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import SCHEMA, STATEMENT, append
from ..sources.turtle import parse


def follow(spark: SparkSession, folder: str, store: str, checkpoint: str) -> StreamingQuery:
    """Load the files of a folder into a store as they come; a batch that is repeated adds nothing."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.ttl").load(folder)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                own = hashlib.sha256(path.encode() + b"\0" + bytes(content)).hexdigest()[:16]
                yield pd.DataFrame([(path, *x) for x in parse(bytes(content).decode(), f"{own}.", path)], columns=["graph", *STATEMENT])

    def add(batch: DataFrame, _: int) -> None:
        append(batch.sparkSession, store, batch)

    return files.select("path", "content").mapInPandas(run, SCHEMA).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of events by tumbling window and kind; events later than ``late`` are not waited for in a stream."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if events.isStreaming else timed
    return timed.groupBy(F.window("ts", length), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of users: events less than ``gap`` apart."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if events.isStreaming else timed
    return timed.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")

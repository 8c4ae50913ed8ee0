"""Structured Streaming: windowed counts of events, and an index that follows file signatures."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def event_windows(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events and their value per window and type; rows later than ``late`` drop out of a stream.
    The same plan runs in batch."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if stamped.isStreaming:
        stamped = stamped.withWatermark("ts", late)
    return stamped.groupBy(F.window("ts", window).alias("w"), "event_type").agg(
        F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 4).alias("value")
    ).select(F.col("w.start").alias("start"), "event_type", "events", "value")


def follow_signatures(stream: DataFrame, store, parse_cache: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch of signature rows is one run of an ``IncrementalStore``: its changed files
    are appended to ``sink``. Commits are known by the stream's id, which ``checkpoint`` keeps, and
    the batch number. A batch replayed after a failure finds its commit, processes nothing again
    and writes the committed files once more over what it may have written."""

    def step(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        spark = batch.sparkSession
        name = json.loads(spark.read.text(f"{checkpoint}/metadata").first()["value"])["id"]
        changed = store.run(batch, parse_cache, None, batch=(name, number))
        changed.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{sink}/stream={name}/batch={number}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""The last state of each key, kept up to date by a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def status_updates(events: DataFrame, key: str, status: str, ts: str, tie: str, delay: str = "1 hour") -> DataFrame:
    """Update-mode rows ``(key, status, ts, tie)`` of the keys whose last state a batch changes.

    The last event is the one with the greatest ``(ts, tie)``, whenever it comes: a late event changes nothing, unless it is the last after all, and an event that comes again is the same
    maximum. Groups are not by time, so the watermark drops no row and ends no state; ``seen`` counts the key's events.
    """
    stream = events.where(F.col(key).isNotNull()).withWatermark(ts, delay) if events.isStreaming else events.where(F.col(key).isNotNull())
    last = F.max(F.struct(F.col(ts).alias("ts"), F.col(tie).alias("tie"), F.col(status).alias("status")))
    return stream.groupBy(F.col(key).alias("key")).agg(last.alias("l"), F.count("*").alias("seen")).select("key", "l.status", "l.ts", "l.tie", "seen")


def run_feed(spark: SparkSession, source: str, schema: str, path: str, checkpoint: str, key: str, status: str, ts: str, tie: str, delay: str = "1 hour") -> None:
    """Take in what is new in ``source`` since the last call and write the changed keys, a folder for each batch, so that a batch that is tried again writes nothing twice."""

    def one(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream = status_updates(spark.readStream.schema(schema).parquet(source), key, status, ts, tie, delay)
    stream.writeStream.foreachBatch(one).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def last_states(spark: SparkSession, path: str) -> DataFrame:
    """``(key, status, ts, seen)`` from the updates written so far: the last batch of a key has all of it."""
    return spark.read.parquet(path).groupBy("key").agg(F.max_by(F.struct("status", "ts", "seen"), "batch").alias("l")).select("key", "l.*")

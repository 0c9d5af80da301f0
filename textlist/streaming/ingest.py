"""Incremental ingest of page records: whole files in, entries and a status log out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINE_SCHEMA = "file_id string, restaurant_id string, page int, line_no int, text string"
#: Folders that states are kept in, by file, so that a batch reads only those its files may be in.
BUCKETS = 256


def ingest(spark: SparkSession, source: str, entries_path: str, status_path: str, checkpoint: str, parse: Callable[[DataFrame], DataFrame]) -> None:
    """Run ``parse`` over the files that are new in ``source`` since the last call, and write entries and states.

    A file's lines must arrive in one input file, since headings and entries need the whole of it. A batch that is tried again
    overwrites its own folder, and files seen in earlier batches are left out, so nothing is written twice. A file with a line that
    has no page or number is left out whole, with the state ``error``.
    """
    bucket = F.pmod(F.xxhash64("file_id"), F.lit(BUCKETS)).cast("int")

    def one(batch: DataFrame, number: int) -> None:
        known, rows = read(spark, status_path), batch
        if known is not None:
            own = [r["b"] for r in batch.select(bucket.alias("b")).distinct().collect()]  # no more than there are buckets
            known = known.where(F.col("bucket").isin(own) & (F.col("batch") < number))
            rows = rows.join(known.select("file_id").distinct(), "file_id", "left_anti")
        bad = rows.groupBy("file_id").agg(F.max(F.col("line_no").isNull() | F.col("page").isNull()).alias("broken"))
        good = rows.join(bad.where("not broken").select("file_id"), "file_id", "left_semi")
        parse(good).write.mode("overwrite").parquet(f"{entries_path}/batch={number}")
        bad.select("file_id", F.when(F.col("broken"), "error").otherwise("parsed").alias("status"), bucket.alias("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(f"{status_path}/batch={number}")

    stream = spark.readStream.schema(LINE_SCHEMA).parquet(source)
    stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read(spark: SparkSession, path: str) -> DataFrame | None:
    """A table of batches, or None before the first."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.parquet(path) if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder) else None


def latest_status(events: DataFrame, key: str, status: str, order: list[str]) -> DataFrame:
    """The last state of each key in an event log."""
    return events.groupBy(key).agg(F.max_by(status, F.struct(*order)).alias("status"))

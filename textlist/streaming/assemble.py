"""Files whose lines come in pieces: kept as tables until they are whole, or out of time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ``total`` is the number of lines of the whole file; it may stand in some of its lines only. ``at`` is when a line was sent.
PIECE_SCHEMA = "file_id string, restaurant_id string, page int, line_no int, text string, total int, at timestamp"
#: The first line of each place of a file, with the batch it came in and its place there.
HELD_SCHEMA = "file_id string, page int, line_no int, first struct<drop:long,came:long,restaurant_id:string,text:string>"
#: When a file's first lines were sent, the number of lines said last, and the state of files that are settled.
FILE_SCHEMA = "file_id string, since timestamp, total int, state string"


def settled(held: DataFrame, files: DataFrame, latest: int | None, wait_ms: int) -> DataFrame:
    """``FILE_SCHEMA`` of ``files(file_id, since, total, broken)`` after a batch: whole by the number of places ``held``, else out of time, else open. ``latest`` is in microseconds."""
    places = held.groupBy("file_id").agg(F.count("*").alias("places"))
    late = F.lit(False) if latest is None else F.unix_micros("since") <= latest - 2000 * wait_ms
    state = F.when(F.col("broken"), "error").when(F.coalesce("places", F.lit(0)) >= F.col("total"), "parsed").when(late, "error")
    return files.join(places, "file_id", "left").select("file_id", "since", "total", state.alias("state"))


def ingest_pieces(spark: SparkSession, source: str, entries_path: str, status_path: str, checkpoint: str, parse: Callable[[DataFrame], DataFrame], wait_ms: int = 3_600_000) -> None:
    """Run ``parse`` over the files that became whole since the last call, and write entries and states, a folder for each batch.

    Open files are two tables under the checkpoint, their lines and what is known of them, written anew by each batch from those of the batch before, so files go on growing after a
    restart, wherever it runs; a batch that is tried again overwrites its own folders. All files of a batch are worked on together, whatever their number.

    Of lines of the same place the first counts. A line without a page or number settles the file as ``error``, and so do lines, of any file, sent twice ``wait_ms`` after its
    first one, where it is not whole by then; what comes for a settled file is dropped. Lines without a file are dropped, and so are those sent ``wait_ms`` or more before
    the latest one of the batches before; a line without a time counts as sent when it is read.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(checkpoint).getFileSystem(spark._jsc.hadoopConfiguration())
    at_batch = lambda what, n: f"{checkpoint}/pieces/{what}/batch={n}"
    read = lambda what, schema, n: spark.read.schema(schema).parquet(at_batch(what, n)) if n >= 0 else spark.createDataFrame([], schema)

    def one(batch: DataFrame, number: int) -> None:
        new = batch.where("file_id is not null").withColumns({"at": F.coalesce("at", F.current_timestamp()), "came": F.monotonically_increasing_id(), "drop": F.lit(number).cast("long")})
        latest = read("latest", "at long", number - 1).agg(F.max("at")).head()[0]
        if latest is not None:
            new = new.where(F.unix_micros("at") > latest - 1000 * wait_ms)
        if number:
            done = spark.read.schema("file_id string, batch long").option("basePath", status_path).parquet(status_path).where(F.col("batch") < number)
            new = new.join(done.select("file_id").distinct(), "file_id", "left_anti")
        new.write.mode("overwrite").parquet(at_batch("new", number))  # read several times below
        new = read("new", f"{PIECE_SCHEMA}, came long, drop long", number)
        newest = new.agg(F.max(F.unix_micros("at"))).head()[0]
        latest = max((t for t in (latest, newest) if t is not None), default=None)
        spark.createDataFrame([(latest,)], "at long").write.mode("overwrite").parquet(at_batch("latest", number))

        before = read("files", FILE_SCHEMA, number - 1).where("state is null")
        lines = new.where("page is not null and line_no is not null").select("file_id", "page", "line_no", F.struct("drop", "came", "restaurant_id", "text").alias("first"))
        lines = read("held", HELD_SCHEMA, number - 1).join(before.select("file_id"), "file_id", "left_semi").unionByName(lines)
        lines.repartition("file_id").groupBy("file_id", "page", "line_no").agg(F.min("first").alias("first")).write.mode("overwrite").parquet(at_batch("held", number))
        held = read("held", HELD_SCHEMA, number)

        known = before.select("file_id", F.lit(-1).cast("long").alias("drop"), F.col("since").alias("at"), F.lit(0).cast("long").alias("came"), "total", F.lit(False).alias("broken"))
        known = known.unionByName(new.select("file_id", "drop", "at", "came", "total", (F.col("page").isNull() | F.col("line_no").isNull()).alias("broken")))
        said = F.max(F.when(F.col("total").isNotNull(), F.struct("drop", "came", "total")))["total"]
        files = known.groupBy("file_id").agg(F.min(F.struct("drop", "at"))["at"].alias("since"), said.alias("total"), F.max("broken").alias("broken"))
        settled(held, files, latest, wait_ms).write.mode("overwrite").parquet(at_batch("files", number))
        files = read("files", FILE_SCHEMA, number)

        whole = held.join(files.where("state = 'parsed'").select("file_id"), "file_id", "left_semi")
        parse(whole.select("file_id", "first.restaurant_id", "page", "line_no", "first.text")).write.mode("overwrite").parquet(f"{entries_path}/batch={number}")
        files.where("state is not null").select("file_id", F.col("state").alias("status")).write.mode("overwrite").parquet(f"{status_path}/batch={number}")
        for what in ("new", "held", "files", "latest"):  # a batch that is tried again needs no more than the one before it
            folder.delete(spark._jvm.org.apache.hadoop.fs.Path(at_batch(what, number - (1 if what == "new" else 2))), True)

    stream = spark.readStream.schema(PIECE_SCHEMA).parquet(source)
    stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

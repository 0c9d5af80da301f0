"""Files cut into chunks of whole pages, for work in document order that is combined chunk by chunk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chunked(lines: DataFrame, size: int) -> DataFrame:
    """``lines`` plus ``_chunk``: numbers that rise with the pages of a file. A chunk has ``size`` lines or a page more.

    Only counts of pages pass a window over the file.
    """
    before = F.sum("_n").over(Window.partitionBy("_file").orderBy("_page").rowsBetween(Window.unboundedPreceding, -1))
    page = F.coalesce("page", F.lit(-1))
    pages = lines.groupBy(F.col("file_id").alias("_file"), page.alias("_page")).agg(F.count("*").alias("_n"))
    pages = pages.withColumn("_chunk", F.floor(F.coalesce(before, F.lit(0)) / size)).drop("_n")
    return lines.join(pages, F.col("file_id").eqNullSafe(F.col("_file")) & (page == F.col("_page"))).drop("_file", "_page")


def carried(df: DataFrame, totals: dict[str, Column], combine: dict[str, str]) -> DataFrame:
    """``df`` plus, for each name, what the file's chunks before the row's own have in all: ``totals`` is made of each chunk, ``combine`` is ``max`` or ``sum``."""
    whole = df.groupBy("file_id", "_chunk").agg(*[c.alias(n) for n, c in totals.items()])
    before = Window.partitionBy("file_id").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.withColumns({n: getattr(F, combine[n])(n).over(before) for n in totals}).toDF("_f", "_c", *totals)
    return df.join(whole, F.col("file_id").eqNullSafe(F.col("_f")) & (F.col("_chunk") == F.col("_c"))).drop("_f", "_c")

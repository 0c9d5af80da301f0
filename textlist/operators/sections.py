"""Sticky three-level headings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import header_level
from .chunks import carried, chunked


def with_sections(lines: DataFrame, chunk: int | None = None) -> DataFrame:
    """Each line's level, and the headings above it. A heading ends those below its level.

    All windows are over the file, so the data is shuffled and sorted once. With ``chunk`` they are over chunks of about so many lines, and the last
    headings of the chunks before are carried over, so that a file of very many lines is many tasks.
    """
    order = ["page", "line_no"]
    if chunk:
        lines = chunked(lines, chunk)
    so_far = Window.partitionBy("file_id", *(["_chunk"] if chunk else [])).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    at = lambda n: F.last(F.when(F.col("level") == n, F.struct(*order, "text")), ignorenulls=True).over(so_far)
    df = lines.withColumn("level", header_level(F.col("text")))
    df = df.withColumns({f"_h{n}": at(n) for n in (1, 2, 3)})
    if chunk:
        said = {f"_c{n}": F.max(F.when(F.col("level") == n, F.struct(*order, "text"))) for n in (1, 2, 3)}
        df = carried(df, said, dict.fromkeys(said, "max"))
        df = df.withColumns({f"_h{n}": F.coalesce(f"_h{n}", f"_c{n}") for n in (1, 2, 3)}).drop("_chunk", *said)
    place = lambda h: F.struct(f"{h}.page", f"{h}.line_no")
    later = lambda a, b: F.col(b).isNull() | (place(a) > place(b))
    two = F.col("_h2").isNotNull() & later("_h2", "_h1")
    three = F.col("_h3").isNotNull() & later("_h3", "_h1") & later("_h3", "_h2")
    df = df.withColumns({"section": F.col("_h1.text"), "sub_section": F.when(two, F.col("_h2.text")), "sub_sub_section": F.when(three, F.col("_h3.text"))})
    return df.drop("_h1", "_h2", "_h3")

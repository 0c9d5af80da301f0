"""Pages: which to drop, what a contents page says, and cleaned lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.text import any_word, normalize_text, rx

PAGE = ["file_id", "page"]
ENTRY_LINE = rx(r"(.+?)(?:\.+\s*|\s*-\s*|\s*\.\s*)(\d+)$")


def page_text(lines: DataFrame) -> DataFrame:
    """One row for each page: its lower-case text in line order, and what its lines are like."""
    trimmed = F.trim(F.col("text"))
    return lines.groupBy(*PAGE).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", F.lower("text").alias("text")))), lambda x: x["text"]), " ").alias("page_text"),
        F.count("*").alias("n_lines"),
        F.bool_and(trimmed.rlike(rx(r"^\d+$"))).alias("all_numbers"),
        F.bool_and(F.char_length(trimmed) < 10).alias("all_short"),
    )


def non_content_pages(lines: DataFrame) -> DataFrame:
    off = (F.col("n_lines") < 2) | any_word(F.col("page_text"), C.OFF_PAGE_WORDS) | F.col("all_numbers") | F.col("all_short")
    return page_text(lines).where(off).select(*PAGE)


def contents_lines(lines: DataFrame) -> DataFrame:
    """Lines of pages with a contents word that name a section and its page number."""
    own = Window.partitionBy(*PAGE)
    marked = lines.withColumn("_hit", F.max(any_word(F.lower("text"), C.CONTENTS_WORDS)).over(own))
    found = marked.where("_hit").where(F.col("text").rlike(ENTRY_LINE))
    return found.select("file_id", "page", "line_no", F.trim(F.regexp_extract("text", ENTRY_LINE, 1)).alias("section"), F.regexp_extract("text", ENTRY_LINE, 2).cast("int").alias("page_num"))


def contents_pages(lines: DataFrame) -> DataFrame:
    return contents_lines(lines).select(*PAGE).distinct()


def contents_mapping(lines: DataFrame) -> DataFrame:
    """Section to page number; later lines overwrite earlier ones."""
    return contents_lines(lines).groupBy("file_id", "section").agg(F.max_by("page_num", F.struct("page", "line_no")).alias("page_num"))


def preprocess_lines(lines: DataFrame) -> DataFrame:
    """Lines of content pages, normalised, without empty ones; ``contents_page`` is set in files that have a contents page."""
    kept = lines.join(non_content_pages(lines), PAGE, "left_anti").withColumn("text", normalize_text(F.col("text"))).where("text <> ''")
    mapped = contents_pages(lines).select("file_id").distinct().withColumn("_has", F.lit(True))
    return kept.join(mapped, "file_id", "left").withColumn("contents_page", F.when(F.col("_has"), F.col("page"))).drop("_has")

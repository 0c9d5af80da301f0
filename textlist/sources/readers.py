"""Readers: page records to lines, file rows to refinement paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def scan_lines(blocks: DataFrame) -> DataFrame:
    """Blocks with text, trimmed."""
    return blocks.withColumn("text", F.trim("text")).where("text <> ''").withColumn("source", F.lit("text"))


def with_recognition(blocks: DataFrame, ocr: DataFrame) -> DataFrame:
    """Each page's text blocks, or, where it has none, the lines of its recognised text, numbered from 1."""
    said = scan_lines(blocks)
    bare = ocr.join(said.select("file_id", "page").distinct(), ["file_id", "page"], "left_anti")
    read = bare.select("file_id", "page", F.posexplode(F.split("ocr_text", r"\R", -1)).alias("line_no", "text"))
    read = read.select("file_id", "page", (F.col("line_no") + 1).alias("line_no"), F.trim("text").alias("text"), F.lit("ocr").alias("source")).where("text <> ''")
    return said.select("file_id", "page", "line_no", "text", "source").unionByName(read)


def refinement_paths(files: DataFrame) -> DataFrame:
    """Files whose notes name their refinement data."""
    return files.select("id", F.regexp_extract(F.coalesce("notes", F.lit("")), r"refinement_json: ([^;\n]+)", 1).alias("path")).where("path <> ''")


def read_entries(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Entries as ``write_entries`` wrote them; ids stay text."""
    return spark.read.schema(schema).parquet(path)


def read_refinement(files: DataFrame, data: DataFrame) -> DataFrame:
    """The refinement rows of each file whose notes name them by ``path``; files without such rows are left out."""
    return refinement_paths(files).join(data, "path")


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Rows as ``write_csv`` wrote them."""
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("emptyValue", "").csv(path)

"""A training-corpus pipeline of five operators: documents in, a mixing plan out.

Defined results, for each stage: null and empty texts are scored as empty by the classifier, become empty in line dedup, link with
nothing, hold no benchmark item and have size 0; a null doc_id is looked at like any other and is never a near duplicate; of rows that
repeat a doc_id each is judged by its own text until near duplicates go, which leaves one row of an id; ties go to the least doc_id (near duplicates)
or the largest (lines); very long texts are read whole; empty tables give empty results; other columns are handed on, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlist.llm import decontaminate, jaccard_join, line_dedup, mixing, quality
from textlist.llm.common import read_table, save


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines repeated in five documents or more stay in one of them."""
    out = line_dedup.without_repeated_lines(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose five-word shingles link at 0.8 or more, the one with the least id stays."""
    return jaccard_join.one_of_each_group(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean_documents(docs, read_table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document, and when."""
    return mixing.mix_digest(docs)


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: The classifier and the similarity stages have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None

"""Queries of this subpackage and their SQL, for the entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import cap_filters, decontaminate, hard_negatives, html_extract, jaccard_join, lexical_search, license_scan, line_dedup, media, mixing, quality, suffix_dedup, toxicity
from .common import read_table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(read_table(spark, sf_dir, "documents"), width=4, percent=85)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup_digest(read_table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(read_table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(read_table(spark, sf_dir, "documents")).drop("kept")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(read_table(spark, sf_dir, "pages"))


def op8_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digest(read_table(spark, sf_dir, "documents"))


def flac_pcm_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.block_digest(read_table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_digest(read_table(spark, sf_dir, "documents"))


def op11_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cap_filters.near_vectors(read_table(spark, sf_dir, "embeddings"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.ranked_search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(read_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_quality": op3_quality,
    "op4_line_dedup": op4_line_dedup,
    "op5_license_scan": op5_license_scan,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_html_extraction": op7_html_extraction,
    "op8_flac_media": op8_flac_media,
    "flac_pcm_blocks": flac_pcm_blocks,
    "op9_decontamination": op9_decontamination,
    "op10_mixing": op10_mixing,
    "op11_cap_filters": op11_cap_filters,
    "op12_lexical_search": op12_lexical_search,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLES: dict[str, str] = {
    "op4_line_dedup": line_dedup.ORACLE,
    "flac_pcm_blocks": media.BLOCK_ORACLE,
    "op9_decontamination": decontaminate.ORACLE,
    "op10_mixing": mixing.ORACLE,
    "op11_cap_filters": cap_filters.ORACLE,
    "op12_lexical_search": lexical_search.ORACLE,
    "op13_hard_negatives": hard_negatives.ORACLE,
}

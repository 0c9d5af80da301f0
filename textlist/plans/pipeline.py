"""Lines to parsed rows for all files at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..fixtures import table
from ..operators import match, mine, pages, rules, sample, sections, segment
from ..operators.lineage import cut, saved


def entries_of(lines: DataFrame) -> DataFrame:
    return segment.segment_entries(sections.with_sections(pages.preprocess_lines(lines)))


def sampled(parsed: DataFrame) -> DataFrame:
    """Both ends of each file, seven rows at most, with their key fields."""
    picked = sample.both_ends(parsed).where("part = 0 or rank > 5").select("file_id", "entry_id", "rank", "text", "section", "sub_section", "n_lines", F.size("fields").alias("n_fields"), *[F.try_element_at("fields", F.lit(k)).alias(k) for k in C.KEYS])
    return cut(picked)  # the match reads them several times


def with_names(picked: DataFrame, found: DataFrame, catalog: DataFrame) -> DataFrame:
    """The sample with the score and the names of its matches."""
    named = found.join(catalog.select("catalog_row", "producer_name", "wine"), "catalog_row")
    return picked.join(named.select("entry_id", "score", "producer_name", "wine"), "entry_id", "left")


def sample_with_matches(parsed: DataFrame, catalog: DataFrame) -> DataFrame:
    """Both ends of each file with their direct or composite match."""
    picked, rows = sampled(parsed), match.normalize_catalog(catalog)
    return with_names(picked, match.item_matches(match.normalize_items(picked), rows), rows)


def refinement(entries: DataFrame, stored_rules: DataFrame, catalog: DataFrame, suggested: DataFrame) -> dict[str, DataFrame]:
    """All that a parse leaves for its refinement, by stage.

    Owners with rules are parsed with them (``rules_exist``). The others' files are parsed without rules (``initial_parse``), a sample of each is enriched from its match of 85
    or more or else from ``suggested(raw_text, suggested)`` (``enriched_sample``), rules are mined of the sample as it was, and the file is parsed again with them
    (``multi_stage``). ``restaurant_rules`` has the stored and the mined rules, ``final_parse`` all files, ``needs_review`` its rows of low confidence.
    """
    entries, stored_rules = cut(entries), cut(stored_rules)
    owners = stored_rules.select("restaurant_id").distinct()
    known = rules.extract_fields(entries.join(owners, "restaurant_id", "left_semi"), stored_rules).withColumn("stage", F.lit("rules_exist"))
    rest = entries.join(owners, "restaurant_id", "left_anti")
    first = saved(rules.extract_fields(rest), "initial")
    picked, rows = sampled(first), match.normalize_catalog(catalog)
    found = saved(match.item_matches(match.normalize_items(picked), rows), "matches")
    mined = saved(mine.mine_rules(with_names(picked, found, rows)), "mined")
    said = picked.select("entry_id", F.col("text").alias("raw_text")).join(suggested, "raw_text").select("entry_id", "suggested")
    enriched = match.enrich_choice(picked.select("entry_id", "file_id", *C.KEYS), found, said, rows)
    again = rules.extract_fields(rest, mined, "file_id").withColumn("stage", F.lit("multi_stage"))
    final = saved(known.unionByName(again), "final")
    given = ["pattern", "confidence", "fields", "provenance", "rule_pos"]
    both = stored_rules.select("restaurant_id", *given).unionByName(mined.select("file_id", *given), allowMissingColumns=True)
    return {"initial_parse": first, "enriched_sample": enriched, "restaurant_rules": both, "final_parse": final, "needs_review": final.where("needs_review"), "stage": final.select("file_id", F.col("stage").alias("state")).distinct()}


def refinement_rows(parts: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The parts with what a reviewer reads of them, flat."""
    parse = lambda df: df.select("file_id", "entry_id", F.to_json("fields").alias("fields"), F.round("row_confidence", 6).alias("row_confidence"))
    enriched = parts["enriched_sample"].select("file_id", "entry_id", "choice", "lwin", F.round("match_confidence", 6).alias("match_confidence"), F.to_json(F.struct(*sorted(C.KEYS))).alias("fields"))
    rules_of = parts["restaurant_rules"].select("restaurant_id", "file_id", "rule_pos", "pattern", "confidence", "provenance")
    return {n: parse(parts[n]) for n in ("initial_parse", "final_parse", "needs_review")} | {"enriched_sample": enriched, "restaurant_rules": rules_of, "stage": parts["stage"]}


def parse_lists(entries: DataFrame, stored_rules: DataFrame, catalog: DataFrame, suggested: DataFrame | None = None) -> DataFrame:
    """Owners with rules are parsed with them; the others' files with rules mined from their own sample. ``stage`` says which."""
    if suggested is None:
        suggested = entries.sparkSession.createDataFrame([], "raw_text string, suggested map<string,string>")
    return refinement(entries, stored_rules, catalog, suggested)["final_parse"]


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lines")

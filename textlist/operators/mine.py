"""Rules mined from a file's sample and its catalogue matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.text import rx

#: Patterns that a mined ruleset always excludes. Fixed values.
EXCLUDED = [r"by\s+the\s+glass", r"wine\s+pairing", "flight", r"tasting\s+menu"]


def literal(text: Column) -> Column:
    """A pattern that matches ``text`` itself."""
    return F.regexp_replace(text, r"([^\p{L}\p{N}_])", r"\\$1")


def mine_rules(sample: DataFrame) -> DataFrame:
    """``sample(file_id, rank, text, producer_name, wine, score, n_fields)`` to ``(file_id, rule_pos, pattern, confidence, fields, provenance)``.

    A match of 85 or more gives an exact and a gap-tolerant pattern; any sample with fields gives its price and vintage. Later samples' rules come later.
    """
    pair = (F.col("score") >= C.FUZZY) & (F.col("producer_name") != "") & (F.col("wine") != "")
    price, vintage = F.regexp_extract("text", rx(f"({C.PRICE})"), 1), F.regexp_extract("text", rx(rf"({C.VINTAGE}|N\.V\.)"), 1)
    group = lambda name, value: F.concat(F.lit(f"(?P<{name}>"), literal(value), F.lit(")"))
    rule = lambda pattern, confidence, fields, origin: F.struct(pattern.alias("pattern"), F.lit(confidence).alias("confidence"), F.array(*map(F.lit, fields)).alias("fields"), F.lit(origin).alias("provenance"))
    both = ["producer", "cuvee"]
    made = F.array(
        F.when(pair, rule(F.concat(group("producer", F.col("producer_name")), F.lit(r"\s+"), group("cuvee", F.col("wine"))), 0.95, both, "lwin_match")),
        F.when(pair, rule(F.concat(group("producer", F.col("producer_name")), F.lit(r"(?:\s+[A-Za-z]+)*\s+"), group("cuvee", F.col("wine"))), 0.85, both, "lwin_fuzzy")),
        F.when(price != "", rule(group("price", price), 0.9, ["price"], "pattern_match")),
        F.when(vintage != "", rule(group("vintage", vintage), 0.9, ["vintage"], "pattern_match")),
    )
    rows = sample.where("n_fields > 0").select("file_id", "rank", F.posexplode(made).alias("kind", "r")).where("r is not null")
    return rows.select("file_id", (F.col("rank") * 4 + F.col("kind")).alias("rule_pos"), "r.pattern", "r.confidence", "r.fields", "r.provenance")


def mine_exclusions(sample: DataFrame) -> DataFrame:
    """``(file_id, pattern, confidence)``: what every mined ruleset excludes, for each file of the sample."""
    made = F.array(*[F.struct(F.lit(p).alias("pattern"), F.lit(0.9).alias("confidence")) for p in EXCLUDED])
    return sample.select("file_id").distinct().select("file_id", F.explode(made).alias("e")).select("file_id", "e.*")


def mine_aliases(sample: DataFrame) -> DataFrame:
    """``(file_id, field, alias, name)``: lower-case names of good matches."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.lower(c).alias("alias"), F.col(c).alias("name")) for f, c in (("producer", "producer_name"), ("cuvee", "wine"))])
    rows = sample.where(F.col("score") >= C.FUZZY).select("file_id", "rank", F.explode(pairs).alias("p")).where("p.name <> ''")
    return rows.groupBy("file_id", "p.field", "p.alias").agg(F.max_by("p.name", "rank").alias("name"))


def mine_headers(sample: DataFrame) -> DataFrame:
    """``(file_id, level, pattern, confidence)``: headings over the sample, and whole texts of entries of several lines as merging examples."""
    made = F.array(
        F.when(F.col("section").isNotNull(), F.struct(F.lit("main").alias("level"), F.col("section").alias("pattern"), F.lit(0.9).alias("confidence"))),
        F.when(F.col("sub_section").isNotNull(), F.struct(F.lit("sub").alias("level"), F.col("sub_section").alias("pattern"), F.lit(0.9).alias("confidence"))),
        F.when(F.col("n_lines") > 1, F.struct(F.lit("merge").alias("level"), F.col("text").alias("pattern"), F.lit(0.8).alias("confidence"))),
    )
    rows = sample.select("file_id", F.explode(made).alias("m")).where("m is not null")
    return rows.groupBy("file_id", "m.level", "m.pattern").agg(F.max("m.confidence").alias("confidence"), F.count("*").alias("n"))

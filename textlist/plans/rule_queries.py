"""Queries over fields, rules and parsed lists, with SQL for another engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..fixtures import table, with_views
from ..functions import confidence as K
from ..functions.text import json_number
from ..operators import match, mine, rules, sample
from ..operators.lineage import new_folder, saved
from ..sources import sinks
from . import pipeline
from .book import Book
from .line_queries import TO_ENTRIES, entries, q, sql_normalize

book = Book()

# ---- SQL pieces -----------------------------------------------------------------------------------------------------


def re2(pattern: str) -> str:
    """The look-ahead becomes part of the match; the group is the same."""
    return pattern.replace("(?=", "(?:")


def sql_valid(f: str, v: str) -> str:
    checks = {
        "vintage": f"regexp_matches({v}, {q(r'^(19|20)[0-9]{2}$|^NV$|^N[.]V[.]$')})",
        "price": f"regexp_matches({v}, {q(C.PRICE_VALUE)})",
        "bottle_size": f"regexp_matches({v}, {q(r'^[0-9]+(?:[.][0-9]+)?(?:ml|cl|L)$|^magnum$|^jeroboam$|^half$')})",
        "country": f"length({v}) BETWEEN 2 AND 50",
        "region": f"length({v}) BETWEEN 2 AND 100",
        "producer": f"length({v}) BETWEEN 2 AND 100 AND NOT regexp_matches(lower({v}), {q('|'.join(C.RANK_WORDS))})",
        "cuvee": f"length({v}) BETWEEN 1 AND 100",
    }
    return checks.get(f, "TRUE")


def sql_confidence(f: str, v: str, origin: str, base: float) -> str:
    factor, weight = C.ORIGIN_FACTORS.get(origin, C.OTHER_ORIGIN), C.FIELD_WEIGHTS.get(f, 0.5)
    special = f" * CASE WHEN upper({v}) IN ('NV', 'N.V.') THEN 0.9::DOUBLE ELSE 1 END" if f == "vintage" else f" * CASE WHEN upper({v}) = 'POA' THEN 0.8::DOUBLE ELSE 1 END" if f == "price" else ""
    return f"least(1.0::DOUBLE, {base}::DOUBLE * {factor}::DOUBLE * CASE WHEN {sql_valid(f, v)} THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END{special} * {weight}::DOUBLE)"


def sql_steps(source: str, text: str, start: str, inherit: bool) -> str:
    """CTEs that apply one pattern after the other to ``source``, from the states of CTE ``start`` or from none."""
    fields = list(C.FIELD_WEIGHTS)
    if not start:
        none = ", ".join(f"CAST(NULL AS VARCHAR) AS v_{f}, CAST(NULL AS DOUBLE) AS c_{f}, CAST(NULL AS VARCHAR) AS o_{f}" for f in fields)
        out = [f"x0 AS (SELECT *, {sql_normalize(text)} AS clean, {none} FROM {source})"]
    else:
        out = [start]
    steps = []
    for pattern, base, names in C.ENTRY_RULES:
        got = {}
        for j, f in enumerate(names):
            got.setdefault(f, []).append(f"nullif(regexp_extract(clean, {q(pattern)}, {j + 1}), '')")
        steps.append((base, "global_rule", {f: f"coalesce({', '.join(v)})" for f, v in got.items()}))
    for f, pattern, base in C.FIELD_RULES:
        steps.append((base, "field_pattern_match", {f: f"nullif(regexp_extract(clean, {q(re2(pattern))}, 1), '')"}))
    if inherit:
        for column, (origin, names) in rules.INHERITED.items():
            if column == "sub_section":
                steps.append((0.7, origin, {f: f"nullif({column}, '')" for f in names}))
    for i, (base, origin, got) in enumerate(steps):
        new = []
        for f, v in got.items():
            take = f"({v} IS NOT NULL AND (v_{f} IS NULL OR c_{f} < {base}::DOUBLE))"
            score = "0.7::DOUBLE" if origin.endswith("inherit") else sql_confidence(f, v, origin, base)
            new.append(f"CASE WHEN {take} THEN {v} ELSE v_{f} END AS v_{f}, CASE WHEN {take} THEN {score} ELSE c_{f} END AS c_{f}, CASE WHEN {take} THEN {q(origin)} ELSE o_{f} END AS o_{f}")
        out.append(f"x{i + 1} AS (SELECT * REPLACE ({', '.join(new)}) FROM x{i})")
    top = " + ".join(f"CASE WHEN c_{f} IS NULL THEN 0 ELSE c_{f} * {w}::DOUBLE END" for f, w in C.FIELD_WEIGHTS.items())
    low = " + ".join(f"CASE WHEN c_{f} IS NULL THEN 0 ELSE {w}::DOUBLE END" for f, w in C.FIELD_WEIGHTS.items())
    out.append(f"xr AS (SELECT *, CASE WHEN ({low}) = 0 THEN 0 ELSE ({top}) / ({low}) END AS row_confidence FROM x{len(steps)})")
    return ", ".join(out)


def sql_owner(source: str, text: str) -> str:
    """The start of the steps with the rules of the fixture."""
    r0 = "(19[0-9]{2}|20[0-9]{2}) +([0-9]{2,4})"
    own = "CAST(restaurant_id AS INT) % 3 = 0"
    v = {
        "vintage": (f"nullif(regexp_extract(clean, '{r0}', 1), '')", "restaurant_rule", 0.9),
        "producer": ("nullif(regexp_extract(clean, '(Domaine [A-Z][a-z]+)', 1), '')", "lwin_match", 0.95),
    }
    cols = []
    for f in C.FIELD_WEIGHTS:
        if f in v:
            x, origin, base = v[f]
            cols.append(f"CASE WHEN {own} THEN {x} END AS v_{f}, CASE WHEN {own} AND {x} IS NOT NULL THEN {sql_confidence(f, x, origin, base)} END AS c_{f}, CASE WHEN {own} AND {x} IS NOT NULL THEN {q(origin)} END AS o_{f}")
        elif f == "price":
            a, b = "nullif(regexp_extract(clean, '([0-9]+) *€', 1), '')", f"nullif(regexp_extract(clean, '{r0}', 2), '')"
            cols.append(f"CASE WHEN {own} THEN coalesce({a}, {b}) END AS v_price, CASE WHEN NOT {own} THEN NULL WHEN {a} IS NOT NULL THEN {sql_confidence('price', a, 'restaurant_rule', 0.8)} WHEN {b} IS NOT NULL THEN {sql_confidence('price', b, 'restaurant_rule', 0.9)} END AS c_price, CASE WHEN {own} AND coalesce({a}, {b}) IS NOT NULL THEN 'restaurant_rule' END AS o_price")
        else:
            cols.append(f"CAST(NULL AS VARCHAR) AS v_{f}, CAST(NULL AS DOUBLE) AS c_{f}, CAST(NULL AS VARCHAR) AS o_{f}")
    return f"xn AS (SELECT *, {sql_normalize(text)} AS clean FROM {source}), x0 AS (SELECT *, {', '.join(cols)} FROM xn)"


VALUES = ", ".join(f"v_{f} AS {f}, round(c_{f}, 6) AS {f}_confidence, o_{f} AS {f}_origin" for f in C.FIELD_WEIGHTS)
LINE_SOURCE = "(SELECT concat_ws('-', file_id, CAST(line_no AS VARCHAR)) AS entry_id, file_id, restaurant_id, page, line_no, text AS raw_text FROM lines)"
TO_LINES = f"{with_views('lines')}, {sql_steps(LINE_SOURCE, 'raw_text', '', False)}"
TO_FIELDS = f"{TO_ENTRIES}, {sql_steps('en', 'raw_text', '', True)}"
TO_OWNED = f"{TO_ENTRIES}, {sql_steps('', '', sql_owner('en', 'raw_text'), True)}"


def flat(df: DataFrame, fields: list[str] | None = None) -> DataFrame:
    cols = []
    for f in fields or C.FIELD_WEIGHTS:
        key = F.lit(f)
        cols += [F.try_element_at("fields", key).alias(f), F.round(F.try_element_at("field_confidence", key), 6).alias(f"{f}_confidence"), F.try_element_at("provenance", key).alias(f"{f}_origin")]
    return df.select("entry_id", *cols, F.round("row_confidence", 6).alias("row_confidence"), "needs_review")


FLAT = f"SELECT entry_id, {VALUES}, round(row_confidence, 6) AS row_confidence, row_confidence < {C.REVIEW_BELOW} AS needs_review FROM xr"


def line_entries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lines").select(F.concat_ws("-", "file_id", "line_no").alias("entry_id"), "file_id", "restaurant_id", "page", "line_no", F.col("text").alias("raw_text"))


def stored_rules(spark: SparkSession, d: str) -> DataFrame:
    return rules.explode_rulesets(table(spark, d, "rulesets"))


def parsed(spark: SparkSession, d: str) -> DataFrame:
    return rules.extract_fields(entries(spark, d))


# ---- queries --------------------------------------------------------------------------------------------------------

VALUE_ROWS = "vals AS (SELECT unnest(['vintage','price','bottle_size','country','region','producer','cuvee','type']) AS field, v, line_no, file_id FROM (SELECT file_id, line_no, text AS v FROM lines UNION ALL SELECT file_id, -line_no, nullif(regexp_extract(text, '(NV|N[.]V[.]|POA|[0-9]+|Magnum)', 1), '') FROM lines UNION ALL SELECT file_id, -1000000 - line_no, concat('1er ', left(text, 6)) FROM lines) t)"


def value_rows(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lines")
    both = lines.select("file_id", "line_no", F.col("text").alias("v")).unionByName(lines.select("file_id", (-F.col("line_no")).alias("line_no"), F.nullif(F.regexp_extract("text", "(NV|N[.]V[.]|POA|[0-9]+|Magnum)", 1), F.lit("")).alias("v")))
    both = both.unionByName(lines.select("file_id", (-1000000 - F.col("line_no")).alias("line_no"), F.concat(F.lit("1er "), F.substring("text", 1, 6)).alias("v")))
    fields = F.array(*map(F.lit, ["vintage", "price", "bottle_size", "country", "region", "producer", "cuvee", "type"]))
    return both.select("file_id", "line_no", "v", F.explode(fields).alias("field"))


VALID_CASE = "CASE WHEN v IS NULL OR v = '' THEN FALSE " + " ".join(f"WHEN field = '{f}' THEN {sql_valid(f, 'v')}" for f in ("vintage", "price", "bottle_size", "country", "region", "producer", "cuvee")) + " ELSE TRUE END"


@book.add("validate_field", f"{with_views('lines')}, {VALUE_ROWS}, y AS (SELECT *, {VALID_CASE} AS valid FROM vals) SELECT file_id, line_no, field, valid, CASE WHEN v IS NULL THEN 0.0 WHEN field = 'type' THEN 0.7 WHEN valid THEN 0.9 ELSE 0.3 END::DOUBLE AS confidence FROM y")
def validate_field(spark: SparkSession, d: str) -> DataFrame:
    return value_rows(spark, d).select("file_id", "line_no", "field", K.checked(F.col("field"), F.col("v")).alias("c")).select("file_id", "line_no", "field", "c.*")


CONF_CASE = " ".join(f"WHEN field = '{f}' THEN {sql_confidence(f, 'v', 'global_rule', 0.95)}" for f in ("vintage", "price", "bottle_size", "country", "region", "producer", "cuvee", "type"))


@book.add("field_confidence", f"{with_views('lines')}, {VALUE_ROWS} SELECT file_id, line_no, field, round(CASE {CONF_CASE} END, 6) AS confidence FROM vals WHERE v IS NOT NULL")
def field_confidence(spark: SparkSession, d: str) -> DataFrame:
    score = K.field_confidence(F.col("field"), F.col("v"), F.lit("global_rule"), F.lit(0.95))
    return value_rows(spark, d).where("v is not null").select("file_id", "line_no", "field", F.round(score, 6).alias("confidence"))


@book.add("field_rules", f"{TO_LINES} {FLAT}")
def field_rules(spark: SparkSession, d: str) -> DataFrame:
    return flat(rules.extract_fields(line_entries(spark, d)))


@book.add("global_rules", f"{TO_LINES} SELECT entry_id, v_producer AS producer, v_cuvee AS cuvee, v_region AS region, v_grape_variety AS grape_variety FROM xr WHERE o_producer = 'global_rule' OR o_cuvee = 'global_rule' OR o_region = 'global_rule'")
def global_rules(spark: SparkSession, d: str) -> DataFrame:
    df = rules.extract_fields(line_entries(spark, d))
    hit = F.exists(F.array(*map(F.lit, ("producer", "cuvee", "region"))), lambda f: F.try_element_at("provenance", f) == "global_rule")
    return df.where(hit).select("entry_id", *[F.try_element_at("fields", F.lit(f)).alias(f) for f in ("producer", "cuvee", "region", "grape_variety")])


@book.add("row_confidence", f"{TO_LINES} SELECT entry_id, round(row_confidence, 6) AS row_confidence FROM xr")
def row_confidence(spark: SparkSession, d: str) -> DataFrame:
    return rules.extract_fields(line_entries(spark, d)).select("entry_id", F.round("row_confidence", 6).alias("row_confidence"))


@book.add("extract_fields", f"{TO_FIELDS} {FLAT}")
def extract_fields(spark: SparkSession, d: str) -> DataFrame:
    return flat(parsed(spark, d))


@book.add("inherit_context", f"{TO_FIELDS} SELECT entry_id, v_subregion AS subregion, v_grape_variety AS grape_variety, o_grape_variety AS origin FROM xr WHERE o_subregion = 'subsection_inherit' OR o_grape_variety = 'subsection_inherit'")
def inherit_context(spark: SparkSession, d: str) -> DataFrame:
    at = lambda c, f: F.try_element_at(c, F.lit(f))
    df = parsed(spark, d).where((at("provenance", "subregion") == "subsection_inherit") | (at("provenance", "grape_variety") == "subsection_inherit"))
    return df.select("entry_id", at("fields", "subregion").alias("subregion"), at("fields", "grape_variety").alias("grape_variety"), at("provenance", "grape_variety").alias("origin"))


@book.add("needs_review", f"{TO_FIELDS} SELECT file_id, entry_id, raw_text, round(row_confidence, 6) AS row_confidence FROM xr WHERE row_confidence < {C.REVIEW_BELOW}")
def needs_review(spark: SparkSession, d: str) -> DataFrame:
    return parsed(spark, d).where("needs_review").select("file_id", "entry_id", "raw_text", F.round("row_confidence", 6).alias("row_confidence"))


@book.add("result_shape", f"{TO_FIELDS} SELECT entry_id, v_producer AS producer, v_vintage AS vintage, section AS section_header, sub_section AS subheader, sub_sub_section AS sub_subheader, raw_text FROM xr")
def result_shape(spark: SparkSession, d: str) -> DataFrame:
    return rules.result_rows(parsed(spark, d)).select("entry_id", "producer", "vintage", "section_header", "subheader", "sub_subheader", "raw_text")


@book.add("ruleset_explode", f"""{with_views("rulesets")}, e AS (SELECT restaurant_id, unnest(range(4)) AS rule_pos, rules_json FROM rulesets)
SELECT restaurant_id, CAST(rule_pos AS INT) AS rule_pos, json_extract_string(rules_json, '$.extraction_rules[' || rule_pos || '].pattern') AS pattern,
CAST(json_extract_string(rules_json, '$.extraction_rules[' || rule_pos || '].confidence') AS DOUBLE) AS confidence, json_extract_string(rules_json, '$.extraction_rules[' || rule_pos || '].provenance') AS provenance FROM e""")
def ruleset_explode(spark: SparkSession, d: str) -> DataFrame:
    return stored_rules(spark, d).drop("fields")


@book.add("quarantine_rules", f"{with_views('rulesets')} SELECT restaurant_id, 3 AS rule_pos, '(?P<cuvee>[' AS pattern FROM rulesets")
def quarantine_rules(spark: SparkSession, d: str) -> DataFrame:
    return rules.check_rules(stored_rules(spark, d)).where("not valid").select("restaurant_id", "rule_pos", "pattern")


@book.add("restaurant_rules", f"{TO_OWNED} {FLAT}")
def restaurant_rules(spark: SparkSession, d: str) -> DataFrame:
    return flat(rules.extract_fields(entries(spark, d), stored_rules(spark, d)))


APPLIED = [("vintage", r"(?P<vintage>19\d{2}|20\d{2})", None), ("price", r"\d+\s*€", 0.6), ("price", r"(?P<price>\d+)\.50", 0.9), ("grape", "pinot noir|Pinot Noir", None)]
#: Patterns that two dialects read differently, and two that only one of them takes, which are put aside.
APPLIED += [("estate", r"(?P<estate>[D&&E]omaine)(?#estate) [A-Z]", 0.7), ("pairing", r"(?P<lead>[[W]ine )?(?(lead)pairing|Riserva)", 0.7), ("grape", "(?P<grape>", 0.9), ("price", "(?P<price>[0-9]{1,4000000000})", 0.9)]


@book.add(
    "apply_rules",
    with_views("lines")
    + r""", r AS (SELECT file_id, line_no, text, regexp_extract(text, '(19\d{2}|20\d{2})', 1) AS a, trim(regexp_extract(text, '\d+\s*€', 0)) AS b, regexp_extract(text, '(\d+)\.50', 1) AS c, regexp_extract(text, 'pinot noir|Pinot Noir', 0) AS g, regexp_extract(text, '([D&E]omaine) [A-Z]', 1) AS e, regexp_extract(text, '[W[]ine pairing|Riserva', 0) AS p FROM lines)
SELECT concat(file_id, '-', line_no) AS text_id, 'vintage' AS field, a AS value, 0.8::DOUBLE AS confidence FROM r WHERE a <> ''
UNION ALL SELECT concat(file_id, '-', line_no), 'price', CASE WHEN c <> '' THEN c ELSE b END, CASE WHEN c <> '' THEN 0.9 ELSE 0.6 END FROM r WHERE b <> '' OR c <> ''
UNION ALL SELECT concat(file_id, '-', line_no), 'grape', g, 0.8 FROM r WHERE g <> ''
UNION ALL SELECT concat(file_id, '-', line_no), 'estate', e, 0.7 FROM r WHERE e <> ''
UNION ALL SELECT concat(file_id, '-', line_no), 'pairing', p, 0.7 FROM r WHERE p <> ''""",
)
def apply_rules(spark: SparkSession, d: str) -> DataFrame:
    given = spark.createDataFrame([("all", i, *r) for i, r in enumerate(APPLIED)], "owner string, rule_pos int, field string, pattern string, confidence double")
    texts = table(spark, d, "lines").select(F.lit("all").alias("owner"), F.concat_ws("-", "file_id", "line_no").alias("text_id"), "text")
    return rules.last_value(given, texts)


@book.add("parse_summary", f"{TO_FIELDS} SELECT file_id, count(*) AS entries, count(*) FILTER (WHERE row_confidence < {C.REVIEW_BELOW}) AS review FROM xr GROUP BY file_id")
def parse_summary(spark: SparkSession, d: str) -> DataFrame:
    return parsed(spark, d).groupBy("file_id").agg(F.count("*").alias("entries"), F.count_if("needs_review").alias("review"))


@book.add("low_confidence_topk", f"{TO_FIELDS}, k AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY CAST(floor(row_confidence * 1000000 + 0.5) AS BIGINT), page, line_no) AS rank FROM xr) SELECT file_id, entry_id, CAST(rank AS INT) AS rank FROM k WHERE rank <= 10")
def low_confidence_topk(spark: SparkSession, d: str) -> DataFrame:
    return sample.lowest(parsed(spark, d).withColumn("row_confidence", F.floor(F.col("row_confidence") * 1000000 + 0.5)), 10, "file_id").select("file_id", "entry_id", "rank")


@book.add(
    "enrichment_sample",
    f"""{TO_FIELDS}, k AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY CAST(floor(row_confidence * 1000000 + 0.5) AS BIGINT), page, line_no) AS rank, count(*) OVER (PARTITION BY file_id) AS n FROM xr)
SELECT file_id, entry_id, CAST(rank AS INT) AS rank, 0 AS part FROM k WHERE rank <= 5 UNION ALL SELECT file_id, entry_id, CAST(rank AS INT), 1 FROM k WHERE n > 6 AND rank > n - 2""",
)
def enrichment_sample(spark: SparkSession, d: str) -> DataFrame:
    return sample.both_ends(parsed(spark, d).withColumn("row_confidence", F.floor(F.col("row_confidence") * 1000000 + 0.5))).select("file_id", "entry_id", "rank", "part")


@book.add(
    "random_review_pick",
    f"{TO_FIELDS} SELECT file_id, entry_id, raw_text, round(row_confidence, 6) AS row_confidence FROM xr QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY md5(concat(entry_id, ':7')), entry_id) = 1",
)
def random_review_pick(spark: SparkSession, d: str) -> DataFrame:
    return sample.random_pick(parsed(spark, d).select("file_id", "entry_id", "raw_text", F.round("row_confidence", 6).alias("row_confidence")), seed=7)


def mined_sample(spark: SparkSession, d: str) -> DataFrame:
    return pipeline.sample_with_matches(parsed(spark, d), table(spark, d, "catalog"))


@book.add(
    "mine_rules",
    f"""{TO_FIELDS}, k AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY CAST(floor(row_confidence * 1000000 + 0.5) AS BIGINT), page, line_no) AS rank, count(*) OVER (PARTITION BY file_id) AS n FROM xr),
m AS (SELECT file_id, rank, regexp_extract(clean, {q(f"({C.PRICE})")}, 1) AS p, regexp_extract(clean, {q(f"({C.VINTAGE}|N[.]V[.])")}, 1) AS v FROM k WHERE (rank <= 5 OR (n > 6 AND rank > n - 2)) AND row_confidence > 0)
SELECT file_id, CAST(rank * 4 + 2 AS INT) AS rule_pos, concat('(?P<price>', regexp_replace(p, '([^a-zA-Z0-9_])', '\\\\\\1', 'g'), ')') AS pattern, 0.9::DOUBLE AS confidence FROM m WHERE p <> ''
UNION ALL SELECT file_id, CAST(rank * 4 + 3 AS INT), concat('(?P<vintage>', regexp_replace(v, '([^a-zA-Z0-9_])', '\\\\\\1', 'g'), ')'), 0.9 FROM m WHERE v <> ''""",
)
def mine_rules(spark: SparkSession, d: str) -> DataFrame:
    """Entries of these lists name no catalogue row well enough, so only price and vintage patterns arise; ``mine_match_rules`` has the others."""
    df = parsed(spark, d).withColumn("row_confidence", F.floor(F.col("row_confidence") * 1000000 + 0.5))
    return mine.mine_rules(pipeline.sample_with_matches(df, table(spark, d, "catalog"))).select("file_id", "rule_pos", "pattern", "confidence")


@book.add(
    "mine_headers",
    f"""{TO_FIELDS}, k AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY CAST(floor(row_confidence * 1000000 + 0.5) AS BIGINT), page, line_no) AS rank, count(*) OVER (PARTITION BY file_id) AS n FROM xr),
s AS (SELECT * FROM k WHERE rank <= 5 OR (n > 6 AND rank > n - 2)),
h AS (SELECT file_id, 'main' AS level, section AS pattern, 0.9 AS c FROM s WHERE section IS NOT NULL UNION ALL SELECT file_id, 'sub', sub_section, 0.9 FROM s WHERE sub_section IS NOT NULL UNION ALL SELECT file_id, 'merge', clean, 0.8 FROM s WHERE n_lines > 1)
SELECT file_id, level, pattern, max(c)::DOUBLE AS confidence, count(*) AS n FROM h GROUP BY file_id, level, pattern""",
)
def mine_headers(spark: SparkSession, d: str) -> DataFrame:
    df = parsed(spark, d).withColumn("row_confidence", F.floor(F.col("row_confidence") * 1000000 + 0.5))
    return mine.mine_headers(pipeline.sample_with_matches(df, table(spark, d, "catalog")))


@book.add("parse_lists")
def parse_lists(spark: SparkSession, d: str) -> DataFrame:
    df = pipeline.parse_lists(entries(spark, d), stored_rules(spark, d), table(spark, d, "catalog"))
    return df.select("entry_id", "file_id", "stage", F.to_json("fields").alias("fields"), F.round("row_confidence", 6).alias("row_confidence"), "needs_review")


@book.add("refinement_stages")
def refinement_stages(spark: SparkSession, d: str) -> DataFrame:
    """All parts of the refinement data of all lists, by owners' rules or by mined ones, written as JSON and read back."""
    said = table(spark, d, "suggested").select("raw_text", F.create_map(F.lit("producer"), "producer", F.lit("cuvee"), "cuvee").alias("suggested"))
    parts = pipeline.refinement(entries(spark, d), stored_rules(spark, d), table(spark, d, "catalog"), said)
    rows, path = sinks.refinement_table(pipeline.refinement_rows(parts)), new_folder(spark, "refinement")
    sinks.write_json(rows, path)
    return spark.read.schema(rows.schema).json(path)


@book.add("mine_exclusions", f"{TO_FIELDS} SELECT DISTINCT file_id, unnest([{', '.join(q(p) for p in mine.EXCLUDED)}]) AS pattern, 0.9::DOUBLE AS confidence FROM xr")
def mine_exclusions(spark: SparkSession, d: str) -> DataFrame:
    return mine.mine_exclusions(sample.both_ends(parsed(spark, d)))


SAMPLED = "k AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY CAST(floor(row_confidence * 1000000 + 0.5) AS BIGINT), page, line_no) AS rank, count(*) OVER (PARTITION BY file_id) AS n FROM ini)"


@book.add(
    "refinement_tables",
    f"""WITH ini AS (SELECT * FROM ({TO_FIELDS} SELECT entry_id, file_id, page, line_no, row_confidence FROM xr)), own AS (SELECT * FROM ({TO_OWNED} SELECT entry_id, row_confidence FROM xr)), rs AS (SELECT * FROM ({with_views("rulesets")} SELECT * FROM rulesets)), {SAMPLED}
SELECT 'initial_parse' AS stage, entry_id, round(row_confidence, 6) AS row_confidence, CAST(NULL AS VARCHAR) AS pattern FROM ini
UNION ALL SELECT 'enriched_sample', entry_id, round(row_confidence, 6), NULL FROM k WHERE rank <= 5 UNION ALL SELECT 'enriched_sample', entry_id, round(row_confidence, 6), NULL FROM k WHERE n > 6 AND rank > n - 2
UNION ALL SELECT 'final_parse', entry_id, round(row_confidence, 6), NULL FROM own UNION ALL SELECT 'needs_review', entry_id, round(row_confidence, 6), NULL FROM own WHERE row_confidence < {C.REVIEW_BELOW}
UNION ALL SELECT 'restaurant_rules', NULL, NULL, json_extract_string(rules_json, '$.extraction_rules[' || p || '].pattern') FROM (SELECT rules_json, unnest(range(4)) AS p FROM rs)
UNION ALL SELECT 'stage', NULL, NULL, concat(restaurant_id, ': rules_exist') FROM rs""",
)
def refinement_tables(spark: SparkSession, d: str) -> DataFrame:
    """All six parts of the refinement data, written as JSON and read back."""
    said = lambda df: df.select("entry_id", F.round("row_confidence", 6).alias("row_confidence"))
    own, given = saved(entries(spark, d), "entries"), saved(stored_rules(spark, d), "rules")  # each part is written once and read by all that need it
    parse = lambda *r: saved(rules.extract_fields(own, *r).select("entry_id", "file_id", "page", "line_no", "row_confidence", "needs_review"), "parsed")
    first, last = parse(), parse(given)
    picked = sample.both_ends(first.withColumns({"row_confidence": F.floor(F.col("row_confidence") * 1000000 + 0.5), "said": F.col("row_confidence")})).withColumn("row_confidence", F.col("said"))
    parts = {"initial_parse": said(first), "enriched_sample": said(picked), "final_parse": said(last), "needs_review": said(last.where("needs_review")), "restaurant_rules": given.select("pattern")}
    parts["stage"] = given.select(F.concat("restaurant_id", F.lit(": rules_exist")).alias("pattern")).distinct()
    rows, path = sinks.refinement_table(parts).select("stage", "entry_id", "row_confidence", "pattern"), new_folder(spark, "refinement")
    sinks.write_json(rows, path)
    return spark.read.schema(rows.schema).json(path)


@book.add(
    "json_sanitize",
    "SELECT event_id, CASE WHEN event_id % 10 < 3 THEN NULL ELSE value END AS value, CAST(ts AS VARCHAR) AS ts FROM events",
)
def json_sanitize(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    odd = F.when(F.col("event_id") % 10 == 0, float("nan")).when(F.col("event_id") % 10 == 1, float("inf")).when(F.col("event_id") % 10 == 2, float("-inf")).otherwise(F.col("value"))
    return events.select("event_id", json_number(odd).alias("value"), F.col("ts").cast("string").alias("ts"))


@book.add("merge_suggestions", f"""{with_views("suggested")} SELECT l.file_id, l.line_no, coalesce(s.producer, '-') AS producer, coalesce(s.cuvee, '-') AS cuvee,
CASE WHEN s.producer IS NOT NULL THEN 0.8::DOUBLE END AS producer_confidence, CASE WHEN s.cuvee IS NOT NULL THEN 0.8::DOUBLE ELSE 0.5::DOUBLE END AS cuvee_confidence FROM lines l LEFT JOIN suggested s ON l.text = s.raw_text""")
def merge_suggestions(spark: SparkSession, d: str) -> DataFrame:
    said = table(spark, d, "suggested").select("raw_text", F.create_map(F.lit("producer"), "producer", F.lit("cuvee"), "cuvee").alias("suggested"))
    own = table(spark, d, "lines").select("file_id", "line_no", F.col("text").alias("raw_text"), F.lit("-").alias("producer"), F.lit("-").alias("cuvee"), F.create_map(F.lit("cuvee"), F.lit(0.5)).alias("field_confidence"))
    df = match.merge_suggested(own, said, ["producer", "cuvee"])
    at = lambda f: F.try_element_at("field_confidence", F.lit(f)).alias(f"{f}_confidence")
    return df.select("file_id", "line_no", "producer", "cuvee", at("producer"), at("cuvee"))

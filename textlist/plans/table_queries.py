"""Queries over catalogue matches and stored tables, with SQL for another engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..fixtures import table, with_views
from ..functions.similarity import sorted_ratio, sorted_tokens
from ..functions.similarity import token_sort_ratio as ratio_of
from ..operators import match, mine, pages, sections, segment, tables, trigrams
from ..operators.lineage import new_folder, saved
from ..sources import readers, sinks
from ..streaming import assemble, feed, ingest
from .book import Book
from .line_queries import ENTRIES, SECTIONS, TO_CLEAN

book = Book()

# ---- SQL pieces -----------------------------------------------------------------------------------------------------

CLEAN = "lower(trim(coalesce({}, '')))"
TAIL = r"\s+(?:grand\s+cru|premier\s+cru|1er\s+cru)$"
CN = "cn AS (SELECT *, " + ", ".join(f"{CLEAN.format(C.KEY_COLUMNS[k]) if k in C.KEY_COLUMNS else chr(39) * 2} AS {k}_norm" for k in C.KEYS) + " FROM catalog)"
PN = rf"regexp_replace(regexp_replace(regexp_replace({CLEAN.format('producer')}, '\s+(?:&|and)\s+.*$', ''), '^(?:château|domaine|estate)\s+', ''), '{TAIL}', '')"
UN = rf"regexp_replace(regexp_replace({CLEAN.format('cuvee')}, '^[''\x22]|[''\x22]$', '', 'g'), '{TAIL}', '')"
IN = f"inn AS (SELECT *, {PN} AS producer_n, {UN} AS cuvee_n, " + ", ".join(f"{CLEAN.format(k)} AS {k}_n" for k in C.KEYS[2:]) + " FROM items)"
TO_MATCH = f"{with_views('catalog', 'items')}, {CN}, {IN}"
DIRECT = "di AS (SELECT entry_id, min(catalog_row) AS catalog_row FROM inn JOIN cn ON " + " AND ".join(f"({k}_n = '' OR {k}_n = {k}_norm)" for k in C.KEYS) + " WHERE concat(" + ", ".join(f"{k}_n" for k in C.KEYS) + ") <> '' GROUP BY entry_id)"


def sql_sorted(x: str) -> str:
    return rf"array_to_string(list_sort(list_filter(regexp_split_to_array({x}, '\s+'), lambda t: t <> '')), ' ')"


def sql_lcs(a: str, b: str) -> str:
    """A row of the table is kept as a list; the loop over ``b`` is a reduction with lists as its elements."""
    row = f"list_transform(range(length({a}) + 1), lambda z: 0)"
    chars = f"list_transform(string_split({b}, ''), lambda c: [unicode(c)])"
    step = f"list_reduce(list_prepend([0], list_transform(range(1, length({a}) + 1), lambda i: [prev[i + 1], CASE WHEN unicode(substr({a}, i, 1)) = ch[1] THEN prev[i] + 1 ELSE -1 END])), lambda acc, e: list_append(acc, greatest(acc[len(acc)], e[1], e[2])))"
    return f"list_last(list_reduce(list_prepend({row}, {chars}), lambda prev, ch: {step}))"


#: Each item with the catalogue row it was made from.
PAIRS = f"""pr AS (SELECT i.entry_id, c.catalog_row, {sql_sorted("concat_ws(' ', " + ", ".join(f"nullif(i.{k}_n, '')" for k in C.KEYS) + ")")} AS a,
 {sql_sorted("concat_ws(' ', " + ", ".join(f"nullif(c.{k}_norm, '')" for k in C.KEYS) + ")")} AS b FROM inn i JOIN cn c ON c.catalog_row = i.true_row)"""


def both(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return match.normalize_items(table(spark, d, "items")), match.normalize_catalog(table(spark, d, "catalog"))


# ---- catalogue ------------------------------------------------------------------------------------------------------


@book.add("catalog_normalize", f"{with_views('catalog')}, {CN} SELECT catalog_row, {', '.join(f'{k}_norm' for k in C.KEYS)}, concat_ws(' ', {', '.join(f'nullif({k}_norm, {chr(39) * 2})' for k in C.KEYS)}) AS composite_key FROM cn")
def catalog_normalize(spark: SparkSession, d: str) -> DataFrame:
    return both(spark, d)[1].select("catalog_row", *[f"{k}_norm" for k in C.KEYS], "composite_key")


@book.add("match_key_normalize", f"{TO_MATCH} SELECT entry_id, {', '.join(f'{k}_n' for k in C.KEYS)} FROM inn")
def match_key_normalize(spark: SparkSession, d: str) -> DataFrame:
    return both(spark, d)[0].select("entry_id", *[f"{k}_n" for k in C.KEYS])


LATEST = f"""la AS (SELECT field, {CLEAN.format("original")} AS original, arg_max({CLEAN.format("corrected")}, seq) AS corrected FROM aliases
WHERE {CLEAN.format("original")} <> '' AND {CLEAN.format("corrected")} <> '' GROUP BY field, {CLEAN.format("original")})"""


@book.add("alias_update", f"{with_views('aliases')}, {LATEST} SELECT * FROM la")
def alias_update(spark: SparkSession, d: str) -> DataFrame:
    return match.latest_aliases(table(spark, d, "aliases"))


USERS = "us AS (SELECT event_id, concat('Brand ', user_id % 60) AS producer, concat('brand ', user_id % 45) AS cuvee FROM events)"


@book.add(
    "alias_apply",
    f"{with_views('aliases')}, {LATEST}, {USERS} SELECT u.event_id, coalesce(a.corrected, lower(u.producer)) AS producer, coalesce(b.corrected, lower(u.cuvee)) AS cuvee FROM us u "
    "LEFT JOIN la a ON a.field = 'producer' AND a.original = lower(u.producer) LEFT JOIN la b ON b.field = 'cuvee' AND b.original = lower(u.cuvee)",
)
def alias_apply(spark: SparkSession, d: str) -> DataFrame:
    said = table(spark, d, "events").select("event_id", F.expr("concat('brand ', user_id % 60)").alias("producer_n"), F.expr("concat('brand ', user_id % 45)").alias("cuvee_n"))
    return match.apply_aliases(said, match.latest_aliases(table(spark, d, "aliases"))).select("event_id", F.col("producer_n").alias("producer"), F.col("cuvee_n").alias("cuvee"))


@book.add("direct_match", f"{TO_MATCH}, {DIRECT} SELECT * FROM di")
def direct_match(spark: SparkSession, d: str) -> DataFrame:
    return match.direct_match(*both(spark, d))


@book.add(
    "token_sort_ratio",
    f"{TO_MATCH}, {PAIRS}, dp AS (SELECT a, b, 200.0 * {sql_lcs('a', 'b')} / (length(a) + length(b)) AS r FROM (SELECT DISTINCT a, b FROM pr)) "
    "SELECT entry_id, catalog_row, round(dp.r, 6) AS ratio FROM pr JOIN dp ON pr.a = dp.a AND pr.b = dp.b",
)
def token_sort_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Each distinct pair of keys is scored once."""
    items, rows = both(spark, d)
    a = items.select("entry_id", F.col("true_row").alias("catalog_row"), F.concat_ws(" ", *[F.nullif(F.col(f"{k}_n"), F.lit("")) for k in C.KEYS]).alias("a"))
    pairs = a.join(rows.select("catalog_row", F.col("composite_key").alias("b")), "catalog_row")
    scored = pairs.select("a", "b").distinct().select("a", "b", F.round(ratio_of(F.col("a"), F.col("b")), 6).alias("ratio"))
    return pairs.join(scored, ["a", "b"]).select("entry_id", "catalog_row", "ratio")


@book.add("match_grade", "SELECT part.p_partkey AS id, CASE WHEN p_retailprice % 101 >= 100 THEN 'direct' WHEN p_retailprice % 101 >= 85 THEN 'fuzzy' WHEN p_retailprice % 101 >= 70 THEN 'partial' ELSE 'no_match' END AS grade FROM part")
def match_grade(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), match.grade(F.col("p_retailprice") % 101).alias("grade"))


@book.add("fuzzy_match_composite")
def fuzzy_match_composite(spark: SparkSession, d: str) -> DataFrame:
    out = match.composite_match(*both(spark, d))
    return out.select("entry_id", "catalog_row", F.round("score", 6).alias("score"))


#: Ratios of the distinct values that stand beside each other, by field.
RATIOS = ", ".join(
    f"r_{k} AS (SELECT a, b, CASE WHEN a = '' OR b = '' THEN 0 ELSE 200.0 * {sql_lcs('a', 'b')} / (length(a) + length(b)) END AS r FROM (SELECT DISTINCT {sql_sorted(f'{k}_n')} AS a, {sql_sorted(f'{k}_norm')} AS b FROM mp WHERE {k}_n <> '' AND {k}_n <> {k}_norm))" for k in C.KEYS
)
POINTS = " + ".join(f"CASE WHEN {k}_n = '' THEN 0 WHEN {k}_n = {k}_norm THEN 100 * {C.KEY_WEIGHTS[k]} ELSE CASE WHEN r_{k}.r > 80 THEN least(100.0, r_{k}.r + {C.NEAR_BOOST.get(k, 0)}) ELSE r_{k}.r END * {C.KEY_WEIGHTS[k]} END" for k in C.KEYS)
WEIGHT = " + ".join(f"CASE WHEN {k}_n = '' THEN 0 ELSE {C.KEY_WEIGHTS[k]} END" for k in C.KEYS)
LOOKUPS = " ".join(f"LEFT JOIN r_{k} ON {sql_sorted(f'mp.{k}_n')} = r_{k}.a AND {sql_sorted(f'mp.{k}_norm')} = r_{k}.b" for k in C.KEYS)


@book.add(
    "match_score",
    f"{TO_MATCH}, mp AS (SELECT i.entry_id, c.catalog_row, {', '.join(f'i.{k}_n, c.{k}_norm' for k in C.KEYS)} FROM (SELECT *, unnest([true_row, true_row + 1]) AS near_row FROM inn) i JOIN cn c ON c.catalog_row = i.near_row), {RATIOS} "
    f"SELECT entry_id, catalog_row, round(({POINTS}) / ({WEIGHT}), 6) AS score FROM mp {LOOKUPS}",
)
def match_score(spark: SparkSession, d: str) -> DataFrame:
    """Each item with the row it was made from and the row after it."""
    items, rows = both(spark, d)
    pairs = items.select("entry_id", F.explode(F.array("true_row", F.col("true_row") + 1)).alias("catalog_row"))
    return match.score_pairs(pairs, items, rows).withColumn("score", F.round("score", 6))


@book.add("best_match")
def best_match(spark: SparkSession, d: str) -> DataFrame:
    return match.best_match(*both(spark, d)).withColumn("score", F.round("score", 6))


@book.add("best_match_strict")
def best_match_strict(spark: SparkSession, d: str) -> DataFrame:
    return match.best_match(*both(spark, d), threshold=C.FUZZY).withColumn("score", F.round("score", 6))


@book.add("match_suggestions")
def match_suggestions(spark: SparkSession, d: str) -> DataFrame:
    return match.suggestions(*both(spark, d)).select("entry_id", "catalog_row", F.round("score", 6).alias("score"), "rank")


@book.add(
    "enrich_entries",
    f"""{TO_MATCH}, {DIRECT} SELECT i.entry_id, coalesce(nullif(i.producer, ''), nullif(trim(c.producer_name), '')) AS producer, coalesce(nullif(i.vintage, ''), nullif(c.vintage_config, '')) AS vintage,
coalesce(i.region, c.region) AS region, c.colour AS type, CASE WHEN d.catalog_row IS NOT NULL THEN 0.95::DOUBLE END AS region_confidence, CASE WHEN c.colour IS NOT NULL THEN 0.95::DOUBLE END AS type_confidence
FROM items i LEFT JOIN di d USING (entry_id) LEFT JOIN cn c ON c.catalog_row = d.catalog_row""",
)
def enrich_entries(spark: SparkSession, d: str) -> DataFrame:
    items, rows = both(spark, d)
    hits = match.direct_match(items, rows).withColumn("score", F.lit(100.0))
    out = match.enrich(table(spark, d, "items"), hits, rows)
    return out.select("entry_id", "producer", "vintage", "region", "type", *[F.try_element_at("field_confidence", F.lit(f)).alias(f"{f}_confidence") for f in ("region", "type")])


#: The direct match, else the row the item was made from where the whole keys are alike enough.
FOUND = f"""{PAIRS}, mt AS (SELECT entry_id, catalog_row, 100.0::DOUBLE AS score FROM di UNION ALL
 SELECT entry_id, catalog_row, score FROM (SELECT entry_id, catalog_row, 200.0 * {sql_lcs("a", "b")} / (length(a) + length(b)) AS score FROM pr WHERE entry_id NOT IN (SELECT entry_id FROM di)) WHERE score >= {C.PARTIAL})"""


def found_matches(items: DataFrame, rows: DataFrame) -> DataFrame:
    direct = match.direct_match(items, rows).withColumn("score", F.lit(100.0))
    rest = items.join(direct, "entry_id", "left_anti").select("entry_id", F.col("true_row").alias("catalog_row"), sorted_tokens(F.concat_ws(" ", *[f"{k}_n" for k in C.KEYS])).alias("a"))
    rest = rest.join(rows.select("catalog_row", sorted_tokens(F.col("composite_key")).alias("b")), "catalog_row")
    rest = rest.select("entry_id", "catalog_row", sorted_ratio(F.col("a"), F.col("b")).alias("score")).where(F.col("score") >= C.PARTIAL)
    return direct.unionByName(rest)


def filled_sql(k: str) -> str:
    return f"coalesce(nullif(i.{k}, ''), nullif(trim(c.{C.KEY_COLUMNS[k]}), ''))" if k in C.KEY_COLUMNS else f"nullif(i.{k}, '')"


@book.add(
    "match_confidence",
    f"{TO_MATCH}, {DIRECT}, {FOUND} SELECT m.entry_id, m.catalog_row, {', '.join(f'CASE WHEN {filled_sql(k)} IS NOT NULL THEN round(least(0.95, m.score / 100), 6) END AS {k}' for k in C.KEY_COLUMNS)} FROM mt m JOIN items i USING (entry_id) JOIN cn c USING (catalog_row)",
)
def match_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Confidences of the key fields of matched items, direct and fuzzy."""
    items, rows = both(spark, d)
    hits = found_matches(items, rows)
    out = match.enrich(table(spark, d, "items"), hits, rows).where("score is not null")
    return out.select("entry_id", "catalog_row", *[F.round(F.try_element_at("field_confidence", F.lit(k)), 6).alias(k) for k in C.KEY_COLUMNS])


@book.add(
    "enrich_sample",
    f"""{TO_MATCH}, {DIRECT}, {FOUND}, g AS (SELECT * FROM mt WHERE score >= {C.FUZZY})
SELECT i.entry_id, CASE WHEN g.score IS NOT NULL THEN 'match' WHEN CAST(i.entry_id AS BIGINT) % 3 = 0 THEN 'suggested' ELSE 'none' END AS choice, c.lwin, round(g.score / 100, 6) AS match_confidence,
CASE WHEN g.score IS NOT NULL THEN {filled_sql("producer")} WHEN CAST(i.entry_id AS BIGINT) % 3 = 0 THEN concat('Said ', i.cuvee) ELSE i.producer END AS producer,
CASE WHEN g.score IS NOT NULL THEN {filled_sql("region")} ELSE i.region END AS region,
CASE WHEN g.score IS NOT NULL THEN round(least(0.95, g.score / 100), 6) WHEN CAST(i.entry_id AS BIGINT) % 3 = 0 THEN 0.8 END AS producer_confidence
FROM items i LEFT JOIN g USING (entry_id) LEFT JOIN cn c USING (catalog_row)""",
)
def enrich_sample(spark: SparkSession, d: str) -> DataFrame:
    """The match where it is good enough, else another source's values where it has some."""
    items, rows = both(spark, d)
    own = table(spark, d, "items")
    said = own.where("cast(entry_id as bigint) % 3 = 0").select("entry_id", F.create_map(F.lit("producer"), F.concat(F.lit("Said "), "cuvee")).alias("suggested"))
    out = match.enrich_choice(own, found_matches(items, rows), said, rows)
    return out.select("entry_id", "choice", "lwin", F.round("match_confidence", 6).alias("match_confidence"), "producer", "region", F.round(F.try_element_at("field_confidence", F.lit("producer")), 6).alias("producer_confidence"))


@book.add(
    "mine_aliases",
    f"""{TO_MATCH}, {DIRECT}, m AS (SELECT CAST(CAST(d.entry_id AS BIGINT) % 7 AS VARCHAR) AS file_id, CAST(d.entry_id AS BIGINT) AS rank, trim(c.producer_name) AS p, trim(c.wine) AS w FROM di d JOIN cn c USING (catalog_row))
SELECT file_id, 'producer' AS field, lower(p) AS alias, arg_max(p, rank) AS name FROM m WHERE p <> '' GROUP BY file_id, lower(p) UNION ALL SELECT file_id, 'cuvee', lower(w), arg_max(w, rank) FROM m WHERE w <> '' GROUP BY file_id, lower(w)""",
)
def mine_aliases(spark: SparkSession, d: str) -> DataFrame:
    items, rows = both(spark, d)
    found = match.direct_match(items, rows).join(rows.select("catalog_row", "producer_name", "wine"), "catalog_row")
    sample = found.select((F.col("entry_id").cast("long") % 7).cast("string").alias("file_id"), F.col("entry_id").cast("long").alias("rank"), "producer_name", "wine", F.lit(100.0).alias("score"))
    return mine.mine_aliases(sample)


@book.add(
    "mine_match_rules",
    f"""{TO_MATCH}, {DIRECT}, {FOUND}, m AS (SELECT CAST(CAST(m.entry_id AS BIGINT) % 7 AS VARCHAR) AS file_id, CAST(m.entry_id AS INT) AS rank, m.score, trim(c.producer_name) AS p, trim(c.wine) AS w, i.vintage AS v FROM mt m JOIN items i USING (entry_id) JOIN cn c USING (catalog_row)),
e AS (SELECT *, regexp_replace(p, '([^a-zA-Z0-9_])', '\\\\\\1', 'g') AS pe, regexp_replace(w, '([^a-zA-Z0-9_])', '\\\\\\1', 'g') AS we FROM m)
SELECT file_id, rank * 4 AS rule_pos, concat('(?P<producer>', pe, ')\\s+(?P<cuvee>', we, ')') AS pattern, 0.95::DOUBLE AS confidence, 'lwin_match' AS provenance FROM e WHERE score >= {C.FUZZY}
UNION ALL SELECT file_id, rank * 4 + 1, concat('(?P<producer>', pe, ')(?:\\s+[A-Za-z]+)*\\s+(?P<cuvee>', we, ')'), 0.85, 'lwin_fuzzy' FROM e WHERE score >= {C.FUZZY}
UNION ALL SELECT file_id, rank * 4 + 2, concat('(?P<price>', left(v, 3), ')'), 0.9, 'pattern_match' FROM e WHERE v IS NOT NULL
UNION ALL SELECT file_id, rank * 4 + 3, concat('(?P<vintage>', v, ')'), 0.9, 'pattern_match' FROM e WHERE v IS NOT NULL""",
)
def mine_match_rules(spark: SparkSession, d: str) -> DataFrame:
    """Rules of samples that name catalogue rows: exact and gap-tolerant pairs, and numbers, of which the price pattern takes three digits."""
    items, rows = both(spark, d)
    hits = found_matches(items, rows).join(rows.select("catalog_row", "producer_name", "wine"), "catalog_row").join(table(spark, d, "items").select("entry_id", "vintage"), "entry_id")
    text = F.concat_ws(" ", F.lit("cask"), F.when(F.col("vintage").isNotNull(), F.concat(F.lit("of "), "vintage")))
    sample = hits.select((F.col("entry_id").cast("long") % 7).cast("string").alias("file_id"), F.col("entry_id").cast("int").alias("rank"), text.alias("text"), "producer_name", "wine", "score", F.lit(1).alias("n_fields"))
    return mine.mine_rules(sample).select("file_id", "rule_pos", "pattern", "confidence", "provenance")


# ---- stored tables --------------------------------------------------------------------------------------------------

STORED = with_views("stored")
KNOWN = ["entry_id", "file_id", "restaurant_id", "producer", "cuvee", "vintage", "price", "type", "region", "row_confidence", "status"]


@book.add("entries_sink", f"{STORED} SELECT {', '.join(KNOWN)}, CASE WHEN bin IS NULL THEN '{{}}' ELSE concat('{{\"bin\":\"', bin, '\"}}') END AS extra_data FROM stored")
def entries_sink(spark: SparkSession, d: str) -> DataFrame:
    """Written by restaurant and read back."""
    rows, path = table(spark, d, "stored"), new_folder(spark, "entries")
    sinks.write_entries(rows, path, KNOWN)
    return readers.read_entries(spark, path, sinks.split_extra(rows, KNOWN).schema)


@book.add("entry_view", f"{STORED} SELECT entry_id, coalesce(bin, '') AS bin, upper(status) AS status, CASE WHEN bin IS NOT NULL THEN bin ELSE cuvee END AS cuvee FROM stored")
def entry_view(spark: SparkSession, d: str) -> DataFrame:
    """Fixed columns with the extra ones laid over them."""
    rows = sinks.split_extra(table(spark, d, "stored"), KNOWN)
    extra = F.coalesce(F.from_json("extra_data", "map<string,string>"), F.create_map().cast("map<string,string>"))
    rows = rows.withColumn("extra", extra)
    over = F.map_concat(F.map_filter(F.create_map(F.lit("cuvee"), "cuvee"), lambda k, _: ~F.map_contains_key("extra", F.lit("bin"))), F.transform_keys("extra", lambda k, _: F.lit("cuvee")))
    return rows.select("entry_id", F.coalesce(F.try_element_at("extra", F.lit("bin")), F.lit("")).alias("bin"), F.upper("status").alias("status"), F.try_element_at(over, F.lit("cuvee")).alias("cuvee"))


@book.add("export_flat", f"{STORED} SELECT entry_id, concat('{{\"producer\":', coalesce('\"' || producer || '\"', 'null'), ',\"type\":', coalesce('\"' || type || '\"', 'null'), '}}') AS fields FROM stored")
def export_flat(spark: SparkSession, d: str) -> DataFrame:
    """Written as CSV and read back."""
    rows, path = table(spark, d, "stored").select("entry_id", F.create_map(F.lit("producer"), "producer", F.lit("type"), "type").alias("fields")), new_folder(spark, "export")
    sinks.write_csv(rows, path)
    return readers.read_csv(spark, path, sinks.export_flat(rows).schema)


@book.add("export_json", f"{STORED} SELECT entry_id, producer, row_confidence, bin FROM stored")
def export_json(spark: SparkSession, d: str) -> DataFrame:
    """Written as JSON and read back."""
    rows, path = table(spark, d, "stored").select("entry_id", "producer", "row_confidence", "bin"), new_folder(spark, "export")
    sinks.write_json(rows, path)
    return spark.read.schema(rows.schema).json(path)


@book.add("refinement_path", f"{with_views('files')} SELECT id, regexp_extract(notes, 'refinement_json: ([^;\\n]+)', 1) AS path FROM files WHERE notes IS NOT NULL")
def refinement_path(spark: SparkSession, d: str) -> DataFrame:
    return readers.refinement_paths(table(spark, d, "files"))


@book.add("refinement_read", f"{STORED}, files AS ({with_views('files')} SELECT * FROM files) SELECT f.id, s.entry_id, s.cuvee FROM files f JOIN stored s ON s.file_id = f.id WHERE f.notes IS NOT NULL AND CAST(s.file_id AS BIGINT) % 3 <> 0")
def refinement_read(spark: SparkSession, d: str) -> DataFrame:
    """Refinement rows of some files, written as JSON and read back by the path in each file's notes."""
    rows = table(spark, d, "stored").where("cast(file_id as bigint) % 3 <> 0").select(F.concat(F.lit("/tmp/r_"), "file_id", F.lit(".json")).alias("path"), "entry_id", "cuvee")
    path = new_folder(spark, "refinement")
    sinks.write_json(rows, path)
    return readers.read_refinement(table(spark, d, "files"), spark.read.schema(rows.schema).json(path)).select("id", "entry_id", "cuvee")


@book.add("needs_parse", f"{STORED} SELECT entry_id FROM stored WHERE coalesce(producer, '') = '' OR coalesce(cuvee, '') = '' OR coalesce(vintage, '') = '' OR coalesce(price, '') = '' OR coalesce(type, '') = ''")
def needs_parse(spark: SparkSession, d: str) -> DataFrame:
    keys = F.array(*[F.coalesce(c, F.lit("")) for c in ("producer", "cuvee", "vintage", "price", "type")])
    return table(spark, d, "stored").where(F.array_contains(keys, "")).select("entry_id")


@book.add("lookup_by_key", f"{STORED} SELECT entry_id, restaurant_id, cuvee FROM stored WHERE restaurant_id = '7' AND status = 'parsed'")
def lookup_by_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "stored").where("restaurant_id = '7' and status = 'parsed'").select("entry_id", "restaurant_id", "cuvee")


@book.add("search_entries", f"{STORED} SELECT entry_id FROM stored WHERE contains(lower(concat_ws(' ', producer, cuvee, region)), 'domaine 1') AND restaurant_id = '3'")
def search_entries(spark: SparkSession, d: str) -> DataFrame:
    said = F.lower(F.concat_ws(" ", "producer", "cuvee", "region"))
    return table(spark, d, "stored").where(F.contains(said, F.lit("domaine 1")) & (F.col("restaurant_id") == "3")).select("entry_id")


@book.add("search_indexed", f"{STORED}, q AS (SELECT unnest(['Domaine 1', 'ring', 'x', 'o', 'a r', 'estate of nowhere']) AS query) SELECT query, entry_id FROM stored, q WHERE contains(lower(concat_ws(' ', producer, cuvee, region)), lower(query))")
def search_indexed(spark: SparkSession, d: str) -> DataFrame:
    """Substrings of several lengths, each found by the same index of trigrams."""
    rows = table(spark, d, "stored").select(F.col("entry_id").alias("id"), F.concat_ws(" ", "producer", "cuvee", "region").alias("text"))
    texts = trigrams.texts_of(rows)
    found = trigrams.search_all(trigrams.build(texts), texts, rows, ["Domaine 1", "ring", "x", "o", "a r", "estate of nowhere"])
    return found.withColumnRenamed("id", "entry_id")


@book.add("restaurant_entries", f"{STORED}, files AS ({with_views('files')} SELECT * FROM files) SELECT f.restaurant_id, count(*) AS entries, count(DISTINCT f.id) AS files FROM files f JOIN stored s ON s.file_id = f.id GROUP BY f.restaurant_id")
def restaurant_entries(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "files").select("id", F.col("restaurant_id").alias("owner"))
    per_file = table(spark, d, "stored").groupBy("file_id").agg(F.count("*").alias("n"))
    return files.join(per_file, F.col("id") == F.col("file_id")).groupBy(F.col("owner").alias("restaurant_id")).agg(F.sum("n").alias("entries"), F.count("*").alias("files"))


@book.add("dashboard_counts", "SELECT (SELECT count(DISTINCT o_custkey % 20) FROM orders) AS restaurants, (SELECT count(*) FROM customer) AS users")
def dashboard_counts(spark: SparkSession, d: str) -> DataFrame:
    owners = table(spark, d, "orders").select((F.col("o_custkey") % 20).alias("k")).distinct().agg(F.count("*").alias("restaurants"))
    return owners.join(table(spark, d, "customer").agg(F.count("*").alias("users")))  # one row each


@book.add("unique_violations", "SELECT c_mktsegment AS value, count(*) AS n FROM customer GROUP BY c_mktsegment HAVING count(*) > 1")
def unique_violations(spark: SparkSession, d: str) -> DataFrame:
    return tables.unique_violations(table(spark, d, "customer"), "c_mktsegment")


@book.add("insert_defaults", "SELECT c_custkey AS id, c_name AS name, 'restaurant' AS role FROM customer UNION ALL SELECT s_suppkey + 1000000, s_name, 'admin' FROM supplier")
def insert_defaults(spark: SparkSession, d: str) -> DataFrame:
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("restaurant").alias("role"))
    new = table(spark, d, "supplier").select((F.col("s_suppkey") + 1000000).alias("id"), F.col("s_name").alias("name"))
    return tables.insert_defaults(users, new, {"role": F.lit("admin")})


CHANGES = "ch AS (SELECT CAST(event_id * 10 + 1 AS VARCHAR) AS entry_id, event_id, event_type FROM events WHERE event_id % 2 = 0)"
NEW = "CASE WHEN c.event_id IS NULL THEN s.producer WHEN c.event_id % 4 = 0 THEN c.event_type ELSE s.producer END AS producer, CASE WHEN c.event_id % 6 = 0 THEN NULL ELSE s.price END AS price"


def patches(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").where("event_id % 2 = 0")
    named = F.map_filter(F.create_map(F.lit("producer"), "event_type", F.lit("price"), F.lit(None).cast("string")), lambda k, _: F.when(k == "producer", F.col("event_id") % 4 == 0).otherwise(F.col("event_id") % 6 == 0))
    return events.select((F.col("event_id") * 10 + 1).cast("string").alias("entry_id"), named.alias("changes"))


@book.add("patch_rows", f"{STORED}, {CHANGES} SELECT s.entry_id, {NEW} FROM stored s LEFT JOIN ch c USING (entry_id)")
def patch_rows(spark: SparkSession, d: str) -> DataFrame:
    return tables.patch_rows(table(spark, d, "stored"), patches(spark, d), "entry_id", ["producer", "price"]).select("entry_id", "producer", "price")


@book.add("bulk_patch", f"{STORED}, {CHANGES} SELECT s.entry_id, {NEW} FROM stored s JOIN ch c USING (entry_id)")
def bulk_patch(spark: SparkSession, d: str) -> DataFrame:
    return tables.patch_rows(table(spark, d, "stored"), patches(spark, d), "entry_id", ["producer", "price"], only_patched=True).select("entry_id", "producer", "price")


@book.add(
    "cascade_delete",
    f"{STORED}, files AS ({with_views('files')} SELECT * FROM files), gone AS (SELECT id FROM files WHERE CAST(restaurant_id AS INT) IN (3, 4)) "
    "SELECT 'files' AS part, id FROM files WHERE CAST(restaurant_id AS INT) NOT IN (3, 4) UNION ALL SELECT 'entries', entry_id FROM stored WHERE file_id NOT IN (SELECT id FROM gone)",
)
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    gone = table(spark, d, "files").select("restaurant_id").where("restaurant_id in ('3', '4')")
    left = tables.cascade_delete({"files": table(spark, d, "files"), "entries": table(spark, d, "stored")}, gone, [("files", "restaurant_id", "id"), ("entries", "file_id", None)])
    return left["files"].select(F.lit("files").alias("part"), "id").unionByName(left["entries"].select(F.lit("entries").alias("part"), F.col("entry_id").alias("id")))


@book.add(
    "sync_upsert",
    "WITH b AS (SELECT user_id AS id, arg_max(concat(event_type, user_id % 7), event_id) AS email FROM events GROUP BY user_id), o AS (SELECT c_custkey AS id, c_mktsegment AS email FROM customer) "
    "SELECT coalesce(o.id, b.id) AS id, coalesce(b.email, o.email) AS email, CASE WHEN o.id IS NULL THEN 'insert' WHEN b.id IS NULL OR b.email = o.email THEN 'keep' ELSE 'update' END AS action FROM o FULL JOIN b ON o.id = b.id",
)
def sync_upsert(spark: SparkSession, d: str) -> DataFrame:
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("email"))
    batch = table(spark, d, "events").select(F.col("user_id").alias("id"), F.expr("concat(event_type, user_id % 7)").alias("email"), "event_id")
    return tables.sync_upsert(users, batch, "id", "event_id")


@book.add("status_transition", f"{with_views('files')} SELECT id, CASE WHEN status IN ('uploaded', 'error') THEN 'processing' ELSE status END AS status, status IN ('uploaded', 'error') AS moved FROM files")
def status_transition(spark: SparkSession, d: str) -> DataFrame:
    return tables.status_transition(table(spark, d, "files").select("id", "status"), "processing")


@book.add("ruleset_replace", f"{with_views('rulesets')} SELECT restaurant_id, CASE WHEN CAST(restaurant_id AS INT) % 2 = 0 THEN concat('v', restaurant_id) ELSE rules_json END AS rules_json FROM rulesets")
def ruleset_replace(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "rulesets")
    new = table(spark, d, "orders").select((F.col("o_custkey") % 20).alias("k")).distinct().where("k % 2 = 0")
    new = new.select(F.col("k").cast("string").alias("restaurant_id"), F.create_map(F.lit("rules_json"), F.concat(F.lit("v"), F.col("k"))).alias("changes"))
    return tables.patch_rows(old, new, "restaurant_id", ["rules_json"])


@book.add(
    "audit_diff",
    f"{with_views('files')} SELECT id, 'status' AS field, status AS old_value, 'processing' AS new_value FROM files WHERE status IN ('uploaded', 'error') "
    "UNION ALL SELECT id, 'notes', notes, NULL FROM files WHERE notes IS NOT NULL AND status = 'error'",
)
def audit_diff(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "files").select("id", "status", "notes")
    new = tables.status_transition(old.withColumn("notes", F.when(F.col("status") != "error", F.col("notes"))), "processing")
    return tables.audit_diff(old, new, "id", ["status", "notes"])


@book.add("latest_status", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS status FROM events GROUP BY user_id")
def latest_status(spark: SparkSession, d: str) -> DataFrame:
    return ingest.latest_status(table(spark, d, "events"), "user_id", "event_type", ["ts", "event_id"])


@book.add("stream_ingest", f"{TO_CLEAN}, {SECTIONS}, {ENTRIES} SELECT entry_id, file_id, raw_text, n_lines FROM en")
def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Two drops of files, each ingested on arrival; the rows are those of one batch over all."""
    folder = new_folder(spark, "ingest")
    lines = table(spark, d, "lines").select("file_id", "restaurant_id", "page", "line_no", "text")
    for part in (0, 1):
        lines.where(F.pmod(F.xxhash64("file_id"), F.lit(2)) == part).repartition("file_id").write.mode("append").parquet(f"{folder}/in")
        ingest.ingest(spark, f"{folder}/in", f"{folder}/entries", f"{folder}/status", f"{folder}/checkpoint", lambda df: segment.segment_entries(sections.with_sections(pages.preprocess_lines(df))))
    return spark.read.parquet(f"{folder}/entries").select("entry_id", "file_id", "raw_text", "n_lines")




@book.add("stream_pieces", f"{TO_CLEAN}, {SECTIONS}, {ENTRIES} SELECT entry_id, file_id, raw_text, n_lines FROM en")
def stream_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Every file comes in two drops, lines of all pages in each; the rows are those of one batch over all."""
    folder = new_folder(spark, "pieces")
    lines = saved(table(spark, d, "lines").select("file_id", "restaurant_id", "page", "line_no", "text"), "lines")
    lines = lines.join(lines.groupBy("file_id").agg(F.count("*").cast("int").alias("total")), "file_id").select("file_id", "restaurant_id", "page", "line_no", "text", "total", F.timestamp_seconds(F.lit(1_700_000_000)).alias("at"))
    for part in (1, 0):
        lines.where(F.col("line_no") % 2 == part).write.mode("append").parquet(f"{folder}/in")
        assemble.ingest_pieces(spark, f"{folder}/in", f"{folder}/entries", f"{folder}/status", f"{folder}/checkpoint", lambda df: segment.segment_entries(sections.with_sections(pages.preprocess_lines(df))))
    return spark.read.parquet(f"{folder}/entries").select("entry_id", "file_id", "raw_text", "n_lines")


@book.add("status_feed", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS status FROM events GROUP BY user_id")
def status_feed(spark: SparkSession, d: str) -> DataFrame:
    """Events in three drops, each with late ones and one with a drop repeated; the states are those of the whole log."""
    folder, events = new_folder(spark, "feed"), table(spark, d, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    for part in (2, 0, 2, 1):
        events.where(F.pmod("event_id", F.lit(3)) == part).write.mode("append").parquet(f"{folder}/in")
        feed.run_feed(spark, f"{folder}/in", events.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), f"{folder}/states", f"{folder}/checkpoint", "user_id", "event_type", "ts", "event_id")
    return feed.last_states(spark, f"{folder}/states").select(F.col("key").alias("user_id"), "status")

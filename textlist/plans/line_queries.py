"""Queries over lines, pages and entries, with SQL for another engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..fixtures import table, with_views
from ..functions import text as T
from ..operators import pages, sections, segment
from ..sources import readers
from .book import Book

book = Book()
RUN_DATE = "2024-01-01"


# ---- SQL pieces -----------------------------------------------------------------------------------------------------


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def matches(x: str, patterns: list[str]) -> str:
    return f"regexp_matches({x}, {q('|'.join(f'(?:{p})' for p in patterns))})"


def words(x: str, listed: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(w)})" for w in listed) + ")"


def sql_normalize(x: str) -> str:
    x = f"regexp_replace({x}, '[‐-―⁃−⎯⏤]', '-', 'g')"
    x = rf"regexp_replace({x}, '(\w+)-\s*\n\s*(\w+)', '\1\2', 'g')"
    x = rf"regexp_replace({x}, '([\p{{L}}\p{{N}}_]+)-\s*([\p{{L}}\p{{N}}_]+)', '\1\2', 'g')"
    x = rf"regexp_replace({x}, '([\p{{L}}\p{{N}}_]+)(?:&|and)\s*([\p{{L}}\p{{N}}_]+)', '\1 & \2', 'g')"
    x = rf"regexp_replace({x}, '([\p{{L}}\p{{N}}_]+)''\s*([\p{{L}}\p{{N}}_]+)', '\1''\2', 'g')"
    for sign in "€$£":
        x = rf"regexp_replace({x}, '(\d+)\s*[{sign}]', '\1{sign}', 'g')"
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def sql_term_count(x: str) -> str:
    return "(" + " + ".join(f"CAST(contains(lower({x}), {q(w)}) AS INT)" for w in C.TERMS + C.REGIONS) + ")"


def sql_excluded(x: str) -> str:
    return matches(f"lower({x})", [p for g in C.EXCLUSIONS.values() for p in g])


def sql_item(x: str) -> str:
    low = f"lower({x})"
    return (
        rf"(length({x}) >= 3 AND NOT {sql_excluded(x)} AND (regexp_matches({low}, '\d') OR (regexp_matches({low}, '\b(19|20)\d{{2}}\b') AND {words(low, C.TERMS + C.REGIONS)})"
        f" OR {matches(low, [p for _, p, _ in C.BOTTLES])} OR {sql_term_count(x)} >= 2))"
    )


def sql_continues(x: str, before: str) -> str:
    low, prev = f"lower({x})", f"lower({before})"
    return (
        rf"(regexp_matches({low}, '^[a-z&;|\-–(]') OR (regexp_matches({prev}, '\d') AND NOT regexp_matches({low}, '\d'))"
        rf" OR ({words(prev, C.HOUSE_TERMS)} AND len(list_filter(regexp_split_to_array({low}, '\s+'), lambda t: t <> '')) <= 3))"
    )


def sql_bottle(x: str, what: int) -> str:
    whens = " ".join(f"WHEN regexp_matches(lower({x}), {q(b[1])}) THEN {q(b[0]) if what == 0 else b[2]}" for b in C.BOTTLES)
    return f"CASE {whens} ELSE {q('standard') if what == 0 else 750} END"


def sql_variants(x: str) -> str:
    return "concat_ws(','," + ", ".join(f"CASE WHEN regexp_matches(lower({x}), {q(p)}) THEN {q(n)} END" for n, p in C.VARIANTS) + ")"


def sql_level(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {matches(x, C.HEADER_PATTERNS[n])} OR {words(f'lower({x})', C.HEADER_WORDS[n])} THEN {n}" for n in (1, 2, 3)) + " END"


PAGE_TEXT = """pt AS (SELECT file_id, page, string_agg(lower(text), ' ' ORDER BY line_no) AS page_text, count(*) AS n_lines,
  bool_and(regexp_matches(trim(text), '^\\d+$')) AS all_numbers, bool_and(length(trim(text)) < 10) AS all_short FROM lines GROUP BY file_id, page)"""
OFF = f"off AS (SELECT file_id, page FROM pt WHERE n_lines < 2 OR {words('page_text', C.OFF_PAGE_WORDS)} OR all_numbers OR all_short)"
CONTENTS = rf"""cl AS (SELECT l.file_id, l.page, l.line_no, trim(regexp_extract(l.text, '(.+?)(?:\.+\s*|\s*-\s*|\s*\.\s*)(\d+)$', 1)) AS section,
  CAST(regexp_extract(l.text, '(.+?)(?:\.+\s*|\s*-\s*|\s*\.\s*)(\d+)$', 2) AS INT) AS page_num
  FROM lines l JOIN pt USING (file_id, page) WHERE {words("page_text", C.CONTENTS_WORDS)} AND regexp_matches(l.text, '(.+?)(?:\.+\s*|\s*-\s*|\s*\.\s*)(\d+)$'))"""
CLEANED = f"""pl AS (SELECT l.file_id, l.restaurant_id, l.page, l.line_no, {sql_normalize("l.text")} AS text,
  CASE WHEN l.file_id IN (SELECT file_id FROM cl) THEN l.page END AS contents_page
  FROM lines l WHERE NOT EXISTS (SELECT 1 FROM off WHERE off.file_id = l.file_id AND off.page = l.page))"""
SECTIONS = f"""lv AS (SELECT *, {sql_level("text")} AS level FROM pl WHERE text <> ''),
s1 AS (SELECT *, sum(CASE WHEN level = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY page, line_no) AS g1 FROM lv),
s2 AS (SELECT *, sum(CASE WHEN level = 2 THEN 1 ELSE 0 END) OVER (PARTITION BY file_id, g1 ORDER BY page, line_no) AS g2 FROM s1),
sc AS (SELECT *, first_value(CASE WHEN g1 > 0 THEN text END) OVER (PARTITION BY file_id, g1 ORDER BY page, line_no) AS section,
  last_value(CASE WHEN level = 2 THEN text END IGNORE NULLS) OVER (PARTITION BY file_id, g1 ORDER BY page, line_no) AS sub_section,
  last_value(CASE WHEN level = 3 THEN text END IGNORE NULLS) OVER (PARTITION BY file_id, g1, g2 ORDER BY page, line_no) AS sub_sub_section FROM s2)"""
ENTRIES = f"""it AS (SELECT *, sum(CASE WHEN {sql_item("text")} THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY page, line_no) AS entry_no FROM sc),
gr AS (SELECT file_id, entry_no, list(text ORDER BY page, line_no) AS texts, arg_min(struct_pack(page := page, line_no := line_no, text := text, restaurant_id := restaurant_id,
  section := section, sub_section := sub_section, sub_sub_section := sub_sub_section), line_no) AS head FROM it WHERE entry_no > 0 GROUP BY file_id, entry_no),
fo AS (SELECT *, list_reduce(list_prepend(struct_pack(raw := head.text, last := head.text, n := 1), list_transform(texts, lambda t: struct_pack(raw := t, last := t, n := 1))),
  lambda a, x: CASE WHEN {sql_continues("x.last", "a.last")} THEN struct_pack(raw := a.raw || ' ' || x.last, last := x.last, n := a.n + 1) ELSE a END) AS f FROM gr),
en AS (SELECT concat_ws('-', file_id, CAST(entry_no AS VARCHAR)) AS entry_id, file_id, CAST(entry_no AS BIGINT) AS entry_no, head.page AS page, head.line_no AS line_no, f.raw AS raw_text, f.n AS n_lines,
  head.restaurant_id AS restaurant_id, head.section AS section, head.sub_section AS sub_section, head.sub_sub_section AS sub_sub_section,
  {sql_bottle("head.text", 0)} AS bottle_size, {sql_bottle("head.text", 1)} AS bottle_size_ml, {sql_variants("head.text")} AS variants FROM fo)"""
TO_PAGES = f"{with_views('lines')}, {PAGE_TEXT}"
TO_CLEAN = f"{TO_PAGES}, {OFF}, {CONTENTS}, {CLEANED}"
TO_SECTIONS = f"{TO_CLEAN}, {SECTIONS}"
TO_ENTRIES = f"{TO_SECTIONS}, {ENTRIES}"
PROSE = "prose AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text FROM documents)"


def lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lines")


def entries(spark: SparkSession, d: str) -> DataFrame:
    return segment.segment_entries(sections.with_sections(pages.preprocess_lines(lines(spark, d))))


def prose(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.explode_outer(F.split("text", "\n", -1)).alias("text"))


# ---- queries --------------------------------------------------------------------------------------------------------


@book.add("normalize_text", f"WITH {PROSE} SELECT doc_id, text, {sql_normalize('text')} AS clean FROM prose UNION ALL SELECT 0, text, {sql_normalize('text')} FROM ({with_views('lines')} SELECT * FROM lines)")
def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    both = prose(spark, d).unionByName(lines(spark, d).select(F.lit(0).cast("long").alias("doc_id"), "text"))
    return both.withColumn("clean", T.normalize_text(F.col("text")))


@book.add("bottle_size", f"{with_views('lines')} SELECT file_id, line_no, {sql_bottle('text', 0)} AS name, {sql_bottle('text', 1)} AS ml FROM lines")
def bottle_size(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).select("file_id", "line_no", T.bottle(F.col("text")).alias("b")).select("file_id", "line_no", "b.name", "b.ml")


@book.add("variants", f"{with_views('lines')} SELECT file_id, line_no, {sql_variants('text')} AS tags FROM lines")
def variants(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).select("file_id", "line_no", F.array_join(T.variants(F.col("text")), ",").alias("tags"))


@book.add(
    "excluded_lines",
    f"{with_views('lines')} SELECT file_id, line_no, CASE " + " ".join(f"WHEN {matches('lower(text)', p)} THEN {q(g)}" for g, p in C.EXCLUSIONS.items()) + f" END AS reason FROM lines WHERE {sql_excluded('text')}",
)
def excluded_lines(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).select("file_id", "line_no", T.exclusion_group(F.col("text")).alias("reason")).where("reason is not null")


@book.add("item_lines", f"{with_views('lines')} SELECT file_id, line_no, text FROM lines WHERE {sql_item('text')}")
def item_lines(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).where(T.is_item(F.col("text"))).select("file_id", "line_no", "text")


@book.add("term_count", f"{with_views('lines')} SELECT file_id, line_no, {sql_term_count('text')} AS n FROM lines")
def term_count(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).select("file_id", "line_no", T.term_count(F.col("text")).alias("n"))


@book.add("continuation_flag", f"{with_views('lines')}, w AS (SELECT *, lag(text) OVER (PARTITION BY file_id ORDER BY line_no) AS before FROM lines) SELECT file_id, line_no, {sql_continues('text', 'before')} AS flag FROM w WHERE before IS NOT NULL")
def continuation_flag(spark: SparkSession, d: str) -> DataFrame:
    df = lines(spark, d).withColumn("before", F.lag("text").over(Window.partitionBy("file_id").orderBy("line_no"))).where("before is not null")
    return df.select("file_id", "line_no", T.is_continuation(F.col("text"), F.col("before")).alias("flag"))


@book.add("non_content_pages", f"{TO_PAGES}, {OFF} SELECT * FROM off")
def non_content_pages(spark: SparkSession, d: str) -> DataFrame:
    return pages.non_content_pages(lines(spark, d))


@book.add("contents_pages", f"{TO_PAGES}, {CONTENTS} SELECT DISTINCT file_id, page FROM cl")
def contents_pages(spark: SparkSession, d: str) -> DataFrame:
    return pages.contents_pages(lines(spark, d))


@book.add("contents_mapping", f"{TO_PAGES}, {CONTENTS} SELECT file_id, section, arg_max(page_num, page * 100000 + line_no) AS page_num FROM cl GROUP BY file_id, section")
def contents_mapping(spark: SparkSession, d: str) -> DataFrame:
    return pages.contents_mapping(lines(spark, d))


@book.add("preprocess_lines", f"{TO_CLEAN} SELECT file_id, page, line_no, text, contents_page FROM pl WHERE text <> ''")
def preprocess_lines(spark: SparkSession, d: str) -> DataFrame:
    return pages.preprocess_lines(lines(spark, d)).select("file_id", "page", "line_no", "text", "contents_page")


@book.add("header_level", f"{with_views('lines')} SELECT file_id, line_no, {sql_level('text')} AS level FROM lines")
def header_level(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).select("file_id", "line_no", T.header_level(F.col("text")).alias("level"))


@book.add("section_context", f"{TO_SECTIONS} SELECT file_id, line_no, level, section, sub_section, sub_sub_section FROM sc")
def section_context(spark: SparkSession, d: str) -> DataFrame:
    return sections.with_sections(pages.preprocess_lines(lines(spark, d))).select("file_id", "line_no", "level", "section", "sub_section", "sub_sub_section")


@book.add("segment_entries", f"{TO_ENTRIES} SELECT * FROM en")
def segment_entries(spark: SparkSession, d: str) -> DataFrame:
    return entries(spark, d).withColumn("variants", F.array_join("variants", ","))


@book.add("assemble_entries", f"{TO_ENTRIES} SELECT file_id, count(*) AS entries, sum(n_lines) AS lines, sum(length(raw_text)) AS chars FROM en GROUP BY file_id")
def assemble_entries(spark: SparkSession, d: str) -> DataFrame:
    return entries(spark, d).groupBy("file_id").agg(F.count("*").alias("entries"), F.sum("n_lines").alias("lines"), F.sum(F.char_length("raw_text")).alias("chars"))


@book.add("scan_lines", f"{with_views('blocks')} SELECT file_id, page, line_no, trim(text) AS text, 'text' AS source FROM blocks WHERE trim(text) <> ''")
def scan_lines(spark: SparkSession, d: str) -> DataFrame:
    return readers.scan_lines(table(spark, d, "blocks"))


@book.add(
    "page_source_fallback",
    f"""{with_views("blocks", "ocr")}, t AS (SELECT file_id, page, line_no, trim(text) AS text, 'text' AS source FROM blocks WHERE trim(text) <> ''),
o AS (SELECT file_id, page, string_split(ocr_text, chr(10)) AS parts FROM ocr WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.file_id = ocr.file_id AND t.page = ocr.page)),
u AS (SELECT file_id, page, unnest(range(1, len(parts) + 1)) AS line_no, unnest(parts) AS text FROM o)
SELECT * FROM t UNION ALL SELECT file_id, page, CAST(line_no AS INT), trim(text), 'ocr' FROM u WHERE trim(text) <> ''""",
)
def page_source_fallback(spark: SparkSession, d: str) -> DataFrame:
    return readers.with_recognition(table(spark, d, "blocks"), table(spark, d, "ocr"))


DATED = r"""coalesce(TRY_CAST(nullif(replace(regexp_extract(filename, '(20[0-9]{2}[-_][0-9]{2}[-_][0-9]{2})', 1), '_', '-'), '') AS DATE),
  CAST(try_strptime(nullif(regexp_extract(filename, '(20[0-9]{6})', 1), ''), '%Y%m%d') AS DATE))"""
META = r"CAST(try_strptime(nullif(regexp_extract(coalesce(nullif(creation_date, ''), mod_date), '^D:([0-9]{8})', 1), ''), '%Y%m%d') AS DATE)"


@book.add("date_from_filename", f"{with_views('files')} SELECT id, CAST({DATED} AS VARCHAR) AS day FROM files")
def date_from_filename(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "files").select("id", T.date_in_filename(F.col("filename")).cast("string").alias("day"))


@book.add("date_from_metadata", f"{with_views('files')} SELECT id, CAST({META} AS VARCHAR) AS day FROM files")
def date_from_metadata(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "files").select("id", T.date_in_metadata(F.col("creation_date"), F.col("mod_date")).cast("string").alias("day"))


@book.add("resolve_list_date", f"{with_views('files')} SELECT id, CAST(coalesce(TRY_CAST(user_date AS DATE), {DATED}, {META}, DATE '{RUN_DATE}') AS VARCHAR) AS day FROM files")
def resolve_list_date(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "files").select("id", T.list_date(F.col("user_date"), F.col("filename"), F.col("creation_date"), F.col("mod_date"), RUN_DATE).cast("string").alias("day"))


@book.add("safe_filename", f"{with_views('files')} SELECT id, regexp_replace(filename, '[^a-zA-Z0-9_.-]', '_', 'g') AS name FROM files")
def safe_filename(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "files").select("id", T.safe_filename(F.col("filename")).alias("name"))

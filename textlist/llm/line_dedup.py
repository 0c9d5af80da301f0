"""Line dedup: range-partitioned line hashes, streamed first occurrences, keep bitmaps.

All work is DataFrame functions. The line's key is the line without ASCII white space at its
ends and with A-Z in lower case. Keys are stood for by 128 hash bits.

Defined results: a null or empty text is one empty line; very long texts are split whole; a null doc_id is one document that
sorts before all others; rows that repeat a doc_id are one document when lines are counted, and each of them has its own keep
bitmap, found by a hash of its text; all lines of the largest doc_id stay, also within one text; an empty table gives an empty
result; columns other than the id and the text are handed on, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_names, save

SPACE = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z only; ``lower`` is the same, and faster, where all bytes are ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def long_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """``(h1, h2, doc, print, pos)`` of each line whose key has at least ``min_chars`` code points; ``print`` is a hash of the text."""
    rows = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("print"), F.posexplode(lines_of(F.col(text_col))).alias("pos", "line"))
    rows = rows.where(F.octet_length("line") >= min_chars).select("doc", "print", "pos", F.trim("line", F.lit(SPACE)).alias("line"))
    rows = rows.where(F.char_length("line") >= min_chars).select("doc", "print", "pos", lower_ascii(F.col("line")).alias("key"))
    return rows.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"), "doc", "print", "pos")


def dropped_lines(rows: DataFrame, min_docs: int, heavy_rows: int = 2000, salts: int = 64) -> DataFrame:
    """``(doc, print, pos)`` of the lines that go.

    Hashes are range-partitioned and sorted by (hash, document descending, position); a window streams over each hash's run, whose
    first row is the occurrence that stays. No run has over ``heavy_rows`` rows: a hash with more is settled by aggregates that are
    combined before the shuffle, and its rows meet the result in ``salts`` parts.
    """
    key = ["h1", "h2"]
    heavy = save(rows.groupBy(*key).count().where(F.col("count") > heavy_rows).select(*key), "heavy-lines")

    run = Window.partitionBy(*key).orderBy(F.desc_nulls_last("doc"), "pos")
    whole = Window.partitionBy(*key)
    light = rows.join(heavy, key, "left_anti").repartitionByRange(*key).sortWithinPartitions(*key, F.desc_nulls_last("doc"), "pos")
    light = light.withColumn("first", F.when((F.row_number().over(run) == 1) | ~F.lag("doc").over(run).eqNullSafe(F.col("doc")), 1).otherwise(0))
    light = light.withColumns({"n": F.sum("first").over(whole), "last": F.max("doc").over(whole)})
    light = light.where((F.col("n") >= min_docs) & ~F.col("doc").eqNullSafe(F.col("last"))).select("doc", "print", "pos")

    salt = F.pmod(F.xxhash64("doc", "print", "pos"), F.lit(salts)).alias("salt")
    salted = heavy.select(*key, F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")).alias("salt"))
    hot = save(rows.select("*", salt).join(salted, [*key, "salt"]), "hot-lines")
    settled = hot.select(*key, "doc").distinct().groupBy(*key).agg(F.count("*").alias("n"), F.max("doc").alias("last")).where(F.col("n") >= min_docs)
    settled = settled.select("*", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")).alias("salt"))
    hot = hot.join(settled, [*key, "salt"]).where(~F.col("doc").eqNullSafe(F.col("last"))).select("doc", "print", "pos")
    return light.unionByName(hot)


def keep_bitmaps(dropped: DataFrame) -> DataFrame:
    """``(doc, print, keep)``: a sparse bitmap of 64-bit words, word number to bits; bit 1 stays.

    A word without dropped lines is left out, and so is a text without any. Repeated rows give the same bits.
    """
    words = dropped.groupBy("doc", "print", F.expr("cast(pos div 64 as int)").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits"))
    return words.groupBy("doc", "print").agg(F.map_from_entries(F.collect_list(F.struct("word", F.bitwise_not("bits")))).alias("keep"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5, heavy_rows: int = 2000) -> DataFrame:
    """``docs`` plus ``n_lines``, ``n_dropped`` and ``kept_text``, the text without its repeated lines.

    Where ``docs`` has a column of such a name, the new one has underscores before it.
    """
    rows = save(long_lines(docs, id_col, text_col, min_chars), "long-lines")
    n_lines, n_dropped, kept_text, doc, print_, keep, lines, words, kept = free_names(docs, "n_lines", "n_dropped", "kept_text", "doc", "print", "keep", "lines", "words", "kept")
    bitmaps = keep_bitmaps(dropped_lines(rows, min_docs, heavy_rows)).toDF(doc, print_, keep)
    out = docs.join(bitmaps, docs[id_col].eqNullSafe(bitmaps[doc]) & (F.xxhash64(docs[text_col]) == bitmaps[print_]), "left").withColumn(lines, lines_of(F.col(text_col)))
    dense = F.transform(F.sequence(F.lit(0), F.shiftright(F.size(lines) - 1, 6)), lambda w: F.coalesce(F.try_element_at(keep, w), F.lit(-1).cast("long")))
    out = out.withColumn(words, F.when(F.col(keep).isNotNull(), dense))
    stay = F.filter(lines, lambda _, i: F.getbit(F.get(words, F.shiftright(i, 6)), i.bitwiseAND(F.lit(63))) == 1)
    out = out.withColumn(kept, F.when(F.col(words).isNotNull(), stay))
    return out.withColumns({
        n_lines: F.size(lines).cast("long"),
        n_dropped: F.coalesce((F.size(lines) - F.size(kept)).cast("long"), F.lit(0).cast("long")),
        kept_text: F.when(F.col(kept).isNull(), F.coalesce(F.col(text_col), F.lit(""))).otherwise(F.array_join(kept, "\n")),
    }).drop(doc, print_, keep, lines, words, kept)


def without_repeated_lines(docs: DataFrame, text_col: str = "text", **options: int | str) -> DataFrame:
    """``docs`` with the text without its repeated lines, columns as they are; a null text becomes the empty one."""
    out = line_dedup(docs, text_col=text_col, **options)
    kept = out.columns[-1]
    return out.select(*[F.col(kept).alias(c) if c == text_col else F.col(c) for c in docs.columns])


def line_dedup_digest(docs: DataFrame) -> DataFrame:
    """The query's columns."""
    out = line_dedup(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
k AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, count(DISTINCT doc_id) AS n, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key),
f AS (SELECT k.doc_id, k.pos, k.line, c.n >= 5 AND k.doc_id <> c.last AS gone FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE gone IS NOT TRUE), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""

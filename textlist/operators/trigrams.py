"""Substring search by posting lists of character trigrams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import new_folder, saved

#: Stand before and behind a text, so that short queries are inside some trigram too; no query has it.
EDGE = "\u0000"
#: Folders that postings are kept in, by trigram.
FOLDERS = 64


def folder_of(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(FOLDERS)).cast("int")


def build(rows: DataFrame) -> DataFrame:
    """The postings ``(gram, id, folder)`` of ``rows(id, text)``, written by folder; a query reads only its trigrams' folders. Null texts have none.

    A posting is a row, so a trigram that all texts have is no single value.
    """
    text = F.concat(F.lit(EDGE * 2), F.lower("text"), F.lit(EDGE * 2))
    grams = F.transform(F.sequence(F.lit(1), F.char_length(text) - 2), lambda i: F.substring(text, i, F.lit(3)))
    postings = rows.where("text is not null").select("id", F.explode(F.array_distinct(grams)).alias("gram")).withColumn("folder", folder_of(F.col("gram")))
    path = new_folder(rows.sparkSession, "trigrams")
    postings.repartition("folder", "gram").sortWithinPartitions("folder", "gram").write.partitionBy("folder").parquet(path)
    return rows.sparkSession.read.schema("gram string, id " + rows.schema["id"].dataType.simpleString() + ", folder int").parquet(path)


def search(postings: DataFrame, rows: DataFrame, query: str) -> DataFrame:
    """The ``rows(id, text)`` whose text holds ``query``, letters' case aside: rows that hold all its trigrams, verified. Rows may share an id."""
    said = query.lower()
    if not said:
        return rows.where("text is not null")
    if len(said) < 3:
        found = postings.where(F.contains("gram", F.lit(said))).select("id").distinct()
    else:
        grams = sorted({said[i : i + 3] for i in range(len(said) - 2)})
        folders = [r[0] for r in rows.sparkSession.createDataFrame([(g,) for g in grams], "gram string").select(folder_of(F.col("gram"))).distinct().collect()]
        own = postings.where(F.col("folder").isin(folders) & F.col("gram").isin(grams))
        found = own.groupBy("id").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(grams)).select("id")
    return rows.join(found, "id", "left_semi").where(F.contains(F.lower("text"), F.lit(said)))


def texts_of(rows: DataFrame) -> DataFrame:
    """``(id, text)``: the distinct texts of ``rows``, numbered. An index of these takes the room of what is said, not of how often."""
    texts = rows.where("text is not null").select("text").distinct()
    return saved(texts.select(F.monotonically_increasing_id().alias("id"), "text"), "texts")


def search_all(postings: DataFrame, texts: DataFrame, rows: DataFrame, queries: list[str]) -> DataFrame:
    """``(query, id)`` of the ``rows(id, text)`` whose text holds a query: each is looked up among ``texts`` by their ``postings``, and the rows are read once for all."""
    found = None
    for query in queries:
        own = search(postings, texts, query).select(F.lit(query).alias("query"), "text")
        found = own if found is None else found.unionByName(own)
    return rows.join(saved(found, "found"), "text").select("query", "id")

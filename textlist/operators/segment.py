"""Lines to entries: an item line opens one, continuation lines join it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bottle, is_continuation, is_item, line_traits, variants
from .chunks import carried, chunked


def segment_entries(lines: DataFrame, echo_head: bool = True, chunk: int | None = None) -> DataFrame:
    """One row for each entry. A line joins if it continues the line joined last, which no fixed offset finds, so the lines of an
    entry are folded in order. With ``echo_head`` the head is tried against itself too, and stands twice if it passes. With ``chunk`` a file is worked on in
    chunks of about so many lines, as ``by_chunks`` says.
    """
    order = ["page", "line_no"]
    if chunk:
        return by_chunks(lines, echo_head, chunk)
    so_far = Window.partitionBy("file_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    df = lines.where(F.trim("text") != "").withColumn("entry_no", F.sum(is_item(F.col("text")).cast("int")).over(so_far)).where("entry_no > 0")
    context = [c for c in ("restaurant_id", "section", "sub_section", "sub_sub_section") if c in df.columns]
    row = F.struct(*order, "text", *context)
    df = df.groupBy("file_id", "entry_no").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    df = df.withColumn("head", F.col("rows")[0])
    start = F.struct(F.col("head.text").alias("raw"), F.col("head.text").alias("last"), F.lit(1).alias("n"))
    rest = F.col("rows") if echo_head else F.slice("rows", F.lit(2), F.size("rows"))

    def join(acc, line):  # noqa: ANN001, ANN202
        more = F.struct(F.concat_ws(" ", acc["raw"], line["text"]).alias("raw"), line["text"].alias("last"), (acc["n"] + 1).alias("n"))
        return F.when(is_continuation(line["text"], acc["last"]), more).otherwise(acc)

    df = df.withColumn("fold", F.aggregate(rest, start, join))
    return entry_rows(df.withColumns({"raw_text": F.col("fold.raw"), "n_lines": F.col("fold.n")}), context)


def entry_rows(df: DataFrame, context: list[str]) -> DataFrame:
    """Entries as they leave: the head's place, context, size and variants."""
    df = df.withColumn("size", bottle(F.col("head.text")))
    return df.select(
        F.concat_ws("-", "file_id", "entry_no").alias("entry_id"), "file_id", "entry_no", F.col("head.page").alias("page"), F.col("head.line_no").alias("line_no"), "raw_text", "n_lines",
        *[F.col(f"head.{c}").alias(c) for c in context], F.col("size.name").alias("bottle_size"), F.col("size.ml").alias("bottle_size_ml"), variants(F.col("head.text")).alias("variants"),
    )


def by_chunks(lines: DataFrame, echo_head: bool, chunk: int) -> DataFrame:
    """``segment_entries`` for files, or entries, of very many lines.

    Of the line joined last only two things count: whether it has a price and a house's term. So what a chunk does to an open entry is a table of four states, made within the
    chunk; tables of the chunks before, one row each, give the state in which a chunk's part of an entry begins, and then each part is folded by itself.
    """
    order, part = ["page", "line_no"], ["file_id", "entry_no", "_chunk"]
    so_far = Window.partitionBy("file_id", "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    df = chunked(lines.where(F.trim("text") != ""), chunk).withColumns({"item": is_item(F.col("text")).cast("int"), **line_traits(F.col("text"))})
    df = carried(df, {"_before": F.sum("item")}, {"_before": "sum"})
    df = df.withColumn("entry_no", F.sum("item").over(so_far) + F.coalesce("_before", F.lit(0))).where("entry_no > 0")
    context = [c for c in ("restaurant_id", "section", "sub_section", "sub_sub_section") if c in df.columns]
    row = F.struct(*order, "text", "item", "lead", "price", "house", "few", *context)
    df = df.groupBy(*part).agg(F.array_sort(F.collect_list(row)).alias("rows")).withColumn("first", F.col("rows")[0])
    df = df.withColumn("head", F.when(F.col("first.item") == 1, F.col("first"))).drop("first")
    rest = F.col("rows") if echo_head else F.when(F.col("head").isNull(), F.col("rows")).otherwise(F.slice("rows", F.lit(2), F.size("rows")))
    state = lambda x: x["price"].cast("int") + 2 * x["house"].cast("int")
    joins = lambda s, x: x["lead"] | ((s % 2 == 1) & ~x["price"]) | ((s >= 2) & x["few"])
    step = lambda s, x: F.when(joins(s, x), state(x)).otherwise(s)
    begin = F.when(F.col("head").isNull(), F.array(*map(F.lit, range(4)))).otherwise(F.array_repeat(state(F.col("head")), 4))
    df = df.withColumn("rest", rest).drop("rows").withColumn("table", F.aggregate("rest", begin, lambda t, x: F.transform(t, lambda s: step(s, x))))
    before = Window.partitionBy("file_id", "entry_no").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("tables", F.collect_list("table").over(before))  # one for each chunk that the entry spans
    enter = F.aggregate("tables", F.lit(0), lambda s, t: F.get(t, s))
    enter = F.when(F.col("head").isNull(), enter).otherwise(state(F.col("head")))
    none = F.array().cast("array<string>")
    fold = lambda acc, x: F.when(joins(acc["s"], x), F.struct(state(x).alias("s"), F.array_append(acc["said"], x["text"]).alias("said"))).otherwise(acc)
    df = df.withColumn("said", F.aggregate("rest", F.struct(enter.alias("s"), none.alias("said")), fold)["said"])
    parts = F.array_sort(F.collect_list(F.struct("_chunk", "said")))
    df = df.groupBy("file_id", "entry_no").agg(F.max("head").alias("head"), parts.alias("parts"))
    said = F.flatten(F.transform("parts", lambda p: p["said"]))
    return entry_rows(df.withColumns({"raw_text": F.array_join(F.concat(F.array("head.text"), said), " "), "n_lines": 1 + F.size(said)}), context)

"""Mixing sources to target weights along a time-varying curriculum.

A source's weight is a piecewise-linear function of training time 0..1. Its integral is the weight
that shares out the mix; the inverse of its running integral says when each of its words is
due, and documents are range-sorted by that position.

Steps, all DataFrame functions: words per document; words per source; capped shares in closed
form (fill sources in the order of cap over weight); a two-level running sum (bucket totals, then
rows in a bucket) in an order dealt by md5 of the id, so that a source with a third
of all rows is spread over its buckets; positions by inverting the curriculum.

A source whose target is r times its size is passed over floor(r) times in whole; the rest goes to
documents in md5 order, the last of them in part, so a source's words meet its target to within one.

Defined results: null text has size 0 and takes 0; null source is a source of its own, after all
others; null ids share one place in the order; rows that repeat are documents of their own; with
no words at all, targets and words taken are 0; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import math
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, save

#: Weight schedules, dealt to the sources in turn: (time, weight) knots whose integrals are 5, 2 and 1.
CURRICULUM = (((0.0, 7.5), (1.0, 2.5)), ((0.0, 2.0), (1.0, 2.0)), ((0.0, 0.5), (1.0, 1.5)))


def integral(knots: tuple[tuple[float, float], ...]) -> float:
    return sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False))


def inverse(knots: tuple[tuple[float, float], ...], share: Column) -> Column:
    """The time at which ``share`` of the schedule's whole integral is reached."""
    whole, area, out = integral(knots), 0.0, None
    for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
        y, slope = share * whole - area, (w1 - w0) / (t1 - t0)
        at = t0 + 2 * y / (w0 + F.sqrt(F.greatest(F.lit(0.0), w0 * w0 + 2 * slope * y)))
        area += (t1 - t0) * (w0 + w1) / 2
        out = F.when(share * whole <= area, at) if out is None else out.when(share * whole <= area, at)
    return F.least(F.lit(1.0), out.otherwise(knots[-1][0]))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(per_source: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """``(source, source_size, turn, target)``: weighted shares of ``share`` times all sizes, each at most ``most`` times its source.

    Filled in the order of cap over weight, the level at which the rest is shared rises until the
    first source that does not reach its cap, so the final level is the largest.
    """
    order = Window.orderBy(F.asc_nulls_last("source"))
    s = per_source.withColumn("turn", ((F.row_number().over(order) - 1) % len(weights)).cast("int"))
    s = s.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), F.col("turn") + 1)).withColumn("cap", most * F.col("source_size"))
    fill = Window.orderBy(F.col("cap") / F.col("w"), F.asc_nulls_last("source"))
    s = s.withColumns({"all": F.sum("source_size").over(Window.partitionBy()), "before": F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)), "rest": F.sum("w").over(fill.rowsBetween(0, Window.unboundedFollowing))})
    s = s.withColumn("level", F.max((share * F.col("all") - F.col("before")) / F.col("rest")).over(Window.partitionBy()))
    return s.select("source", "source_size", "turn", F.least(F.col("cap"), F.col("level") * F.col("w")).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", curriculum: tuple = CURRICULUM, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``(doc_id, size, source_size, target, taken, position, positions)``, range-sorted by position.

    ``positions`` has one training position for each pass over the document; ``position`` is the first.
    """
    sized = save(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")), "sized")
    digits = max(1, min(7, round(math.log(math.sqrt(max(1, sized.count())), 16))))
    weights = [integral(k) for k in curriculum]
    goal = save(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "targets")

    sized = sized.withColumn("order", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).withColumn("bucket", F.substring("order", 1, digits))
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit(""))  # null joins null
    sums = sized.groupBy(key.alias("key"), "bucket").agg(F.sum("size").alias("bucket_size"))
    base = sums.select("key", "bucket", (F.sum("bucket_size").over(Window.partitionBy("key").orderBy("bucket")) - F.col("bucket_size")).alias("base"))
    base = base.join(goal.select(key.alias("key"), "source_size", "turn", "target"), "key")
    inside = Window.partitionBy("key", "bucket").orderBy("order", F.asc_nulls_first("doc_id"), "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = sized.withColumn("key", key).withColumn("within", F.sum("size").over(inside) - F.col("size")).join(base, ["key", "bucket"])

    rows = rows.withColumn("start", F.col("base") + F.col("within"))
    rows = rows.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    extra = F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), F.floor(F.col("target") - F.col("passes") * F.col("source_size")) - F.col("start")))
    rows = rows.withColumn("extra", F.when(F.col("size") > 0, extra).otherwise(0)).withColumn("taken", (F.col("passes") * F.col("size") + F.col("extra")).cast("long"))
    turns = (F.col("passes") + F.when(F.col("extra") > 0, 1).otherwise(0)).cast("int")
    rows = rows.withColumn("shares", F.when(F.col("taken") > 0, F.transform(F.sequence(F.lit(0), turns - 1), lambda p: (p * F.col("source_size") + F.col("start")) / F.col("target"))))
    due = None
    for turn, knots in enumerate(curriculum):
        at = F.transform(F.col("shares"), partial(inverse, knots))
        due = F.when(F.col("turn") == turn, at) if due is None else due.when(F.col("turn") == turn, at)
    rows = rows.withColumn("positions", due).withColumn("position", F.round(F.get("positions", F.lit(0)), 6))
    rows = rows.repartitionByRange(F.asc_nulls_last("position"), "order").sortWithinPartitions(F.asc_nulls_last("position"), "order")
    return rows.select("doc_id", "size", "source_size", "target", "taken", "position", "positions")


def mix_digest(docs: DataFrame) -> DataFrame:
    """The query's columns."""
    return mix(docs).drop("positions")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS o FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
             (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS turn FROM d GROUP BY source),
w AS (SELECT *, CASE turn WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, 2.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, turn, least(cap, (SELECT max(level) FROM l) * w) AS target FROM l),
r AS (
  SELECT d.doc_id, d.size, t.*, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS passes,
         CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY o, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS BIGINT) - d.size AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
x AS (SELECT *, CASE WHEN size > 0 THEN least(size, greatest(0, CAST(floor(target - passes * source_size) AS BIGINT) - start)) ELSE 0 END AS extra FROM r)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(passes * size + extra AS BIGINT) AS taken,
  CASE WHEN passes * size + extra > 0 THEN round(least(1.0, CASE turn
    WHEN 0 THEN 2 * (start / target * 5) / (7.5 + sqrt(greatest(0.0, 7.5 * 7.5 + 2 * -5.0 * (start / target * 5))))
    WHEN 1 THEN 2 * (start / target * 2) / (2.0 + sqrt(greatest(0.0, 2.0 * 2.0)))
    ELSE 2 * (start / target) / (0.5 + sqrt(greatest(0.0, 0.5 * 0.5 + 2 * 1.0 * (start / target)))) END), 6) END AS position
FROM x
"""

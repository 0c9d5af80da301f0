"""Matching items with a catalogue: exact by the fields an item has, then fuzzy."""

from __future__ import annotations

from functools import reduce

from pyspark.accumulators import Accumulator
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.similarity import sorted_ratio, sorted_tokens
from . import metric_index, threshold
from .lineage import saved

DESIGNATION = r"\s+(?:grand\s+cru|premier\s+cru|1er\s+cru)$"


def clean(value: Column) -> Column:
    return F.lower(F.trim(F.coalesce(value, F.lit(""))))


def normalize_catalog(catalog: DataFrame) -> DataFrame:
    """``catalog`` with its nulls as '', a ``_norm`` column for each key field and the composite key."""
    norms = {f"{k}_norm": clean(F.col(C.KEY_COLUMNS[k])) if C.KEY_COLUMNS.get(k) in catalog.columns else F.lit("") for k in C.KEYS}
    df = catalog.withColumns(norms)
    df = df.withColumn("composite_key", F.array_join(F.filter(F.array(*norms), lambda x: x != ""), " "))
    return df.withColumns({c: F.trim(F.coalesce(c, F.lit(""))) for c, t in catalog.dtypes if t == "string"})


def latest_aliases(aliases: DataFrame) -> DataFrame:
    """``(field, original, corrected)``: the last correction of each, lower-case and trimmed, both sides filled."""
    df = aliases.select("field", clean(F.col("original")).alias("original"), clean(F.col("corrected")).alias("corrected"), "seq")
    return df.where("original <> '' and corrected <> ''").groupBy("field", "original").agg(F.max_by("corrected", "seq").alias("corrected"))


def apply_aliases(items: DataFrame, aliases: DataFrame) -> DataFrame:
    """``items`` with corrected producer and cuvee. The join's sides are sized by Spark; nothing is forced."""
    for field in ("producer", "cuvee"):
        own = aliases.where(F.col("field") == field).select(F.col("original").alias(f"{field}_n"), F.col("corrected").alias("_fixed"))
        items = items.join(own, f"{field}_n", "left").withColumn(f"{field}_n", F.coalesce("_fixed", f"{field}_n")).drop("_fixed")
    return items


def normalize_items(items: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """``items`` with ``_n`` columns: lower-case, aliases applied, prefixes, suffixes, designations and quotes off."""
    df = items.withColumns({f"{k}_n": clean(F.col(k)) for k in C.KEYS})
    if aliases is not None:
        df = apply_aliases(df, aliases)
    producer = F.regexp_replace("producer_n", r"\s+(?:&|and)\s+.*$", "")
    producer = F.regexp_replace(F.regexp_replace(producer, r"^(?:château|domaine|estate)\s+", ""), DESIGNATION, "")
    cuvee = F.regexp_replace(F.regexp_replace("cuvee_n", r"^['\"]|['\"]$", ""), DESIGNATION, "")
    return df.withColumns({"producer_n": producer, "cuvee_n": cuvee})


def filled(k: str) -> Column:
    return F.col(f"{k}_n") != ""


def direct_match(items: DataFrame, catalog: DataFrame) -> DataFrame:
    """``(entry_id, catalog_row)``: the first catalogue row that equals the item in all fields the item has.

    Items are told apart by which fields they have. Each of the kinds that occur has the catalogue's rows with only its fields, the first of
    equal ones, and all kinds are one equality join, so no row meets the whole catalogue. Items without any field match nothing.
    """
    mask = reduce(Column.__add__, [F.when(filled(k), 1 << i).otherwise(0) for i, k in enumerate(C.KEYS)])
    names = [f"{k}_n" for k in C.KEYS]
    items = saved(items.select("entry_id", *names, mask.alias("mask")), "items")  # read for the kinds and for the join
    kinds = sorted(r["mask"] for r in items.select("mask").distinct().collect() if r["mask"])  # 63 at most
    if not kinds:
        return items.select("entry_id", F.lit(None).cast("bigint").alias("catalog_row")).where("false")
    rows = catalog.select("catalog_row", *[f"{k}_norm" for k in C.KEYS], F.explode(F.array(*map(F.lit, kinds))).alias("mask"))
    own = [F.when(F.col("mask").bitwiseAND(1 << i) > 0, F.col(f"{k}_norm")).otherwise("").alias(f"{k}_n") for i, k in enumerate(C.KEYS)]
    rows = rows.select("catalog_row", "mask", *own).groupBy("mask", *names).agg(F.min("catalog_row").alias("catalog_row"))
    return items.join(rows, ["mask", *names]).select("entry_id", "catalog_row")


def pair_score(keys: list[str] = C.KEYS) -> Column:
    """Weighted score of a joined pair over the fields the item has, from the ratio of each field's tokens."""
    parts, whole = [], []
    for k in keys:
        w, boost = C.KEY_WEIGHTS[k], C.NEAR_BOOST.get(k, 0)
        ratio = sorted_ratio(sorted_tokens(F.col(f"{k}_n")), sorted_tokens(F.col(f"{k}_norm")))
        near = F.when(ratio > 80, F.least(F.lit(100.0), ratio + boost)).otherwise(ratio) if boost else ratio
        parts.append(F.when(filled(k), F.when(F.col(f"{k}_n") == F.col(f"{k}_norm"), 100.0).otherwise(near) * w).otherwise(0.0))
        whole.append(F.when(filled(k), w).otherwise(0.0))
    total = reduce(Column.__add__, whole)
    return F.when(total > 0, reduce(Column.__add__, parts) / total).otherwise(0.0)


def grade(score: Column) -> Column:
    return F.when(score >= C.DIRECT, "direct").when(score >= C.FUZZY, "fuzzy").when(score >= C.PARTIAL, "partial").otherwise("no_match")


def score_pairs(pairs: DataFrame, items: DataFrame, catalog: DataFrame) -> DataFrame:
    """``pairs(entry_id, catalog_row)`` with the weighted ``score`` of each."""
    left, right = items.select("entry_id", *[f"{k}_n" for k in C.KEYS]), catalog.select("catalog_row", *[f"{k}_norm" for k in C.KEYS])
    return pairs.join(left, "entry_id").join(right, "catalog_row").withColumn("score", pair_score()).select("entry_id", "catalog_row", "score")


def scored_pairs(items: DataFrame, catalog: DataFrame, k: int | None = None, meter: Accumulator | None = None) -> DataFrame:
    """``(entry_id, catalog_row, score)`` of pairs at or above the partial threshold; with ``k`` only each item's best.

    Items enter the search once for each distinct key; ``threshold`` says how the search leaves out what cannot be among the best.
    """
    columns = {f: sorted_tokens(F.col(f"{f}_n")) for f in C.KEYS}
    rows = catalog.select("catalog_row", *[sorted_tokens(F.col(f"{f}_norm")).alias(f) for f in C.KEYS])
    said = saved(items.select("entry_id", *[c.alias(f) for f, c in columns.items()]), "said")
    keys = saved(distinct_keys(said), "keys")
    found = threshold.search(keys, rows, k, C.PARTIAL, meter)
    members = said.join(keys, C.KEYS).select("entry_id", "rep")
    return members.join(found, "rep").select("entry_id", "catalog_row", "score")


def told_once(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``items`` as written, and the distinct values of their fields, each with one of the items' ``entry_id``."""
    items = saved(items.select("entry_id", *[f"{k}_n" for k in C.KEYS]), "items")
    keys = distinct_keys(items)
    return items, saved(keys.select(F.col("rep").alias("entry_id"), *[f"{k}_n" for k in C.KEYS]), "told")


def for_all(items: DataFrame, keys: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """What was ``found`` for the distinct ``keys``, for each of ``items``."""
    names = [f"{k}_n" for k in C.KEYS]
    return items.join(keys.join(found, "entry_id", how).drop("entry_id"), names, how).drop(*names)


def best_match(items: DataFrame, catalog: DataFrame, threshold: float = C.PARTIAL) -> DataFrame:
    """``(entry_id, catalog_row, score, provenance)`` of every item: direct, else the best weighted score, else nulls. Equal items are looked for once."""
    items, keys = told_once(items)
    direct = saved(direct_match(keys, catalog).withColumn("score", F.lit(100.0)), "direct")
    rest = keys.join(direct, "entry_id", "left_anti")
    fuzzy = scored_pairs(rest, catalog, 1).where(F.col("score") >= threshold)
    found = direct.withColumn("provenance", F.lit("direct")).unionByName(fuzzy.withColumn("provenance", grade(F.col("score"))))
    return for_all(items, keys, found, "left")


def suggestions(items: DataFrame, catalog: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` best catalogue rows of each item, at or above the partial threshold. Equal items are looked for once."""
    items, keys = told_once(items)
    order = Window.partitionBy("entry_id").orderBy(F.desc("score"), "catalog_row")
    found = scored_pairs(keys, catalog, k).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return for_all(items, keys, found, "inner").select("entry_id", "catalog_row", "score", "rank")


def composite_match(items: DataFrame, catalog: DataFrame, meter: metric_index.Meter | None = None) -> DataFrame:
    """``(entry_id, catalog_row, score)``: the best ratio of whole keys, at or above the partial threshold; the first row on ties.

    Keys are looked up in a metric index of the catalogue's distinct keys.
    """
    items = items.withColumn("text", sorted_tokens(F.concat_ws(" ", *[f"{k}_n" for k in C.KEYS]))).where("text <> ''").select("entry_id", "text")
    items = saved(items, "said")
    rows = catalog.select("catalog_row", sorted_tokens(F.col("composite_key")).alias("text")).where("text <> ''").groupBy("text").agg(F.min("catalog_row").alias("catalog_row"))
    space = F.lit("").alias("space")
    keys = saved(distinct_keys(items), "keys")
    index = metric_index.build(rows.select(space, F.col("catalog_row").alias("id"), "text"), meter)
    found = metric_index.nearest(index, keys.select(space, "rep", "text"), 1, C.PARTIAL).select("rep", F.col("id").alias("catalog_row"), F.col("ratio").alias("score"))
    return items.join(keys, "text").join(found, "rep").select("entry_id", "catalog_row", "score")


def distinct_keys(said: DataFrame) -> DataFrame:
    """The distinct values of all columns but ``entry_id``, with one of their ``entry_id`` as ``rep``."""
    return said.groupBy(*[c for c in said.columns if c != "entry_id"]).agg(F.min("entry_id").alias("rep"))


def item_matches(items: DataFrame, catalog: DataFrame) -> DataFrame:
    """``(entry_id, catalog_row, score)``: the direct match, else the best by the whole key."""
    direct = saved(direct_match(items, catalog).withColumn("score", F.lit(100.0)), "direct")
    return direct.unionByName(composite_match(items.join(direct, "entry_id", "left_anti"), catalog))


def enrich(items: DataFrame, matches: DataFrame, catalog: DataFrame) -> DataFrame:
    """Items with empty fields filled from their match (confidence .95), and key fields of matched items at ``min(.95, score / 100)``."""
    cat = catalog.select("catalog_row", *[F.col(c).alias(f"_{k}") for k, c in C.KEY_COLUMNS.items()], F.nullif(F.col("colour"), F.lit("")).alias("_type"))
    df = items.join(matches.select("entry_id", "catalog_row", "score"), "entry_id", "left").join(cat, "catalog_row", "left")
    fields = [*C.KEY_COLUMNS, "type"]
    if "type" not in df.columns:
        df = df.withColumn("type", F.lit(None).cast("string"))
    own = {f: F.nullif(F.col(f), F.lit("")) for f in fields}
    new = {f: F.nullif(F.col(f"_{f}"), F.lit("")) for f in fields}
    sure = F.least(F.lit(0.95), F.col("score") / 100)
    marks = [F.struct(F.lit(f).alias("k"), F.when(F.col("score").isNotNull() & F.coalesce(own[f], new[f]).isNotNull() & F.lit(f in C.KEYS), sure).when(own[f].isNull() & new[f].isNotNull(), 0.95).alias("v")) for f in fields]
    df = df.withColumn("field_confidence", F.map_from_entries(F.filter(F.array(*marks), lambda x: x["v"].isNotNull())))
    return df.withColumns({f: F.coalesce(own[f], new[f]) for f in fields}).drop(*[f"_{f}" for f in fields])


def enrich_choice(items: DataFrame, matches: DataFrame, suggested: DataFrame, catalog: DataFrame) -> DataFrame:
    """Items enriched from a match of 85 or more, else by another source's values, else as they are; ``choice`` says which.

    ``suggested(entry_id, suggested)`` has a map of values. A chosen match leaves its ``lwin`` number and ``match_confidence``, its score as a share.
    """
    good = matches.where(F.col("score") >= C.FUZZY)
    numbers = catalog.select("catalog_row", "lwin")
    first = enrich(items.join(good.select("entry_id"), "entry_id", "left_semi"), good, catalog).join(numbers, "catalog_row", "left")
    first = first.withColumns({"choice": F.lit("match"), "match_confidence": F.col("score") / 100})
    rest = items.join(good.select("entry_id"), "entry_id", "left_anti").withColumns({"raw_text": F.col("entry_id"), "field_confidence": F.create_map().cast("map<string,double>"), "type": F.lit(None).cast("string")})
    said = suggested.select(F.col("entry_id").alias("raw_text"), "suggested")
    rest = merge_suggested(rest.join(said.select(F.col("raw_text").alias("entry_id"), F.lit(True).alias("_has")).distinct(), "entry_id", "left"), said, [*C.KEY_COLUMNS, "type"])
    rest = rest.withColumn("choice", F.when(F.col("_has"), "suggested").otherwise("none")).drop("_has", "raw_text")
    return first.unionByName(rest, allowMissingColumns=True)


def merge_suggested(entries: DataFrame, suggested: DataFrame, fields: list[str]) -> DataFrame:
    """Entries with another source's values by text laid over their own, at confidence .8 where it says anything."""
    first = F.struct(F.coalesce(F.to_json("suggested"), F.lit("")))
    suggested = suggested.groupBy("raw_text").agg(F.min_by("suggested", first).alias("suggested"))  # of several, the first as JSON
    df = entries.join(suggested, "raw_text", "left")
    said = F.map_filter(F.coalesce("suggested", F.create_map().cast("map<string,string>")), lambda _, v: v.isNotNull())
    df = df.withColumn("_said", said)
    marks = F.transform_values("_said", lambda _, __: F.lit(0.8))
    keep = F.map_filter(F.coalesce("field_confidence", F.create_map().cast("map<string,double>")), lambda k, _: ~F.map_contains_key("_said", k))
    df = df.withColumn("field_confidence", F.map_concat(keep, marks))
    return df.withColumns({f: F.coalesce(F.try_element_at("_said", F.lit(f)), F.col(f)) for f in fields}).drop("_said", "suggested")

"""Table upkeep in whole batches: inserts, patches, cascades, upserts, audit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import saved

#: Legal next states of a file. Fixed values.
NEXT = {"uploaded": ["processing"], "processing": ["parsed", "error"], "parsed": [], "error": ["processing"]}


def insert_defaults(table: DataFrame, new: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """``table`` and ``new`` rows; columns that ``new`` lacks take their default, or null."""
    rows = new.withColumns({c: d for c, d in defaults.items() if c not in new.columns})
    return table.unionByName(rows.select(*[c for c in table.columns if c in rows.columns]), allowMissingColumns=True)


def patch_rows(table: DataFrame, patches: DataFrame, key: str, fields: list[str], only_patched: bool = False) -> DataFrame:
    """Fields named in a row's ``changes`` map take its value, null included; unknown ids change nothing."""
    df = table.join(patches.select(key, "changes"), key, "inner" if only_patched else "left")
    new = {f: F.when(F.map_contains_key(F.coalesce("changes", F.create_map().cast("map<string,string>")), F.lit(f)), F.try_element_at("changes", F.lit(f))).otherwise(F.col(f)) for f in fields}
    return df.withColumns(new).drop("changes")


def cascade_delete(tables: dict[str, DataFrame], gone: DataFrame, chain: list[tuple[str, str, str | None]]) -> dict[str, DataFrame]:
    """Delete ``gone(key)`` down a chain of ``(table, foreign key, own key)``: what hangs on a deleted row goes too."""
    out = {}
    for name, foreign, own in chain:
        rows = tables[name]
        doomed = gone.toDF(foreign).distinct()
        out[name] = rows.join(doomed, foreign, "left_anti")
        gone = rows.join(doomed, foreign, "left_semi").select(own) if own else doomed
    return out


def sync_upsert(table: DataFrame, batch: DataFrame, key: str, order: str) -> DataFrame:
    """Insert unseen keys, update changed ones; the last row of a key in the batch counts. ``action`` says what happened."""
    values = [c for c in table.columns if c != key]
    last = batch.groupBy(key).agg(F.max_by(F.struct(*values), order).alias("new"))
    old = table.select(key, F.struct(*values).alias("old"))
    df = old.join(last, key, "full_outer")
    action = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull() | F.col("new").eqNullSafe(F.col("old")), "keep").otherwise("update")
    return df.select(key, F.coalesce("new", "old").alias("v"), action.alias("action")).select(key, "v.*", "action")


def status_transition(files: DataFrame, asked: str) -> DataFrame:
    """Files that may take the state take it; ``moved`` says which."""
    may = reduce(Column.__or__, [(F.col("status") == s) for s, n in NEXT.items() if asked in n], F.lit(False))
    return files.withColumn("moved", may).withColumn("status", F.when(may, asked).otherwise(F.col("status")))


def digests(table: DataFrame, key: str, fields: list[str], buckets: int) -> DataFrame:
    """``(bucket, digest)``: for each bucket of keys the count and sums of its rows' hashes, the same in any order."""
    value = F.xxhash64(F.col(key), *[F.coalesce(F.col(f).cast("string"), F.lit("\u0000")) for f in fields])
    rows = table.select(bucket_of(key, buckets).alias("bucket"), value.alias("h"))
    half = F.pmod("h", F.lit(1 << 32))
    return rows.groupBy("bucket").agg(F.struct(F.count("*"), F.bit_xor("h"), F.sum(half.cast("decimal(38,0)")), F.sum((F.shiftright("h", 32)).cast("decimal(38,0)"))).alias("digest"))


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")


def changed_buckets(before: DataFrame, after: DataFrame, key: str, fields: list[str], buckets: int) -> DataFrame:
    """The buckets whose digests differ; no more rows than ``buckets``."""
    a, b = (digests(t, key, fields, buckets).toDF("bucket", d) for t, d in ((before, "da"), (after, "db")))
    return a.join(b, "bucket", "full_outer").where(~F.col("da").eqNullSafe(F.col("db"))).select("bucket")


def audit_diff(before: DataFrame, after: DataFrame, key: str, fields: list[str], buckets: int = 4096) -> DataFrame:
    """``(key, field, old_value, new_value)`` of every field that differs; rows on one side only differ from null.

    Both tables are first summed up by buckets of keys, and only rows of buckets whose sums differ are shuffled and joined.
    """
    changed = saved(changed_buckets(before, after, key, fields, buckets), "changed")
    touched = lambda t: t.withColumn("_bucket", bucket_of(key, buckets)).join(changed, F.col("_bucket") == F.col("bucket"), "left_semi").drop("_bucket")
    before, after = touched(before), touched(after)
    a = before.select(key, F.array(*[F.col(f).cast("string") for f in fields]).alias("a"))
    b = after.select(key, F.array(*[F.col(f).cast("string") for f in fields]).alias("b"))
    names = F.array(*map(F.lit, fields))
    rows = a.join(b, key, "full_outer").select(key, F.explode(F.sequence(F.lit(0), F.lit(len(fields) - 1))).alias("i"), "a", "b")
    rows = rows.select(key, names[F.col("i")].alias("field"), F.get("a", F.col("i")).alias("old_value"), F.get("b", F.col("i")).alias("new_value"))
    return rows.where(~F.col("old_value").eqNullSafe(F.col("new_value")))


def unique_violations(table: DataFrame, column: str) -> DataFrame:
    return table.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).where("n > 1")

"""Writers: entries, refinement tables, flat exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def split_extra(rows: DataFrame, known: list[str]) -> DataFrame:
    """Known columns as they are; all others as one JSON column, nulls left out."""
    extra = [c for c in rows.columns if c not in known]
    return rows.select(*known, F.to_json(F.struct(*sorted(extra))).alias("extra_data") if extra else F.lit("{}").alias("extra_data"))


def write_entries(rows: DataFrame, path: str, known: list[str]) -> None:
    """Appends the rows, in a folder for each restaurant, so that a restaurant's rows are read without the others."""
    split_extra(rows, known).repartition("restaurant_id").write.mode("append").partitionBy("restaurant_id").parquet(path)


def refinement_table(stages: dict[str, DataFrame]) -> DataFrame:
    """The rows of all stages in one table, told apart by ``stage``."""
    out = None
    for name, rows in stages.items():
        one = rows.withColumn("stage", F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def write_json(rows: DataFrame, path: str) -> None:
    """A JSON object on each line; nulls are left out."""
    rows.write.mode("append").json(path)


def export_flat(rows: DataFrame) -> DataFrame:
    """Maps, arrays and structs as JSON text, so that the rows fit CSV."""
    return rows.select(*[F.to_json(c).alias(c) if t.startswith(("map", "array", "struct")) else F.col(c) for c, t in rows.dtypes])


def write_csv(rows: DataFrame, path: str) -> None:
    """Flat rows with a header; quotes are doubled, and an empty text is told from a null by its quotes."""
    export_flat(rows).write.mode("append").option("header", True).option("escape", '"').option("emptyValue", '""').csv(path)

"""Samples for review: lowest confidence, both ends, one at random."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ORDER = ["row_confidence", "page", "line_no"]


def lowest(rows: DataFrame, k: int = 10, by: str | None = None) -> DataFrame:
    """The ``k`` rows of least confidence, of all or of each ``by``; ties in document order."""
    if by is None:
        return rows.orderBy("row_confidence", "entry_id").limit(k)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*ORDER))).where(F.col("rank") <= k)


def both_ends(rows: DataFrame, by: str = "file_id") -> DataFrame:
    """The five lowest rows of each file, and the two highest where it has more than six; a small file's rows may be in both."""
    df = rows.withColumns({"rank": F.row_number().over(Window.partitionBy(by).orderBy(*ORDER)), "n": F.count("*").over(Window.partitionBy(by))})
    low = df.where("rank <= 5").withColumn("part", F.lit(0))
    high = df.where("n > 6 and rank > n - 2").withColumn("part", F.lit(1))
    return low.unionByName(high)


def random_pick(rows: DataFrame, seed: int, by: str = "file_id") -> DataFrame:
    """One row of each file; the same seed picks the same row."""
    best = F.min_by(F.struct(*rows.columns), F.struct(F.md5(F.concat_ws(":", "entry_id", F.lit(seed))), F.col("entry_id")))
    return rows.groupBy(by).agg(best.alias("r")).select("r.*")

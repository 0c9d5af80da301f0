"""Shared helpers: reading inputs, cutting lineage in the shared folder, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the text contracts, as a regular-expression class body.
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set, only a session within one machine gets its own (tests)."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def save(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def contracted(edges: DataFrame, most: int) -> DataFrame:
    """``edges(a, b)`` as stars: each partition's edges are united in runs of at most ``most``, and each vertex is given the least of its run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while (up := least.get(top, top)) != top:
                top = up
            while x != top:
                least[x], x = top, least.get(x, x)
            return top

        def stars() -> pa.RecordBatch:
            rows = [(x, root(x)) for x in list(least)]
            least.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (list(zip(*rows, strict=True)) or [(), ()])], ["a", "b"])

        for batch in batches:
            for x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                x, y = root(x), root(y)
                if x != y:
                    least[max(x, y)] = min(x, y)
            if len(least) > most:
                yield stars()
        yield stars()

    return edges.mapInArrow(run, "a long, b long")


def connected_components(edges: DataFrame, max_rounds: int = 60, most: int = 500_000) -> DataFrame:
    """Smallest reachable id for every vertex of ``edges(a, b)``, as ``(id, component)``.

    Edges are united within tasks, ``most`` at a time, which settles a small graph. A larger one goes on with large-star and small-star
    steps until only stars are left; each step is one shuffle of the remaining edges, and every step's edges are a written table, so a lost
    executor costs one step. Vertices without an edge do not appear. Null ends are dropped.
    Each star keeps a vertex's neighbours as rows, so a hub never becomes one collected group: the hub's minimum is a map-side-combined
    aggregate and is joined back, where a hub's rows are split as a skewed join.
    """
    edges = save(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "cc")
    parts = 1 + edges.count() // most
    edges = save(contracted(edges.coalesce(parts), most), "cc")
    for _ in range(max_rounds if parts > 1 else 0):
        tops = edges.select(F.col("b").alias("a")).distinct()
        if edges.join(tops, "a", "left_semi").isEmpty() and edges.groupBy("a").agg(F.min("b").alias("b"), F.max("b").alias("c")).where("b <> c").isEmpty():
            break
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        edges = save(contracted(small, most), "cc")
    else:
        if parts > 1:
            raise RuntimeError("connected components did not settle")
    stars = edges.groupBy("a").agg(F.min("b").alias("component"))
    return stars.select(F.col("a").alias("id"), "component").union(edges.select("b").distinct().select(F.col("b").alias("id"), F.col("b").alias("component")))


def joined_components(groups: DataFrame, edges: DataFrame) -> DataFrame:
    """``groups(id, component)`` after adding ``edges(a, b)``: only the graph of the groups that the edges touch is worked on."""
    a, b = groups.toDF("a", "ca"), groups.toDF("b", "cb")
    between = edges.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    new = save(connected_components(between), "cc-new")
    moved = groups.join(new.toDF("component", "least"), "component", "left").select("id", F.coalesce("least", "component").alias("component"))
    return moved.unionByName(new.join(groups.select("id"), "id", "left_anti"))

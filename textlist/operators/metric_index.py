"""Nearest strings by insertion-deletion distance, a metric, so that the triangle inequality rules out whole groups of strings.

The ratio of two strings is ``100 * (1 - distance / both lengths)``, so a ratio of at least r bounds the distance. Strings go to the cell of their nearest pivot. A
cell can only hold what a key looks for if the key's distance to its pivot, less the cell's radius, is within that bound. Keys are first compared with their own cell, and what is
found there tightens the bound for all others. In a cell, distances to a few reference strings rule out single strings in the same way, before two
strings are compared. Cells are cut into tiles of a fixed size, and keys and strings of a tile meet in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.accumulators import Accumulator
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.strings import Strings, pair_lcs, pair_ratio
from .lineage import saved, spread, tasks

#: Strings of a space among which pivots are looked for, and most pivots of a space.
SAMPLE, PIVOTS = 2048, 1024
#: Reference strings of a space: its first pivots, which stand far apart.
REFERENCES = 16
#: Keys and strings of a tile.
TILE = 4096
#: Pairs looked at at once.
AT_ONCE = 1 << 20


def distances(a: Strings, b: Strings) -> np.ndarray:
    """Insertions and deletions between each of ``a`` and each of ``b``."""
    i, j = np.repeat(np.arange(len(a.texts)), len(b.texts)), np.tile(np.arange(len(b.texts)), len(a.texts))
    return (a.length[i] + b.length[j] - 2 * pair_lcs(b, a, j, i)).reshape(len(a.texts), len(b.texts))


def far_apart(texts: list[str], n: int) -> list[str]:
    """``n`` of the texts, each as far as can be from those before it."""
    strings, near = Strings(texts), np.full(len(texts), np.iinfo(np.int64).max)
    out, at = [], 0
    while len(out) < n and near[at] > 0:
        out.append(texts[at])
        near = np.minimum(near, distances(strings, Strings([texts[at]]))[:, 0])
        at = int(near.argmax())
    return out


@dataclass(frozen=True)
class Meter:
    """Counts of a search: pairs of keys and strings whose cells meet, and pairs that are compared."""

    met: Accumulator
    compared: Accumulator


@dataclass(frozen=True)
class Cells:
    """The pivots of each space, and what is known of their cells; a cell is a pivot's number over all spaces."""

    pivots: dict[str, list[str]]
    first: dict[str, int]
    radius: np.ndarray
    longest: np.ndarray
    size: np.ndarray


@dataclass(frozen=True)
class Index:
    """``rows(cell, id, text, refs)`` in ``cells``."""

    rows: DataFrame
    cells: Cells
    meter: Meter | None


def by_space(run: Callable[[str, pa.Table], pa.Table | None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Runs over the rows of each space of a batch, some thousand at a time."""

    def all_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for space in batch["space"].unique().to_pylist():
                rows = pa.Table.from_batches([batch]).filter(pa.compute.equal(batch["space"], space))
                for lo in range(0, rows.num_rows, 2048):
                    out = run(space, rows.slice(lo, 2048))
                    if out is not None:
                        yield from out.to_batches()

    return all_batches


def build(rows: DataFrame, meter: Meter | None = None) -> Index:
    """An index of ``rows(space, id, text)``; spaces are few and have nothing to do with one another.

    Pivots are taken from at most ``SAMPLE`` strings of each space, drawn by hash; every string is indexed.
    """
    rows = saved(rows, "strings")
    drawn = Window.partitionBy("space").orderBy(F.xxhash64("text"), "text")
    sample: dict[str, list[str]] = {}
    for r in rows.select("space", "text").distinct().withColumn("n", F.row_number().over(drawn)).where(F.col("n") <= SAMPLE).collect():
        sample.setdefault(r["space"], []).append(r["text"])
    count = {r["space"]: r["count"] for r in rows.groupBy("space").count().collect()}
    pivots = {s: far_apart(sorted(t), min(PIVOTS, 1 + int(1.8 * count[s] ** 0.5))) for s, t in sorted(sample.items())}
    first = dict(zip(pivots, np.cumsum([0, *map(len, pivots.values())]).tolist(), strict=False))

    def assigned(space: str, t: pa.Table) -> pa.Table:
        d = distances(Strings(t["text"].to_pylist()), Strings(pivots[space]))
        near = d.argmin(axis=1)
        more = {"cell": near + first[space], "away": d[np.arange(len(d)), near], "size": [len(x) for x in t["text"].to_pylist()]}
        return pa.table({c: pa.array(np.asarray(v, np.int32)) for c, v in more.items()} | {"id": t["id"], "text": t["text"], "refs": pa.array(list(d[:, :REFERENCES].astype(np.int32)), pa.list_(pa.int32()))})

    indexed = saved(spread(rows.select("space", "id", "text")).mapInArrow(by_space(assigned), "cell int, away int, size int, id long, text string, refs array<int>"), "cells")
    whole = sum(map(len, pivots.values()))
    radius, longest, size = (np.zeros(whole, np.int64) for _ in range(3))
    for r in indexed.groupBy("cell").agg(F.max("away").alias("r"), F.max("size").alias("l"), F.count("*").alias("n")).collect():  # no more rows than pivots
        radius[r["cell"]], longest[r["cell"]], size[r["cell"]] = r["r"], r["l"], r["n"]
    return Index(indexed.select("cell", "id", "text", "refs"), Cells(pivots, first, radius, longest, size), meter)


def allowed(least: np.ndarray, both: np.ndarray) -> np.ndarray:
    """The distance at which strings of so many characters still have a ratio of ``least``."""
    return (1 - least / 100) * both + 1e-9


def sent(index: Index, keys: DataFrame, which: str) -> DataFrame:
    """``keys(space, rep, text, least)`` to the cells where they are compared: the nearest, all that are in reach, or all of these but the nearest."""

    known, meter = index.cells, index.meter

    def run(space: str, t: pa.Table) -> pa.Table | None:
        if space not in known.pivots:
            return None
        strings, least = Strings(t["text"].to_pylist()), t["least"].to_numpy()
        d = distances(strings, Strings(known.pivots[space]))
        cells = slice(known.first[space], known.first[space] + d.shape[1])
        near = np.where(known.size[cells] > 0, d - 0.5 * (d == 0), np.inf).argmin(axis=1)
        if which == "nearest":
            row, cell = np.arange(len(d)), near
        else:
            reach = (d - known.radius[cells] <= allowed(least[:, None], strings.length[:, None] + known.longest[cells])) & (known.size[cells] > 0)
            if which == "others":
                reach[np.arange(len(d)), near] = False
            row, cell = np.nonzero(reach)
        if meter:
            meter.met.add(int(known.size[cells][cell].sum()))
        refs = pa.array(list(d[row, :REFERENCES].astype(np.int32)), pa.list_(pa.int32()))
        return pa.table({"cell": pa.array((cell + known.first[space]).astype(np.int32)), "rep": t["rep"].take(pa.array(row)), "text": t["text"].take(pa.array(row)), "least": pa.array(least[row]), "refs": refs})

    return spread(keys.select("space", "rep", "text", F.col("least").cast("double").alias("least"))).mapInArrow(by_space(run), f"cell int, rep {keys.schema['rep'].dataType.simpleString()}, text string, least double, refs array<int>")


def compared(index: Index, keys: DataFrame, k: int | None) -> DataFrame:
    """``(rep, id, ratio)`` of keys sent to cells: each tile's ``k`` best of a key with a ratio of ``least`` or more, the smaller id on ties."""
    meter = index.meter

    def tile(a: pa.Table, b: pa.Table) -> pa.Table:
        i, j, ratio = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if a.num_rows and b.num_rows:
            b = b.sort_by("id")
            left, right = Strings(a["text"].to_pylist()), Strings(b["text"].to_pylist())
            refs = [np.array(x["refs"].to_pylist(), np.int32) for x in (a, b)]
            least, out = a["least"].to_numpy(), []
            step = max(1, AT_ONCE // b.num_rows)
            for lo in range(0, a.num_rows, step):
                some = slice(lo, lo + step)
                most = allowed(least[some, None], left.length[some, None] + right.length)
                near = np.abs(left.length[some, None] - right.length) <= most
                for r in range(refs[0].shape[1]):
                    near &= np.abs(refs[0][some, r, None] - refs[1][:, r]) <= most
                i, j = np.nonzero(near)
                ratio = pair_ratio(left, right, i + lo, j)
                good = ratio >= least[i + lo]
                if meter:
                    meter.compared.add(len(i))
                out.append((i[good] + lo, j[good], ratio[good]))
            i, j, ratio = (np.concatenate(x) for x in zip(*out, strict=True))
            if k is not None:
                order = np.lexsort((j, -ratio, i))
                i, j, ratio = i[order], j[order], ratio[order]
                kept = np.arange(len(i)) - np.searchsorted(i, i) < k
                i, j, ratio = i[kept], j[kept], ratio[kept]
        return pa.table({"rep": a["rep"].take(pa.array(i)), "id": b["id"].take(pa.array(j)), "ratio": pa.array(ratio)})

    return tiles(keys, index.rows, ["cell"], "rep", "id", tile, f"rep {keys.schema['rep'].dataType.simpleString()}, id long, ratio double")


def tiles(left: DataFrame, right: DataFrame, key: list[str], own: str, other: str, tile: Callable[[pa.Table, pa.Table], pa.Table], shape: str) -> DataFrame:
    """``tile`` of the rows of both sides with the same ``key``, at most some ``TILE`` of either side at a time.

    Rows are dealt out by ``own`` and ``other`` where a key has more, so a hot key is many tasks.
    """
    counts = [df.groupBy(*key).agg(F.ceil(F.count("*") / TILE).alias(n)) for df, n in ((left, "parts"), (right, "blocks"))]
    many = counts[0].join(counts[1], key)
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    a = left.join(many, key).withColumns({"part": F.pmod(F.xxhash64(own, F.lit(1)), F.col("parts")), "block": each("blocks")}).drop("parts", "blocks")
    b = right.join(many, key).withColumns({"block": F.pmod(F.xxhash64(other, F.lit(2)), F.col("blocks")), "part": each("parts")}).drop("parts", "blocks")
    n, dealt = tasks(left.sparkSession), [*key, "part", "block"]
    a, b = a.toDF(*a.columns).repartition(n, *dealt), b.toDF(*b.columns).repartition(n, *dealt)
    return a.groupBy(*key, "part", "block").cogroup(b.groupBy(*key, "part", "block")).applyInArrow(tile, shape)


def top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("rep").orderBy(F.desc("ratio"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(index: Index, keys: DataFrame, k: int, least: float) -> DataFrame:
    """``keys(space, rep, text)``, best a written table, to ``(rep, id, ratio, rank)``: the ``k`` strings of the key's space with the highest ratios of ``least`` or more; the smaller id on ties."""
    own = saved(compared(index, sent(index, keys.withColumn("least", F.lit(least)), "nearest"), k), "nearest")
    bound = top(own, k).groupBy("rep").agg(F.min("ratio").alias("edge"), F.count("*").alias("n")).where(F.col("n") == k).select("rep", "edge")
    rest = keys.join(bound, "rep", "left").withColumn("least", F.coalesce("edge", F.lit(least)))
    return top(own.unionByName(compared(index, saved(sent(index, rest, "others"), "sent"), k)), k)


def within(index: Index, keys: DataFrame) -> DataFrame:
    """``keys(space, rep, text, least)`` to ``(rep, id, ratio)`` of all strings of the key's space with a ratio of ``least`` or more."""
    return compared(index, saved(sent(index, keys, "all"), "sent"), None)

"""Hard-negative mining: for each anchor and each of its positives, rows of other labels that score nearly as high.

Scores are inner products of integer vectors, made tile by tile: a block of anchors and a block of candidates meet in one task, whose
score matrix is a Strassen product of int64 matrices. What leaves a tile are heaps of fixed size, the best rows so far of each anchor
(positives) or of each anchor and positive (windows), and heaps of the same key merge into one.

Defined results: rows with a null id, a null label, a null vector, or a null or non-finite component take no part; shorter vectors are filled up with zeros, an
empty one has zeros only; of rows that repeat an id the one with the least label and vector takes part; equal scores go by the
smaller id; an empty table gives an empty result; other columns are not read, whatever their names. Components are held to 64 bits, and sums wrap at 64 bits: scores are
exact as long as they fit.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import save

#: Below this size on any side a product is summed column by column.
LEAF = 16
#: Anchors and candidates of one tile.
ANCHORS, CANDIDATES = 1024, 4096


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """``a @ b`` of int64 matrices by seven half-sized products; odd sides get a row or column of zeros.

    Sums wrap at 64 bits in every step, so the result is exact whenever it fits, whatever the steps between were.
    """
    m, k, n = a.shape[0], a.shape[1], b.shape[1]
    if min(m, k, n) <= leaf:
        out = np.zeros((m, n), np.int64)
        for j in range(k):
            out += a[:, j, None] * b[j]
        return out
    a, b = np.pad(a, ((0, m % 2), (0, k % 2))), np.pad(b, ((0, k % 2), (0, n % 2)))
    x, y, z = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:x, :y], a[:x, y:], a[x:, :y], a[x:, y:]
    b11, b12, b21, b22 = b[:y, :z], b[:y, z:], b[y:, :z], b[y:, z:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * x, 2 * z), np.int64)
    out[:x, :z], out[:x, z:], out[x:, :z], out[x:, z:] = p1 + p4 - p5 + p7, p3 + p5, p2 + p4, p1 - p2 + p3 + p6
    return out[:m, :n]


def heaps(score: np.ndarray, may: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``(row, column)`` of the ``k`` best allowed columns of each row, best first; the earlier column on ties."""
    least = np.iinfo(np.int64).min
    if score.shape[1] > k:
        held = np.where(may, score, least)
        at = held.shape[1] - k
        edge = np.partition(held, at, axis=1)[:, at]
        may = may & (score >= edge[:, None])
    row, col = np.nonzero(may)
    order = np.lexsort((col, ~score[row, col], row))
    row, col = row[order], col[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    return row[rank < k], col[rank < k]


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows of a matrix, filled up with zeros."""
    column = column.combine_chunks()
    out, size = np.zeros((len(column), width), np.int64), np.diff(column.offsets.to_numpy())
    inside = np.arange(width) < size[:, None]
    out[inside] = column.flatten().to_numpy()
    return out


def mining_rows(embeddings: DataFrame) -> DataFrame:
    """``embeddings(vec_id, label, embedding)`` to one row ``(vec_id, label, v)`` an id that takes part, components as floor(256 * x)."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.alias("x"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull()).where(F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))))
    limit = 9.2e18
    v = F.transform("x", lambda c: F.floor(F.greatest(F.lit(-limit), F.least(F.lit(limit), 256 * c))))
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", v.alias("v"))).alias("r")).select("vec_id", "r.label", "r.v")


def tiles(anchors: DataFrame, rows: DataFrame, within: list[str], tile: Callable[[pa.Table, pa.Table], pa.Table], shape: str) -> DataFrame:
    """``tile`` of each block of anchors with each block of candidates that agree in ``within``: both sides are sent to a key of their two blocks.

    ``anchors`` has a column ``part`` and ``blocks``, ``rows`` a column ``block`` and ``parts``: the numbers of blocks and of parts to meet.
    """
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    key = [*within, "part", "block"]
    left = anchors.withColumn("block", each("blocks")).drop("blocks")
    right = rows.withColumn("part", each("parts")).drop("parts")
    left, right = (df.toDF(*df.columns) for df in (left, right))  # both may come from one table
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(tile, shape)


def best(rows: DataFrame, key: list[str], score: str, by: str, k: int) -> DataFrame:
    """Heaps of the same key merged: the ``k`` rows of highest score with their ``rank``; the smaller ``by`` on ties.

    Spark cuts each task's rows to ``k`` a key before they are shuffled.
    """
    order = Window.partitionBy(*key).orderBy(F.desc(score), by)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(embeddings: DataFrame, every: int = 100, noisy: int = 7, labels: int = 10, k_positives: int = 5, k_negatives: int = 5, low: tuple[int, int] = (80, 100)) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    Anchors are the rows whose id ``every`` divides; where ``noisy`` divides it, the label moves on by one. Of an anchor's rows of its own label the
    first ``k_positives`` are its positives; for each the first ``k_negatives`` rows of other labels with
    ``low[0] * positive <= low[1] * negative <= low[1] * positive`` are returned.

    Anchors are a stated query set, so the work is anchors times rows, dealt out in tiles of a fixed size; positives need only tiles of one label.
    No side is broadcast and no task holds more than one tile.
    """
    rows = mining_rows(embeddings)
    rows = save(rows.withColumn("label", F.when(F.pmod("vec_id", F.lit(noisy)) == 0, F.pmod(F.col("label") + 1, F.lit(labels))).otherwise(F.col("label"))), "mining")
    is_anchor = F.pmod("vec_id", F.lit(every)) == 0
    deal = lambda name, n: F.pmod(F.xxhash64("vec_id", F.lit(7)), n).alias(name)
    blocks = lambda n, size: F.greatest(F.lit(1), F.ceil(n / size)).cast("long")
    # numbers of blocks by label, one row each, and for all; joined as rows, so many labels are no burden
    counts = rows.groupBy("label").agg(blocks(F.count("*"), CANDIDATES).alias("blocks"), blocks(F.count_if(is_anchor), ANCHORS).alias("parts"))
    total = rows.agg(F.count("*").alias("n"), F.count_if(is_anchor).alias("m"), F.max(F.size("v")).alias("width")).first()
    width, whole = total["width"] or 0, {"blocks": max(1, -(-total["n"] // CANDIDATES)), "parts": max(1, -(-total["m"] // ANCHORS))}

    def scores(a: pa.Table, b: pa.Table) -> np.ndarray:
        return strassen(matrix(a["v"], width), np.ascontiguousarray(matrix(b["v"], width).T))

    def positives(a: pa.Table, b: pa.Table) -> pa.Table:
        b = b.sort_by("vec_id")
        own, ids, score = a["vec_id"].to_numpy(), b["vec_id"].to_numpy(), np.zeros((0, 0), np.int64)
        row = col = np.zeros(0, np.int64)
        if len(own) and len(ids):
            score = scores(a, b)
            row, col = heaps(score, own[:, None] != ids, k_positives)
        return pa.table({"anchor_id": own[row], "positive_id": ids[col], "score": score[row, col]})

    same = rows.join(counts, "label")
    found = tiles(same.where(is_anchor).withColumn("part", deal("part", F.col("parts"))).select("label", "part", "blocks", "vec_id", "v"), same.withColumn("block", deal("block", F.col("blocks"))).select("label", "block", "parts", "vec_id", "v"), ["label"], positives, "anchor_id long, positive_id long, score long")
    heap = best(found, ["anchor_id"], "score", "positive_id", k_positives)
    heap = save(heap.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("rank", "positive_id", "score"))).alias("p")), "positives")  # no more than k_positives each

    def windows(a: pa.Table, b: pa.Table) -> pa.Table:
        b = b.sort_by("vec_id")
        own, ids, out = a["vec_id"].to_numpy(), b["vec_id"].to_numpy(), []
        if len(own) and len(ids):
            score, p = scores(a, b), a["p"].to_pylist()
            other = a["label"].to_numpy()[:, None] != b["label"].to_numpy()
            for j in range(k_positives):
                has = np.array([len(x) > j for x in p])
                high = np.array([x[j]["score"] if len(x) > j else 0 for x in p], np.int64)
                # low[0] * p <= low[1] * s, without products that may not fit
                q, r = np.divmod(high, low[1])
                least = q * low[0] - (-(r * low[0]) // low[1])
                row, col = heaps(score, other & has[:, None] & (score >= least[:, None]) & (score <= high[:, None]), k_negatives)
                out.append((own[row], np.array([p[i][j]["positive_id"] for i in row.tolist()], np.int64), high[row], ids[col], score[row, col]))
        columns = [np.concatenate(c).astype(np.int64) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 5
        return pa.table(dict(zip(["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"], columns, strict=True)))

    anchors = rows.where(is_anchor).join(heap, F.col("vec_id") == F.col("anchor_id")).select(deal("part", F.lit(whole["parts"])), F.lit(whole["blocks"]).cast("long").alias("blocks"), "vec_id", "label", "v", "p")
    others = rows.select(deal("block", F.lit(whole["blocks"])), F.lit(whole["parts"]).cast("long").alias("parts"), "vec_id", "label", "v")
    mined = tiles(anchors, others, [], windows, "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    mined = best(mined, ["anchor_id", "positive_id"], "negative_score", "negative_id", k_negatives)
    return mined.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


ORACLE = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
 WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id AS id, b.label AS label, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, own, id, score FROM s WHERE own = label QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
 row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS rank FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> p.own AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""

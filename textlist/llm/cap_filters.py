"""Embedding near-dedup by spherical-cap filters: which vectors are alike, and the groups they form.

1. Equal vectors become one, with a weight.
2. Filter directions are the words of a random product code: a vector is turned by random signs and Hadamard steps and cut into two halves, each with its own
   small code, and a direction is a code word of each half. A vector is list-decoded to all directions whose inner product exceeds the cap's height: words of a half
   are kept only where the other half's best can still lift them over it. (More parts make smaller codes, but the directions of a vector then are so much alike that a third of the links is lost at the same cost.)
3. Vectors of one best direction that stand within half the link's angle of one of them, the leader, are a family: any two of its members link,
   which needs no comparison. So a crowd of near copies is a few families, however large it is.
4. Families and single vectors meet in cells of directions with the same first half, and are compared where they share a direction. By leaders' angle and
   families' radii all of their members link, or none, or members have to be compared, which is done family by family in tiles. A pair that shares several directions is taken at the first
   of them, so links are counted where they are found, and no pair leaves a task.

Links are exact (each is verified in double precision); how many are found is a matter of chance that grows with ``filters``, the mean number of directions of a vector:
five for each doubling of the vectors, with which more than 0.95 of pairs right at the threshold are found, and nearly all that are nearer. The number of directions grows with the number of vectors, so that cells do not.

Defined results: null vectors, zero vectors and those with null or non-finite components link with nothing; shorter vectors are filled up with
zeros; of rows that repeat an id the one with the least vector counts, and one row is returned; a null id links with nothing and has no component; an empty
table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, save

#: Parts of the product code.
PARTS = 2
#: Vectors of one direction in the mean.
POPULATION = 8
#: Most vectors of a cell or of a family's tile in one task.
TILE = 4096
#: Candidate pairs looked at at once.
AT_ONCE = 1 << 19
#: Rounds of leaders.
ROUNDS = 2
#: Angles nearer than this to a bound are settled by the vectors themselves.
SLACK = 1e-7


def units(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors in double precision, filled up to ``width``, at length 1."""
    column = column.combine_chunks()
    out, size = np.zeros((len(column), width)), np.diff(column.offsets.to_numpy())
    out[np.arange(width) < size[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    out /= np.maximum(np.abs(out).max(axis=1, initial=0, keepdims=True), 5e-324)
    return out / np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), 5e-324)


def mean_filters(n: int) -> int:
    """Caps of a vector in the mean, for ``n`` vectors: higher caps, which more vectors need, are shared by fewer of a pair."""
    return max(20, math.ceil(5 * math.log2(n + 1)))


def words_of(n: int, filters: int) -> int:
    """Words of a half, so that a direction has ``POPULATION`` of the ``n`` vectors in the mean."""
    return max(4, math.ceil((max(1, n) * filters / POPULATION) ** (1 / PARTS)))


class Code:
    """A random product code with ``size`` words a part, and the cap's height at which a vector is in ``filters`` caps in the mean."""

    def __init__(self, width: int, size: int, filters: int, seed: int = 11) -> None:
        random = np.random.default_rng(seed)
        self.width, self.size = max(64, 1 << max(0, width - 1).bit_length()), size
        self.signs = random.choice([-1.0, 1.0], (3, self.width))
        words = random.standard_normal((PARTS, self.width // PARTS, size))
        self.words = words / np.linalg.norm(words, axis=1, keepdims=True) / math.sqrt(PARTS)
        probe = random.standard_normal((128, self.width))
        self.height = self._height(probe / np.linalg.norm(probe, axis=1, keepdims=True), filters)

    def _height(self, probe: np.ndarray, filters: int, steps: int = 4096) -> float:
        """From the distribution of a sum of one value of each part: the histograms of the parts, convolved."""
        total = np.zeros(PARTS * steps)
        for parts in zip(*self.products(probe), strict=True):
            dist = np.ones(1)
            for values in parts:
                at = ((values + 1) / 2 * steps).astype(int)  # no value is beyond 1
                dist = np.convolve(dist, np.bincount(at, minlength=steps))
            total[: len(dist)] += dist
        above = np.cumsum(total[::-1])[::-1] / len(probe)
        return float((np.searchsorted(-above, -filters) + PARTS / 2) / steps * 2 - PARTS)

    def turned(self, u: np.ndarray) -> np.ndarray:
        """Random signs and a Hadamard step, three times."""
        out = np.zeros((len(u), self.width))
        out[:, : u.shape[1]] = u
        for signs in self.signs:
            out *= signs
            half = 1
            while half < self.width:
                v = out.reshape(len(out), -1, 2, half)
                out = np.stack([v[:, :, 0] + v[:, :, 1], v[:, :, 0] - v[:, :, 1]], axis=2).reshape(len(out), self.width)
                half *= 2
            out /= math.sqrt(self.width)
        return out

    def products(self, u: np.ndarray) -> list[np.ndarray]:
        return [part @ words for part, words in zip(np.split(self.turned(u), PARTS, axis=1), self.words, strict=True)]

    def decode(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The best direction of each vector, and ``(row, direction)`` of all caps that it is in, its best among them, sorted."""
        (first, last), n = self.products(u), len(u)
        best = first.argmax(axis=1) * self.size + last.argmax(axis=1)
        top, end = first.max(axis=1), last.max(axis=1)
        (r1, c1), (r2, c2) = np.nonzero(first >= (self.height - end)[:, None]), np.nonzero(last >= (self.height - top)[:, None])
        n1, n2 = np.bincount(r1, minlength=n), np.bincount(r2, minlength=n)
        begin = np.cumsum(n2) - n2
        times = n2[r1]  # each first half meets the last halves of its vector
        one = np.repeat(np.arange(len(r1)), times)
        two = np.arange(len(one)) - np.repeat(np.cumsum(times) - times, times) + begin[r1[one]]
        good = first[r1[one], c1[one]] + last[r1[one], c2[two]] >= self.height
        row, at = np.r_[r1[one[good]], np.arange(n)], np.r_[c1[one[good]] * self.size + c2[two[good]], best]
        order = np.lexsort((at, row))
        row, at = row[order], at[order]
        new = np.r_[True, (row[1:] != row[:-1]) | (at[1:] != at[:-1])]
        return best, row[new], at[new]


def ragged(row: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    """Lists of values by row; rows are sorted."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32)), pa.array(values.astype(np.int64)))


def decoded(classes: DataFrame, code: Code, width: int) -> DataFrame:
    """``classes(id, w, x)`` plus ``best`` and ``filters``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, (1 << 21) // code.size)
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                some = pa.Table.from_batches([batch.slice(lo, step)])
                best, row, at = code.decode(units(some["x"], width))
                more = some.append_column("best", pa.array(best.astype(np.int64))).append_column("filters", ragged(row, at, some.num_rows))
                yield from more.combine_chunks().to_batches()

    kind = classes.schema["x"].dataType.simpleString()
    return classes.mapInArrow(run, f"id long, w long, x {kind}, best long, filters array<long>")


def families(rows: DataFrame, width: int, most: float) -> DataFrame:
    """``rows`` plus ``fam``, the id of a leader within the angle ``most`` or else the own id, and the ``angle`` to it.

    A leader is drawn at random among the rows of one best direction, so that a crowd is likely to get one of its own.
    """
    kind, out = rows.schema["x"].dataType.simpleString(), None
    shape = f"id long, w long, x {kind}, best long, filters array<long>, fam long, angle double"

    def led(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.Table.from_batches([batch])
            gap = angle(units(t["x"], width), units(t["lx"], width))
            gap[t["id"].to_numpy() == t["lid"].to_numpy()] = 0
            t = t.append_column("fam", pa.array(t["lid"].to_numpy(), mask=gap > most)).append_column("angle", pa.array(gap))
            yield from t.drop_columns(["lid", "lx"]).to_batches()

    for turn in range(ROUNDS):
        leaders = rows.groupBy("best").agg(F.min_by(F.struct(F.col("id").alias("lid"), F.col("x").alias("lx")), F.struct(F.xxhash64("id", F.lit(turn)), "id")).alias("l")).select(F.col("best").alias("lb"), "l.*")
        met = rows.join(leaders, F.col("best") == F.col("lb")).select("id", "w", "x", "best", "filters", "lid", "lx").mapInArrow(led, shape)
        met = save(met, "families")
        own = met.where("fam is not null")
        out = own if out is None else out.unionByName(own)
        rows = met.where("fam is null").drop("fam", "angle")
    return out.unionByName(rows.select("*", F.col("id").alias("fam"), F.lit(0.0).alias("angle")))


def angle(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Angles of unit vectors, exact for small ones too."""
    return 2 * np.arctan2(np.linalg.norm(u - v, axis=1), np.linalg.norm(u + v, axis=1))


def least_reached(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least node that each of ``n`` nodes reaches by the edges."""
    least = np.arange(n)
    while True:
        low = np.minimum(least[i], least[j])
        new = least.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == least).all():
            return least
        least = new


def first_shared(filters: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least filter that the rows ``i`` and ``j`` share; ``filters`` has a row of them for each, filled up with unlike values."""
    out, step = np.empty(len(i), np.int64), max(1, AT_ONCE // max(1, filters.shape[1] ** 2))
    for lo in range(0, len(i), step):
        a, b = filters[i[lo : lo + step]], filters[j[lo : lo + step]]
        out[lo : lo + step] = np.where((a[:, :, None] == b[:, None]).any(axis=2) & (a >= 0), a, np.iinfo(np.int64).max).min(axis=1)
    return out


def compared(t: pa.Table, width: int, words: int, cosine: float) -> pa.Table:
    """What a cell finds out: links added to an entity (kind 0), an entity and the least one it reaches (1), pairs to compare by members (2)."""
    limit, prefix = math.acos(cosine), t["prefix"][0].as_py()
    t = t.sort_by("ent")
    u, r, w, ent, side = units(t["x"], width), t["r"].to_numpy(), t["w"].to_numpy(), t["ent"].to_numpy(), t["side"].to_numpy()
    lists = t["filters"].combine_chunks()
    size = np.diff(lists.offsets.to_numpy())
    table = np.full((len(ent), int(size.max())), -1, np.int64)
    table[np.arange(table.shape[1]) < size[:, None]] = lists.flatten().to_numpy()
    row, at = np.nonzero(table // words == prefix)
    order = np.lexsort((row, table[row, at]))
    row, at = row[order], table[row, at][order]
    add, linked, members = np.zeros(len(ent), np.int64), [], []
    both = t["a"][0].as_py() == t["b"][0].as_py()

    def settle(i: np.ndarray, j: np.ndarray, f: np.ndarray) -> None:
        dot, reach = np.einsum("ij,ij->i", u[i], u[j]), r[i] + r[j]
        link, maybe = (reach == 0) & (dot >= cosine), np.zeros(len(i), bool)
        wide = np.flatnonzero(reach > 0)
        gap = angle(u[i[wide]], u[j[wide]])
        link[wide] = gap + reach[wide] <= limit - SLACK
        maybe[wide] = ~link[wide] & (gap - reach[wide] <= limit + SLACK)
        for mask, to in ((link, linked), (maybe, members)):
            k = np.flatnonzero(mask)
            k = k[first_shared(table, i[k], j[k]) == f[k]]
            to.append(np.stack([i[k], j[k]]))
        i, j = linked[-1]
        np.add.at(add, i, w[j])
        np.add.at(add, j, w[i])

    held, n = [], 0
    left = np.arange(len(at))
    for gap in range(1, len(at)):
        left = left[left + gap < len(at)]
        left = left[at[left] == at[left + gap]]
        if not len(left):
            break
        pair = left if both else left[side[row[left]] != side[row[left + gap]]]
        held.append((row[pair], row[pair + gap], at[pair]))
        n += len(pair)
        if n > AT_ONCE:
            settle(*map(np.concatenate, zip(*held, strict=True)))
            held, n = [], 0
    if held:
        settle(*map(np.concatenate, zip(*held, strict=True)))
    i, j = np.concatenate(linked, axis=1) if linked else np.zeros((2, 0), np.int64)
    k, m = np.concatenate(members, axis=1) if members else np.zeros((2, 0), np.int64)
    least, some = least_reached(len(ent), i, j), np.flatnonzero(add)
    apart = np.flatnonzero(least != np.arange(len(ent)))
    kinds = np.repeat([0, 1, 2], [len(some), len(apart), len(k)])
    return pa.table({"kind": pa.array(kinds.astype(np.int32)), "a": np.r_[ent[some], ent[apart], ent[k]], "b": np.r_[add[some], ent[least[apart]], ent[m]]})


def by_members(pairs: DataFrame, members: DataFrame, sizes: DataFrame, width: int, cosine: float) -> DataFrame:
    """Families that are neither all alike nor all apart: ``(kind, a, b)`` as in ``compared``, of their members. Families go in tiles of ``TILE`` members."""
    n = F.ceil(F.col("n") / TILE)
    for own in ("a", "b"):
        pairs = pairs.join(sizes.select(F.col("fam").alias(own), n.alias(f"n{own}")), own)
    each = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    own = lambda c: pairs.join(members, F.col(c) == F.col("fam")).withColumn(f"t{c}", F.pmod(F.xxhash64("id", F.lit(3)), F.col(f"n{c}")))
    key = ["a", "b", "ta", "tb"]
    left, right = own("a").withColumn("tb", each("nb")).select(*key, "id", "w", "x"), own("b").withColumn("ta", each("na")).select(*key, "id", "w", "x")
    left, right = left.toDF(*left.columns), right.toDF(*right.columns)

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        ids = np.r_[a["id"].to_numpy(), b["id"].to_numpy()]
        if not a.num_rows or not b.num_rows:
            ids = ids[:0]
        i = j = np.zeros(0, np.int64)
        if len(ids):
            i, j = np.nonzero(units(a["x"], width) @ units(b["x"], width).T >= cosine)
        add, j = np.zeros(len(ids), np.int64), j + a.num_rows
        if len(i):
            w = np.r_[a["w"].to_numpy(), b["w"].to_numpy()]
            np.add.at(add, i, w[j])
            np.add.at(add, j, w[i])
        order = np.argsort(ids)
        place = np.argsort(order)
        least, some = least_reached(len(ids), place[i], place[j]), np.flatnonzero(add)
        least = ids[order][least[place]] if len(ids) else ids
        apart = np.flatnonzero(least != ids)
        kinds = np.repeat([0, 1], [len(some), len(apart)]).astype(np.int32)
        return pa.table({"kind": pa.array(kinds), "a": np.r_[ids[some], ids[apart]], "b": np.r_[add[some], least[apart]]})

    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(run, "kind int, a long, b long")


def near_vectors(embeddings: DataFrame, cosine: float = 0.9, filters: int | None = None) -> DataFrame:
    """``embeddings(vec_id, embedding)`` to ``(vec_id, n_links, component_id, kept)``, one row an id; links are pairs found with a cosine of ``cosine`` or more."""
    element = embeddings.schema["embedding"].dataType.elementType.simpleString()
    kind = "float" if element == "float" else "double"
    fit = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))) & F.exists("x", lambda c: c != 0)
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("x"))
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("x")).alias("r")).select("vec_id", F.col("r.x").alias("x"))
    rows = save(rows.withColumn("x", F.when(fit & F.col("vec_id").isNotNull(), F.col("x"))), "vectors")
    classes = save(rows.where("x is not null").groupBy("x").agg(F.min("vec_id").alias("id"), F.count("*").alias("w")).select("id", "w", "x"), "classes")
    n, width = classes.agg(F.count("*"), F.coalesce(F.max(F.size("x")), F.lit(1))).first()
    filters = filters or mean_filters(n)
    code = Code(width, words_of(n, filters), filters)

    members = save(families(decoded(classes, code, width), width, math.acos(cosine) / 2 - SLACK), "members")
    sizes = save(members.groupBy("fam").agg(F.count("*").alias("n"), F.sum("w").alias("w"), F.max("angle").alias("r")), "sizes")
    own = members.select("fam", F.explode("filters").alias("f")).distinct().groupBy("fam").agg(F.sort_array(F.collect_list("f")).alias("filters"))  # as many as there are caps over a family
    leaders = members.where("id = fam").select("fam", "x")
    cells = leaders.join(sizes.drop("n"), "fam").join(own, "fam").select(F.col("fam").alias("ent"), "w", "r", "x", "filters", F.explode(F.array_distinct(F.transform("filters", lambda f: F.floor(f / code.size)))).alias("prefix"))
    short = "int" if code.size**2 < 1 << 31 else "long"
    cells = cells.withColumn("filters", F.filter("filters", lambda f: f < (F.col("prefix") + 1) * code.size).cast(f"array<{short}>"))  # later ones settle nothing
    cells = save(cells, "cells")
    large = cells.groupBy("prefix").agg(F.ceil(F.count("*") / TILE).alias("tiles"))
    cells = cells.join(large, "prefix").withColumn("side", F.pmod(F.xxhash64("ent", F.lit(5)), F.col("tiles"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    cells = cells.select("prefix", F.least("side", "other").alias("a"), F.greatest("side", "other").alias("b"), "side", "ent", "w", "r", "x", "filters")
    found = save(cells.groupBy("prefix", "a", "b").applyInArrow(lambda t: compared(t, width, code.size, cosine), "kind int, a long, b long"), "found")
    closer = save(by_members(found.where("kind = 2").select("a", "b"), members.select("fam", "id", "w", "x"), sizes, width, cosine), "closer")

    total = lambda df, name: df.where("kind = 0").groupBy(F.col("a").alias(name)).agg(F.sum("b").alias(f"{name}_links"))
    edges = members.where("id <> fam").select(F.col("id").alias("a"), F.col("fam").alias("b")).unionByName(found.where("kind = 1").select("a", "b")).unionByName(closer.where("kind = 1").select("a", "b"))
    whole = members.join(sizes.select("fam", F.col("w").alias("all")), "fam").join(total(found, "fam"), "fam", "left").join(total(closer, "id"), "id", "left").join(connected_components(edges), "id", "left")
    links = F.col("all") - 1 + F.coalesce("fam_links", F.lit(0)) + F.coalesce("id_links", F.lit(0))
    whole = whole.select(F.col("x").alias("_x"), links.alias("n_links"), F.coalesce("component", "id").alias("component"))
    out = rows.join(whole, F.col("x") == F.col("_x"), "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_dot_product(a.x, b.x) / (sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x))) >= 0.9),
reach AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON l.a = r.b),
c AS (SELECT a, min(b) AS least FROM reach GROUP BY a), k AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(k.n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(c.least, e.vec_id)) AS component_id, e.vec_id <= coalesce(c.least, e.vec_id) AS kept
FROM embeddings e LEFT JOIN k ON k.a = e.vec_id LEFT JOIN c ON c.a = e.vec_id
"""

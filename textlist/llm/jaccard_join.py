"""N-gram Jaccard join: documents whose sets of word shingles are alike, and the groups they form.

Two sets A and B link when ``100 * |A & B| >= percent * |A | B|``. The answer is exact for 48-bit shingle hashes.

1. Every text becomes its set of shingle hashes, of which are kept its size, a 128-bit hash and its count vector: how many
   shingles fall in each token group. Longer sets have more groups (256 and up, at most four shingles in each in the mean), each a split
   of a coarser one, so vectors of two lengths meet on the coarser groups. Sets that are the same go under their least id.
2. Where the trees stand. Linked sets differ in at most ``(100 - percent) / (100 + percent)`` of the sum of their sizes. So if hash space
   is cut into more ranges than that, some range holds the same shingles in both: sets that share (size band, range, hash of the
   shingles in the range) are one block, and only they can link. Empty ranges are left out where enough others remain to keep this
   certain. Blocks with the same members are one.
3. In each block an R-tree over the count vectors finds the pairs that may link: a node's bound is the sum of coordinate minima with its
   upper corner. The first search takes every found pair for a link and asks only for as many as join the block; those are verified on the sets,
   and links make groups.
4. Where a block's members are in different groups still, the tree is searched again, and members of different groups that the bound does not keep
   apart make families. A family's sets are sent to one place, once each, whatever blocks they are in, and an R-tree over
   them is searched to the end: its pairs of different groups
   that pass the bound are verified on the spot, until the groups are joined or no pair is left. So no link between different texts is lost.

No task holds a large block or family: one of over ``TILE`` members is cut into tiles, of one group each where groups are that large; the first
search is within tiles, to each of which the block's centre is added, the second is over pairs of tiles that are not all of one group.

Only size bands, ranges and set hashes decide where rows go, so a hot source does not matter; copies are collapsed by map-side
combined aggregates.

Defined results: a null, empty or blank text has no shingles and links with nothing; a text with fewer words than a
shingle is one shingle; a null id is in no group and its component is null; rows that repeat an id are one vertex, which has the links
of all of their texts; very long texts are taken whole; an empty table gives an empty result; only id and text are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, free_names, joined_components, save
from .textbytes import LOWER, NOT_SPACE, mixed, text_slices, word_hashes, words

GROUPS = 256
TREE_LEAF = 16
TILE = 1024
FACTORS = mixed(np.arange(101, 117, dtype=np.uint64)) | np.uint64(1)
FILTER_BITS = 1 << 24


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """48-bit shingle hashes, sorted and distinct in each text, and where each text's begin (and end, at last)."""
    data = LOWER[data]
    start, end, row = words(data, offsets, NOT_SPACE)
    h = word_hashes(data, start, end)
    n, texts = len(h), len(offsets) - 1
    count = np.bincount(row, minlength=texts)
    full = np.zeros(0, np.uint64)
    if n >= width:
        full = sum((h[j : n - width + 1 + j] * FACTORS[j] for j in range(width)), np.zeros(n - width + 1, np.uint64))
        own = row[: n - width + 1] == row[width - 1 :]
        full, of = full[own], row[: n - width + 1][own]
    else:
        of = np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        first = np.searchsorted(row, short)
        more = np.zeros(len(short), np.uint64)
        for j in range(width - 1):
            has = count[short] > j
            more[has] += h[first[has] + j] * FACTORS[j]
        full = np.r_[full, more + count[short].astype(np.uint64)]
        of = np.r_[of, short]
    keys = np.unique((of.astype(np.uint64) << np.uint64(48)) | (mixed(full) >> np.uint64(16)))
    bounds = np.searchsorted(keys, np.arange(texts + 1, dtype=np.uint64) << np.uint64(48))
    return keys & np.uint64((1 << 48) - 1), bounds


def slices(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for row, end, data, offsets in text_slices(batch.column("text")):
        for a in range(0, end - row, 1 << 15):  # row numbers have 16 bits
            b = min(end - row, a + (1 << 15))
            yield row + a, row + b, *shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width)


def segment_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.r_[np.uint64(0), np.cumsum(values, dtype=np.uint64)]
    return sums[bounds[1:]] - sums[bounds[:-1]]


def groups_of(n: int) -> int:
    """Token groups of a set of ``n`` shingles: a power of two, so that each is a split of a coarser one."""
    return max(GROUPS, 1 << (max(1, n - 1) // 4).bit_length())


def count_vector(h: np.ndarray) -> bytes:
    """Shingles by token group, 255 where there are more."""
    groups = groups_of(len(h))
    return np.minimum(np.bincount((h & np.uint64(groups - 1)).astype(np.int64), minlength=groups), 255).astype(np.uint8).tobytes()


def count_vectors(h: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """``count_vector`` of each text; short texts all at once."""
    n = np.diff(bounds)
    short = n <= 4 * GROUPS
    of = np.repeat(np.cumsum(short) - 1, n)
    mine = np.repeat(short, n)
    flat = np.bincount(of[mine] * GROUPS + (h[mine] & np.uint64(GROUPS - 1)).astype(np.int64), minlength=short.sum() * GROUPS)
    flat, at, out = np.minimum(flat, 255).astype(np.uint8).tobytes(), 0, []
    for i, small in enumerate(short.tolist()):
        if small:
            out.append(flat[at : at + GROUPS])
            at += GROUPS
        else:
            out.append(count_vector(h[bounds[i] : bounds[i + 1]]))
    return out


def describe(docs: DataFrame, width: int) -> DataFrame:
    """``(id, n, s1, s2, vec)`` of each row: size, hash of the set, count vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, h, bounds in slices(batch, width):
                s1, s2 = segment_sums(mixed(h), bounds), segment_sums(mixed(h ^ np.uint64(1 << 50)), bounds)
                columns = [batch.column("id")[row:end], pa.array(np.diff(bounds)), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), pa.array(count_vectors(h, bounds), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n", "s1", "s2", "vec"])

    return docs.mapInArrow(run, "id long, n long, s1 long, s2 long, vec binary")


class Bands:
    """Size bands such that linked sets are in the same or in neighbouring bands, and each band's ranges.

    Linked sets of a level differ in at most ``differ`` shingles, so of ``differ + 1 + spare`` ranges more than ``spare`` hold the same in
    both, and as many as ``spare`` may be left out.
    """

    def __init__(self, percent: int, most: int) -> None:
        low, self.low = 1, [1]
        while low <= most:
            low = max(low + 1, -(-low * 100 // percent))
            self.low.append(low)
        self.ranges, self.spare = [], []
        for low, high in zip(self.low, self.low[1:], strict=False):
            a = high - 1
            both = a + a * 100 // percent
            differ = both * (100 - percent) // (100 + percent)
            spare = 0
            for _ in range(20):  # as many as ranges that a set of the least size leaves empty, with room for chance
                ranges = differ + 1 + spare
                empty = math.exp(-low / ranges)
                spare = min(math.ceil(empty * ranges + 2 * math.sqrt(empty * (1 - empty) * ranges)), differ)
            self.ranges.append(differ + 1 + spare)
            self.spare.append(spare)

    def band(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(np.array(self.low), n, "right") - 1


def signatures(h: np.ndarray, bounds: np.ndarray, bands: Bands) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(text, signature)`` of the ranges of each text, for its own band and the one below."""
    n = np.diff(bounds)
    band = bands.band(np.maximum(1, n))
    m = mixed(h + np.uint64(77))
    sums = np.r_[np.uint64(0), np.cumsum(m, dtype=np.uint64)]
    of = np.repeat(np.arange(len(n)), n)
    for down in (0, 1):
        level = band - down
        use = (n > 0) & (level >= 0)
        ranges = np.array(bands.ranges)[np.maximum(0, level)]
        spare = np.array(bands.spare)[np.maximum(0, level)]
        base = np.r_[0, np.cumsum(np.where(use, ranges, 0))]
        here = use[of]
        cell = base[of] + ((h >> np.uint64(16)) * ranges[of].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        size = np.bincount(cell[here], minlength=base[-1])
        text = np.repeat(np.arange(len(n)), np.diff(base))
        # a text's cells lie in hash order, so its first shingle in a cell follows from the sizes
        edge = np.r_[0, np.cumsum(size)]
        first = bounds[text] + edge[:-1] - edge[base[text]]
        # the thinnest ranges are left out, all of one size together: of those that linked sets share, both leave out the same or one the fewer
        least = np.zeros(len(n), np.int64)
        for thin in range(2):
            least += np.bincount(text, weights=size <= thin, minlength=len(n)) <= spare
        keep = size >= least[text]
        text, number, first, size = text[keep], (np.arange(base[-1]) - base[text])[keep], first[keep], size[keep]
        sig = mixed((sums[first + size] - sums[first]) + mixed(number.astype(np.uint64) + (level[text].astype(np.uint64) << np.uint64(32))))
        yield text, sig


def blocks(docs: DataFrame, width: int, bands: Bands, remember: int = 200_000, hold: int = 1 << 20) -> DataFrame:
    """``(block, id)``: the members of all blocks with several members; blocks with the same members are one.

    A block's name is a hash of its members, or of its range where it has over ``hold`` rows, which no task holds at once.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            for row, _, h, bounds in slices(batch, width):
                whole = segment_sums(mixed(h), bounds).tolist()
                new = np.ones(len(whole), bool)
                for i, (s, id_) in enumerate(zip(whole, ids[row : row + len(whole)].tolist(), strict=True)):
                    # a copy of what this task has blocked already under a smaller id; the smallest of all stands for the set later
                    new[i] = s not in seen
                    seen.add(s)
                if len(seen) > remember:
                    seen.clear()
                for text, sig in signatures(h, bounds, bands):
                    keep = new[text]
                    yield pa.RecordBatch.from_arrays([pa.array(sig[keep].view(np.int64)), pa.array(ids[row + text[keep]].astype(np.int64))], ["sig", "id"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: set[int] = set()
        for table, whole in runs(batches, "sig", hold):
            sig, ids = table.column("sig").to_numpy(), table.column("id").to_numpy()
            if not whole:
                yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array(ids)], ["block", "id"])
                continue
            order = np.lexsort((ids, sig))
            sig, ids = sig[order], ids[order]
            new = np.r_[True, (sig[1:] != sig[:-1]) | (ids[1:] != ids[:-1])]  # repeated rows are one member
            sig, ids = sig[new], ids[new]
            start = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
            size = np.diff(np.r_[start, len(sig)])
            name = np.add.reduceat(mixed(ids.view(np.uint64) ^ np.uint64(0x5BD1E995)), start)
            fresh = np.zeros(len(start), bool)
            for i in np.flatnonzero(size > 1).tolist():
                fresh[i] = int(name[i]) not in names
                names.add(int(name[i]))
            if len(names) > remember:
                names.clear()
            keep = np.repeat(fresh, size)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(name, size)[keep].view(np.int64)), pa.array(ids[keep])], ["block", "id"])

    rows = docs.where("id is not null").mapInArrow(emit, "sig long, id long")
    return rows.repartition("sig").sortWithinPartitions("sig").mapInArrow(gather, "block long, id long").distinct()


def runs(batches: Iterator[pa.RecordBatch], key: str, hold: int) -> Iterator[tuple[pa.Table, bool]]:
    """Tables of the sorted rows in which no run of equal keys is cut, with True; a run of over ``hold`` rows comes in parts, each with False."""
    held: list[pa.RecordBatch] = []
    long = None  # the key of a run that is handed on in parts
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy()
        if long is not None:
            n = int(np.searchsorted(k, long, "right"))
            if n:
                yield pa.Table.from_batches([batch.slice(0, n)]), False
            batch, k = batch.slice(n), k[n:]
            if not len(k):
                continue
            long = None
        cut = int(np.searchsorted(k, k[-1]))
        if held and (cut or held[-1].column(key)[-1].as_py() != k[0]):
            yield pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks(), True
            held = [batch.slice(cut)]
        elif cut:
            yield pa.Table.from_batches([batch.slice(0, cut)]), True
            held = [batch.slice(cut)]
        else:
            held.append(batch)
        if sum(b.num_rows for b in held) > hold:
            yield pa.Table.from_batches(held), False
            held, long = [], k[-1]
    if held:
        yield pa.Table.from_batches(held).combine_chunks(), True


def each_run(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """A table for each run of equal keys of the sorted rows, which are few for each key."""
    for table, _ in runs(batches, key, 1 << 62):
        k = table.column(key).to_numpy()
        start = np.r_[np.flatnonzero(np.r_[True, k[1:] != k[:-1]]), len(k)]
        for a, b in zip(start[:-1].tolist(), start[1:].tolist(), strict=True):
            yield table.slice(a, b - a)


def least_overlap(na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Shingles that linked sets of these sizes share at least."""
    return -(-percent * (na + nb) // (100 + percent))


class Points:
    """Count vectors on the coarsest groups that one of them has, with sizes.

    A vector with a cell of 255 is ``full``: the cell may stand for more, so that two such vectors bound nothing but their sizes.
    """

    def __init__(self, vectors: list[bytes], sizes: np.ndarray) -> None:
        groups = min(map(len, vectors))
        rows = [np.frombuffer(v, np.uint8) for v in vectors]
        self.full = np.array([r.max() == 255 for r in rows])
        self.at = np.stack([r.reshape(-1, groups).sum(0, dtype=np.int32) if len(r) > groups else r.astype(np.int32) for r in rows])
        self.sizes = sizes


class RTree:
    """Points in pages, pages in nodes: each node keeps its points' upper corner, least and largest size and, if they share it, group."""

    def __init__(self, points: Points, groups: np.ndarray) -> None:
        _, groups = np.unique(groups, return_inverse=True)
        self.order = np.lexsort((points.sizes, groups))
        self.points, self.sizes, self.groups, self.full = points.at[self.order], points.sizes[self.order], groups[self.order], points.full[self.order]
        self.levels = [(self.points, self.sizes, self.sizes, self.groups, self.full)]
        while len(self.levels[-1][0]) > TREE_LEAF:
            p, low, high, g, full = self.levels[-1]
            cuts = np.arange(0, len(p), TREE_LEAF)
            least, most = np.minimum.reduceat(g, cuts), np.maximum.reduceat(g, cuts)
            self.levels.append((np.maximum.reduceat(p, cuts), np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts), np.where(least == most, least, -1), np.logical_or.reduceat(full, cuts)))

    def near(self, k: int, percent: int) -> np.ndarray:
        """Positions of the points of other groups whose bound with point ``k`` reaches the link."""
        point, size, group, full = self.points[k], self.sizes[k], self.groups[k], self.full[k]
        at = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            corners, low, high, groups, fulls = self.levels[depth]
            at = at[groups[at] != group]
            at = at[(100 * high[at] >= percent * size) & (100 * size >= percent * low[at])]
            bound = np.minimum(corners[at], point).sum(1, dtype=np.int64)
            bound = np.where(fulls[at] & full, np.minimum(high[at], size), bound)
            at = at[bound >= least_overlap(np.maximum(low[at], -(-percent * size // 100)), size, percent)]
            if depth:
                at = (at[:, None] * TREE_LEAF + np.arange(TREE_LEAF)).ravel()
                at = at[at < len(self.levels[depth - 1][0])]
        return at


def joining_pairs(tree: RTree, percent: int) -> list[tuple[int, int]]:
    """Pairs (input positions) that join all that may link, were each pair a link: one for each point and group it is not joined with yet."""
    label = tree.groups.copy()
    out = []
    for k in range(len(label)):
        if (label == label[0]).all():
            break
        near = tree.near(k, percent)
        near = near[label[near] != label[k]]
        others, first = np.unique(label[near], return_index=True)
        out += [(int(tree.order[k]), int(tree.order[j])) for j in near[first]]
        if len(others):
            label[np.isin(label, others)] = label[k]
    return out


def linked_pairs(tree: RTree, percent: int, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links (input positions) that join the tree's groups as far as any do: a pair is verified unless its ends are joined already.

    Points of the largest group need not ask: every pair with them is found from its other side.
    """
    label = tree.groups.copy()
    done = np.zeros(len(label), bool)
    out = []
    for k in np.flatnonzero(label != np.argmax(np.bincount(label))).tolist():
        near = tree.near(k, percent)
        a = int(tree.order[k])
        for j in near[~done[near]].tolist():
            if label[j] == label[k]:
                continue
            b = int(tree.order[j])
            if alike(sets[a], sets[b], percent):
                out.append((a, b))
                label[label == label[j]] = label[k]
        done[k] = True
    return out


def alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = np.sort(np.concatenate([x, y]))
    same = int((both[1:] == both[:-1]).sum())
    return 100 * same >= percent * (len(both) - same)


def packed(h: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """Hashes of each text in six bytes each."""
    raw = h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
    return [raw[6 * a : 6 * b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def unpacked(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return wide.view("<u8").ravel()


def by_key(rows: DataFrame, *more: str) -> DataFrame:
    return rows.repartition("key").sortWithinPartitions("key", *more)


def first_tiles(members: DataFrame) -> DataFrame:
    """``members(block, v)`` to ``(key, v)``: blocks cut into tiles of some ``TILE`` members, each with its block's centre."""
    sizes = members.groupBy("block").agg(F.count("*").alias("k"), F.min_by("v", F.xxhash64("v")).alias("centre")).where("k > 1")
    sizes = sizes.withColumn("tiles", F.expr(f"cast(ceil(k / {TILE}.0D) as long)"))
    rows = members.join(sizes, "block").select("block", F.pmod(F.xxhash64("v"), F.col("tiles")).alias("tile"), "v")
    centres = sizes.where("tiles > 1").select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("tile"), F.col("centre").alias("v"))
    return rows.unionByName(centres).select(F.xxhash64("block", "tile").alias("key"), "v").distinct()


def second_tiles(members: DataFrame) -> DataFrame:
    """``members(block, v, comp)`` of blocks with several groups to ``(key, v, comp)``: each pair of groups meets in some key.

    A group with over ``TILE`` members has tiles of its own, smaller ones share tiles; a pair of tiles that are all of one group goes.
    """
    counts = members.groupBy("block", "comp").agg(F.count("*").alias("c"))
    small = counts.where(f"c < {TILE}").groupBy("block").agg(F.sum("c").alias("rest"))
    open_ = counts.groupBy("block").agg(F.count("*").alias("groups")).where("groups > 1").select("block")
    counts = counts.join(open_, "block", "left_semi").join(small, "block", "left")
    named = members.join(counts, ["block", "comp"]).withColumn("own", F.col("c") >= TILE)
    parts = F.expr(f"cast(ceil(if(own, c, rest) / {TILE}.0D) as long)")
    named = named.select("block", "v", "comp", F.xxhash64(F.when(F.col("own"), F.col("comp")), "own", F.pmod(F.xxhash64("v"), parts)).alias("tile"))
    tiles = named.groupBy("block", "tile").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
    pairs = tiles.toDF("block", "tile", "low", "high").join(tiles.toDF("block", "other", "low2", "high2"), "block").where("tile <= other and not (low = high and low2 = high2 and low = low2)")
    alone = tiles.groupBy("block").agg(F.count("*").alias("n"))
    pairs = pairs.join(alone, "block").where("n = 1 or tile <> other")  # a tile meets itself in its pairs with others
    keys = pairs.select("block", F.xxhash64("block", "tile", "other").alias("key"), F.explode(F.array_distinct(F.array("tile", "other"))).alias("tile"))
    return named.join(keys, ["block", "tile"]).select("key", "v", "comp")


def tree_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """``rows(key, v, n, vec)`` to the ``(a, b)`` that the first search asks for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in each_run(batches, "key"):
            v = table.column("v").to_numpy()
            if len(v) > 1:
                tree = RTree(Points(table.column("vec").to_pylist(), table.column("n").to_numpy()), np.arange(len(v)))
                found = joining_pairs(tree, percent)
                if found:
                    x, y = v[np.array(found)].T
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    return by_key(rows).mapInArrow(run, "a long, b long").where("a <> b").distinct()


def near_edges(rows: DataFrame, percent: int) -> DataFrame:
    """``rows(key, v, comp, n, vec)`` to ``(a, b)``: points of different groups in each other's reach, as many as join all that are in reach of one another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in each_run(batches, "key"):
            tree = RTree(Points(table.column("vec").to_pylist(), table.column("n").to_numpy()), table.column("comp").to_numpy())
            v = table.column("v").to_numpy()[tree.order]
            label, found = np.arange(len(v)), []
            for k in np.flatnonzero(tree.groups != np.argmax(np.bincount(tree.groups))).tolist():
                near = tree.near(k, percent)
                near = near[label[near] != label[k]]
                others, first = np.unique(label[near], return_index=True)
                found += [(v[k], v[j]) for j in near[first]]
                if len(others):
                    label[np.isin(label, others)] = label[k]
            if found:
                a, b = np.array(found).T
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])

    return by_key(rows).mapInArrow(run, "a long, b long").distinct()


def tree_links(rows: DataFrame, percent: int) -> DataFrame:
    """``rows(key, v, comp, items)`` to the ``(a, b)`` that link members of different groups, as many as join them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in each_run(batches, "key"):
            v = table.column("v").to_numpy()
            sets = [unpacked(raw) for raw in table.column("items").to_pylist()]
            tree = RTree(Points([count_vector(h) for h in sets], np.array([len(h) for h in sets])), table.column("comp").to_numpy())
            found = linked_pairs(tree, percent, sets)
            if found:
                x, y = v[np.array(found)].T
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])

    return by_key(rows).mapInArrow(run, "a long, b long")


def slot(id_: Column) -> Column:
    return F.pmod(F.xxhash64(id_), F.lit(FILTER_BITS))


def small(rows: DataFrame, most: int = 500_000) -> DataFrame:
    """``rows``, narrow ones, to be broadcast where they are ``most`` at most; beyond that they are joined by a shuffle."""
    return F.broadcast(rows) if rows.count() <= most else rows


def sets_of(ids: DataFrame, docs: DataFrame, width: int, remember: int = 200_000) -> DataFrame:
    """``(v, items)``: the sets of the documents in ``ids(v)``, and of a few others; only theirs are made again.

    They are found by a bit table of fixed size (2 MB on the driver). Repeated rows may come several times.
    """
    need = ids.select(slot(F.col("v")).alias("s")).groupBy(F.expr("s div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 64 as int))")).alias("bits")).toArrow()
    table = np.zeros(FILTER_BITS // 64, np.uint64)
    table[need["word"].to_numpy()] = need["bits"].to_numpy().view(np.uint64)
    table = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = table.value
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            s = batch.column("slot").to_numpy()
            batch = batch.filter(pa.array((bits[s // 64] >> (s % 64).astype(np.uint64)) & np.uint64(1) == 1))
            for row, end, h, bounds in slices(batch, width):
                ids = batch.column("id")[row:end]
                new = np.ones(end - row, bool)
                for i, mine in enumerate(zip(ids.to_pylist(), segment_sums(mixed(h), bounds).tolist(), strict=True)):
                    new[i] = bounds[i + 1] > bounds[i] and mine not in seen
                    seen.add(mine)
                if len(seen) > remember:
                    seen.clear()
                yield pa.RecordBatch.from_arrays([ids, pa.array(packed(h, bounds), pa.binary())], ["v", "items"]).filter(pa.array(new))

    made = save(docs.where("id is not null").withColumn("slot", slot(F.col("id"))).mapInArrow(run, "v long, items binary"), "set-items")
    table.destroy()
    return made


def verified(pairs: DataFrame, made: DataFrame, percent: int, share: int = 1000) -> DataFrame:
    """The ``(a, b)`` whose sets link. A set ``a`` is sent once for ``share`` of its pairs."""
    parts = pairs.groupBy("a").agg(F.expr(f"cast(ceil(count(*) / {share}.0D) as long)").alias("parts"))
    keyed = pairs.join(parts, "a").select(F.xxhash64("a", F.pmod(F.xxhash64("b"), F.col("parts"))).alias("key"), "a", "b")
    sides = keyed.select("key", F.lit(0).alias("side"), "a", F.col("a").alias("b")).distinct().unionByName(keyed.select("key", F.lit(1).alias("side"), "a", "b"))
    rows = made.join(small(save(sides.withColumn("v", F.col("b")), "sides")), "v").select("key", "side", "a", "b", "items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = None, []
        for batch in batches:
            keys, sides = batch.column("key").to_pylist(), batch.column("side").to_pylist()
            keep = []
            for k, side, raw in zip(keys, sides, batch.column("items"), strict=True):
                if k != key:
                    key, own = k, []
                other = unpacked(raw.as_py())
                if not side:
                    own.append(other)
                keep.append(bool(side) and any(alike(x, other, percent) for x in own))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return by_key(rows, "side").mapInArrow(run, "a long, b long").distinct()


def links(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """``sets`` of all rows with text, and ``(id, component)`` of the ids that have shingles."""
    docs = docs.where("text is not null")
    sets = save(describe(docs, width), "sets")
    most = sets.agg(F.max("n")).first()[0] or 0

    filled = sets.where("n > 0 and id is not null").select("id", "n", "s1", "s2")
    least = filled.groupBy("n", "s1", "s2").agg(F.min("id").alias("v"))
    names = save(filled.join(least, ["n", "s1", "s2"]).select("id", "v").distinct(), "names")
    same = names.groupBy("id").agg(F.min("v").alias("b"), F.max("v").alias("c")).where("b <> c").select("id", "b")  # ids that repeat with another text
    same = names.join(same, "id").where("v <> b").select(F.col("v").alias("a"), "b")

    members = blocks(docs, width, Bands(percent, most)).join(names, "id").select("block", "v").distinct()
    members = save(members, "blocks")
    points = save(sets.join(members.select("v").distinct(), sets["id"] == F.col("v"), "left_semi").dropDuplicates(["id", "s1", "s2"]).select(F.col("id").alias("v"), "n", "vec"), "points")

    asked = save(tree_pairs(first_tiles(members).join(points, "v"), percent), "asked")
    made = sets_of(asked.select(F.explode(F.array("a", "b")).alias("v")).distinct(), docs, width)
    groups = save(connected_components(verified(asked, made, percent).unionByName(same)), "groups")

    again = members.join(groups.withColumnRenamed("id", "v"), "v", "left").select("block", "v", F.coalesce("component", "v").alias("comp"))
    near = near_edges(second_tiles(again).join(points, "v"), percent)
    family = connected_components(near).toDF("v", "block").join(groups.withColumnRenamed("id", "v"), "v", "left").select("block", "v", F.coalesce("component", "v").alias("comp"))
    left = save(second_tiles(family), "open")
    rest = save(left.select("v").distinct().join(asked.select(F.explode(F.array("a", "b")).alias("v")), "v", "left_anti"), "rest")  # of blocks with several tiles
    if not rest.isEmpty():
        made = made.unionByName(sets_of(rest, docs, width))
    more = save(tree_links(made.join(small(left), "v"), percent).distinct(), "links")
    groups = joined_components(groups, more)
    comps = names.join(groups.withColumnRenamed("id", "v"), "v", "left").groupBy("id").agg(F.min(F.coalesce("component", "v")).alias("component"))
    return sets, save(comps, "components")


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` of each row; the component is the least id reachable by links."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sets, groups = links(docs, width, percent)
    rows = sets.select("id", "n").unionByName(docs.where("text is null").select("id", F.lit(0).cast("long").alias("n")))
    return rows.join(groups, "id", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def one_of_each_group(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` of the least id of each group, one row of each id; rows with a null id all stay, and so do texts without words.

    Of rows that repeat the id, the one with the longest text stays, then the first in order of the text; rows that are the same are one.
    """
    groups = jaccard_components(docs.select(id_col, text_col), width, percent, id_col, text_col).where(F.col(id_col).isNotNull())
    gone, again = free_names(docs, "gone", "again")
    drop = save(groups.groupBy(id_col).agg((F.min("component_id") != F.col(id_col)).alias("linked"), F.count("*").alias("rows")).where("linked or rows > 1").select(F.col(id_col).alias(gone), F.expr("not linked").alias(again)), "gone")
    rows = docs.join(drop, docs[id_col].cast("long") == drop[gone], "left").where(F.col(gone).isNull() | F.col(again))
    if drop.where(F.col(again)).isEmpty():
        return rows.drop(gone, again)
    plain = [F.xxhash64(c) for c, t in docs.dtypes if "map<" not in t]
    order = F.struct(F.coalesce(-F.char_length(text_col), F.lit(1)), F.coalesce(text_col, F.lit("")), *plain)
    repeated = rows.where(F.col(again)).groupBy(id_col).agg(F.min_by(F.struct(*docs.columns), order).alias(again)).select(F.col(again))
    return rows.where(F.col(again).isNull()).drop(gone, again).unionByName(repeated.select(f"{again}.*"))

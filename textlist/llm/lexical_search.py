"""Ranked lexical search: the best documents for each benchmark item, by a K2-treap over the grid of terms and documents.

1. Texts become postings of the terms that some item has: a table of bits of fixed size, made from the items, is all that tasks are sent of them. Lengths and
   document counts are taken over all documents.
2. Documents are dealt into blocks, and each block meets each part of the items in one task. There the grid of the part's terms (rows, by falling weight)
   and the block's documents (columns, by id) becomes a K2-treap: a quadtree whose cells exist only where they hold a posting, each with the highest impact
   in it, kept as child masks by level.
3. An item descends from the root with a path for each of its rows: a range of documents is bounded by the sum of the impacts of its cells, the ranges of highest bounds are halved first, and a
   range that cannot reach the best documents found is left. Single documents have exact scores.
4. The best of all blocks are merged by item.

Defined results: null and empty texts are no documents with terms and are never found; each row of ``documents`` is a document by itself, also where it repeats
an id; a null id comes after all others on ties; rows of one item id are one item, a null item id takes no part; items without terms have no rows, nor has an empty
table; very long texts and items are read whole; other columns are not read, whatever their names. Terms are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import save
from .textbytes import LOWER, text_slices, word_hashes, words

#: Bytes of terms: ASCII digits and letters, and all bytes of longer characters.
TERM = np.zeros(256, bool)
TERM[48:58] = TERM[65:91] = TERM[97:123] = TERM[128:] = True
#: Bits of the table of the items' terms. A fuller one lets more terms through, which costs work, not results.
TABLE_BITS = 24
#: Documents of a block and items of a part.
DOCUMENTS, ITEMS = 8192, 512
#: Ranges halved at once.
AT_ONCE = 256


def hashed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(hash, row)`` of each term of a slice of texts."""
    data = LOWER[data]
    start, end, row = words(data, offsets, TERM)
    return word_hashes(data, start, end), row


def item_terms(items: DataFrame) -> DataFrame:
    """``items(item_id, text)`` to distinct ``(item_id, term)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, data, offsets in text_slices(batch["text"]):
                term, row = hashed(data, offsets)
                yield pa.RecordBatch.from_arrays([batch["item_id"].take(pa.array(first + row)), pa.array(term.view(np.int64))], ["item_id", "term"])

    kind = items.schema["item_id"].dataType.simpleString()
    return items.where("item_id is not null").select("item_id", "text").mapInArrow(run, f"item_id {kind}, term long").distinct()


def bit_table(terms: DataFrame) -> np.ndarray:
    """The bits of all terms, of a fixed size; at most one row for each 64 of them comes to the driver."""
    slot = F.shiftrightunsigned("term", 64 - TABLE_BITS)
    rows = terms.select(slot.alias("slot")).groupBy(F.floor(F.col("slot") / 64).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("bits")).collect()
    out = np.zeros(1 << (TABLE_BITS - 6), np.uint64)
    out[[r["at"] for r in rows]] = np.array([r["bits"] for r in rows], np.int64).view(np.uint64)
    return out


def postings(documents: DataFrame, bits: np.ndarray) -> DataFrame:
    """``documents(doc_id, text)`` to ``(doc_id, n, terms, tfs)``: the count of all terms, and those that the table has with their counts."""
    sent = documents.sparkSession.sparkContext.broadcast(bits)  # of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for batch in batches:
            for first, end, data, offsets in text_slices(batch["text"]):
                rows = end - first
                term, row = hashed(data, offsets)
                n = np.bincount(row, minlength=rows)
                slot = term >> np.uint64(64 - TABLE_BITS)
                own = np.flatnonzero(table[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1))
                distinct, number = np.unique(term[own], return_inverse=True)
                cell, tf = np.unique(row[own] * max(1, len(distinct)) + number, return_counts=True)
                begin = np.searchsorted(cell, np.arange(rows + 1) * max(1, len(distinct))).astype(np.int32)
                kept = distinct.view(np.int64)[cell % max(1, len(distinct))]
                columns = [batch["doc_id"].slice(first, rows), pa.array(n.astype(np.int64)), pa.ListArray.from_arrays(begin, pa.array(kept)), pa.ListArray.from_arrays(begin, pa.array(tf.astype(np.int64)))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "terms", "tfs"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, terms array<long>, tfs array<long>")


POPCOUNT = np.array([bin(x).count("1") for x in range(16)], np.int64)


class Treap:
    """A K2-treap of the points ``(row, column)`` with positive values, in a grid of side ``2 ** height``.

    Nodes of all levels stand one after the other; a node has the highest value below it, a mask of its quadrants that are not
    empty, and the place of its first child.
    """

    def __init__(self, row: np.ndarray, column: np.ndarray, value: np.ndarray, height: int) -> None:
        self.height = height
        code = np.zeros(len(row), np.int64)
        for bit in range(height):
            code |= (row >> bit & 1) << (2 * bit + 1) | (column >> bit & 1) << (2 * bit)
        order = np.argsort(code)
        keys, most, masks, counts = code[order], value[order], [np.zeros(len(row), np.int64)], [np.zeros(len(row), np.int64)]
        values = [most]
        for _ in range(height):
            up = keys >> 2
            start = np.flatnonzero(np.r_[True, up[1:] != up[:-1]])
            masks.append(np.bitwise_or.reduceat(1 << (keys & 3), start))
            counts.append(np.diff(np.r_[start, len(keys)]))
            keys, most = up[start], np.maximum.reduceat(most, start)
            values.append(most)
        self.most, self.mask = np.concatenate(values[::-1]), np.concatenate(masks[::-1])
        children = np.concatenate(counts[::-1])
        self.first = 1 + np.cumsum(children) - children

    def best(self, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """``(column, sum)`` of the ``k`` columns with the highest positive sums over ``rows``, best first; the lower column on ties."""
        at, column, level = np.zeros((1, len(rows)), np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64)
        bound = np.array([len(rows) * self.most[0]])
        found, score, take = np.zeros(0, np.int64), np.zeros(0, np.int64), 16
        while len(bound):
            if len(bound) > take:
                pick = np.argpartition(-bound, take)[:take]
                rest = np.ones(len(bound), bool)
                rest[pick] = False
            else:
                pick, rest = slice(None), np.zeros(len(bound), bool)
            cells, deep, col = at[pick], level[pick], column[pick]
            below = (rows >> (self.height - 1 - deep)[:, None] & 1) << 1
            mask, first = np.where(cells >= 0, self.mask[cells], 0), self.first[cells]
            new = []
            for side in (0, 1):
                quadrant = below | side
                child = np.where(mask >> quadrant & 1, first + POPCOUNT[mask & (1 << quadrant) - 1], -1)
                new.append((child, 2 * col + side, deep + 1, np.where(child >= 0, self.most[child], 0).sum(axis=1)))
            child, col, deep, sums = (np.concatenate(x) for x in zip(*new, strict=True))
            leaf = (deep == self.height) & (sums > 0)
            if leaf.any():
                found, score = np.r_[found, col[leaf]], np.r_[score, sums[leaf]]
                order = np.lexsort((found, -score))[:k]
                found, score = found[order], score[order]
                take = AT_ONCE if len(found) == k else take
            go = (deep < self.height) & (sums > 0)
            at, column, level, bound = np.r_[at[rest], child[go]], np.r_[column[rest], col[go]], np.r_[level[rest], deep[go]], np.r_[bound[rest], sums[go]]
            if len(found) == k:  # a range with the same bound may still hold a lower column
                may = (bound > score[-1]) | (bound == score[-1]) & (column << (self.height - level) < found[-1])
                at, column, level, bound = at[may], column[may], level[may], bound[may]
        return found, score


def block_best(items: pa.Table, docs: pa.Table, k: int) -> pa.Table:
    """The best documents of a block for each item of a part."""
    docs, name = docs.sort_by("doc_id"), items["item_id"].combine_chunks().dictionary_encode()
    terms, number = np.unique(items["term"].to_numpy(), return_inverse=True)
    weight = np.zeros(len(terms), np.int64)
    weight[number] = items["w"].to_numpy()
    lists = docs["terms"].combine_chunks()
    column = np.repeat(np.arange(docs.num_rows), np.diff(lists.offsets.to_numpy()))
    term, tf = lists.flatten().to_numpy(), docs["tfs"].combine_chunks().flatten().to_numpy()
    at = np.minimum(np.searchsorted(terms, term), max(0, len(terms) - 1))
    own = np.flatnonzero(terms[at] == term) if len(terms) else np.zeros(0, np.int64)
    at, column, tf = at[own], column[own], tf[own]
    value = weight[at] * (1_000_000_000 * tf // (1000 * tf + 8 * docs["m"].to_numpy()[column]))
    some = np.flatnonzero(value)
    item, doc, score = [], [], []
    if len(some):
        place = np.empty(len(terms), np.int64)
        place[np.argsort(-weight, kind="stable")] = np.arange(len(terms))
        high, wide = int(len(terms) - 1).bit_length(), int(docs.num_rows - 1).bit_length()
        height = max(1, high, wide)
        place <<= height - max(1, high)  # rows stand apart, so that a cell of few documents has few rows
        treap = Treap(place[at[some]], column[some] << (height - max(1, wide)), value[some], height)
        asked = np.argsort(name.indices.to_numpy(), kind="stable")
        edges = np.searchsorted(name.indices.to_numpy()[asked], np.arange(len(name.dictionary) + 1))
        for i in range(len(name.dictionary)):
            col, best = treap.best(np.sort(place[number[asked[edges[i] : edges[i + 1]]]]), k)
            item.append(np.full(len(col), i))
            doc.append(col >> (height - max(1, wide)))
            score.append(best)
    item, doc, score = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (item, doc, score))
    return pa.table({"item_id": name.dictionary.take(pa.array(item)), "doc_id": docs["doc_id"].take(pa.array(doc)), "score": pa.array(score.astype(np.int64))})


def ranked_search(documents: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """``documents(doc_id, text)`` and ``items(item_id, text)`` to the ``k`` highest-scoring documents of each item: ``(item_id, rank, doc_id, score)``.

    Items are a stated query set; work is blocks of documents times parts of items, and what leaves a block are ``k`` rows for each item.
    """
    terms = save(item_terms(items), "terms")
    posted = save(postings(documents, bit_table(terms)), "postings")
    total = posted.agg(F.count_if(F.col("n") > 0).alias("N"), F.coalesce(F.sum("n"), F.lit(0)).alias("L"), F.count_if(F.size("terms") > 0).alias("held")).first()
    n, length = total["N"], max(1, total["L"])
    df = posted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weighed = save(terms.join(df, "term").withColumn("w", F.floor(1000 * F.log((2.0 * n + 2) / (2 * F.col("df") + 1)))).where("w > 0").select("item_id", "term", "w"), "weights")
    asked = weighed.select("item_id").distinct().count()
    parts, blocks = max(1, -(-asked // ITEMS)), max(1, -(-total["held"] // DOCUMENTS))
    each = lambda name, many: F.explode(F.sequence(F.lit(0), F.lit(many - 1))).alias(name)
    left = weighed.select(F.pmod(F.xxhash64("item_id"), F.lit(parts)).cast("int").alias("part"), each("block", blocks), "item_id", "term", "w")
    right = posted.where(F.size("terms") > 0).select(F.pmod(F.xxhash64("doc_id", "n", "terms"), F.lit(blocks)).cast("int").alias("block"), each("part", parts), "doc_id", F.expr(f"10 + (90 * n * {n}L) div {length}L").alias("m"), "terms", "tfs")
    shape = f"item_id {items.schema['item_id'].dataType.simpleString()}, doc_id {documents.schema['doc_id'].dataType.simpleString()}, score long"
    found = left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInArrow(lambda a, b: block_best(a, b, k), shape)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    found = found.select("item_id", "doc_id", "score").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
g AS (SELECT count(*) AS n, sum(len(ws)) AS l FROM d WHERE len(ws) > 0),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE item_id IS NOT NULL),
p AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(ws) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, g GROUP BY term, n),
s AS (SELECT i.item_id, d.row, d.doc_id, CAST(sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (10 + (90 * len(d.ws) * g.n) // g.l)))) AS BIGINT) AS score FROM i JOIN p USING (term) JOIN w USING (term) JOIN d ON d.row = p.row, g GROUP BY i.item_id, d.row, d.doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""

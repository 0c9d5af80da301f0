"""Exact substring dedup over UTF-8 bytes: every byte covered by a ``WIDTH``-byte string that starts earlier goes.

"Earlier" is a smaller document id, or the same document and a smaller start. The answer is exact for 64-bit hashes.

1. Anchors. Every window of ``WIDTH`` bytes picks the ``GRAM``-byte gram in it with the least hash (the last on ties). Equal windows pick equal
   grams at equal offsets. A first pass counts grams; those seen once cannot be part of a repeat. Grams seen more often
   are marked in a bit table of fixed size: what passes it by chance only costs work. So are grams of over ``HOT`` slices in a second one.
2. Pieces. The windows in a row that pick one anchor are a piece of text. A second pass sends each piece whose gram is marked to the task of its
   gram; a task sends equal pieces of one slice as one row with the list of places, so that a gram
   in a third of all documents is a few rows from each task. A hot gram is split by the bytes around it: a window has 0 to 68 bytes before its gram
   and the rest after it, so in each of ``PARTS`` classes of windows all share the gram and 51 bytes next to it, 83 in one run; a piece goes to the task of each such
   run that it has, and equal windows meet in the class that they are of.
3. Suffix arrays. Of equal pieces the first place stays and the rest go in whole, place by place as they come: a task holds each different piece once. Different pieces of one
   gram are cut into ``UNIT``-byte symbols
   counted from the gram. Symbols that only one piece has cannot be in a repeat, and runs of too few others are left out; the rest of
   a batch of grams is one sequence, whose suffix array is made by linear grouping. Neighbours in it
   that share as many symbols as every window holds in whole are candidates; windows are then compared
   by all their bytes, and the earliest of equal windows stays.
4. The spans are gathered by document, joined to the texts, merged and cut out.

Defined results: null and empty texts have no bytes and lose none; texts shorter than a window lose nothing; a null id sorts before all
others; repeated rows of an id are one document (the same place is not an earlier one), and each row gets
the result of its own text; very long texts are read whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .jaccard_join import runs
from .suffix_array import suffix_array
from .textbytes import mixed, text_slices, window_hashes, word_hashes

WIDTH, GRAM, UNIT = 100, 32, 8
#: Symbols that lie in every window in whole, wherever it starts.
WHOLE = (WIDTH - UNIT + 1) // UNIT
TABLE_BITS = 1 << 27
SLICE = 1 << 20
PIECES = 20_000
#: Slices in which a gram stands that is split, and the classes of windows that it is split by.
HOT, PARTS = 4096, 4
STEP = (WIDTH - GRAM) // PARTS
RUN = GRAM + STEP * (PARTS - 1)
NULL_ID = -(1 << 63)


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(first window, end window, anchor, gram hash)`` of each piece; window starts and anchors are byte positions."""
    none = np.zeros(0, np.int64)
    if len(data) < WIDTH:
        return none, none, none, none.astype(np.uint64)
    g = window_hashes(data, GRAM)
    span = WIDTH - GRAM + 1
    least, step = g, 1
    while 2 * step <= span:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    least = np.minimum(least[: len(g) - span + 1], least[span - step :][: len(g) - span + 1])
    newest = g[span - 1 :] == least
    begins = newest.copy()
    begins[1:] |= least[1:] != least[:-1]
    begins[0] = True
    inside = offsets[:-1][offsets[:-1] < len(least)]
    begins[inside] = True
    valid = np.ones(len(least), bool)  # windows that cross the end of a row are none
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        valid[max(a, b - WIDTH + 1) : b] = False
    ends = np.flatnonzero(~valid)
    begins[ends] = True
    first = np.flatnonzero(begins)
    end = np.r_[first[1:], len(least)]
    keep = valid[first]
    first, end = first[keep], end[keep]
    anchor = first + span - 1
    inner = np.flatnonzero(~newest[first])
    for part in np.array_split(inner, max(1, len(inner) // 20_000)):
        block = g[first[part][:, None] + np.arange(span - 1, -1, -1)]
        anchor[part] = first[part] + span - 1 - block.argmin(1)
    return first, end, anchor, mixed(g[anchor])


def slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - TABLE_BITS.bit_length() + 1)).astype(np.int64)


def marked_grams(docs: DataFrame, hot: int = HOT) -> np.ndarray:
    """Two bit tables, of grams seen more than once and of those seen over ``hot`` times (twice a slice at most): 16 MB each, however many there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column("text"), SLICE):
                h, n = np.unique(anchors(data, offsets)[3], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.minimum(n, 2).astype(np.int8))], ["h", "n"])

    counts = docs.select("text").mapInArrow(run, "h long, n byte").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1")
    at = f"shiftrightunsigned(h, {64 - TABLE_BITS.bit_length() + 1})"
    bit = f"shiftleft(1L, cast({at} % 64 as int))"
    words = counts.groupBy(F.expr(f"shiftright({at}, 6)").alias("word")).agg(F.bit_or(F.expr(bit)).alias("bits"), F.bit_or(F.expr(f"if(n > {hot}, {bit}, 0L)")).alias("hot"))
    table = np.zeros((2, TABLE_BITS // 64), np.uint64)
    found = words.toArrow()
    for k, c in enumerate(("bits", "hot")):
        table[k, found["word"].to_numpy()] = found[c].to_numpy().view(np.uint64)
    return table


def marked(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    s = slot(h)
    return (bits[s >> 6] >> (s & 63).astype(np.uint64)) & np.uint64(1) == 1


def split_grams(data: np.ndarray, first: np.ndarray, end: np.ndarray, anchor: np.ndarray, h: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(piece, key)``: pieces of other grams under their gram, those of hot grams under each run of bytes around the gram that they have."""
    piece, key = [np.flatnonzero(~hot)], [h[~hot]]
    for k in range(PARTS):
        start = anchor - STEP * k
        has = np.flatnonzero(hot & (start >= first) & (start + RUN <= end + WIDTH - 1))
        piece.append(has)
        key.append(mixed(word_hashes(data, start[has], start[has] + RUN) + np.uint64(k)))
    return np.concatenate(piece), np.concatenate(key)


def pieces(docs: DataFrame, table: np.ndarray) -> DataFrame:
    """``(h, at, text, doc, print, start)``: a gram, its offset in the piece, the piece, and the places where the slice has it."""
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, heavy = shared.value
        for batch in batches:
            ids, prints = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "print"))
            for row, _, data, offsets in text_slices(batch.column("text"), SLICE):
                first, end, anchor, h = anchors(data, offsets)
                keep = marked(bits, h)
                first, end, anchor, h = first[keep], end[keep], anchor[keep], h[keep]
                hot = marked(heavy, h)
                if hot.any():
                    piece, h = split_grams(data, first, end, anchor, h, hot)
                    first, end, anchor = first[piece], end[piece], anchor[piece]
                if not len(first):
                    continue
                raw = data.tobytes()
                own = np.searchsorted(offsets, first, "right") - 1
                doc, mark, start = ids[row + own].tolist(), prints[row + own].tolist(), (first - offsets[own]).tolist()
                places: dict[tuple, tuple[list, list, list]] = {}
                for k, key in enumerate(zip(h.tolist(), (anchor - first).tolist(), map(raw.__getitem__, map(slice, first.tolist(), (end + WIDTH - 1).tolist())), strict=True)):
                    at = places.get(key)
                    if at is None:
                        places[key] = [doc[k]], [mark[k]], [start[k]]
                    else:
                        at[0].append(doc[k])
                        at[1].append(mark[k])
                        at[2].append(start[k])
                keys = list(zip(*places, strict=True))
                all_ = list(zip(*places.values(), strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.array(keys[0], np.uint64).view(np.int64)), pa.array(keys[1], pa.int32()), pa.array(keys[2], pa.binary()),
                        pa.array(all_[0], pa.list_(pa.int64())), pa.array(all_[1], pa.list_(pa.int64())), pa.array(all_[2], pa.list_(pa.int32())),
                    ], ["h", "at", "text", "doc", "print", "start"],
                )

    return docs.mapInArrow(run, "h long, at int, text binary, doc array<long>, print array<long>, start array<int>")


def repeated_windows(h: np.ndarray, at: np.ndarray, text: list[bytes], doc: np.ndarray, start: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs ``(piece, first byte, end byte)`` that the first place of a piece loses to other pieces of its gram.

    The pieces differ; ``doc`` and ``start`` are the first place of each.
    """
    size = np.fromiter(map(len, text), np.int64, len(text))
    raw = np.frombuffer(b"".join(text), np.uint8)
    base = np.cumsum(size) - size
    gram = base + at  # where the gram stands in raw
    low = -(at // UNIT)  # symbols from low on lie in the piece in whole
    high = (size - at) // UNIT
    count = high - low
    piece = np.repeat(np.arange(len(text)), count)
    number = np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count) + low[piece]
    where = gram[piece] + UNIT * number
    chars = raw[where[:, None] + np.arange(UNIT)].view(np.uint64).ravel()
    key = mixed(chars ^ mixed(h.view(np.uint64)[piece] + number.astype(np.uint64)))  # equal bytes at equal distance from one gram
    _, symbol, times = np.unique(key, return_inverse=True, return_counts=True)
    alone = times[symbol] < 2
    cut = alone.copy()
    cut[0] = True
    cut[1:] |= (piece[1:] != piece[:-1]) | alone[:-1]
    run = np.cumsum(cut) - 1
    long_enough = (np.bincount(run)[run] >= WHOLE) & ~alone
    kept = np.flatnonzero(long_enough)
    if not len(kept):
        return []
    run = run[kept]
    gap = np.r_[False, run[1:] != run[:-1]]
    pos = np.arange(len(kept)) + np.cumsum(gap)  # in the sequence: an end symbol between runs
    sequence = np.zeros(int(pos[-1]) + 1, np.int64)
    sequence[pos] = symbol[kept] + 1
    back = np.full(len(sequence) + WHOLE, -1)
    back[pos] = kept
    ranked = np.array(suffix_array(sequence.tolist()))
    sequence = np.r_[sequence, np.zeros(WHOLE, np.int64)]
    ranked = ranked[sequence[ranked] > 0]
    same = np.ones(len(ranked) - 1, bool)
    for j in range(WHOLE):
        a, b = sequence[ranked[:-1] + j], sequence[ranked[1:] + j]
        same &= (a == b) & (a > 0)
    joined = np.r_[same, False] | np.r_[False, same]
    family = np.cumsum(np.r_[True, ~same])[joined]
    head = back[ranked[joined]]  # index of the first of the shared symbols

    begin = (where[head][:, None] - np.arange(UNIT)).ravel()
    family = (family[:, None] * UNIT + np.arange(UNIT)).ravel()
    owner = np.repeat(piece[head], UNIT)
    fits = (begin >= base[owner]) & (begin + WIDTH <= base[owner] + size[owner])
    begin, family, owner = begin[fits], family[fits], owner[fits]
    if not len(begin):
        return []
    lead = family % UNIT  # bytes before the shared symbols; the others follow them
    extra = np.arange(WIDTH - WHOLE * UNIT)
    rest = raw[begin[:, None] + np.where(extra < lead[:, None], extra, extra + WHOLE * UNIT)]
    rest = np.concatenate([rest, np.zeros((len(rest), -rest.shape[1] % 8), np.uint8)], 1).view(np.uint64)
    place = start[owner] + begin - base[owner]
    order = np.lexsort((place, doc[owner], *rest.T, family))
    f, r = family[order], rest[order]
    later = np.r_[False, (f[1:] == f[:-1]) & (r[1:] == r[:-1]).all(1)]
    lost = np.zeros(len(raw), bool)
    lost[begin[order][later]] = True
    edge = np.diff(np.r_[False, lost, False].astype(np.int8))
    edge_at = base[np.searchsorted(base, np.flatnonzero(edge == 1), "right") - 1]
    owners = np.searchsorted(base, np.flatnonzero(edge == 1), "right") - 1
    return list(zip(owners.tolist(), (np.flatnonzero(edge == 1) - edge_at).tolist(), (np.flatnonzero(edge == -1) - edge_at + WIDTH - 1).tolist(), strict=True))


class Batch:
    """Whole grams, one after the other: the first place of each different piece, and the spans that others lose."""

    def __init__(self) -> None:
        self.first: dict[tuple[int, int, bytes], tuple[int, int, int]] = {}
        self.lost: list[tuple[int, int, int, int]] = []

    def add(self, table: pa.Table) -> None:
        """Of the places of equal pieces, whichever is not the first so far is lost."""
        columns = (table.column(c).to_pylist() for c in ("h", "at", "text", "doc", "start", "print"))
        for gram, at, text, doc, start, mark in zip(*columns, strict=True):
            key, n = (gram, at, text), len(text)
            least = self.first.get(key)
            for place in zip(doc, start, mark, strict=True):
                if least is None:
                    least = place
                elif place[:2] != least[:2]:
                    gone, least = (place, least) if place > least else (least, place)
                    self.lost.append((gone[0], gone[2], gone[1], gone[1] + n))
            self.first[key] = least

    def spans(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*self.lost, strict=True)) or [()] * 4, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["id", "print", "start", "end"])
        self.lost = []
        return out

    def close(self) -> pa.RecordBatch:
        """The spans that differing pieces of one gram lose to each other, and those still held; the batch is empty then."""
        seen: dict[int, int] = {}
        for gram, _, _ in self.first:
            seen[gram] = seen.get(gram, 0) + 1
        several = [(*key, *place) for key, place in self.first.items() if seen[key[0]] > 1]
        if several:
            gram, at, text, doc, start, mark = zip(*several, strict=True)
            for k, a, b in repeated_windows(np.array(gram, np.int64), np.array(at, np.int64), list(text), np.array(doc, np.int64), np.array(start, np.int64)):
                self.lost.append((doc[k], mark[k], start[k] + a, start[k] + b))
        self.first = {}
        return self.spans()


def spans(rows: DataFrame, hold: int = 100_000) -> DataFrame:
    """``(id, print, start, end)`` of all spans to remove."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch, n = Batch(), 0
        for table, whole in runs(batches, "h", hold):
            batch.add(table)
            n += table.num_rows
            if whole and n >= PIECES:
                yield batch.close()
                n = 0
            elif len(batch.lost) > hold:
                yield batch.spans()
        yield batch.close()

    return rows.repartition("h").sortWithinPartitions("h").mapInArrow(run, "id long, print long, start int, end int")


def row_id(id_: Column) -> Column:
    return F.coalesce(id_.cast("long"), F.lit(NULL_ID))


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """``(id, n_bytes, n_removed, n_spans, kept, kept_sha256)`` of each row; ``kept`` is what is left, as bytes."""
    texts = docs.select(row_id(F.col(id_col)).alias("id"), F.xxhash64(text_col).alias("print"), F.col(text_col).alias("text"))
    found = spans(pieces(texts, marked_grams(texts, hot)))
    found = found.groupBy("id", "print").agg(F.collect_list(F.struct("start", "end")).alias("spans"))  # no more than one text has
    rows = docs.select(F.col(id_col).alias("doc_id"), row_id(F.col(id_col)).alias("id"), F.xxhash64(text_col).alias("print"), F.col(text_col).alias("text"))
    rows = rows.join(found, ["id", "print"], "left").select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, cuts in zip(batch.column("text"), batch.column("spans"), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                out.append(cut_out(raw, cuts.as_py() or []))
            size, gone, n, kept = zip(*out, strict=True) if out else ((),) * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(n, pa.int64()), pa.array(kept, pa.binary()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")


def cut_out(raw: bytes, cuts: list[dict]) -> tuple[int, int, int, bytes]:
    """Size, bytes removed, maximal removed runs, what is left."""
    at, gone, n, kept = 0, 0, 0, []
    reach = -1
    for a, b in sorted((c["start"], c["end"]) for c in cuts):
        if a > reach:
            kept.append(raw[max(at, 0) : a])
            n += 1
            gone += b - a
        elif b > reach:
            gone += b - reach
        reach = max(reach, b)
        at = reach
    kept.append(raw[at:])
    return len(raw), gone, n, b"".join(kept)

"""Media columns: FLAC streams in binary columns, decoded to PCM blocks with sample offsets.

``store`` makes a FLAC stream of each text's bytes, ``pcm_blocks`` turns any column of such
streams into a row for each frame (block number, first sample, samples, PCM bytes), so that a reader
can seek by sample, and ``media_digest`` stores, reads back and sums up in one pass.

Defined results: null and empty texts are 64 zero bytes of payload; very long texts are coded whole,
frame by frame, in slices of at least one text; a null stream has no blocks; a stream that is not
FLAC, fails a check sum (``Broken``) or has over 24 bits a sample (``Unread``) raises, and names the fault, unless ``on_error="skip"``, which leaves out its
blocks; repeated rows give equal rows; an empty table gives an empty result; columns other than the
id and the text or stream are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flac
from .textbytes import text_slices

UNIT = 64
SLICE = 1 << 19


def padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row followed by zero bytes up to a positive multiple of 64."""
    size = np.diff(offsets)
    whole = np.maximum(UNIT, -(-size // UNIT) * UNIT)
    at = np.r_[0, np.cumsum(whole)]
    out = np.zeros(int(at[-1]), np.uint8)
    out[np.repeat(at[:-1] - offsets[:-1], size) + np.arange(len(data))] = data
    return out, at


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_bytes, media)``: the FLAC stream of each padded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in text_slices(batch.column(1), SLICE):
                streams = flac.encode(*padded(data, offsets))
                yield pa.RecordBatch.from_arrays([batch.column(0)[row:end], pa.array(np.diff(offsets)), pa.array(streams, pa.binary())], [id_col, "n_bytes", "media"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, media binary")


def decoded(streams: pa.Array, on_error: str) -> Iterator[tuple[np.ndarray, flac.Frames]]:
    """The frames of ``streams``, some ``SLICE`` of bytes or samples at a time and at least one stream, and where these streams stand; nulls are left out.

    Where one of several streams has a fault, each is decoded by itself.
    """

    def read(some: list[tuple[int, bytes]]) -> Iterator[tuple[np.ndarray, flac.Frames]]:
        try:
            yield np.array([i for i, _ in some], np.int64), flac.decode([x for _, x in some])
        except (flac.Broken, flac.Unread):
            if len(some) > 1:
                for one in some:
                    yield from read([one])
            elif on_error != "skip":
                raise

    held, size = [], 0
    for i, stream in enumerate(streams):
        if not stream.is_valid:
            continue
        x = stream.as_py()
        try:
            head = flac.metadata(x)
            heavy = max(len(x), head.total * head.channels)
        except (flac.Broken, flac.Unread):
            heavy = len(x)
        if held and size + heavy > SLICE:
            yield from read(held)
            held, size = [], 0
        held.append((i, x))
        size += heavy
    if held:
        yield from read(held)


def pcm_blocks(media: DataFrame, id_col: str = "doc_id", media_col: str = "media", on_error: str = "raise") -> DataFrame:
    """``(id, block, sample_offset, n_samples, channels, bits, pcm)`` of each frame of each stream.

    PCM is signed and little-endian, channels interleaved, in as many whole bytes as a sample needs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, f in decoded(batch.column(1), on_error):
                wide = -(-f.depth // 8)
                if len(np.unique(wide)) == 1:
                    data = f.samples.astype("<i4").view(np.uint8).reshape(-1, 4)[:, : wide[0]].tobytes()
                else:
                    data = f.samples.astype("<i4").view(np.uint8).reshape(-1, 4)[np.arange(4) < np.repeat(wide, np.diff(f.offsets))[:, None]].tobytes()
                ends = np.cumsum(f.count * (f.channels * wide)[f.row]).tolist()
                block = np.arange(len(f.row)) - np.searchsorted(f.row, f.row)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(at[f.row])), pa.array(block), pa.array(f.sample), pa.array(f.count), pa.array(f.channels[f.row].astype(np.int32)), pa.array(f.depth[f.row].astype(np.int32)),
                        pa.array([data[a:b] for a, b in zip([0, *ends], ends)], pa.binary()),  # noqa: B905
                    ], [id_col, "block", "sample_offset", "n_samples", "channels", "bits", "pcm"],
                )

    kind = media.schema[id_col].dataType.simpleString()
    return media.select(id_col, media_col).mapInArrow(run, f"`{id_col}` {kind}, block long, sample_offset long, n_samples long, channels int, bits int, pcm binary")


def features(samples: np.ndarray, offsets: np.ndarray) -> list[str]:
    """Mean and energy of the samples, energy of their differences and sign changes, each in whole numbers."""
    n = np.diff(offsets)
    step = np.diff(samples, prepend=samples[:1])
    step[offsets[:-1]] = 0
    turn = np.r_[False, (samples[1:] < 0) != (samples[:-1] < 0)]
    turn[offsets[:-1]] = False
    sums = [np.add.reduceat(x.astype(np.int64), offsets[:-1]) for x in (samples, samples * samples, step * step, turn)]
    return [f"mean={a * 1000 // m},energy={b * 1000 // m},step={c * 1000 // m},turns={d}" for m, a, b, c, d in zip(n.tolist(), *(x.tolist() for x in sums), strict=True)]


def media_digest(docs: DataFrame) -> DataFrame:
    """The query's columns: each text is stored as a FLAC stream, and the stored bytes are read back and checked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in text_slices(batch.column(1), SLICE):
                streams = flac.encode(*padded(data, offsets))
                read = flac.decode(streams)
                payload = (read.samples + 128).astype(np.uint8).tobytes()
                ends = read.offsets.tolist()
                each = [payload[a:b] for a, b in zip(ends, ends[1:])]  # noqa: B905
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[row:end],
                        pa.array(np.diff(offsets)),
                        pa.array(np.diff(read.offsets)),
                        pa.array([hashlib.sha256(x).hexdigest() for x in each]),
                        pa.array([zlib.crc32(x[-UNIT:]) for x in each], pa.int64()),
                        pa.array([len(x) for x in streams], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in streams]),
                        pa.array(features(read.samples, read.offsets)),
                    ],
                    NAMES,
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    types = [kind, "long", "long", "string", "long", "long", "string", "string"]
    return docs.select("doc_id", F.col("text")).mapInArrow(run, ", ".join(map(" ".join, zip(NAMES, types, strict=True))))


NAMES = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def block_digest(docs: DataFrame) -> DataFrame:
    """``(doc_id, block, sample_offset, n_samples, pcm)``: the stored streams of all texts, read back block by block; PCM as hexadecimal."""
    rows = pcm_blocks(store(docs.select("doc_id", "text")))
    return rows.select("doc_id", "block", "sample_offset", "n_samples", F.hex("pcm").alias("pcm"))


#: Samples are bytes less 128, so that as signed bytes their top bit is turned: half of each hexadecimal pair by a table.
BLOCK_ORACLE = """
WITH p AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, rpad(h, CAST(greatest(1, ceil(length(h) / 128.0)) AS INT) * 128, '0') AS h FROM p),
b AS (SELECT doc_id, unnest(range(CAST(ceil(length(h) / 512.0) AS BIGINT))) AS block, h FROM w),
c AS (SELECT doc_id, block, substr(h, block * 512 + 1, 512) AS h FROM b)
SELECT doc_id, block, block * 256 AS sample_offset, length(h) // 2 AS n_samples,
  array_to_string(list_transform(range(length(h) // 2), lambda i: translate(substr(h, 2 * i + 1, 1), '0123456789ABCDEF', '89ABCDEF01234567') || substr(h, 2 * i + 2, 1)), '') AS pcm FROM c
"""

"""Words of many texts at once, as hashes, straight from Arrow's buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64
#: Bytes that separate words, and A-Z as a-z.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Longer words are hashed one by one.
BLOCKS = 8
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=U)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that lets every bit depend on every other."""
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(32))


def in_groups(batches: Iterator[pa.RecordBatch], limit: int, column: str = "text") -> Iterator[pa.Table]:
    """Tables of about ``limit`` bytes of text, or of one longer text."""
    kept, size = [], 0
    for batch in batches:
        ends = np.cumsum(np.diff(_offsets(batch.column(column))))
        low = 0
        while low < batch.num_rows:
            before = int(ends[low - 1]) if low else 0
            high = max(low + 1, int(np.searchsorted(ends, before + limit - size, side="right")))
            kept.append(batch.slice(low, high - low))
            size += int(ends[high - 1]) - before
            low = high
            if size >= limit or low < batch.num_rows:
                yield pa.Table.from_batches(kept).combine_chunks()
                kept, size = [], 0
    if kept:
        yield pa.Table.from_batches(kept).combine_chunks()


def _offsets(texts: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_string(texts.type)
    raw = np.frombuffer(texts.buffers()[1], dtype=np.int64 if wide else np.int32) if len(texts) else np.zeros(1, dtype=np.int64)
    return raw[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)


def word_hashes(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """A 63-bit hash of each word of all ``texts`` (no nulls), with A-Z as a-z, and each text's number of words.

    Words of up to 8 bytes have a hash of their own; longer ones are told apart by 63 bits.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.chunk(0) if texts.num_chunks == 1 else pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    offsets = _offsets(texts)
    low, n = int(offsets[0]), int(offsets[-1] - offsets[0])
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
    raw = np.zeros(n + 8, dtype=np.uint8)
    raw[:n] = LOWER[np.frombuffer(texts.buffers()[2], dtype=np.uint8)[low : low + n]]
    solid = ~SPACE[raw[:n]]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    edge = offsets[:-1] - low
    edge = edge[edge < n]
    begins[edge] = solid[edge]
    stops = solid.copy()
    stops[:-1] &= ~solid[1:]
    edge = offsets[1:] - low - 1
    edge = edge[edge >= 0]
    stops[edge] = solid[edge]
    start, size = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    size -= start
    eights = np.ndarray((n + 1,), dtype="<u8", buffer=raw, strides=(1,))
    first = eights[start] & _KEEP[np.minimum(size, 8)]
    h = mixed(first + np.minimum(size, 8).astype(U) * U(0x9E3779B97F4A7C15))
    rows = np.flatnonzero(size > 8)
    for block in range(1, BLOCKS):
        if not len(rows):
            break
        left = size[rows] - 8 * block
        more = eights[start[rows] + 8 * block] & _KEEP[np.minimum(left, 8)]
        h[rows] = mixed(h[rows] * U(0x9E3779B97F4A7C15) + more + np.minimum(left, 8).astype(U))
        rows = rows[left > 8]
    for k in rows.tolist():
        h[k] = xxhash.xxh3_64_intdigest(raw[start[k] : start[k] + size[k]].tobytes())
    counts = np.searchsorted(start, offsets - low, side="left")
    return (h >> U(1)).astype(np.int64), np.diff(counts)

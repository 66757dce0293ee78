"""Vectorised text helpers for Arrow batches: word spans, hashes, batch slices.

Texts are handled as UTF-8 bytes. Every word class here holds either all or
none of the bytes from 0x80, so words never cut a character. Each text is
followed by a newline, which no word class holds, so words never cross texts.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at a time, so that arrays over them stay in a core's cache; a longer text is one slice.
SLICE_BYTES = 500_000

U = np.uint64


def _table(predicate) -> np.ndarray:
    return np.array([predicate(b) for b in range(256)], dtype=bool)


#: `[^\x20\x09-\x0D]`
NOT_BLANK = _table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]`
ALNUM = _table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
#: Lower case of A-Z.
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)

_rng = np.random.default_rng(20240607)
#: A random odd 64-bit number for each byte value.
BYTE_CODE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_BASE = U(0x9E3779B97F4A7C15)
_BASE_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]), 1 << 16)
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (shifts and odd multipliers)."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U(33))
    h = h * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of the batch's rows with about ``limit`` bytes of text each."""
    if not batch.num_rows:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    part = (np.cumsum(lengths + 1) - 1) // limit
    cuts = np.flatnonzero(np.diff(part)) + 1
    bounds = [0, *cuts.tolist(), batch.num_rows]
    for a, b in zip(bounds, bounds[1:]):
        yield batch.slice(a, b - a)


def looked_up(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """``table[data]`` for a table of one byte for each byte value."""
    return np.frombuffer(data.tobytes().translate(table.view(np.uint8).tobytes()), np.uint8)


def release() -> None:
    """Give memory that a task has freed back to the system: its worker process lives on beside the JVM."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # not glibc
        pass


class Texts:
    """The texts of a string column as one byte array.

    ``data`` holds each text followed by a newline; text i is
    ``data[start[i]:start[i + 1] - 1]``. Null counts as empty.
    """

    def __init__(self, column: pa.Array):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = pc.fill_null(column.cast(pa.large_string()), "")
        joined = pc.binary_join_element_wise(column, pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()))
        n = len(joined)
        offsets = np.frombuffer(joined.buffers()[1], dtype=np.int64)[joined.offset : joined.offset + n + 1]
        self.n = n
        self.start = offsets - offsets[0] if n else np.zeros(1, np.int64)
        raw = joined.buffers()[2]
        whole = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
        self.data = whole[int(offsets[0]) : int(offsets[-1])] if n else whole[:0]

    def lowered(self) -> np.ndarray:
        return looked_up(self.data, LOWER)

    def owner(self, positions: np.ndarray) -> np.ndarray:
        """The number of the text that each byte position is in."""
        return np.searchsorted(self.start, positions, side="right") - 1


def spans(data: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes of a class."""
    inside = np.zeros(len(data) + 2, np.uint8)
    inside[1:-1] = looked_up(data, kind)
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


#: Bytes up to which a span is hashed by blocks of eight; a longer one by sums over all bytes.
_SHORT = 64
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, alike for equal bytes wherever they stand."""
    size = end - start
    h = size.astype(np.uint64) * U(0xD6E8FEB86659FD93)
    blocks = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    live = np.flatnonzero(size <= _SHORT)
    for at in range(0, _SHORT, 8):
        if at:
            live = live[size[live] > at]
        if not len(live):
            break
        word = blocks[start[live] + at] & _MASKS[np.minimum(size[live] - at, 8)]
        mixed = (h[live] ^ word) * U(0x9FB21C651E98DF25)
        h[live] = mixed ^ (mixed >> U(32))
    if len(long := np.flatnonzero(size > _SHORT)):
        power, inverse = _power_tables(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_CODE[data] * power[:-1], out=total[1:])
        h[long] += (total[end[long]] - total[start[long]]) * inverse[start[long]]
    return mix(h)


def run_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive entries; shorter than ``h`` by k - 1."""
    n = max(0, len(h) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * U(0xC2B2AE3D27D4EB4F) + h[j : j + n]
    return mix(out)


def counts(owner: np.ndarray, n: int) -> np.ndarray:
    """How many entries each of n owners has."""
    return np.bincount(owner, minlength=n).astype(np.int64)

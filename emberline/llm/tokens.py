"""Words and hashes of whole Arrow text batches in numpy, without a Python loop over words.

A word is a maximal run of bytes other than space and ``\\x09``-``\\x0D``. NULL texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 21  # texts of one step; a longer single text makes a step of its own

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column, one after the other, and where each row begins (one more than rows)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_string()) if pa.types.is_string(column.type) else column
        column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = column.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows whose texts have at most ``limit`` bytes together, one row at least."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths.astype(np.int64))
        at, n = 0, batch.num_rows
        while at < n:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finalizer, in place."""
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    table = _powers.get(base)
    if table is None or len(table) < n:
        factors = np.full(max(n, SLICE_BYTES + 64), np.uint64(base))
        factors[0] = 1
        table = _powers[base] = np.cumprod(factors)
    return table


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    """What :func:`span_hashes` needs of ``buf``; one value more than bytes."""
    sums = np.zeros(len(buf) + 1, dtype=np.uint64)
    terms = buf.astype(np.uint64)
    terms += np.uint64(1)
    terms *= _power_table(_INVERSE, len(buf))[: len(buf)]
    np.cumsum(terms, out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span of the buffer with these prefix sums; equal bytes have equal hashes."""
    h = sums[ends]
    h -= sums[starts]
    h *= _power_table(_BASE, len(sums))[starts]
    return mix(h)


@dataclass
class Words:
    """Words of a run of texts: byte spans, and for each text the number of its first word (one more than texts)."""

    buf: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self, lower: bool = True) -> np.ndarray:
        return span_hashes(prefix_sums(LOWER[self.buf] if lower else self.buf), self.starts, self.ends)


def words(column: pa.Array) -> Words:
    buf, offsets = text_buffer(column)
    if not len(buf):
        none = np.zeros(0, np.int64)
        return Words(buf, offsets, none, none, np.zeros(len(offsets), np.int64))
    inside = ~_SPACE[buf]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    close = inside.copy()
    close[:-1] &= ~inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(buf))]
    begin[cuts] = inside[cuts]
    close[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(close) + 1
    return Words(buf, offsets, starts, ends, np.searchsorted(starts, offsets))


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` neighbours of ``h``; it has ``len(h) - k + 1`` values, or none."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for j in range(1, k):
        out *= np.uint64(_BASE)
        out ^= out >> np.uint64(29)
        out += h[j : j + n]
    return mix(out)


def inside_text(w: Words, k: int) -> np.ndarray:
    """Numbers of the words at which a run of ``k`` words of one text begins."""
    last = np.repeat(w.first[1:], w.counts)
    at = np.arange(len(w.starts))
    return at[at + k <= last]


def signed(h: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(h).view(np.int64))

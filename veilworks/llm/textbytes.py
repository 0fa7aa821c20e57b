"""Vectorised work on whole batches of UTF-8 text: word spans, word hashes and rolling window hashes.

Every function takes flat numpy arrays, so one call serves thousands of texts. Hashes are
polynomials modulo 2**64 finished by a bit mixer; they are equal in every process and run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The bytes that separate words: blank and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_SPACE = ~SPACE
#: ASCII letters to lower case, all other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_ODD = 0x9E3779B97F4A7C15
_ROLL = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_BLOCK = 1 << 17


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_tables: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _tables or len(_tables["up"]) < n:
        n = max(n, _BLOCK + 1)
        _tables["up"] = _powers(_ODD, n)
        _tables["down"] = _powers(pow(_ODD, -1, 1 << 64), n)
    return _tables["up"], _tables["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


#: Two sets of values of the 256 bytes: their numbers from 1, and random ones from a rule.
BYTE_VALUES = (np.arange(1, 257, dtype=np.uint64), mix(np.arange(501, 757, dtype=np.uint64)))


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts on end, and n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32, n + 1 + column.offset)[column.offset :].astype(np.int64)
    if data is None or not offsets[-1]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of about `limit` bytes of text, so that memory stays bounded."""
    for batch in batches:
        _, offsets = flat(batch.column(text))
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit)))
            yield batch.slice(start, min(end, batch.num_rows) - start)
            start = end


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the longest runs of `inside` bytes within each text, and n + 1 word offsets."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    is_in = inside[data]
    begins, closes = is_in.copy(), is_in.copy()
    begins[1:] &= ~is_in[:-1]
    closes[:-1] &= ~is_in[1:]
    edge = offsets[1:-1]
    first = edge[edge < n]
    begins[first] = is_in[first]
    last = edge[edge > 0] - 1
    closes[last] = is_in[last]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = BYTE_VALUES[0]) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; spans are in order and do not overlap.

    values: what each byte counts as; another of BYTE_VALUES gives a hash independent of the first."""
    out = np.empty(len(starts), np.uint64)
    at, n = 0, len(starts)
    while at < n:
        base = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, base + _BLOCK, side="right")))
        size = int(ends[to - 1] - base)
        up, down = _power_tables(size + 1)
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(values[data[base : base + size]] * up[:size], out=sums[1:])
        s, e = starts[at:to] - base, ends[at:to] - base
        out[at:to] = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(_ROLL[0])
        at = to
    return mix(out)


def rolling(h: np.ndarray, k: int, variant: int = 0) -> np.ndarray:
    """A hash of each run of k values (the last k - 1 positions are void), by doubling."""
    if len(h) < k or k < 1:
        return np.zeros(0, np.uint64)
    base = _ROLL[variant] | 1
    done, length, unit, size = None, 0, h, 1
    while True:
        if k & size:
            if done is None:
                done, length = unit, size
            else:
                n = len(h) - length - size + 1
                done = done[:n] + unit[length : length + n] * np.uint64(pow(base, length, 1 << 64))
                length += size
        if length == k:
            return mix(done + np.uint64(k))
        n = len(h) - 2 * size + 1
        if n > 0:
            unit = unit[:n] + unit[size : size + n] * np.uint64(pow(base, size, 1 << 64))
        size *= 2


def owners(word_offsets: np.ndarray) -> np.ndarray:
    """For each word the index of its text."""
    return np.repeat(np.arange(len(word_offsets) - 1), np.diff(word_offsets))


def window_starts(word_offsets: np.ndarray, k: int) -> np.ndarray:
    """Positions at which a window of k words lies within one text."""
    ends = np.repeat(word_offsets[1:], np.diff(word_offsets))
    return np.flatnonzero(np.arange(len(ends)) + k <= ends)

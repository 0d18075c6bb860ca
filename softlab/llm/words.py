"""Vectorised words and word hashes over Arrow text batches.

The separators of every word rule used here are ASCII bytes, so words can be
cut on the UTF-8 bytes of a whole batch with a 256-entry lookup table: no
regular expression and no Python string per word.  A word's 64-bit hash is a
polynomial in an odd base modulo 2**64 over random byte values, taken from
prefix sums and mixed at the end; a window's hash is a polynomial over its
word hashes.  Bytes are worked through in blocks of ``BLOCK`` (cut between
words), so memory is bounded whatever the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 16          # bytes hashed at a time (fits a core's cache)
SLICE_BYTES = 4 << 20    # text of the sub-batches given to the numpy code

_rng = np.random.Generator(np.random.PCG64(20240917))
_BYTE_VALUE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_WINDOW_BASE = np.uint64(0xD6E8FEB86659FD93)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: ``[^\x20\x09-\x0D]+``
NOT_BLANK = np.ones(256, dtype=bool)
NOT_BLANK[[0x20, *range(0x09, 0x0E)]] = False
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` (after lower-casing A-Z)
ALNUM = np.ones(256, dtype=bool)
ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = False

_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(which: str, n: int) -> np.ndarray:
    """The first ``n`` powers of the base ("up") or of its inverse ("down")."""
    if len(_powers[which]) < n:
        steps = np.full(max(n, BLOCK + 4096), _BASE if which == "up" else _BASE_INVERSE, np.uint64)
        steps[0] = 1
        _powers[which] = np.cumprod(steps)
    return _powers[which][:n]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser (splitmix64); ``salt`` gives independent functions."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n + 1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    n = len(column)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch | pa.Table, text: str, limit: int = SLICE_BYTES) -> Iterator:
    """Consecutive row ranges of ``batch`` with about ``limit`` bytes of text
    each (one row at least; every row exactly once)."""
    if isinstance(batch, pa.Table):
        batch = batch.combine_chunks()
    n = batch.num_rows
    if n == 0:
        return
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0)
    ends = np.cumsum(np.asarray(size, dtype=np.int64))
    start, done = 0, 0
    while start < n:
        stop = max(int(np.searchsorted(ends, done + limit, side="right")), start + 1)
        yield batch.slice(start, stop - start)
        done, start = ends[stop - 1], stop


class Words:
    """Words of the rows of one text buffer.

    ``start``/``end``: byte positions; ``first``: index of each row's first
    word (n + 1 entries); ``hash``: 64-bit hash of each word.
    """

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, lower: bool = False,
                 hashed: bool = True):
        self.buf = LOWER[buf] if lower else buf
        inside = is_word[self.buf]
        n = len(buf)
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        cuts = offsets[(offsets > 0) & (offsets < n)]
        begins[cuts] = inside[cuts]
        ends[cuts - 1] = inside[cuts - 1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets).astype(np.int64)
        if hashed:
            self.hash = hash_ranges(self.buf, self.start, self.end)

    def __len__(self) -> int:
        return len(self.start)

    @property
    def rows(self) -> np.ndarray:
        """Row of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions (word indices) at which ``n`` words of one row begin, and
        the hashes of those windows."""
        h = window_hash(self.hash, n)
        ok = np.zeros(len(self) + 1, np.int32)
        begin, stop = self.first[:-1], np.maximum(self.first[1:] - n + 1, self.first[:-1])
        np.add.at(ok, begin, 1)
        np.add.at(ok, stop, -1)
        at = np.flatnonzero(np.cumsum(ok[:-1]) > 0)
        return at, h[at]


def hash_ranges(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges that are in order and don't overlap."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = max(int(np.searchsorted(end, start[i] + BLOCK, side="right")), i + 1)
        low, high = int(start[i]), int(end[j - 1])
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(_BYTE_VALUE[buf[low:high]] * _power("up", high - low), out=sums[1:])
        a, b = start[i:j] - low, end[i:j] - low
        out[i:j] = (sums[b] - sums[a]) * _power("down", high - low + 1)[a] + (b - a).astype(np.uint64)
        i = j
    return mix(out)


def window_hash(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` entries from each position on (the last n - 1 entries
    of the result are not windows and hold 0)."""
    out = np.zeros(len(h), np.uint64)
    m = len(h) - n + 1
    if m > 0:
        acc = h[:m].copy()
        for k in range(1, n):
            acc *= _WINDOW_BASE
            acc += h[k:k + m]
        out[:m] = mix(acc, n)
    return out


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... (length[0] of them), start[1], ... in one array."""
    total = int(length.sum())
    if total == 0:
        return np.empty(0, np.int64)
    shift = np.asarray(start, np.int64) - (np.cumsum(length) - length)
    kind = np.int32 if total < 2**31 and int(shift.max()) + total < 2**31 and int(shift.min()) > -2**31 else np.int64
    out = np.repeat(shift.astype(kind), length)
    out += np.arange(total, dtype=kind)
    return out


def cover(at: np.ndarray, length, n: int) -> np.ndarray:
    """Which of ``n`` positions lie in a range ``[at, at + length)``."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, at, 1)
    np.add.at(step, at + length, -1)
    return np.cumsum(step[:-1]) > 0


def pack(sorted_values: np.ndarray) -> bytes:
    """Ascending unsigned integers as differences, byte plane by byte plane:
    the planes of zeros shrink to nothing in Spark's shuffle compression."""
    d = np.diff(sorted_values, prepend=sorted_values.dtype.type(0))
    return planes(d)


def unpack(data: bytes, kind) -> np.ndarray:
    d = unplanes(data, kind)
    return np.cumsum(d, dtype=kind)


def planes(values: np.ndarray) -> bytes:
    w = values.dtype.itemsize
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, w).T).tobytes()


def unplanes(data: bytes, kind) -> np.ndarray:
    w = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(w, -1).T).reshape(-1).view(kind)

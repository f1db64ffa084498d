"""Whole-batch text primitives on numpy arrays.

Everything here works on the UTF-8 bytes of an Arrow string column without a
Python object per word. Batches are walked in pieces of about ``PIECE`` bytes,
so memory follows the piece (or the one longest text), not the batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text handled at a time.
PIECE = 1 << 18

_U64 = np.uint64
_BASE = _U64(0x9E3779B97F4A7C15)

#: The characters that part words: space and U+0009 to U+000D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: ASCII lower-casing of bytes; other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes that part words when punctuation is to be ignored.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(_U64, copy=True)
    x ^= x >> _U64(33)
    x *= _U64(0xFF51AFD7ED558CCD)
    x ^= x >> _U64(33)
    x *= _U64(0xC4CEB9FE1A85EC53)
    x ^= x >> _U64(33)
    return x


def pieces(column: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes of text, one row at least."""
    n = len(column)
    if n == 0:
        return
    sizes = np.nan_to_num(pa.compute.binary_length(column).to_numpy(zero_copy_only=False).astype(float))
    ends = np.cumsum(sizes)
    at = 0
    while at < n:
        done = ends[at - 1] if at else 0.0
        stop = max(at + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield at, min(stop, n)
        at = min(stop, n)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): row i is bytes[offsets[i]:offsets[i + 1]]; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """The words of a piece of texts.

    ``start``/``end`` are byte positions, ``doc`` the row of each word,
    ``first[i]:first[i + 1]`` the words of row i, ``hash`` a 64-bit value.
    """

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, parts: np.ndarray = SPACE, lower: bool = True, seed: int = 0) -> None:
        n, rows = len(raw), len(offsets) - 1
        inside = ~parts[raw]
        opens, closes = inside.copy(), inside.copy()
        if n:
            opens[1:] &= ~inside[:-1]
            closes[:-1] &= ~inside[1:]
            # a row's end parts words too
            cuts = offsets[1:-1]
            cuts = cuts[(cuts > 0) & (cuts < n)]
            opens[cuts] = inside[cuts]
            closes[cuts - 1] = inside[cuts - 1]
        self.raw, self.offsets = raw, offsets
        self.start = np.flatnonzero(opens)
        self.end = np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(rows), self.count)
        self._hash: np.ndarray | None = None
        self._lower, self._seed = lower, seed

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = span_hash(LOWER[self.raw] if self._lower else self.raw, self.start, self.end, self._seed)
        return self._hash


_P = _U64((1 << 61) - 1)
#: From which the bases of the polynomial are drawn.
_DRAWN = 0x0B3F5E6A91C27D84
#: Bytes of a span from which it is hashed alone.
_LONG = 2048


def _times(x: np.ndarray, by: int) -> np.ndarray:
    """x * by modulo 2^61 - 1, for x and by below it."""
    low, high = _U64(by & 0x7FFFFFFF), _U64(by >> 31)  # 31 and 30 bits
    x0, x1 = x & _U64(0x7FFFFFFF), x >> _U64(31)
    middle = x0 * high + x1 * low  # below 2^62, and weighs 2^31
    # 2^61 counts 1, so x1 * high weighs 2 and the middle's bits from the 30th on 1
    total = (x1 * high << _U64(1)) + (middle >> _U64(30)) + ((middle & _U64(0x3FFFFFFF)) << _U64(31)) + x0 * low
    total = (total & _P) + (total >> _U64(61))
    return total - _P * (total >= _P)


@lru_cache
def _base(seed: int) -> tuple[int, np.ndarray]:
    """The base of a seed, and its products with the sizes of spans."""
    drawn = int.from_bytes(hashlib.blake2b(f"{_DRAWN}:{seed}".encode(), digest_size=8).digest(), "little") % int(_P)
    return drawn, _times(np.arange(_LONG + 1, dtype=_U64), drawn)


def span_hash(raw: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each span of bytes, equal for equal spans anywhere.

    A polynomial over groups of 7 bytes modulo the prime 2^61 - 1, so two
    different spans of n bytes collide for at most n / 7 + 1 of the 2^61 bases.
    """
    size, (base, first) = end - start, _base(seed)
    value = size.astype(_U64)
    padded = np.concatenate((raw, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(raw) + 1,), "<u8", padded.data, 0, (1,))  # the 8 bytes from each place
    live = np.flatnonzero((size > 0) & (size <= _LONG))
    at, left = start[live], size[live]
    h = None
    while len(live):  # the first round's product depends on the size alone
        h = first[left] if h is None else _times(h, base)
        group = eight[at] & (_U64((1 << 56) - 1) >> (_U64(8) * (7 - np.minimum(left, 7)).astype(_U64)))
        h = h + group + _U64(1)
        h -= _P * (h >= _P)
        done = left <= 7
        if done.any():
            value[live[done]] = h[done]
            more = ~done
            live, at, left, h = live[more], at[more] + 7, left[more] - 7, h[more]
        else:
            at, left = at + 7, left - 7
    for i in np.flatnonzero(size > _LONG):
        digest = hashlib.blake2b(raw[start[i] : end[i]].tobytes(), digest_size=8, salt=seed.to_bytes(8, "little")).digest()
        value[i] = int.from_bytes(digest, "little")
    return mix(value)


def windows(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each run of ``width`` words inside a row, in order."""
    h = words.hash
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, _U64)
    with np.errstate(over="ignore"):
        value = np.zeros(n, dtype=_U64)
        for k in range(width):
            value = value * _BASE + h[k : k + n]
        value = mix(value)
    ok = words.doc[:n] == words.doc[width - 1 :]
    return words.doc[:n][ok], value[ok]


def row_sums(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, weights=values, minlength=n).astype(np.int64)


def code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points, offsets) of a piece of texts; null is empty."""
    raw, offsets = text_bytes(column)
    lead = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=lead[1:])
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    return points, lead[offsets]

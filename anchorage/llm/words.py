"""Words of whole texts as numpy arrays, for use inside Arrow batches.

A word is a maximal run of bytes outside space and \\t..\\r, which is the
pattern ``[^\\x20\\x09-\\x0D]+`` on UTF-8.  Texts are handled in slices of half
a MB, so memory follows the longest single text, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19
_U = np.uint64
_SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
IS_WORD = np.ones(256, dtype=bool)
IS_WORD[list(_SPACES)] = False
#: Bytes that begin a code point.
IS_LEAD = (np.arange(256) & 0xC0) != 0x80
_LOWER = np.arange(256)
_LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection that spreads 64-bit values."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def seeded(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit values."""
    return mix((np.arange(1, n + 1, dtype=_U) + _U(seed * 1_000_003)) * _U(0x9E3779B97F4A7C15))


_BASE = 0xD6E8FEB86659FD93  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = seeded(1, 256)
_BYTE_LOWER = _BYTE[_LOWER]
_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the hash base and of its inverse."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(max(n, SLICE_BYTES + 1), base, _U)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=_U)
    return _powers[0][:n], _powers[1][:n]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Prefix sums S of values[i] * base**i; see ``span_hash``."""
    out = np.zeros(len(values) + 1, _U)
    np.cumsum(values * powers(len(values))[0], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Rolling hash of each span: equal for equal contents wherever they stand."""
    return mix((prefix[end] - prefix[start]) * powers(len(prefix))[1][start] + (end - start).astype(_U))


class Words:
    """The words of some texts.

    ``data`` bytes of all texts, ``bounds`` byte offsets of texts, ``start`` and
    ``end`` byte offsets of words, ``first`` word offsets of texts, ``doc`` the
    text of each word, ``hash`` its 64-bit hash, ``prefix`` the bytes' prefix hash.
    """

    def __init__(self, data: np.ndarray, bounds: np.ndarray, lower: bool = False):
        self.data, self.bounds = data, bounds
        n = len(data)
        is_word = IS_WORD[data]
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = is_word[:-1], is_word[1:]
        inner = bounds[(bounds > 0) & (bounds < n)]
        before[inner] = False
        after[inner - 1] = False
        self.is_word = is_word
        self.start = np.flatnonzero(is_word & ~before)
        self.end = np.flatnonzero(is_word & ~after) + 1
        self.first = np.searchsorted(self.start, bounds)
        self.doc = np.repeat(np.arange(len(bounds) - 1), np.diff(self.first))
        self.prefix = prefix_hash((_BYTE_LOWER if lower else _BYTE)[data])
        self.hash = span_hash(self.prefix, self.start, self.end)

    def __len__(self) -> int:
        return len(self.start)

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a value per byte, for each text."""
        sums = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums[self.bounds[1:]] - sums[self.bounds[:-1]]

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of all windows of ``n`` words of one text, and their hashes."""
        at = np.flatnonzero(self.doc[: max(0, len(self) - n + 1)] == self.doc[n - 1:]) if len(self) >= n else \
            np.zeros(0, np.int64)
        prefix = prefix_hash(self.hash)
        return at, span_hash(prefix, at, at + n)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[bounds[0]: bounds[-1]], bounds - bounds[0]


def slices(bounds: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes together, one text at least."""
    lo, n = 0, len(bounds) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + size, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def sliced(column: pa.Array, lower: bool = False) -> Iterator[tuple[int, int, Words]]:
    """(from, to, words) of consecutive ranges of rows of a string column."""
    data, bounds = raw(column)
    for lo, hi in slices(bounds):
        own = bounds[lo: hi + 1]
        yield lo, hi, Words(data[own[0]: own[-1]], own - own[0], lower)

"""Vectorised words and hashes over the bytes of a column of texts.

All functions work on the UTF-8 bytes of many texts at once.  Every class of
characters used here is decided by single bytes: those of a character beyond
ASCII are all 0x80 or more, so they are either all in the class or all out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one numpy step takes, so that memory stays bounded.
STEP_BYTES = 4 << 20
_CHUNK = 1 << 18
_U = np.uint64


def _table(members: Iterator[int]) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


#: Characters other than space and 0x09 to 0x0D.
NOT_SPACE = ~_table([0x20, *range(0x09, 0x0E)])
#: Digits, letters and all that is beyond ASCII, once A-Z are lower-cased.
ALNUM = _table([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
#: A-Z to a-z, other bytes to themselves.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 0x20
_PLAIN = np.arange(256, dtype=np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all bits."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_M = 0x5851F42D4C957F2D
_powers: dict[tuple[int, bool], np.ndarray] = {}


def powers(base: int, n: int, inverse: bool = False) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, or of the inverse of the odd base."""
    have = _powers.get((base, inverse))
    if have is None or len(have) < n:
        b = pow(base, -1, 1 << 64) if inverse else base
        have = np.full(max(n, _CHUNK + 4096), b, _U)
        have[0] = 1
        _powers[base, inverse] = have = np.multiply.accumulate(have)
    return have[:n]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a string column one after another, and where each starts; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``limit`` bytes together, or of one longer text."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = j


def words(data: np.ndarray, offsets: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of member bytes within each text, and the first word of each text."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = members[data]
    change = np.diff(inside)
    first, last = change[:-1] == 1, change[1:] == -1
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    if len(cut):
        first[cut] = members[data[cut]]
        last[cut - 1] = members[data[cut - 1]]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool) -> np.ndarray:
    """A 64-bit hash of each span of bytes; spans come in order of their starts and ends."""
    byte = _BYTE[FOLD if fold else _PLAIN]
    out = np.empty(len(starts), _U)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _CHUNK, "right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        total = np.zeros(hi - lo + 1, _U)
        np.cumsum(byte[data[lo:hi]] * powers(_M, hi - lo), out=total[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = (total[e] - total[s]) * powers(_M, hi - lo + 1, inverse=True)[s]
        i = j
    return mix(out)


def gram_hash(h: np.ndarray, k: int, base: int = 0x2545F4914F6CDD1D) -> np.ndarray:
    """A 64-bit hash of each k consecutive values of h."""
    n = len(h)
    if n < k:
        return np.empty(0, _U)
    total = np.zeros(n + 1, _U)
    np.cumsum(h * powers(base, n), out=total[1:])
    return mix((total[k:] - total[:-k]) * powers(base, n - k + 1, inverse=True))


def within(first: np.ndarray, k: int) -> np.ndarray:
    """For each k consecutive words of all texts: whether they are of one text. first: where each text's words start."""
    n = int(first[-1])
    if n < k:
        return np.zeros(0, bool)
    ok = np.ones(n, bool)
    for end in np.unique(first[1:]):
        ok[max(0, end - k + 1) : end] = False
    return ok[: n - k + 1]

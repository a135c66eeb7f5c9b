"""Vectorised text kernels over raw UTF-8 buffers.

Arrow hands a task its texts as one byte buffer plus offsets.  Everything here
works on that pair with numpy, so no Python string is made per word.  Words,
word windows and whole texts are identified by 64-bit fingerprints: a
polynomial hash over a table of random odd values, finished with a mixing
round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_MASK = (1 << 64) - 1
_GOLDEN = 0x9E3779B97F4A7C15


def _mix_int(x: int) -> int:
    x = (x + _GOLDEN) & _MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _MASK
    return x ^ (x >> 31)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finisher, elementwise."""
    x = x + _U(_GOLDEN)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BASE = _mix_int(11) | 1
_INV = pow(_BASE, -1, 1 << 64)
_WORD_BASE = _mix_int(12) | 1

_ALL = np.arange(256)
#: Bytes of words made of everything but ASCII white space.
NO_SPACE = ~np.isin(_ALL, [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
#: Bytes of words made of ASCII letters, digits and every non-ASCII character.
ALNUM = ((_ALL >= 48) & (_ALL <= 57)) | ((_ALL >= 65) & (_ALL <= 90)) | ((_ALL >= 97) & (_ALL <= 122)) | (_ALL >= 128)

_EXACT = np.array([_mix_int(1000 + i) | 1 for i in range(256)], dtype=_U)
_FOLD = _EXACT.copy()
_FOLD[65:91] = _EXACT[97:123]

_pow = np.ones(1, _U)
_inv = np.ones(1, _U)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        size = max(n, 1 << 16)
        _pow = np.full(size, _BASE, _U)
        _inv = np.full(size, _INV, _U)
        _pow[0] = _inv[0] = 1
        _pow, _inv = np.cumprod(_pow, dtype=_U), np.cumprod(_inv, dtype=_U)
    return _pow[:n], _inv[:n]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        kind = np.int32
    elif pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        return buffers(column.cast(pa.string()))
    if column.null_count:
        column = column.fill_null(b"" if "binary" in str(column.type) else "")
    n = len(column)
    _, offs, data = column.buffers()
    if n == 0 or offs is None:
        return np.empty(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(offs, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most ``limit`` bytes, or of one longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and the index of each text's first word (one more for the end)."""
    n = len(data)
    if n == 0:
        empty = np.empty(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    word = inside[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    cuts = offsets[:-1][offsets[:-1] < n]
    first[cuts] = word[cuts]
    last = word.copy()
    last[:-1] &= ~word[1:]
    ends = offsets[1:][offsets[1:] > 0] - 1
    last[ends] = word[ends]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool) -> np.ndarray:
    """Fingerprints of the words; fold: A-Z as a-z."""
    if len(starts) == 0:
        return np.empty(0, _U)
    power, inverse = _powers(len(data))
    total = np.zeros(len(data) + 1, _U)
    np.cumsum((_FOLD if fold else _EXACT)[data] * power, dtype=_U, out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(_U))


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Fingerprint of the ``size`` words that start at each position (garbage where they run over)."""
    out = np.zeros(len(words), _U)
    factor = 1
    for k in range(min(size, len(words))):
        out[: len(words) - k] += words[k:] * _U(factor)
        factor = factor * _WORD_BASE & _MASK
    return mix(out + _U(size))


def window_starts(first: np.ndarray, size: int) -> np.ndarray:
    """Mask of the positions at which a whole window of one text starts."""
    ok = np.ones(int(first[-1]), bool)
    lengths = np.diff(first)
    for k in range(1, size):
        at = first[1:][lengths >= k] - k
        ok[at] = False
    return ok


def shingle_sets(words: np.ndarray, first: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct shingles of each text; one of all words where there are fewer."""
    whole = window_hashes(words, size)
    out = []
    for i in range(len(first) - 1):
        a, b = int(first[i]), int(first[i + 1])
        if b - a >= size:
            out.append(np.unique(whole[a : b - size + 1]))
        elif b > a:
            out.append(window_hashes(words[a:b], b - a)[:1])
        else:
            out.append(np.empty(0, _U))
    return out

"""Hashes of words and runs of words, for a whole Arrow batch at once.

Texts stay bytes: separators and the letters A to Z are single bytes in UTF-8, so words are
found and hashed by array operations, without a Python object for each word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes handled at once, unless one text is longer.
SLICE = 1 << 18

_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)

#: Words between white space, A to Z in lower case.
WHITE = np.zeros(256, bool)
WHITE[[32, *range(9, 14)]] = True
#: Words of letters, digits and bytes beyond ASCII.
MARKS = np.ones(256, bool)
MARKS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit over all of 64."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    if name not in _powers or len(_powers[name]) < n:
        rows = np.full(max(n, SLICE + 1), base, np.uint64)
        rows[0] = 1
        _powers[name] = np.multiply.accumulate(rows)
    return _powers[name][:n]


_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def slices(column, most: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, starts of the rows and the end) of a string
    column; a null is empty."""
    import pyarrow as pa

    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def words(data: np.ndarray, starts: np.ndarray, separators: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word and the row it is in."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = ~separators[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = starts[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begins[edges] |= inside[edges]  # a row begins a word, and ends one
    ends[edges - 1] |= inside[edges - 1]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * _power("base", _BASE, len(data)), out=sums[1:])
    hashes = (sums[last] - sums[first]) * _power("inverse", _INVERSE, len(data) + 1)[first]
    row = np.searchsorted(starts, first, "right") - 1
    return mix(hashes ^ (last - first).astype(np.uint64)), row


def runs(hashes: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each run of ``k`` words of one row, and the row."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n, np.uint64)
    step = np.uint64(1)
    for j in range(k):
        total += hashes[j : j + n] * step
        step = np.uint64((int(step) * int(_STEP)) & 0xFFFFFFFFFFFFFFFF)
    whole = row[:n] == row[k - 1 :]
    return mix(total[whole] ^ np.uint64(k)), row[:n][whole]


def shingles(data: np.ndarray, starts: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes by row, and where each row's begin; a row of fewer than ``k`` words has
    one, of all its words."""
    hashes, row = words(data, starts)
    rows = len(starts) - 1
    found, where = runs(hashes, row, k)
    parts, places = [found], [where]
    sizes = np.bincount(row, minlength=rows)
    for n in range(1, k):
        short = np.flatnonzero(sizes == n)
        if len(short):
            of = np.isin(row, short)
            h, r = runs(hashes[of], row[of], n)
            parts.append(h)
            places.append(r)
    if len(parts) > 1:
        found, where = np.concatenate(parts), np.concatenate(places)
        order = np.argsort(where, kind="stable")
        found, where = found[order], where[order]
    return found, np.searchsorted(where, np.arange(rows + 1)), sizes

"""Words of Arrow string columns as 64-bit hashes, computed on UTF-8 bytes without Python strings.

Words are runs of bytes other than blank and tab to carriage return, like ``[^\\x20\\x09-\\x0D]+``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


@cache
def _powers(base: int, length: int) -> np.ndarray:
    out = np.full(length, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every bit (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows in one array and where each row starts; null rows are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def blocks(offsets: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``most`` bytes; a longer row is a range of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def word_bounds(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and end; ``starts`` are the rows' first bytes, which always open a word."""
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~SPACES[data]
    opens = inside[1:-1] & ~inside[:-2]
    closes = inside[1:-1] & ~inside[2:]
    edges = starts[(starts > 0) & (starts < n)]
    opens[edges] |= inside[1:-1][edges]
    closes[edges - 1] |= inside[1:-1][edges - 1]
    return np.flatnonzero(opens), np.flatnonzero(closes) + 1


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end of every word, and the number of words before each row."""
    opens, ends = word_bounds(data, offsets[:-1])
    chars = LOWER[data] if lower else data
    sums = np.zeros(len(chars) + 1, np.uint64)
    if len(chars) <= BLOCK_BYTES * 2:
        up, down = _powers(_BASE, BLOCK_BYTES * 2 + 1), _powers(_INVERSE, BLOCK_BYTES * 2 + 1)
    else:
        up, down = _powers.__wrapped__(_BASE, len(chars) + 1), _powers.__wrapped__(_INVERSE, len(chars) + 1)
    np.cumsum((chars.astype(np.uint64) + np.uint64(1)) * up[: len(chars)], out=sums[1:])
    hashes = mix((sums[ends] - sums[opens]) * down[opens] + (ends - opens).astype(np.uint64))
    before = np.searchsorted(opens, offsets)
    return hashes, opens, ends, before

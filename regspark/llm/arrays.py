"""Vectorised text helpers for functions that run inside ``mapInArrow`` tasks.

All of them work on the byte buffer of an Arrow text column, so a batch of
documents costs a fixed number of numpy passes, however many words it holds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

# The byte classes of the two kinds of word, as given by their
# patterns over UTF-8 bytes (every byte from 0x80 on belongs to a word).
_BYTES = np.arange(256)
NOT_SPACE = ~(((_BYTES >= 0x09) & (_BYTES <= 0x0D)) | (_BYTES == 0x20))
ALNUM = (_BYTES >= 0x80) | ((_BYTES >= 0x30) & (_BYTES <= 0x39)) \
    | ((_BYTES >= 0x41) & (_BYTES <= 0x5A)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A))
LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)

_BYTE_VALUE = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)

#: Bytes of text worked on at a time; bounds a task's numpy memory.
BLOCK_BYTES = 1 << 20


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a text column; null reads as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    if data is None or off[-1] == off[0]:
        return np.empty(0, np.uint8), np.zeros(len(off), np.int64)
    return np.frombuffer(data, np.uint8)[off[0]:off[-1]], off - off[0]


def blocks(column: pa.Array, limit: int = BLOCK_BYTES):
    """Yields (first row, data, offsets) over runs of rows of about ``limit`` bytes."""
    data, off = buffers(column)
    row = 0
    while row < len(off) - 1:
        end = max(row + 1, int(np.searchsorted(off, off[row] + limit, "right")) - 1)
        yield row, data[off[row]:off[end]], off[row:end + 1] - off[row]
        row = end


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values evenly (an invertible finaliser)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def words(data: np.ndarray, off: np.ndarray, table: np.ndarray):
    """Starts and ends of all words, and for each row the index of its first word.

    A word never crosses rows. ``table`` tells which bytes belong to words.
    """
    inside = table[data]
    rows = off[:-1][off[:-1] < off[1:]]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[rows] |= inside[rows]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends_at = off[1:][off[:-1] < off[1:]] - 1
    last[ends_at] |= inside[ends_at]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off, "left")


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word, ASCII letters lower-cased."""
    if len(starts) == 0:
        return np.empty(0, np.uint64)
    value, at = _word_bytes(data, starts, ends)
    return mix(np.add.reduceat(value, at) + (ends - starts).astype(np.uint64))


def prefix_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int):
    """Index of each word of more than ``size`` bytes, and the hash of its first ``size``.

    A word of just these bytes has the same hash.
    """
    long = np.flatnonzero(ends - starts > size)
    places = LOWER[data[starts[long, None] + np.arange(size)]]
    powers = np.cumprod(np.full(size, _STEP, np.uint64))
    return long, mix((_BYTE_VALUE[places] * powers).sum(1, dtype=np.uint64) + np.uint64(size))


def _word_bytes(data, starts, ends):
    lengths = ends - starts
    at = np.cumsum(lengths) - lengths
    where = np.arange(int(lengths.sum())) + np.repeat(starts - at, lengths)
    place = where - np.repeat(starts, lengths)
    powers = np.cumprod(np.full(int(lengths.max()), _STEP, np.uint64))
    return _BYTE_VALUE[LOWER[data[where]]] * powers[place], at


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` consecutive hashes."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i in range(size):
        total = mix(total + hashes[i:i + n] * np.uint64(2 * i + 3))
    return total

"""Vectorised word splitting and hashing over Arrow string columns.

A batch of texts is one byte buffer. Words are found with byte-class masks and
hashed with a polynomial hash over a table of random 64-bit letters, all in
numpy, so a task spends a few nanoseconds a byte and no Python object per word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; bounds the temporaries of a task (about 60 bytes each).
SLICE_BYTES = 1 << 20

_RNG = np.random.default_rng(0x5EED)
_LETTER = _RNG.integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        np.multiply.accumulate(out, out=out)
    return out


_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(SLICE_BYTES + 1, 1 << int(n).bit_length())
    for have, tables in _TABLES.items():
        if have >= size:
            return tables
    _TABLES.clear()
    _TABLES[size] = (_powers(_BASE, size), _powers(_BASE_INVERSE, size))
    return _TABLES[size]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def byte_class(word_bytes) -> np.ndarray:
    """A 256-entry mask of the bytes that belong to words."""
    mask = np.zeros(256, bool)
    mask[list(word_bytes)] = True
    return mask


#: `[^\x20\x09-\x0D]+`: everything but ASCII white space.
NOT_SPACE = byte_class(b for b in range(256) if b != 0x20 and not 0x09 <= b <= 0x0D)
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing: ASCII digits, small letters and all of non-ASCII.
ALNUM = byte_class(b for b in range(256) if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
SAME = np.arange(256, dtype=np.uint8)
#: Lower-cases A-Z only.
LOWER = np.where((SAME >= 65) & (SAME <= 90), SAME + 32, SAME).astype(np.uint8)


@dataclass
class Words:
    """Words of the texts of a slice, in order; `first[i]:first[i + 1]` are those of text i."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """64-bit hashes of the words; equal words have equal hashes."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        power, inverse = _power_tables(len(self.data))
        with np.errstate(over="ignore"):
            total = np.empty(len(self.data) + 1, np.uint64)
            total[0] = 0
            np.cumsum(_LETTER[self.data] * power[: len(self.data)], out=total[1:])
            h = (total[self.end] - total[self.start]) * inverse[self.start]
        return mix(h)


def text_slices(column: pa.Array, limit: int = SLICE_BYTES):
    """Yield (first row, number of rows, bytes, offsets) of runs of texts of about `limit` bytes; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_large_binary(column.type) else "")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        to = min(to, n)
        yield at, to - at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def split_words(data: np.ndarray, offsets: np.ndarray, letters: np.ndarray = NOT_SPACE, table: np.ndarray = SAME) -> Words:
    """Words of a slice: maximal runs of `letters` after `table` is applied; none spans two texts."""
    if table is not SAME:
        data = table[data]
    n = len(data)
    is_word = np.zeros(n + 2, bool)
    is_word[1:-1] = letters[data]
    # a text border inside a run ends one word and starts another
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    edge = is_word[1:] != is_word[:-1]
    starts = edge & is_word[1:]
    ends = edge & is_word[:-1]
    if len(inner):
        both = inner[is_word[inner] & is_word[inner + 1]]
        starts[both] = True
        ends[both] = True
    start, end = np.flatnonzero(starts), np.flatnonzero(ends)
    return Words(data, start, end, np.searchsorted(start, offsets))


def rolling(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of `width` consecutive values (across text borders too; mask those)."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(width):
            out = (out ^ h[j : j + n]) * np.uint64(0x9FB21C651E98DF25)
            out ^= out >> np.uint64(32)
    return out


def owners(words: Words) -> np.ndarray:
    """The text number of each word."""
    return np.repeat(np.arange(len(words.first) - 1), words.counts)

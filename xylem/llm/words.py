"""Words and their names, computed over whole Arrow batches at once.

A word is a maximal run of bytes other than space and U+0009..U+000D, which
equals ``[^\\x20\\x09-\\x0D]+`` on the text since those separators are single
bytes in UTF-8. Names depend on content only, so every task of every job gives
equal words the same name without any exchange; where equal names alone decide,
those of two lanes are compared, 128 bits in all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from xylem.functions.hashing import U, mixed, span_names

_BASE = 0x9E3779B97F4A7C15
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def distinct(names: np.ndarray) -> np.ndarray:
    """The sorted distinct names; sorting is several times as fast as hashing them."""
    names = np.sort(names)
    return names[np.r_[True, names[1:] != names[:-1]][: len(names)]]


def distinct_counts(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct names, and how often each stands there."""
    names = np.sort(names)
    begin = np.flatnonzero(np.r_[True, names[1:] != names[:-1]][: len(names)])
    return names[begin], np.diff(np.r_[begin, len(names)])


class Places:
    """Looks names up in a sorted array that holds them all: by a table of their hashes, and by bisection where two meet."""

    def __init__(self, names: np.ndarray):
        self.names = names
        self.shift = U(64 - max(10, int(len(names)).bit_length() + 2))
        self.table = np.zeros(1 << (64 - int(self.shift)), np.int32)
        self.table[self._slot(names)] = np.arange(len(names), dtype=np.int32)

    def _slot(self, names: np.ndarray) -> np.ndarray:
        return (names * U(_BASE)) >> self.shift

    def __call__(self, names: np.ndarray) -> np.ndarray:
        if not len(names):
            return np.zeros(0, np.int64)
        at = self.table[self._slot(names)]
        missed = np.flatnonzero(self.names[at] != names)
        at[missed] = np.searchsorted(self.names, names[missed])
        return at


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its rows' offsets in them; null rows are empty."""
    column = column.cast(pa.large_binary()) if column.type != pa.large_binary() else column
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row the index of its first word (rows + 1 numbers)."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~SEPARATOR[data]
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    # words that touch across a row's end are two words
    cuts = offsets[1:-1]
    cuts = np.unique(cuts[(cuts > 0) & (cuts < len(data))])
    cuts = cuts[(inside[cuts] == 1) & (inside[cuts + 1] == 1)]
    if len(cuts):
        starts, ends = np.sort(np.r_[starts, cuts]), np.sort(np.r_[ends, cuts])
    return starts, ends, np.searchsorted(starts, offsets)


def word_names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    """A 64-bit name for each word; names of the two lanes are independent."""
    return span_names(data, starts, ends, lane)


def window_names(names: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """A 64-bit name of each window of ``size`` names, of a few (len(names) - size + 1 of them), whatever row they lie in."""
    n = len(names) - size + 1
    if n <= 0:
        return np.zeros(0, U)
    base = U(((_BASE * (2 * seed + 1) + 2 * seed) & (1 << 64) - 1) | 1)
    out = np.zeros(n, U)
    for i in range(size):
        out = out * base + names[i : i + n]
    return mixed(out)


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most`` bytes of text; a longer text is a slice of its own."""
    data = batch.column(column)
    if data.type in (pa.string(), pa.binary()):
        ends = np.frombuffer(data.buffers()[1], np.int32, len(data) + 1, data.offset * 4).astype(np.int64)
    else:
        ends = np.frombuffer(data.buffers()[1], np.int64, len(data) + 1, data.offset * 8)
    at = 0
    while at < len(data):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to

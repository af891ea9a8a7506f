"""Token ids of words, each distinct word encoded once in a Python worker's life.

An encoder whose ids of a text are its words' ids in a row (its vocabulary and
rules never reach over white space) needs to see a word once; texts are then
gathered from the pool. A word is found by its name of one lane and verified by
that of the other; one that meets another's name gets a new one. The pool is
emptied at ``MOST`` words, so memory stays bounded whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from xylem.llm.blocks import member
from xylem.llm.words import U, mixed, word_bounds, word_names

MOST = 1_000_000


class WordPool:
    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int = MOST, bounds: Callable | None = None):
        """encode: words to their counts of ids and all ids in a row. bounds: (bytes, rows' offsets) to (bytes, starts, ends,
        rows' first units) of parts that the encoder treats alike wherever they stand; by default, words."""
        self.encode, self.most = encode, most
        self.bounds = bounds or (lambda data, offsets: (data, *word_bounds(data, offsets)))
        self._empty()

    def _empty(self) -> None:
        self.names, self.checks = np.zeros(0, U), np.zeros(0, U)
        self.begin, self.size, self.ids = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.uint32)

    def _learn(self, names: np.ndarray, checks: np.ndarray, words: list[str]) -> None:
        size, ids = self.encode(words)
        begin = len(self.ids) + np.cumsum(size) - size
        self.ids = np.concatenate([self.ids, ids])
        where = np.searchsorted(self.names, names)
        self.names, self.checks = np.insert(self.names, where, names), np.insert(self.checks, where, checks)
        self.begin, self.size = np.insert(self.begin, where, begin.astype(np.int32)), np.insert(self.size, where, size.astype(np.int32))

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all rows in a row, and the rows' offsets in them."""
        data, starts, ends, first = self.bounds(data, offsets)
        own, checks = word_names(data, starts, ends), word_names(data, starts, ends, 1)
        while True:
            names, at, inverse = np.unique(own, return_index=True, return_inverse=True)
            new = ~member(names, self.names)
            if new.any():
                if len(self.names) + int(new.sum()) > self.most:
                    self._empty()
                    new[:] = True
                self._learn(names[new], checks[at[new]], [data[starts[i] : ends[i]].tobytes().decode() for i in at[new].tolist()])
            slot = np.searchsorted(self.names, names)
            strange = self.checks[slot][inverse] != checks
            if not strange.any():
                break
            own[strange] = mixed(own[strange] ^ checks[strange])
        size, begin = self.size[slot][inverse], self.begin[slot][inverse].astype(np.int64)
        total = np.cumsum(size, dtype=np.int64)
        n = int(total[-1]) if len(total) else 0
        return self.ids[np.arange(n) + np.repeat(begin - total + size, size)], np.r_[0, total][first]

"""Context-tree weighting over bytes, each byte eight binary decisions, on whole tables of counts at once.

A gram is ``depth`` bytes of context, latest first, and the byte that follows,
as one number of 8 * (depth + 1) bits. In every context of 0 .. depth bytes,
every prefix of a byte is a node with a Krichevsky-Trofimov estimator. A node's
weighted probability is half its own estimate and half the product of the nodes
one context byte longer. The predictive mixture of a byte takes each node's
share from its block probabilities, from the deepest context up to the empty one.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from xylem.llm.words import U

_TABLE = np.array([math.lgamma(x / 2) if x else 0.0 for x in range(1 << 13)])


def log_gamma(doubled: np.ndarray) -> np.ndarray:
    """log gamma(doubled / 2) for whole numbers from 1 on."""
    out = _TABLE[np.minimum(doubled, len(_TABLE) - 1)]
    big = doubled >= len(_TABLE)
    x = doubled[big] / 2
    out[big] = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    return out


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """The natural logarithm of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return log_gamma(2 * zeros + 1) + log_gamma(2 * ones + 1) - 2 * _TABLE[1] - log_gamma(2 * (zeros + ones) + 2)


@dataclass
class Level:
    """The nodes of one context length and one prefix length that occur, by id (context, prefix)."""

    ids: np.ndarray
    zeros: np.ndarray
    ones: np.ndarray
    deeper: np.ndarray  # log of the product of the nodes one context byte longer

    def weighted(self, last: bool) -> np.ndarray:
        own = log_kt(self.zeros, self.ones)
        return own if last else np.logaddexp(own, self.deeper) - math.log(2)

    def mix(self, at: np.ndarray, bit: np.ndarray, below: np.ndarray | None) -> np.ndarray:
        """The probability of each bit at its node, given the one that longer contexts mix to."""
        zeros, ones = self.zeros[at], self.ones[at]
        own = (np.where(bit, ones, zeros) + 0.5) / (zeros + ones + 1)
        if below is None:
            return own
        share = 1 / (1 + np.exp(np.clip(self.deeper - log_kt(self.zeros, self.ones), -700, 700)))[at]
        return share * own + (1 - share) * below


def levels(grams: np.ndarray, counts: np.ndarray, depth: int, top: int = 0) -> dict[tuple[int, int], Level]:
    """The nodes of context lengths top .. depth. grams: sorted and distinct."""
    out: dict[tuple[int, int], Level] = {}
    for d in range(depth, top - 1, -1):
        symbol = ((grams >> U(8 * (depth - d) + 8)) << U(8)) | (grams & U(255)) if d < depth else grams
        order = np.argsort(symbol, kind="stable")
        symbol, total = symbol[order], np.r_[0, np.cumsum(counts[order])]
        for k in range(8):
            half = symbol >> U(7 - k)
            begin = np.flatnonzero(np.r_[True, half[1:] != half[:-1]][: len(half)])
            n = np.diff(total[np.r_[begin, len(half)]])
            node, bit = half[begin] >> U(1), (half[begin] & U(1)).astype(np.int64)
            ids, at = np.unique(node, return_inverse=True)
            ones = np.bincount(at, n * bit, len(ids)).astype(np.int64)
            zeros = np.bincount(at, n * (1 - bit), len(ids)).astype(np.int64)
            deeper = np.zeros(len(ids))
            if d < depth:
                below = out[d + 1, k]
                parent = ((below.ids >> U(k + 8)) << U(k)) | (below.ids & U((1 << k) - 1))
                deeper = np.bincount(np.searchsorted(ids, parent), below.weighted(d + 1 == depth), len(ids))
            out[d, k] = Level(ids, zeros, ones, deeper)
    return out


def log10_probabilities(grams: np.ndarray, depth: int, nodes: dict[tuple[int, int], Level]) -> np.ndarray:
    """log10 of the mixture's probability of each gram's last byte after its context; nodes: of all context lengths."""
    out = np.zeros(len(grams))
    for k in range(8):
        bit = ((grams >> U(7 - k)) & U(1)).astype(bool)
        p = None
        for d in range(depth, -1, -1):
            ids = (((grams >> U(8 * (depth - d) + 8)) << U(8)) | (grams & U(255))) >> U(8 - k)
            level = nodes[d, k]
            p = level.mix(np.searchsorted(level.ids, ids), bit, p)
        out += np.log10(p)
    return out


def stream(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's words joined by one space and closed by a line feed, all in a row, and the rows' offsets in it."""
    empty = first[1:] == first[:-1]
    where = first[:-1][empty]  # a row without words is the line feed alone
    starts, ends = np.insert(starts, where, 0), np.insert(ends, where, 0)
    first = first + np.r_[0, np.cumsum(empty)]
    size = ends - starts + 1
    close = np.cumsum(size)
    out = np.full(int(close[-1]) if len(close) else 0, 32, np.uint8)
    at = np.ones(len(out), bool)
    at[close - 1] = False
    out[at] = data[np.repeat(starts - (close - size), size)[at] + np.flatnonzero(at)]
    offsets = np.r_[0, close][first]
    out[offsets[1:] - 1] = 10
    return out, offsets


def contexts(symbols: np.ndarray, offsets: np.ndarray, depth: int) -> np.ndarray:
    """The gram that ends at each byte; before a row's first byte stand line feeds."""
    out = symbols.astype(U)
    rows = np.flatnonzero(np.diff(offsets) > 0)
    first, last = offsets[rows], offsets[rows + 1]
    for d in range(1, depth + 1):
        before = np.full(len(symbols), 10, np.uint8)
        before[d:] = symbols[: max(0, len(symbols) - d)]
        for i in range(d):  # the first d bytes of each row
            at = first + i
            before[at[at < last]] = 10
        part = before.astype(U)
        part <<= U(8 * (depth + 1 - d))
        out |= part
    return out

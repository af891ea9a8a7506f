"""64-bit names of spans of bytes, computed over whole buffers at once.

A name mixes its span's bytes eight at a time, step by step (no polynomial,
whose names of long regular spans can meet); long spans are hashed by BLAKE2.
Two lanes name independently: where equal names alone decide, both are compared.
Names depend on content only.
"""

from __future__ import annotations

import hashlib

import numpy as np

U = np.uint64
_BASE, _STEP = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)
_LANES = [U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F)]
_LOW_BYTES = np.array([(1 << (8 * i)) - 1 for i in range(9)], U)
#: Longest span, in bytes, that is named eight bytes at a time.
LONG = 256


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits."""
    x = x.copy()
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def span_names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    """A name for each span of data."""
    return named_spans(data, starts, ends, (lane,))[0]


def named_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lanes: tuple[int, ...] = (0, 1)) -> list[np.ndarray]:
    """The names of each span of data in several lanes."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    size = ends - starts
    names = [mixed(size.astype(U) * _LANES[lane]) for lane in lanes]
    todo, at, left = slice(None), 0, size
    while len(left):
        part = (eight[starts[todo] + at] & _LOW_BYTES[np.minimum(left, 8)]) * _BASE
        for x in names:
            x[todo] = mixed(x[todo] * _STEP ^ part)
        at += 8
        todo = np.flatnonzero((size > at) & (size <= LONG)) if at == 8 else todo[size[todo] > at]
        left = size[todo] - at
    for i in np.flatnonzero(size > LONG).tolist():
        raw = data[starts[i] : ends[i]].tobytes()
        for lane, x in zip(lanes, names, strict=True):
            x[i] = int.from_bytes(hashlib.blake2b(raw, digest_size=8, key=bytes([lane])).digest(), "little")
    return names

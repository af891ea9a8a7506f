"""Substring dedup by recompression.

Words get names; then rounds alternate two steps over every text. A run of one
symbol becomes a symbol named by the symbol and the run's length. A pair whose
left symbol falls in one half of the alphabet and right symbol in the other
becomes a symbol named by both; the halves come from a bit of the name, new in
each round, so a symbol never pairs on both sides. Names are functions of
content, 128 bits, so every task of every round names globally alike. Rounds go
on until symbols reach the window's scale.

Whether a symbol forms depends on few neighbours: each carries the stretch of
words that decided it, and one whose stretch lies within a window forms in every
copy of that window. Two rounds of exchange follow. First each window is
represented by the longest symbol decided inside it, and blocks learn which of
these stand at two places of the corpus: only their windows can repeat. Then the
windows left are parsed into symbols: from the lowest level up, the symbols at
both ends that context could have joined are taken off, runs whole, and so on in
the next level between them. Equal windows have equal parses and, names being
unique, different ones different parses; so the parses' names verify repeats. A
window without a symbol decided inside it (as in very long runs) is always parsed.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from xylem.llm import blocks
from xylem.llm.shared import give_back
from xylem.llm.words import U, mixed, text_bytes, word_bounds, word_names

#: Bytes of text that are parsed at a time.
PART = 1 << 19
_RUN, _PAIR = (U(0xA24BAED4963EE407), U(0x8EBC6AF09C88C6E3)), (U(0x9FB21C651E98DF25), U(0x589965CC75374CC3))
_ENDS, _JOIN = (U(0xE7037ED1A0B428DB), U(0x1D8E4E27C47D124F)), U(0x9E3779B97F4A7C15)
_FAR = np.int32(1 << 29)
#: Bits of a window's key that hold its symbol's number, and its name's.
_NUMBER, _NAME = 30, 27


@dataclass
class Level:
    """A sequence of symbols and the step that follows: ``to`` has for each symbol, and for the end, the symbol of the next
    level that begins with it or holds it."""

    names: list[np.ndarray]  # by lane
    bit: np.ndarray | None  # of a step of pairs: which symbols can only be right parts
    head: np.ndarray | None  # of a step of runs: where they begin, and the end
    to: np.ndarray


@dataclass
class Parse:
    """All levels over a few texts; and the symbols that the steps made, with the stretches of words that decided them."""

    levels: list[Level]
    last: list[np.ndarray]
    made: list[np.ndarray]  # their names, by lane
    length: np.ndarray
    low: np.ndarray
    high: np.ndarray


def rounds_of(window: int) -> int:
    """Steps of pairs after which symbols have the scale of the window; the same for all texts."""
    return max(2, window.bit_length() - 1)


def recompress(names: list[np.ndarray], first: np.ndarray, window: int) -> Parse:
    """names: of the words of texts in a row, by lane; first: for each text the index of its first word, and the end."""
    n = len(names[0])
    row = np.repeat(np.arange(len(first) - 1, dtype=np.int32), np.diff(first))
    start = np.arange(n, dtype=np.int32)
    low, high = start, start + np.int32(1)
    levels: list[Level] = []
    made: list[list[np.ndarray]] = [[] for _ in range(len(names) + 3)]

    def note(fresh: np.ndarray) -> None:
        fresh = fresh[high[fresh] - low[fresh] <= window]
        ends = np.r_[start[1:], np.int32(n)]
        for column, x in zip(made, (*names, ends - start, low, high), strict=True):
            column.append(x[fresh])

    for level in range(rounds_of(window)):
        size = len(start)
        # runs
        same = np.zeros(size + 1, bool)
        same[1:size] = (names[0][1:] == names[0][:-1]) & (names[-1][1:] == names[-1][:-1]) & (row[1:] == row[:-1])
        head = np.flatnonzero(~same[:size])
        length = np.diff(np.r_[head, size])
        levels.append(Level(names, None, np.r_[head, size], np.r_[np.cumsum(~same[:size]) - 1, len(head)]))
        tail = head + length - 1
        left, right = np.maximum(head - 1, 0), np.minimum(tail + 1, max(size - 1, 0))
        inside_l, inside_r = (head > 0) & (row[left] == row[head]), (tail + 1 < size) & (row[right] == row[head])
        lo = np.minimum(np.minimum(low[head], low[tail]), np.where(inside_l, low[left], -_FAR))
        hi = np.maximum(np.maximum(high[head], high[tail]), np.where(inside_r, high[right], _FAR))
        # what stands beside a run decides where it ends
        low, high = np.minimum(lo, np.where(inside_r, low[right], _FAR)), np.maximum(hi, np.where(inside_l, high[left], -_FAR))
        runs = np.flatnonzero(length > 1)
        names = [x[head] for x in names]
        for lane, x in enumerate(names):
            x[runs] = mixed((x[runs] ^ _RUN[lane]) * U(3) + length[runs].astype(U))
        start, row = start[head], row[head]
        note(runs)
        # pairs
        size = len(start)
        bit = (mixed(names[0] + U(level)) >> U(63)).astype(bool)
        together = row[1:] == row[:-1]
        joins = np.zeros(size, bool)
        joins[: size - 1] = ~bit[:-1] & bit[1:] & together
        keep = ~np.r_[False, joins[:-1]][:size]
        levels.append(Level(names, bit, None, np.r_[np.cumsum(keep) - 1, keep.sum()]))
        lo, hi = low.copy(), high.copy()
        before, after = np.r_[False, together][:size], np.r_[together, False][:size]
        at = np.flatnonzero(bit)  # the symbol before decides
        lo[at], hi[at] = np.where(before[at], np.minimum(low[at], low[at - 1]), -_FAR), np.where(before[at], np.maximum(high[at], high[at - 1]), high[at])
        at = np.flatnonzero(~bit)
        other = np.minimum(at + 1, size - 1)
        lo[at], hi[at] = np.where(after[at], np.minimum(low[at], low[other]), low[at]), np.where(after[at], np.maximum(high[at], high[other]), _FAR)
        at = np.flatnonzero(joins)
        names = [x.copy() for x in names]
        for lane, x in enumerate(names):
            x[at] = mixed((x[at] ^ _PAIR[lane]) * U(5) + mixed(x[at + 1]) * U(7))
        place = levels[-1].to[at]
        names, start, row, low, high = [x[keep] for x in names], start[keep], row[keep], lo[keep], hi[keep]
        note(place)
    together = [np.concatenate(x) for x in made]
    return Parse(levels, names, together[: len(names)], *together[len(names) :])


def longest_inside(parse: Parse, first: np.ndarray, n: int, window: int) -> np.ndarray:
    """For the window that starts at each word, the number of the longest symbol decided inside it (-1: there is none). Of
    equally long ones the greatest name wins, then the last: the same in each copy of the window."""
    row = np.searchsorted(first, parse.low, "right") - 1
    a, b = np.maximum(parse.high - window, first[row]), np.minimum(parse.low, first[row + 1] - window)
    at = np.flatnonzero(a <= b)
    a, b = a[at], b[at]
    key = (np.minimum(parse.length[at], 127).astype(U) << U(_NUMBER + _NAME)) | (parse.made[0][at] >> U(64 - _NAME) << U(_NUMBER)) | at.astype(U)
    power = np.frexp(b - a + 1)[1] - 1  # ranges as two overlapping ones of a power of two
    carry = np.zeros(n, U)
    for k in range(int(power.max(initial=0)), -1, -1):
        some = power == k
        np.maximum.at(carry, a[some], key[some])
        np.maximum.at(carry, b[some] - (1 << k) + 1, key[some])
        if k and n > (half := 1 << (k - 1)):
            moved = carry.copy()
            np.maximum(moved[half:], carry[:-half], out=moved[half:])
            carry = moved
    return np.where(carry > 0, (carry & U((1 << _NUMBER) - 1)).astype(np.int64), -1)


def parsed(parse: Parse, begin: np.ndarray, window: int) -> list[np.ndarray]:
    """Names, by lane, of the parses of the windows that start at these words."""
    i, j = begin.astype(np.int64), begin.astype(np.int64) + window
    out = [np.zeros(len(begin), U) for _ in parse.last]

    def take(names: list[np.ndarray], where: np.ndarray, at: np.ndarray, times: np.ndarray | int, end: int) -> None:
        for lane, x in enumerate(names):
            out[lane][where] = mixed(out[lane][where] * _JOIN + (x[at] ^ _ENDS[end]) * (U(2) * np.asarray(times, U) + U(1)))

    for level in parse.levels:
        live = np.flatnonzero(i < j)
        if not len(live):
            break
        x = i[live]
        if level.head is not None:
            y = np.minimum(level.head[level.to[x] + 1], j[live])
            take(level.names, live, x, y - x, 0)
            i[live] = y
            live = live[y < j[live]]
            y = j[live]
            x = np.maximum(level.head[level.to[y - 1]], i[live])
            take(level.names, live, y - 1, y - x, 1)
            j[live] = x
        else:
            off = live[level.bit[x]]
            take(level.names, off, i[off], 1, 0)
            i[off] += 1
            live = live[i[live] < j[live]]
            off = live[~level.bit[j[live] - 1]]
            take(level.names, off, j[off] - 1, 1, 1)
            j[off] -= 1
        i, j = level.to[i], level.to[j]
    while len(live := np.flatnonzero(i < j)):
        take(parse.last, live, i[live], 1, 0)
        i[live] += 1
    return out


def _whole(first: np.ndarray, n: int, window: int) -> np.ndarray:
    """Which words start a window that stays in its row."""
    return np.arange(n) + window <= np.repeat(first[1:], np.diff(first))


def _covered(repeats: np.ndarray, window: int) -> np.ndarray:
    step = np.zeros(len(repeats) + 1, np.int64)
    at = np.flatnonzero(repeats)
    step[at] += 1
    np.add.at(step, at + window, -1)
    return np.cumsum(step[:-1]) > 0


def substring_dedup(docs: DataFrame, window: int = 35, with_text: bool = False, keep: list[str] | None = None) -> DataFrame:
    """Finds all words covered by a window of ``window`` words that also starts anywhere else, in any row of ``docs``
    (doc_id, text), the same row included; windows are judged on the input.

    Returns for each row doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space, UTF-8), removed
    (spans of words, end exclusive) and, with_text, kept_text: the text without the removed words and the white space
    before them; and kept, a structure of the columns named in ``keep``. Null and empty texts have no words
    and keep nothing, other columns of ``docs`` are ignored, also those named like the result's, repeated rows count as
    separate places, null ids stay null, and an empty table gives an empty result. The longest text is held by one task.
    docs is read more than once and has to give the same rows each time, as a table does."""
    if window < 2:
        raise ValueError("a window has two words at least")
    n_blocks, n_buckets = blocks.counts(blocks.text_size(docs))
    texts = blocks.blocked(docs, n_blocks, keep)

    def parts(table: pa.Table, lanes: int):
        """Of each part of a block: the parse, each window's symbol, which windows are whole, and the number of words before.
        What the parses took goes back after the last."""
        before = 0
        for part in blocks.in_order(table, PART):
            data, offsets = text_bytes(part.column("text"))
            starts, ends, first = word_bounds(data, offsets)
            if n := len(starts):
                parse = recompress([word_names(data, starts, ends, lane) for lane in range(lanes)], first, window)
                yield parse, longest_inside(parse, first, n, window), _whole(first, n, window), before
                del parse
            before += n
        give_back()

    def symbols(table: pa.Table) -> pa.Table:
        found = [np.zeros(0, U)]
        for parse, best, whole, _ in parts(table, 1):
            inside = np.zeros(len(parse.length), bool)
            inside[best[whole & (best >= 0)]] = True
            found.append(parse.made[0][inside])
        return blocks.asked_table(blocks.asked(table.column("block")[0].as_py(), np.concatenate(found), n_buckets))

    def windows(left: pa.Table, right: pa.Table) -> pa.Table:
        told = blocks.told(right)
        found: list[tuple[np.ndarray, ...]] = [(np.zeros(0, U), np.zeros(0, U), np.zeros(0, np.int64))]
        n_words = 0
        for parse, best, whole, before in parts(left, 2):
            inside = np.zeros(len(parse.length) + 1, bool)
            inside[best[whole]] = True
            at = np.flatnonzero(inside[:-1])
            inside[at] = blocks.member(parse.made[0][at], told)
            inside[-1] = True  # windows without a symbol
            begin = np.flatnonzero(whole & inside[best])
            found.append((*parsed(parse, begin, window), begin + before))
            n_words = before + len(whole)
        return blocks.placed_table(left.column("block")[0].as_py() if left.num_rows else 0, *(np.concatenate(x) for x in zip(*found, strict=True)), n_words, n_buckets)

    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        cut = []
        for part in blocks.in_order(left, PART):
            data, offsets = text_bytes(part.column("text"))
            cut.append((part, data, offsets, *word_bounds(data, offsets)))
        gone = _covered(blocks.places(right, sum(len(x[3]) for x in cut)), window)
        out, before = [], 0
        for part, data, offsets, starts, ends, first in cut:
            out.append(_rows(part, data, offsets, starts, ends, first, gone[before : before + len(starts)], with_text))
            before += len(starts)
        del cut, gone
        give_back()
        return pa.concat_tables(out)

    shared = blocks.repeated(texts.groupBy("block").applyInArrow(symbols, blocks.ASKED))
    verified = blocks.placed(texts.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(windows, blocks.PLACED))
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    kinds = {"doc_id": docs.schema["doc_id"].dataType, "n_words": T.LongType(), "n_removed": T.LongType(), "kept_sha256": T.StringType(), "removed": T.ArrayType(span)}
    kinds |= ({"kept_text": T.StringType()} if with_text else {}) | ({"kept": texts.schema["kept"].dataType} if keep else {})
    schema = T.StructType([T.StructField(*x) for x in kinds.items()])
    return texts.groupBy("block").cogroup(verified.groupBy("block")).applyInArrow(apply, schema)


def _rows(left, data, offsets, starts, ends, first, gone, with_text) -> pa.Table:
    raw = data.tobytes()
    n_words, n_removed, digests, spans, texts = [], [], [], [], []
    for i in range(left.num_rows):
        a, b = int(first[i]), int(first[i + 1])
        part = gone[a:b]
        removed = int(part.sum())
        n_words.append(b - a)
        n_removed.append(removed)
        low, high = int(offsets[i]), int(offsets[i + 1])
        if not removed:
            digests.append(hashlib.sha256(b" ".join(raw[low:high].split())).hexdigest())
            spans.append([])
            texts.append(raw[low:high].decode() if with_text else "")
            continue
        step = np.diff(np.r_[0, part.astype(np.int8), 0])
        s, e = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        spans.append([{"start": int(x), "end": int(y)} for x, y in zip(s, e, strict=True)])
        pieces, at = [], low
        for x, y in zip(s, e, strict=True):
            pieces.append(raw[at : int(ends[a + x - 1]) if x else low])
            at = int(ends[a + y - 1])
        pieces.append(raw[at:high])
        digests.append(hashlib.sha256(b" ".join(b" ".join(pieces).split())).hexdigest())
        texts.append(b"".join(pieces).decode() if with_text else "")
    columns = {
        "doc_id": left.column("doc_id"),
        "n_words": pa.array(n_words, pa.int64()),
        "n_removed": pa.array(n_removed, pa.int64()),
        "kept_sha256": pa.array(digests, pa.string()),
        "removed": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    }
    columns |= {"kept_text": pa.array(texts, pa.string())} if with_text else {}
    columns |= {"kept": left.column("kept")} if "kept" in left.column_names else {}
    return pa.table(columns)

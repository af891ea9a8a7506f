"""SentencePiece encoding and decoding by a shared-prefix Viterbi search.

A text is cut into marked words where no piece of the vocabulary can reach
across. A slice's distinct new words are sorted, which walks their trie depth
first: the forward state of a prefix is computed once and serves all words that
begin with it. For a unigram model the state is the best sum of scores. For a
merge (BPE) model it is the last piece of the prefix's segmentation: a prefix
extends by the one piece that, with the last piece before it, is segmented as
just these two, which gives exactly what the merges give.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from xylem.llm.shared import mapped
from xylem.llm.wordpool import WordPool
from xylem.llm.words import slices, text_bytes

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, MERGES = 1, 2
#: Words in a worker's pool, and bytes of text at a time.
WORDS, PART = 600_000, 1 << 20


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
            continue
        size = number() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, raw[at : at + size]
        at += size


class Model:
    """What a model file says: pieces with scores and types, kind of search, normalization."""

    def __init__(self, path: str):
        self.pieces: list[tuple[str, float, int]] = []
        self.kind, self.prefix, normalizer = UNIGRAM, True, b""
        with open(path, "rb") as file:
            raw = file.read()
        for field, value in _fields(raw):
            if field == 1:
                part = dict(_fields(value))
                self.pieces.append((part[1].decode(), float(np.frombuffer(part.get(2, bytes(4)), "<f4")[0]), part.get(3, NORMAL)))
            elif field == 2:
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif field == 3:
                part = dict(_fields(value))
                self.prefix, normalizer = bool(part.get(3, 1)), part.get(2, b"")
                if part.get(4, 1):
                    raise ValueError("models that remove extra white space are not supported")
        if normalizer or any(kind in (USER, UNUSED) for *_, kind in self.pieces):
            raise ValueError("models with a character map, user-defined or unused pieces are not supported")
        if self.kind not in (UNIGRAM, MERGES):
            raise ValueError("unigram and merge models are supported")
        self.ids = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind == NORMAL}
        self.scores = {p: s for p, s, kind in self.pieces if kind == NORMAL}
        self.bytes = {int(p[1:-1], 16): i for i, (p, _, kind) in enumerate(self.pieces) if kind == BYTE}
        self.unknown = next(i for i, (*_, kind) in enumerate(self.pieces) if kind == UNKNOWN)
        self.longest = max(map(len, self.ids))
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece reaches over a word's end")
        used = set("".join(self.ids))
        #: ASCII bytes that no piece has: they stand alone.
        self.alone = np.array([i < 128 and chr(i) not in used and i != 32 for i in range(256)])

    @cached_property
    def letters(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What each id adds to a text, all in a row, with begins and sizes; one more id adds nothing."""
        show = {NORMAL: lambda p: p.replace(MARK, " ").encode(), BYTE: lambda p: bytes([int(p[1:-1], 16)]), UNKNOWN: lambda p: " ⁇ ".encode(), CONTROL: lambda p: b""}
        table = [show[kind](p) for p, _, kind in self.pieces]
        size = np.array([*map(len, table), 0])
        return np.frombuffer(b"".join(table), np.uint8), np.cumsum(size) - size, size


class Pairs:
    """Which pieces of a merge model may follow each other: those that the merges of both together give again.

    A piece is undone into the two that its last merge joined; going back in time, always undoing what was merged last, no
    pair that stands across the border may have a merge that would have come before. Of equal merges the leftmost is first."""

    def __init__(self, model: Model):
        order = sorted(model.scores, key=lambda p: -model.scores[p])
        letters = sorted({c for p in order for c in p})
        #: Numbers of single characters; any other character is number 0.
        self.letters = {c: i for i, c in enumerate(letters, 1)}
        self.number = dict(self.letters)
        self.rank, self.left, self.right = [-1] * (len(letters) + 1), [0] * (len(letters) + 1), [0] * (len(letters) + 1)
        self.joined: dict[int, int] = {}
        for rank, piece in enumerate(order):
            if len(piece) == 1:
                continue
            splits = [(self.number.get(piece[:i]), self.number.get(piece[i:])) for i in range(1, len(piece))]
            splits = [(x, y) for x, y in splits if x is not None and y is not None]
            split = next(((x, y) for x, y in splits if self.follow(x, y)), None)
            if split is None:
                continue  # no merges give it
            self.number[piece] = len(self.rank)
            self.rank.append(rank)
            self.left.append(split[0])
            self.right.append(split[1])
            for x, y in splits:
                self.joined[x << 32 | y] = rank
        for piece in order:
            if piece not in self.number and any(piece[:i] in model.scores or piece[i:] in model.scores for i in range(1, len(piece))) and self._merged(piece, model.scores) == [piece]:
                raise ValueError("a piece has a better score than its parts")

    @staticmethod
    def _merged(text: str, scores: dict[str, float]) -> list[str]:
        parts = list(text)
        while (best := max(((scores[p], -i) for i in range(len(parts) - 1) if (p := parts[i] + parts[i + 1]) in scores), default=None)) is not None:
            parts[-best[1] : 2 - best[1]] = [parts[-best[1]] + parts[1 - best[1]]]
        return parts

    def follow(self, x: int, y: int) -> bool:
        joined, rank = self.joined, self.rank
        limit = 1 << 30
        while True:
            if joined.get(x << 32 | y, limit) < limit:
                return False
            if rank[x] > rank[y]:
                limit = rank[x]
                x = self.right[x]
            elif rank[y] < 0:
                return True
            else:
                limit = rank[y] + 1
                y = self.left[y]


class Viterbi:
    """Segments words in sorted order; the states of the prefix that a word shares with the one before are kept."""

    def __init__(self, model: Model):
        self.model = model
        self.worst = min(model.scores.values(), default=0.0) - 10
        self.pairs = Pairs(model) if model.kind == MERGES else None
        number = self.pairs.number if self.pairs else {p: i for i, p in enumerate(model.scores)}
        #: What pieces of two characters or more end with, and the piece's number if that is one.
        self.suffixes = {p[i:]: -1 for p in number for i in range(len(p) - 1)} | {p: i for p, i in number.items() if len(p) > 1}
        self.word = ""
        self.size = [0]  # of the last piece, by length of prefix
        self.last = [-1]  # its number
        self.score = [0.0]

    def _extend(self, word: str, end: int) -> None:
        sizes, ending = self.size, self.suffixes
        found, n = [], 1
        while n < end and (number := ending.get(word[end - n - 1 : end])) is not None:
            n += 1
            if number >= 0:
                found.append((n, number))
        if self.pairs:
            last, follow = self.last, self.pairs.follow
            for n, number in reversed(found):
                if n == end or follow(last[end - n], number):
                    break
            else:
                n, number = 1, self.pairs.letters.get(word[end - 1], 0)
            sizes.append(n)
            last.append(number)
            return
        best, size = self.score[end - 1] + self.model.scores.get(word[end - 1], self.worst), 1
        for n, _ in found:
            score = self.score[end - n] + self.model.scores[word[end - n : end]]
            if score > best:
                best, size = score, n
        sizes.append(size)
        self.score.append(best)

    def segment(self, word: str) -> list[str]:
        shared, most = 0, min(len(word), len(self.word))
        while shared < most and word[shared] == self.word[shared]:
            shared += 1
        del self.size[shared + 1 :], self.score[shared + 1 :], self.last[shared + 1 :]
        self.word = word
        for end in range(shared + 1, len(word) + 1):
            self._extend(word, end)
        out, end = [], len(word)
        while end:
            out.append(word[end - self.size[end] : end])
            end -= self.size[end]
        return out[::-1]

    def ids(self, word: str) -> list[int]:
        out: list[int] = []
        for piece in self.segment(word):
            if piece in self.model.ids:
                out.append(self.model.ids[piece])
            elif self.model.bytes:
                out += [self.model.bytes[b] for b in piece.encode()]
            else:
                out.append(self.model.unknown)
        return out


@cache
def _codec(path: str) -> tuple[Model, WordPool]:
    model = Model(path)
    search = Viterbi(model)

    def bounds(data: np.ndarray, offsets: np.ndarray):
        """Units that tile the texts: blanks with the word after them, or a byte that stands alone."""
        blank, alone = data == 32, model.alone[data]
        begin = blank.copy()
        begin[1:] &= ~blank[:-1]
        begin |= alone
        begin[1:] |= alone[:-1]
        begin[offsets[:-1][offsets[:-1] < len(data)]] = True
        starts = np.flatnonzero(begin)
        return data, starts, np.r_[starts[1:], len(data)][: len(starts)], np.searchsorted(starts, offsets)

    def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found: list[list[int]] = [[]] * len(words)
        marked = [w.replace(" ", MARK) for w in words]
        for i in sorted(range(len(words)), key=marked.__getitem__):
            found[i] = search.ids(marked[i])
        return np.array([len(x) for x in found], np.int64), np.array([y for x in found for y in x], np.uint32)

    return model, WordPool(encode, WORDS, bounds)


def _encoded(path: str, texts: pa.Array) -> pa.ListArray:
    rules, pool = _codec(path)
    column = pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), MARK, " ")
    if rules.prefix:
        column = pc.if_else(pc.equal(pc.binary_length(column), 0), column, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), column, pa.scalar("", pa.large_string())))
    found, offsets = pool.texts(*text_bytes(column))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(found.astype(np.int32)))


def _decoded(path: str, column: pa.Array) -> pa.Array:
    rules, _ = _codec(path)
    letters, begin, size = rules.letters
    column = pc.fill_null(column, [])
    flat = pc.fill_null(column.flatten(), -1).to_numpy(zero_copy_only=False)
    flat = np.where((flat >= 0) & (flat < len(size) - 1), flat, len(size) - 1)
    rows = np.r_[0, np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False))]
    total = np.r_[0, np.cumsum(size[flat])]
    raw = letters[np.arange(total[-1]) + np.repeat(begin[flat] - total[:-1], size[flat])].tobytes()
    ends = total[rows].tolist()
    return pa.array([raw[a + (rules.prefix and raw[a : a + 1] == b" ") : b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.string())


def _without(docs: DataFrame, *names: str) -> list[T.StructField]:
    """The fields of docs but those of these names."""
    return [f for f in docs.schema.fields if f.name.lower() not in {n.lower() for n in names}]


def _place(fields: list[T.StructField], name: str) -> str:
    """What a column is called while it is mapped."""
    return next(f"c{i}" for i, f in enumerate(fields) if f.name.lower() == name.lower())


def sentencepiece_encode(docs: DataFrame, model: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with a column of ids (array of int) of a text column, as the model file's own library gives them.

    Null and empty texts have no ids; a column of that name is replaced; repeated rows and other columns stay as they are;
    a very long word costs time in proportion to its length; an empty table stays empty."""
    return sentencepiece_codec(docs, model, text, ids, None)


def sentencepiece_codec(docs: DataFrame, model: str, text: str = "text", ids: str = "ids", decoded: str | None = "decoded") -> DataFrame:
    """docs with the ids of a text column and the text that the ids give, both in one pass over the rows; rows and other
    columns as ``sentencepiece_encode`` and ``sentencepiece_decode`` state."""
    kinds = {ids: T.ArrayType(T.IntegerType())} | ({decoded: T.StringType()} if decoded else {})
    kept, made = _without(docs, *kinds), [T.StructField(*x) for x in kinds.items()]

    source = _place(kept, text)

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        for batch in batches:
            for part in slices(batch, source, PART):
                lists = _encoded(model, part.column(source))
                yield [*part.columns, lists, *([_decoded(model, lists)] if decoded else [])]

    return mapped(docs, kept, made, both)


def sentencepiece_decode(docs: DataFrame, model: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """docs with the text of a column of ids; bytes that are no UTF-8 become U+FFFD. Null and empty lists give an empty
    text, and an id outside the vocabulary, or a null, gives nothing; a column of that name is replaced; repeated rows and
    other columns stay as they are; an empty table stays empty."""
    kept = _without(docs, text)

    source = _place(kept, ids)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield [*part.columns, _decoded(model, part.column(source))]

    return mapped(docs, kept, [T.StructField(text, T.StringType())], decode)

"""Packing by cutting-stock column generation.

A document's ids are cut at multiples of the sequence length; a full piece is a
sequence. The rest pieces are the orders of a cutting-stock problem: a histogram
of their lengths, in units, has at most length / unit rows however large the
corpus. A linear program over patterns (how many pieces of each length fill one
sequence) is solved on that histogram; a knapsack by dynamic programming prices
new patterns until none saves anything. Patterns are used a whole number of
times, what that leaves is filled first-fit decreasing, and each class's
documents, ranked by a distributed count, take the places the patterns offer.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from xylem.llm.shared import checkpointed, give_back
from xylem.llm.wordpool import WordPool
from xylem.llm.words import LOWER, slices, text_bytes, word_bounds

LENGTH, UNIT, END = 4096, 16, 2
_pools: dict[str, WordPool] = {}


_PLAIN = np.zeros(256, bool)
_PLAIN[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


def _units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Lower-cases A-Z, and cuts a full stop or comma from the plain letter or digit before it, as the tokenizer does; its
    special tokens are matched before it lower-cases, so bytes that may hold one stay as they are."""
    if b"<|" not in data.tobytes():
        data = LOWER[data]
    starts, ends, _ = word_bounds(data, offsets)
    last = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    tail = ((last == 44) | (last == 46)) & (ends - starts > 1)
    tail[tail] = _PLAIN[data[ends[tail] - 2]]
    cut = ends[tail] - 1
    starts, ends = np.sort(np.r_[starts, cut]), np.sort(np.r_[ends, cut])
    return data, starts, ends, np.searchsorted(starts, offsets)


def pool(tokenizer: str) -> WordPool:
    """The worker's pool for a tokenizers file whose pre-tokenizer drops white space."""
    if tokenizer not in _pools:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(tokenizer)

        def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
            sizes, ids = [], []
            for at in range(0, len(words), 512):
                part = words[at : at + 512]
                found = tok.encode(" ".join(part), add_special_tokens=False)
                begins = np.cumsum([0] + [len(x) + 1 for x in part])
                owner = np.searchsorted(begins, [x for x, _ in found.offsets], "right") - 1 if found.ids else np.zeros(0, np.int64)
                sizes.append(np.bincount(owner, minlength=len(part)))
                ids.append(np.array(found.ids, np.uint32))
            return np.concatenate(sizes).astype(np.int64), np.concatenate(ids)

        _pools[tokenizer] = WordPool(encode, bounds=_units)
    return _pools[tokenizer]


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH) -> DataFrame:
    """The pieces of each row of docs (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, place (its row's number,
    which tells repeated rows apart)."""
    end = np.array([END], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = pool(tokenizer)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, offsets = words.texts(*text_bytes(part.column("text")))
                ids = ids.astype("<u4")
                out: list[list[int]] = [[], [], [], [], []]
                for i in range(part.num_rows):
                    a, b = int(offsets[i]), int(offsets[i + 1])
                    n = b - a + 1
                    for start in range(0, n, length):
                        size = min(length, n - start)
                        crc = zlib.crc32(ids[a + start : min(b, a + start + size)].tobytes())
                        for column, x in zip(out, (i, start, size, zlib.crc32(end, crc) if start + size == n else crc, n), strict=True):
                            column.append(x)
                at = pa.array(out[0], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(at), part.column("place").take(at), *(pa.array(x, pa.int64()) for x in out[1:])], names=["doc_id", "place", "start", "length", "ids_crc32", "doc_tokens"])
        give_back()

    texts = docs.select("doc_id", F.monotonically_increasing_id().alias("place"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(cut, f"doc_id {dict(docs.dtypes)['doc_id']}, place long, start long, length long, ids_crc32 long, doc_tokens long")


def knapsack(values: np.ndarray, weights: np.ndarray, capacity: int, most: int) -> tuple[float, list[np.ndarray]]:
    """The greatest value of a multiset of items of total weight at most capacity, and up to ``most`` multisets (how often
    each has each item): for the items through which the greatest values go, the best multiset that has the item."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    upto = np.searchsorted(weights, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if k := upto[c]:
            gain = best[c - weights[:k]] + values[:k]
            j = gain.argmax()
            if gain[j] > best[c]:
                best[c], choice[c] = gain[j], j
    through = values + best[capacity - weights]
    found = []
    for j in np.argsort(-through)[:most]:
        counts, c = np.zeros(len(weights), np.int64), capacity - int(weights[j])
        counts[j] = 1
        while c > 0:
            if choice[c] < 0:
                c -= 1
            else:
                counts[choice[c]] += 1
                c -= int(weights[choice[c]])
        found.append(counts)
    return float(best[capacity]), found


def column_generation(weights: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 5e-4, rounds: int = 20_000, each: int = 24) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows) and how often the least fractional packing uses each. weights: ascending. It ends when no pattern
    saves anything, or when the packing is proven to be within ``gap`` of the least possible; each pricing offers up to
    ``each`` patterns."""
    basis = np.diag((capacity // weights).astype(float))
    inverse = np.diag(1 / np.diag(basis))
    used = inverse @ demand
    least, pivots = (weights @ demand) / capacity, 0
    for _ in range(rounds):
        prices = inverse.sum(0)
        value, columns = knapsack(prices, weights, capacity, each)
        if value <= 1 + 1e-9 or used.sum() <= max(least, (prices @ demand) / value) * (1 + gap):
            break
        for column in columns:
            if inverse.sum(0) @ column <= 1 + 1e-9:
                continue
            change = inverse @ column
            able = change > 1e-9
            ratio = np.where(able, used / np.where(able, change, 1), np.inf)
            out = int(ratio.argmin())
            basis[:, out] = column
            used = np.maximum(used - ratio[out] * change, 0)
            used[out] = ratio[out]
            row = inverse[out] / change[out]
            inverse -= np.outer(change, row)
            inverse[out] = row
            pivots += 1
            if pivots % 200 == 0:
                inverse = np.linalg.inv(basis)
                used = np.maximum(inverse @ demand, 0)
    return basis.T.round().astype(np.int64), used


def plan(weights: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[int, np.ndarray]]:
    """(how many sequences, pieces of each class in each) that place the demand exactly."""
    patterns, used = column_generation(weights, demand.astype(float), capacity)
    out, rest = [], demand.copy()
    for i in np.argsort(-used):
        pattern = patterns[i]
        need = pattern > 0
        times = int(min(int(used[i] + 1e-6), (rest[need] // pattern[need]).min(initial=np.iinfo(np.int64).max)))
        if times > 0:
            out.append((times, pattern))
            rest -= times * pattern
    while rest.sum():  # the whole multiples of the fullest pattern that the rest still allows, largest pieces first
        left, pattern = capacity, np.zeros(len(weights), np.int64)
        for j in range(len(weights) - 1, -1, -1):
            take = min(int(rest[j] - pattern[j]), left // int(weights[j]))
            pattern[j] += take
            left -= take * int(weights[j])
        need = pattern > 0
        times = int((rest[need] // pattern[need]).min())
        out.append((times, pattern))
        rest -= times * pattern
    return out


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, unit: int = UNIT) -> DataFrame:
    """Packs docs (doc_id, text) into sequences of at most ``length`` ids.

    Returns for each piece doc_id, start (its document's ids before it), length, ids_crc32 (of its ids as little-endian
    unsigned 32-bit numbers), doc_tokens, sequence_id and offset (gapless from 0 in its sequence). A document's ids are its
    text's without special tokens, then END. A null or empty text is one piece of the END alone; repeated rows are packed
    each for itself; other columns of docs are ignored; an empty table gives an empty result. Null ids keep their pieces.

    The driver holds the histogram and the patterns: at most length / unit classes by ``salts`` counts."""
    spark: SparkSession = docs.sparkSession
    capacity = length // unit
    kind = F.when(F.col("length") == length, F.lit(capacity + 1)).otherwise(F.ceil(F.col("length") / unit)).cast("int")
    found = checkpointed(pieces(docs, tokenizer, length).withColumn("kind", kind))
    salts = int(np.clip(found.count() // 50_000, 8, 4096))
    salted = found.withColumn("salt", F.pmod(F.xxhash64("place", "start"), F.lit(salts)).cast("int"))
    counts = np.zeros((capacity + 2, salts), np.int64)
    for row in salted.groupBy("kind", "salt").count().collect():
        counts[row["kind"], row["salt"]] = row["count"]
    demand = counts.sum(1)
    before = np.cumsum(counts, 1) - counts
    present = np.flatnonzero(demand[: capacity + 1])
    steps = plan(present, demand[present], capacity) if len(present) else []
    ranges: dict[int, list[tuple[int, int, int]]] = {int(k): [] for k in present}
    taken, sequence = dict.fromkeys(ranges, 0), 0
    for times, pattern in steps:
        for j in np.flatnonzero(pattern):
            k = int(present[j])
            ranges[k].append((taken[k], int(pattern[j]), sequence))
            taken[k] += times * int(pattern[j])
        sequence += times
    ranges[capacity + 1] = [(0, 1, sequence)]
    tables = {k: np.array(v, np.int64).T for k, v in ranges.items() if v}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, salt, number = (np.asarray(batch.column(x)) for x in ("kind", "salt", "number"))
            rank = before[kinds, salt] + number - 1
            out = np.empty(len(rank), np.int64)
            for k in np.unique(kinds):
                begins, each, base = tables[int(k)]
                at = kinds == k
                i = np.searchsorted(begins, rank[at], "right") - 1
                out[at] = base[i] + (rank[at] - begins[i]) // each[i]
            keep = ["doc_id", "place", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in keep), pa.array(out)], names=[*keep, "sequence_id"])

    numbered = salted.withColumn("number", F.row_number().over(Window.partitionBy("kind", "salt").orderBy("place", "start")))
    columns = found.select("doc_id", "place", "start", "length", "ids_crc32", "doc_tokens")
    placed = numbered.mapInArrow(place, f"{', '.join(f'{n} {t}' for n, t in columns.dtypes)}, sequence_id long")
    order = Window.partitionBy("sequence_id").orderBy("place", "start").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.coalesce(F.sum("length").over(order), F.lit(0)).alias("offset"))

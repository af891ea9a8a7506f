"""Blocks of documents and the names they hold in common.

A corpus is dealt by its rows' numbers into blocks of about ``BLOCK_BYTES`` of
text, so no block follows a hot source, an id, or a group of copies. A block's
distinct names go to buckets by their low bits as packed arrays: a name travels
once for each block that holds it, however often it stands there. ``repeated``
tells each block which of its names stand twice in the corpus; ``placed`` does so
with names of 128 bits and answers with the places that they came from. Jobs
that read the blocks several times in one plan share a single exchange of text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from xylem.llm.words import U, slices

BLOCK_BYTES = 8 << 20
BUCKET_BYTES = 24 << 20
#: Of the largest bitmap of wanted keys: 16 MB.
BITS = 27
ASKED = "bucket int, block int, names binary, many binary"
TOLD = "block int, names binary"
TOLD_ARROW = pa.schema([("block", pa.int32()), ("names", pa.binary())])
PLACED = "bucket int, block int, names binary, checks binary, at binary, many binary"
FOUND = "block int, at binary, mask binary"


def text_size(docs: DataFrame, text: str = "text") -> int:
    """Bytes of text in the whole table, by one aggregate over all rows."""
    return int(docs.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0)


def counts(total: int) -> tuple[int, int]:
    """Numbers of blocks and of buckets for a corpus of ``total`` bytes."""
    return max(1, -(-total // BLOCK_BYTES)), max(32, -(-total // BUCKET_BYTES))


def numbered(docs: DataFrame, n: int) -> DataFrame:
    """docs with place, a number for each row, and block, which it is dealt to by that number."""
    placed = docs.withColumn("place", F.monotonically_increasing_id())
    return placed.withColumn("block", F.pmod(F.xxhash64("place"), F.lit(n)).cast("int"))


def column(name: str) -> Column:
    """A column by its name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def blocked(docs: DataFrame, n: int, keep: list[str] | None = None) -> DataFrame:
    """(block, place, doc_id, text) and, if there are columns to keep, kept, a structure of them; null texts are empty."""
    kept = [F.struct(*(column(c).alias(c) for c in keep)).alias("kept")] if keep else []
    return numbered(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *kept), n)


def in_order(table: pa.Table, most: int) -> Iterator[pa.RecordBatch]:
    """The rows of a block by their numbers, in slices of about ``most`` bytes of text."""
    for batch in table.sort_by("place").combine_chunks().to_batches():
        yield from slices(batch, "text", most)


def asked(block: int, names: np.ndarray, buckets: int) -> list[tuple[int, int, bytes, bytes]]:
    """Rows of ASKED for the names a block holds; ``many`` flags those that it holds more than once."""
    if not len(names):
        return []
    names = np.sort(names)
    first = np.r_[True, names[1:] != names[:-1]]
    at = np.flatnonzero(first)
    many = np.diff(np.r_[at, len(names)]) > 1
    names = names[at]
    bucket = (names % U(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    names, many, bucket = names[order], many[order], bucket[order]
    cuts = np.r_[0, np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, len(bucket)]
    return [(int(bucket[a]), block, names[a:b].tobytes(), np.packbits(many[a:b]).tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def asked_table(rows: list[tuple[int, int, bytes, bytes]]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    return pa.table({"bucket": pa.array(columns[0], pa.int32()), "block": pa.array(columns[1], pa.int32()), "names": pa.array(columns[2], pa.binary()), "many": pa.array(columns[3], pa.binary())})


def _answer(table: pa.Table) -> pa.Table:
    """Tells each block which of its names stand in the corpus more than once."""
    parts = [np.frombuffer(x, U) for x in table.column("names").to_pylist()]
    many = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(p)).astype(bool) for x, p in zip(table.column("many").to_pylist(), parts, strict=True)]
    sizes = np.array([len(p) for p in parts])
    names, index = np.unique(np.concatenate(parts), return_inverse=True)
    often = np.bincount(index, minlength=len(names)) > 1
    often[index[np.concatenate(many)]] = True
    keep, ends = often[index], np.cumsum(sizes)
    out = [(block, p[k].tobytes()) for block, p, k in zip(table.column("block").to_pylist(), parts, np.split(keep, ends[:-1]), strict=True) if k.any()]
    return pa.table([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], schema=TOLD_ARROW)


def repeated(names: DataFrame) -> DataFrame:
    """(block, names): the names of each block that stand more than once in the corpus. names: rows of ASKED."""
    return names.groupBy("bucket").applyInArrow(_answer, TOLD)


def _cuts(bucket: np.ndarray) -> list[tuple[int, int]]:
    cuts = np.r_[0, np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, len(bucket)].tolist() if len(bucket) else [0]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def groups(names: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal pairs of names stand together, and where each group begins."""
    order = np.lexsort((checks, names))
    a, b = names[order], checks[order]
    return order, np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(a)])


def placed_table(block: int, names: np.ndarray, checks: np.ndarray, at: np.ndarray, n_words: int, buckets: int) -> pa.Table:
    """Rows of PLACED for the 128-bit names found at places of a block: each distinct name once, with one place. Places of
    names that the block holds more than once are known to be repeated: they go along as a mask over its words."""
    order, begin = groups(names, checks)
    count = np.diff(np.r_[begin, len(order)])
    mask = np.zeros(n_words, bool)
    mask[at[order[np.repeat(count > 1, count)]]] = True
    one = order[begin]
    bucket = (names[one] % U(buckets)).astype(np.int32)
    by = np.argsort(bucket, kind="stable")
    one, many, bucket = one[by], (count > 1)[by], bucket[by]
    spans = _cuts(bucket)
    cut = lambda x: [x[one[a:b]].tobytes() for a, b in spans]
    rows = [[int(bucket[a]) for a, _ in spans], [block] * len(spans), cut(names), cut(checks), cut(at.astype(np.uint32)), [np.packbits(many[a:b]).tobytes() for a, b in spans]]
    if mask.any():
        for column, value in zip(rows, (block % buckets, block, None, None, np.packbits(mask).tobytes(), None), strict=True):
            column.append(value)
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
    return pa.table([pa.array(x, t) for x, t in zip(rows, kinds, strict=True)], names=["bucket", "block", "names", "checks", "at", "many"])


def _found(table: pa.Table) -> pa.Table:
    """Tells each block at which of its places names stand that the corpus holds more than once."""
    blocks, names, checks, at, many = (table.column(c).to_pylist() for c in ("block", "names", "checks", "at", "many"))
    rows = [(b, None, x) for b, n, x in zip(blocks, names, at, strict=True) if n is None]
    asks = [i for i, n in enumerate(names) if n is not None]
    if asks:
        sizes = [len(names[i]) // 8 for i in asks]
        a, b = (np.concatenate([np.frombuffer(x[i], U) for i in asks]) for x in (names, checks))
        often = np.concatenate([np.unpackbits(np.frombuffer(many[i], np.uint8), count=n).astype(bool) for i, n in zip(asks, sizes, strict=True)])
        order, begin = groups(a, b)
        count = np.diff(np.r_[begin, len(order)])
        own = ~often
        often[order[np.repeat((count > 1) | np.logical_or.reduceat(often[order], begin), count)]] = True
        end = 0
        for i, n in zip(asks, sizes, strict=True):
            begin_i, end = end, end + n
            places = np.frombuffer(at[i], np.uint32)[(often & own)[begin_i:end]]
            if len(places):
                rows.append((blocks[i], places.tobytes(), None))
    columns = list(zip(*rows, strict=True)) or [[]] * 3
    return pa.table([pa.array(x, t) for x, t in zip(columns, (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["block", "at", "mask"])


def placed(names: DataFrame) -> DataFrame:
    """(block, at, mask): the places of each block whose names stand more than once in the corpus. names: rows of PLACED."""
    return names.groupBy("bucket").applyInArrow(_found, FOUND)


def places(table: pa.Table, n_words: int) -> np.ndarray:
    """Which words of a block rows of FOUND name."""
    out = np.zeros(n_words, bool)
    for at, mask in zip(table.column("at").to_pylist(), table.column("mask").to_pylist(), strict=True):
        if mask is not None:
            out |= np.unpackbits(np.frombuffer(mask, np.uint8), count=n_words).astype(bool)
        else:
            out[np.frombuffer(at, np.uint32)] = True
    return out


def told(table: pa.Table) -> np.ndarray:
    """All names in rows of TOLD, sorted."""
    parts = [np.frombuffer(x, U) for x in table.column("names").to_pylist()]
    return np.sort(np.concatenate(parts)) if parts else np.zeros(0, U)


def member(x: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which elements of x stand in the sorted array ``of``."""
    if not len(of) or not len(x):
        return np.zeros(len(x), bool)
    return of[np.minimum(np.searchsorted(of, x), len(of) - 1)] == x


def among(df: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows of df whose key (a long) stands in wanted, and a few others that share their bit in a bitmap of 2**BITS bits
    at most; what goes to the driver and from there to all tasks has that bound, however many keys are wanted."""
    bits = min(BITS, max(12, wanted.count().bit_length() + 4))
    slot = F.shiftrightunsigned(F.xxhash64(key), 64 - bits)
    words = wanted.select(F.shiftright(slot, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(slot, F.lit(64)).cast("int")).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(1 << (bits - 6), np.int64)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    shared, names = df.sparkSession.sparkContext.broadcast(table), df.columns

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("__slot").to_numpy()
            found = (shared.value[at >> 6] >> (at & 63)) & 1
            yield batch.filter(pa.array(found.astype(bool))).select(names)

    return df.withColumn("__slot", slot).mapInArrow(keep, df.schema)

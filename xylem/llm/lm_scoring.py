"""Language-model scoring by context-tree weighting, and a smoothed unigram base.

Learning: each task counts the words and the byte grams of its training texts,
names them once, and deals the counts to buckets; what meets there is summed in
two steps, so no group grows with the number of tasks. The tree is cut at
contexts of two bytes: a bucket holds whole subtrees, and the driver closes the
nodes of shorter contexts, 65,536 at most. Scoring: a block of texts asks the
buckets for the words and grams that it holds, each once, and sums the answers
along its texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xylem.llm import blocks
from xylem.llm.ctw import Level, contexts, levels, log10_probabilities, stream
from xylem.llm.shared import checkpointed
from xylem.llm.words import LOWER, Places, U, distinct, distinct_counts, mixed, slices, text_bytes, word_bounds, word_names

#: Bytes of context, and distinct names that a task holds before it passes them on.
DEPTH, HELD = 5, 1_500_000
WORD, GRAM = 0, 1
#: Bytes of text whose grams are in memory at a time.
PART = 1 << 21


def _read(texts: pa.Array, depth: int):
    """Names of words with their rows' bounds, and grams with theirs."""
    data, offsets = text_bytes(texts)
    data = LOWER[data]
    starts, ends, first = word_bounds(data, offsets)
    symbols, bounds = stream(data, starts, ends, first)
    return word_names(data, starts, ends), first, contexts(symbols, bounds, depth), bounds


def _bucket(kind: int, names: np.ndarray, buckets: int, depth: int) -> np.ndarray:
    return ((names if kind == WORD else mixed(names >> U(8 * (depth - 1)))) % U(buckets)).astype(np.int32)


def _summed(names: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(names, kind="stable")
    names, counts = names[order], counts[order]
    begin = np.flatnonzero(np.r_[True, names[1:] != names[:-1]][: len(names)])
    return names[begin], np.add.reduceat(counts, begin) if len(begin) else counts[:0]


class _Counts:
    """Names and their counts in the training rows that a task has read since it last passed them on."""

    def __init__(self, kind: int):
        self.kind, self.parts, self.size = kind, [], 0

    def add(self, names: np.ndarray, trained: np.ndarray) -> None:
        """Counts the trained names; the others are kept with a count of 0."""
        counted, counts = distinct_counts(names[trained])
        others = distinct(names[~trained])
        self.parts += [(counted, counts), (others, np.zeros(len(others), np.int64))]
        self.size += len(counted) + len(others)
        if self.size > HELD:
            self.parts = [self.total()]
            self.size = len(self.parts[0][0])

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        return _summed(*(np.concatenate(x) for x in zip(*self.parts, strict=True))) if self.parts else (np.zeros(0, U), np.zeros(0, np.int64))

    def rows(self, buckets: int, depth: int) -> pa.RecordBatch:
        names, counts = self.total()
        self.parts, self.size = [], 0
        return _dealt(self.kind, names, buckets, depth, counts)


def _spans(kind: int, names: np.ndarray, buckets: int, depth: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    bucket = _bucket(kind, names, buckets, depth)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cuts = np.r_[0, np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, len(bucket)].tolist() if len(bucket) else [0]
    return order, bucket, list(zip(cuts[:-1], cuts[1:], strict=True))


def _dealt(kind: int, names: np.ndarray, buckets: int, depth: int, counts: np.ndarray) -> pa.RecordBatch:
    order, bucket, spans = _spans(kind, names, buckets, depth)
    names, counts = names[order], counts[order]
    n = len(spans)
    return pa.RecordBatch.from_arrays([pa.array([kind] * n, pa.int32()), pa.array([int(bucket[a]) for a, _ in spans], pa.int32()), pa.array([names[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([counts[a:b].tobytes() for a, b in spans], pa.binary())], names=["kind", "bucket", "names", "counts"])


def _held(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """All names of rows of counts, sorted, with their sums."""
    names, counts = ([np.frombuffer(x, kind) for x in table.column(c).to_pylist()] for c, kind in (("names", U), ("counts", np.int64)))
    return _summed(np.concatenate(names), np.concatenate(counts)) if names else (np.zeros(0, U), np.zeros(0, np.int64))


def _top(rows: list) -> dict[tuple[int, int], Level]:
    """The nodes of contexts of one byte and none, from their parts."""
    node = np.array([r["node"] for r in rows], np.int64)
    zeros, ones = (np.array([r[c] for r in rows], np.int64) for c in ("zeros", "ones"))
    deeper = np.array([r["deeper"] for r in rows], float)
    out: dict[tuple[int, int], Level] = {}
    for k in range(8):
        at = np.flatnonzero((node & 255) >> k == 1)
        ids = ((node[at] >> 8) << k) | (node[at] & ((1 << k) - 1))
        order = np.argsort(ids)
        at, ids = at[order], ids[order].astype(U)
        out[1, k] = one = Level(ids, zeros[at], ones[at], deeper[at])
        prefix, back = np.unique(ids & U((1 << k) - 1), return_inverse=True)
        total = lambda x: np.bincount(back, x, len(prefix))  # noqa: B023, E731
        out[0, k] = Level(prefix, total(one.zeros).astype(np.int64), total(one.ones).astype(np.int64), total(one.weighted(False)))
    return out


def lm_scoring(docs: DataFrame, trained: str = "crc32(cast(doc_id as string)) % 5 <> 1", depth: int = DEPTH) -> DataFrame:
    """Scores every row of docs (doc_id, text); learns from those for which ``trained`` holds (a null id: it does).

    A text is its words, lower-cased in A-Z, and an end; null and empty texts are the end alone. Returns doc_id, held_out,
    n_tokens, n_known (tokens that training has), train_tokens, base_score (log10, smoothed unigram), score (log10 of the
    tree's probability of the words joined by one space and closed by the end) and bits_per_byte. Repeated rows count and
    are scored each; a very long text is read whole, by one task; other columns are ignored; an empty table gives an empty result; with no training row every
    estimate is the uniform one."""
    if not 2 <= depth <= 7:
        raise ValueError("depth must be from 2 to 7")
    flag = F.coalesce(F.expr(trained), F.lit(True))
    total = blocks.text_size(docs)
    n_blocks, buckets = blocks.counts(total)
    salts = max(1, n_blocks // 256)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Counts(WORD), _Counts(GRAM)
        for batch in batches:
            for part in slices(batch, "text", PART):
                train = part.column("trained").to_numpy(zero_copy_only=False).astype(bool)
                names, first, grams, bounds = _read(part.column("text"), depth)
                held[0].add(names, np.repeat(train, np.diff(first)))
                held[1].add(grams, np.repeat(train, np.diff(bounds)))
                for x in held:
                    if x.size > HELD // 2:
                        yield x.rows(buckets, depth)
        for x in held:
            if x.size:
                yield x.rows(buckets, depth)

    def merge(table: pa.Table) -> pa.Table:
        names, counts = _held(table)
        return pa.table({"kind": table.column("kind")[:1], "bucket": table.column("bucket")[:1], "names": pa.array([names.tobytes()], pa.binary()), "counts": pa.array([counts.tobytes()], pa.binary())})

    counted = "kind int, bucket int, names binary, counts binary"
    learned = docs.select(F.coalesce("text", F.lit("")).alias("text"), flag.alias("trained")).mapInArrow(count, counted)
    part = learned.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts))).groupBy("kind", "bucket", "salt").applyInArrow(lambda t: merge(t), counted)
    model = checkpointed(part.groupBy("kind", "bucket").applyInArrow(lambda t: merge(t), counted))

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The parts of short contexts' nodes that a bucket knows; and its distinct and all training words, as node -1."""
        for batch in batches:
            for kind, a, b in zip(*(batch.column(c).to_pylist() for c in ("kind", "names", "counts")), strict=True):
                names, counts = np.frombuffer(a, U), np.frombuffer(b, np.int64)
                if kind == WORD:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in ([-1], [int((counts > 0).sum())], [int(counts.sum())], [0.0])], names=["node", "zeros", "ones", "deeper"])
                    continue
                nodes = levels(names, counts, depth, 1)
                for k in range(8):
                    one = nodes[1, k]
                    ids = one.ids.astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (((ids >> k) << 8) | (1 << k) | (ids & ((1 << k) - 1)), one.zeros, one.ones, one.deeper)], names=["node", "zeros", "ones", "deeper"])

    rows = model.select("kind", "names", "counts").mapInArrow(close, "node long, zeros long, ones long, deeper double").groupBy("node").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("deeper").alias("deeper")).collect()
    n_train = docs.where(flag).count()
    different, words = next(((r["zeros"], r["ones"]) for r in rows if r["node"] == -1), (0, 0))
    n_tokens, n_distinct = words + n_train, different + (n_train > 0)
    spread = float(n_tokens + 0.5 * (n_distinct + 1))
    top = _top([r for r in rows if r["node"] >= 0])

    texts = blocks.numbered(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), flag.alias("trained")), n_blocks).drop("place")

    def parts(table: pa.Table) -> Iterator[pa.RecordBatch]:
        for batch in table.to_batches():
            yield from slices(batch, "text", PART)

    def distinct_names(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """The words and grams of a block, sorted."""
        found: tuple[list, list] = [], []
        for part in parts(table):
            names, _, grams, _ = _read(part.column("text"), depth)
            found[0].append(distinct(names))
            found[1].append(distinct(grams))
        return tuple(distinct(np.concatenate([*x, np.zeros(0, U)])) for x in found)

    def ask(table: pa.Table) -> pa.Table:
        out = []
        for kind, found in zip((WORD, GRAM), distinct_names(table), strict=True):
            order, bucket, spans = _spans(kind, found, buckets, depth)
            found = found[order]
            out += [(kind, int(bucket[a]), table.column("block")[0].as_py(), found[a:b].tobytes()) for a, b in spans]
        return pa.table([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["kind", "bucket", "block", "names"])

    def answer(asked: pa.Table, known: pa.Table) -> pa.Table:
        empty = pa.table({"block": pa.array([], pa.int32()), "kind": pa.array([], pa.int32()), "bucket": pa.array([], pa.int32()), "values": pa.array([], pa.binary())})
        if not asked.num_rows:
            return empty
        kind = asked.column("kind")[0].as_py()
        names, value = _held(known)
        value = value if kind == WORD else log10_probabilities(names, depth, levels(names, value, depth, 2) | top)
        told = [value[np.searchsorted(names, np.frombuffer(x, U))].tobytes() for x in asked.column("names").to_pylist()]
        return pa.table({"block": asked.column("block"), "kind": asked.column("kind"), "bucket": asked.column("bucket"), "values": pa.array(told, pa.binary())})

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by([("kind", "ascending"), ("bucket", "ascending")])
        told = {k: [] for k in (WORD, GRAM)}
        for kind, x in zip(right.column("kind").to_pylist(), right.column("values").to_pylist(), strict=True):
            told[kind].append(np.frombuffer(x, np.int64 if kind == WORD else float))
        known = distinct_names(left)
        values = []
        for kind in (WORD, GRAM):
            out = np.zeros(len(known[kind]))
            if len(out):
                out[_spans(kind, known[kind], buckets, depth)[0]] = np.concatenate(told[kind])
            values.append(out)
        places, done = [Places(x) for x in known], []
        for part in parts(left):
            names, first, grams, bounds = _read(part.column("text"), depth)
            n, row = part.num_rows, np.repeat(np.arange(part.num_rows), np.diff(first))
            count = values[WORD][places[WORD](names)]
            base = np.bincount(row, np.log10((count + 0.5) / spread), n) + np.log10((n_train + 0.5) / spread)
            size = np.diff(bounds)
            tree = np.bincount(np.repeat(np.arange(n), size), values[GRAM][places[GRAM](grams)], n)
            held_out = ~part.column("trained").to_numpy(zero_copy_only=False).astype(bool)
            columns = (held_out, np.diff(first) + 1, np.bincount(row, count > 0, n).astype(np.int64) + int(n_train > 0), np.full(n, n_tokens), base, tree, -tree / np.log10(2) / size)
            done.append(pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, columns)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"]))
        return pa.Table.from_batches(done)

    # a name is asked for once by each block, and buckets grow in number with the blocks: what meets in one stays as large
    asks = texts.groupBy("block").applyInArrow(ask, "kind int, bucket int, block int, names binary")
    answers = asks.groupBy("kind", "bucket").cogroup(model.groupBy("kind", "bucket")).applyInArrow(lambda a, b: answer(a, b), "block int, kind int, bucket int, values binary")
    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")

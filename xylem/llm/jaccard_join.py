"""N-gram Jaccard join as a blocked sparse matrix product.

Rows of the incidence matrix are distinct n-gram sets, its columns n-grams, from
rare to frequent by a fixed-size table of counts. Two sets with Jaccard
similarity of at least t share one of their first ``size - ceil(t * size) + 1``
n-grams, so only that part of each row is multiplied: columns are dealt to
blocks, a block multiplies its columns with their transpose, accumulates overlap
counts and discards a pair as soon as its sizes, or what is left of both rows
after the shared n-gram, bound the overlap below what t asks for. Whole texts
then decide each remaining pair exactly.

A column of many near copies is not multiplied out. First each set meets the
next one of its column; links found give components. Rows of columns that still
hold several components are clustered over these columns and dealt to blocks of
whole rows; blocks of a cluster whose sizes may fit are multiplied, all overlaps
counted, and only links between components kept. No link between components is
lost, so the components are those of the full product.

A column of more rows than ``COLUMN`` is dealt to several blocks; a few rows of
each meet in a product of their own, and all its rows count as possibly similar.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from xylem.llm import blocks
from xylem.llm.components import components
from xylem.llm.shared import checkpointed, dropped, give_back
from xylem.llm.words import LOWER, U, mixed, slices, text_bytes, window_names, word_bounds, word_names

#: Counters of the table that orders n-grams: 2**BITS at least and 2**MOST_BITS at most; rows of a column that a block
#: holds, about; rows by which a part of a column meets the others.
BITS, MOST_BITS, COLUMN, BRIDGES = 18, 22, 20_000, 8
#: Counters that go together.
PIECE = 1 << 12
#: Bytes of text that are read at a time; shares in which a column's rows meet what its components tell.
PART, SALTS = 1 << 20, 32
#: Rows in a block of whole rows, about, where texts are short.
ROWS = 200
_SET, _CHECK = U(0xC2B2AE3D27D4EB4F), U(0x27D4EB2F165667C5)


def ngram_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """For each text, the sorted distinct names of its n-grams of lower-cased words; a shorter text has its whole sequence
    as one, and a text without words has none."""
    data, offsets = text_bytes(texts)
    data = LOWER[data]
    starts, ends, first = word_bounds(data, offsets)
    names = word_names(data, starts, ends)
    grams = window_names(names, n)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            x = np.sort(grams[a : b - n + 1])
            yield x[np.r_[True, x[1:] != x[:-1]]]
        elif b > a:
            yield window_names(names[a:b], b - a, seed=b - a)
        else:
            yield np.zeros(0, U)


def set_names(grams: np.ndarray) -> tuple[int, int]:
    """Two independent signed 64-bit names of a set."""
    if not len(grams):
        return 0, 0
    size = np.array([len(grams)], U)
    return tuple(int(mixed(mixed(grams ^ seed).sum(keepdims=True) + size * seed).astype(np.int64)[0]) for seed in (_SET, _CHECK))


def node_of(grams: np.ndarray, shared: frozenset[int]) -> int:
    """The number of a set: its first name, or both mixed where two sets share the first."""
    name, check = set_names(grams)
    return other_name(name, check) if name in shared else name


def other_name(name: int, check: int) -> int:
    return int(mixed(np.array([(name ^ check << 1) & (1 << 64) - 1], U)).astype(np.int64)[0])


def _slot(grams: np.ndarray, bits: int) -> np.ndarray:
    return (grams >> U(64 - bits)).astype(np.int64)


def _narrow(counts: np.ndarray) -> bytes:
    """Counts as the narrowest unsigned numbers that hold them; their width tells which."""
    return counts.astype(np.min_scalar_type(int(counts.max()))).tobytes()


def _summed(table: pa.Table) -> np.ndarray:
    total = np.zeros(PIECE, np.int64)
    for x in table.column("counts").to_pylist():
        total += np.frombuffer(x, f"u{len(x) // PIECE}").astype(np.int64)
    return total


def _added(table: pa.Table) -> pa.Table:
    return pa.table({"part": table.column("part")[:1], "counts": pa.array([_narrow(_summed(table))], pa.binary())})


def _ranked(table: pa.Table, most: int) -> pa.Table:
    """What the driver needs of a piece of the counters: ranks, the sum, and the counters above ``most`` with their counts."""
    total = _summed(table)
    rank = np.minimum(np.floor(4 * np.log2(total + 1)), 255).astype(np.uint8)
    at = np.flatnonzero(total > most)
    return pa.table({"part": table.column("part")[:1], "ranks": pa.array([rank.tobytes()], pa.binary()), "sum": pa.array([int(total.sum())]), "at": pa.array([at.astype(np.int32).tobytes()], pa.binary()), "often": pa.array([total[at].tobytes()], pa.binary())})


def frequency_table(texts: DataFrame, n: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """How many n-grams of the corpus fall on each of a fixed number of counters, as a rank from rare to frequent (log
    scale); and to how many parts a column of the counter is dealt. All rows count; the driver gets a byte for each counter
    and the counts of those above COLUMN, not all counts."""
    bits = int(np.clip((total >> 11).bit_length(), BITS, MOST_BITS))
    salts = max(1, total >> 31)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for piece in slices(batch, "text", PART):
                found = list(ngram_sets(piece.column("text"), n))
                if found:
                    np.add.at(total, _slot(np.concatenate(found), bits), 1)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total) // PIECE), pa.int32()), pa.array([_narrow(total[i : i + PIECE]) for i in range(0, len(total), PIECE)], pa.binary())], names=["part", "counts"])

    # in two steps, so that no group grows with the number of tasks
    summed = texts.select("text").mapInArrow(count, "part int, counts binary").withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts))).groupBy("part", "salt").applyInArrow(lambda t: _added(t), "part int, counts binary")
    rank, parts, often, whole, column = np.zeros(1 << bits, np.uint8), np.ones(1 << bits, np.uint16), [], 0, COLUMN
    for row in summed.groupBy("part").applyInArrow(lambda t: _ranked(t, column), "part int, ranks binary, sum long, at binary, often binary").collect():
        begin = row["part"] * PIECE
        rank[begin : begin + PIECE] = np.frombuffer(row["ranks"], np.uint8)
        often.append((begin + np.frombuffer(row["at"], np.int32), np.frombuffer(row["often"], np.int64)))
        whole += row["sum"]
    most = max(column, int(4 * (whole / len(rank))))
    for at, counts in often:
        parts[at] = np.clip(-(-counts // most), 1, 1 << 15)
    return rank, parts


def prefix_length(size: int, percent: int) -> int:
    return size - -(-percent * size // 100) + 1


def _incidence(texts: DataFrame, n: int, percent: int, tables, shared: frozenset[int], buckets: int) -> DataFrame:
    """Blocks of columns: for each slice of texts and bucket, the names of n-grams, and for each the row (a set) and how
    many n-grams the row has, and has from this one on. A slice names a set once, however many copies it holds."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, parts = tables.value
        bits = len(rank).bit_length() - 1
        for batch in batches:
            for piece in slices(batch, "text", 2 * PART):
                seen: set[int] = set()
                grams, owner, size, left = [], [], [], []
                for found in ngram_sets(piece.column("text"), n):
                    if not len(found) or (name := node_of(found, shared)) in seen:
                        continue
                    seen.add(name)
                    k = prefix_length(len(found), percent)
                    ranks = rank[_slot(found, bits)]
                    order = np.argsort(ranks, kind="stable")[:k]  # equally frequent ones by name
                    grams.append(found[order])
                    owner.append(np.full(k, name, np.int64))
                    size.append(np.full(k, len(found), np.int32))
                    left.append(len(found) - np.arange(k, dtype=np.int32))
                if not grams:
                    continue
                grams, owner, size, left = (np.concatenate(x) for x in (grams, owner, size, left))
                of = mixed(owner.astype(U)) % parts[_slot(grams, bits)].astype(U)
                bucket = (np.where(of > 0, mixed(grams + of), grams) % U(buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                grams, owner, size, left, bucket = (x[order] for x in (grams, owner, size, left, bucket))
                cuts = np.r_[0, np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, len(bucket)].tolist()
                spans = list(zip(cuts[:-1], cuts[1:], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]]), *(pa.array([x[a:b].tobytes() for a, b in spans], pa.binary()) for x in (grams, owner, size, left))], names=["bucket", "grams", "owner", "size", "left"])
        give_back()

    return texts.select("text").mapInArrow(rows, "bucket int, grams binary, owner binary, size binary, left binary")


def _ceil_overlap(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap of sets of these sizes with percent / 100 of similarity."""
    return -(-percent * (a.astype(np.int64) + b) // (100 + percent))


def _columns(table: pa.Table, parts: np.ndarray) -> tuple[np.ndarray, ...]:
    """A bucket's entries by column, size and row, each once, without whole columns of a single row; and which are of a
    column that is dealt to several buckets."""
    columns = [np.concatenate([np.frombuffer(x, kind) for x in table.column(c).to_pylist()]) for c, kind in (("grams", U), ("owner", np.int64), ("size", np.int32), ("left", np.int32))]
    order = np.argsort(columns[0], kind="stable")
    g = columns[0][order]
    same = g[1:] == g[:-1]
    dealt = parts[_slot(g, len(parts).bit_length() - 1)] > 1
    keep = np.r_[False, same] | np.r_[same, False] | dealt
    order, dealt = order[keep], dealt[keep]
    g, o, s, l = (x[order] for x in columns)
    order = np.lexsort((o, s, g))
    g, o, s, l, dealt = g[order], o[order], s[order], l[order], dealt[order]
    keep = np.r_[True, (g[1:] != g[:-1]) | (o[1:] != o[:-1])][: len(g)]
    return g[keep], o[keep], s[keep], l[keep], dealt[keep]


def _able(s, l, i, j, percent) -> np.ndarray:
    """Pairs of entries (i the smaller set) whose sizes and remainders allow the similarity."""
    return (100 * s[i].astype(np.int64) >= percent * s[j].astype(np.int64)) & (np.minimum(l[i], l[j]) >= _ceil_overlap(s[i], s[j], percent))


def _pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows and the number of columns that each was found in."""
    low, high = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((high, low))
    low, high = low[order], high[order]
    at = np.flatnonzero(np.r_[True, (low[1:] != low[:-1]) | (high[1:] != high[:-1])][: len(low)])
    return low[at], high[at], np.diff(np.r_[at, len(low)])


PRODUCT = "a long, b long, gram long, size int, left int, bridge boolean"


def _chain(g: np.ndarray, o: np.ndarray, s: np.ndarray, l: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of each row with the next of its column, if it can be similar to it."""
    i = np.flatnonzero(g[1:] == g[:-1])
    i = i[_able(s, l, i, i + 1, percent)]
    a, b, _ = _pairs(o[i], o[i + 1])
    return a, b


def _product(percent: int, tables):
    def multiply(table: pa.Table) -> pa.Table:
        """Pairs (a, b) of each row with the next of its column that it can be similar to; the entries (gram, a, size, left) of
        columns in which a row can be similar to one farther on; and, of columns dealt to several buckets, all entries, with
        a few of them as bridges to the other parts."""
        give_back()  # what the bucket before took
        g, o, s, l, dealt = _columns(table, tables.value[1])
        n = len(g)
        a, b = _chain(g, o, s, l, percent)
        column = np.cumsum(np.r_[True, g[1:] != g[:-1]][:n])
        key = (column << 32) + s
        most = np.minimum(100 * s.astype(np.int64) // percent, (100 + percent) * l.astype(np.int64) // percent - s)
        last = np.searchsorted(key, key - s + np.maximum(most, 0), "right")
        reach = np.flatnonzero(last > np.arange(n) + 2)
        need = np.zeros(n + 1, np.int64)
        need[reach] += 1
        np.add.at(need, last[reach], -1)
        at = np.flatnonzero((np.cumsum(need[:-1]) > 0) | dealt)
        begin = np.searchsorted(column, column, "left")
        size = np.searchsorted(column, column, "right") - begin
        place = np.arange(n) - begin
        step = np.maximum(1, size // BRIDGES)
        bridge = dealt & ((place % step == 0) | (place == size - 1))
        none, zero = pa.nulls(len(at), pa.int64()), pa.nulls(len(a), pa.int64())
        join = lambda x, y, kind: pa.concat_arrays([pa.array(x, kind), pa.array(y, kind)])
        return pa.table({"a": join(a, o[at], pa.int64()), "b": join(b, none, pa.int64()), "gram": join(zero, g[at].astype(np.int64), pa.int64()), "size": join(zero.cast(pa.int32()), s[at], pa.int32()), "left": join(zero.cast(pa.int32()), l[at], pa.int32()), "bridge": join(np.zeros(len(a), bool), bridge[at], pa.bool_())})

    return multiply


def _bridged(percent: int):
    def meet(table: pa.Table) -> pa.Table:
        """Pairs of the rows by which the parts of a column meet."""
        g, o, s, l = (table.column(c).to_numpy() for c in ("gram", "a", "size", "left"))
        order = np.lexsort((o, s, g))
        a, b = _chain(g[order], o[order], s[order], l[order], percent)
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    return meet


def _block(table: pa.Table) -> pa.Table:
    """A block of rows of the matrix as one row: names, components, sizes and all n-grams in a row."""
    owner, component, size = (table.column(c).to_numpy() for c in ("owner", "component", "size"))
    grams = b"".join(table.column("grams").to_pylist())
    return pa.table({"cluster": table.column("cluster")[:1], "band": table.column("band")[:1], "part": table.column("part")[:1], "least": [component.min()], "most": [component.max()], "rows": pa.array([np.r_[owner, component, size.astype(np.int64)].tobytes()], pa.binary()), "grams": pa.array([grams], pa.binary())}, schema=BLOCK_ARROW)


BLOCK = "cluster long, band int, part long, least long, most long, rows binary, grams binary"
BLOCK_ARROW = pa.schema([("cluster", pa.int64()), ("band", pa.int32()), ("part", pa.int64()), ("least", pa.int64()), ("most", pa.int64()), ("rows", pa.binary()), ("grams", pa.binary())])


def _block_links(rows_a: bytes, grams_a: bytes, rows_b: bytes, grams_b: bytes, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between rows of two blocks that lie in different components, as far as they join components that the links
    before them have not: a spanning forest of all such links. A row is multiplied with the other block's rows unless all
    of them are in its component by then."""
    sides = []
    for rows, grams in ((rows_a, grams_a), (rows_b, grams_b)):
        owner, component, size = np.frombuffer(rows, np.int64).reshape(3, -1)
        sides.append((owner, component, size, np.frombuffer(grams, U), np.r_[0, np.cumsum(size)]))
    names, counts = np.unique(np.concatenate([sides[0][1], sides[1][1]]), return_counts=True)
    where = [np.searchsorted(names, side[1]) for side in sides]
    root = np.arange(len(names))
    largest = counts.argmax()
    out_a, out_b = [], []
    for i_side, j_side in ((0, 1), (1, 0)):
        owner, _, size, grams, begin = sides[i_side]
        other, _, sizes, all_grams, starts = sides[j_side]
        for i in np.flatnonzero(where[i_side] != largest).tolist():
            apart = root[where[j_side]] != root[where[i_side][i]]
            if not apart.any():
                continue
            both = np.add.reduceat(blocks.member(all_grams, grams[begin[i] : begin[i + 1]]), starts[:-1], dtype=np.int64)
            for j in np.flatnonzero(apart & (100 * both >= percent * (size[i] + sizes - both))).tolist():
                x, y = root[where[i_side][i]], root[where[j_side][j]]
                if x != y:
                    root[root == max(x, y)] = min(x, y)
                    out_a.append(int(owner[i]))
                    out_b.append(int(other[j]))
    return np.array(out_a, np.int64), np.array(out_b, np.int64)


def spread(keys: DataFrame) -> DataFrame:
    """keys once for each salt, for a join by key and salt. Spark takes these rows for as many as keys has, so it is kept from
    sending them to the driver and from there to all executors."""
    return keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")


def _dealt(open_rows: DataFrame, percent: int, most: int) -> DataFrame:
    """open_rows with band, a class of size, and part: blocks of about ``most`` n-grams, or ROWS rows of short texts. A component of that many n-grams has
    blocks of its own, so that pairs of its blocks need no product; smaller ones share blocks, each whole in one."""
    band = F.floor(F.log(F.col("size").cast("double")) / float(np.log(100 / percent) * 1.001)).cast("int")
    rows = open_rows.withColumn("band", band).withColumn("salt", F.pmod(F.xxhash64("owner"), F.lit(SALTS)).cast("int"))
    grams = rows.groupBy("cluster", "band", "component").agg(F.sum(F.greatest("size", F.lit(most // ROWS))).alias("grams"))
    shared = grams.where(F.col("grams") < most).groupBy("cluster", "band").agg(F.ceil(F.sum("grams") / most).cast("long").alias("parts"))
    # a component of many rows is dealt out by its rows as well
    known = grams.join(shared, ["cluster", "band"], "left")
    own = F.xxhash64("component", F.pmod(F.xxhash64("owner"), F.ceil(F.col("grams") / most).cast("long")))
    part = F.when(F.col("grams") >= most, own).otherwise(F.pmod(F.xxhash64("component"), F.col("parts")))
    return rows.join(spread(known), ["cluster", "band", "component", "salt"]).select("cluster", "band", part.alias("part"), "owner", "component", "size")


def _open_links(open_rows: DataFrame, texts: DataFrame, sets: DataFrame, n: int, percent: int, most: int = 50_000) -> DataFrame:
    """All links between components that open_rows (cluster, owner, component, size) leave possible. A cluster's rows are
    dealt to blocks; blocks of one class of size or of neighbours that hold several components are multiplied."""
    held = checkpointed(_dealt(open_rows, percent, most).join(sets.select(F.col("node").alias("owner"), "place"), "owner"))
    columns = ("cluster", "band", "part", "owner", "component", "size")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", PART):
                grams = pa.array([x.tobytes() for x in ngram_sets(part.column("text"), n)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), grams], names=[*columns, "grams"])
        give_back()

    filled = held.join(blocks.among(texts, held.select("place"), "place"), "place").select(*columns, "text").mapInArrow(fill, "cluster long, band int, part long, owner long, component long, size int, grams binary")
    made = checkpointed(filled.groupBy("cluster", "band", "part").applyInArrow(_block, BLOCK))
    dropped(held)
    light = made.select("cluster", "band", "part", "least", "most")
    a, b = light.alias("a"), light.alias("b")
    later = ((F.col("a.band") == F.col("b.band")) & (F.col("a.part") <= F.col("b.part"))) | (F.col("a.band") + 1 == F.col("b.band"))
    mixed_up = (F.col("a.least") != F.col("a.most")) | (F.col("b.least") != F.col("b.most")) | (F.col("a.least") != F.col("b.least"))
    matched = a.join(b, (F.col("a.cluster") == F.col("b.cluster")) & later & mixed_up).select("a.cluster", F.col("a.band").alias("band_a"), F.col("a.part").alias("part_a"), F.col("b.band").alias("band_b"), F.col("b.part").alias("part_b"))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("rows_a", "grams_a", "rows_b", "grams_b")), strict=True):
                x, y = _block_links(*row, percent)
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])
        give_back()

    side = lambda x: made.select("cluster", F.col("band").alias(f"band_{x}"), F.col("part").alias(f"part_{x}"), F.col("rows").alias(f"rows_{x}"), F.col("grams").alias(f"grams_{x}"))
    # keyed by block, so that the blocks of a large cluster spread over tasks
    pairs = matched.join(side("a"), ["cluster", "band_a", "part_a"]).join(side("b"), ["cluster", "band_b", "part_b"])
    return pairs.mapInArrow(multiply, "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame, sets: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) of sets whose whole texts have the similarity. sets: (node, place) of one row of texts for each. Only
    texts of sets that some pair has are exchanged."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text_b", PART):
                keep, last, left = np.zeros(part.num_rows, bool), None, None
                a = part.column("a").to_numpy()
                for i, y in enumerate(ngram_sets(part.column("text_b"), n)):
                    if last is None or a[i] != last:
                        last, left = a[i], next(ngram_sets(part.column("text_a").slice(i, 1), n))
                    both = int(blocks.member(y, left).sum())
                    keep[i] = 100 * both >= percent * (len(left) + len(y) - both)
                yield pa.RecordBatch.from_arrays([x.filter(pa.array(keep)) for x in (part.column("a"), part.column("b"))], names=["a", "b"])
        give_back()

    side = lambda x: sets.select(F.col("node").alias(x), F.col("place").alias(f"place_{x}"))
    held = checkpointed(pairs.join(side("a"), "a").join(side("b"), "b"))
    some = blocks.among(texts, held.select(F.col("place_a").alias("place")).union(held.select("place_b")).distinct(), "place")
    text = lambda x: some.select(F.col("place").alias(f"place_{x}"), F.col("text").alias(f"text_{x}"))
    met = held.join(text("a"), "place_a").join(text("b"), "place_b")
    links = checkpointed(met.select("a", "b", "text_a", "text_b").mapInArrow(compare, "a long, b long"))
    dropped(held)
    return links


def jaccard_join(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """Links rows of docs (doc_id, text) whose sets of distinct word n-grams have a Jaccard similarity of percent / 100 or more.

    Returns for each row doc_id, n_shingles (the size of its set) and component_id (the smallest doc_id reachable by links,
    its own included). Words are lower-cased in A-Z; a text of fewer words is its whole sequence as one n-gram; null and
    empty texts and those without words have the empty set and link with nothing; very long texts are rows like others.
    Equal sets are one row of the matrix, told apart by 128 bits; repeated rows link with each other; rows without an id
    keep a null component and link nothing; other columns of docs are ignored. An empty table gives an empty result. docs
    is read more than once and has to give the same rows each time, as a table does."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("place", F.monotonically_increasing_id())
    total = blocks.text_size(texts)
    buckets = blocks.counts(total)[1]

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", PART):
                found = [(len(x), *set_names(x)) for x in ngram_sets(part.column("text"), n)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("place"), *(pa.array([x[i] for x in found], pa.int64()) for i in range(3))], names=["doc_id", "place", "n_shingles", "name", "check"])
        give_back()

    kinds = [docs.schema["doc_id"].dataType, *[T.LongType()] * 4]
    named = checkpointed(texts.mapInArrow(name, T.StructType([T.StructField(x, t) for x, t in zip(("doc_id", "place", "n_shingles", "name", "check"), kinds, strict=True)])))
    held = named.where("n_shingles > 0 and doc_id is not null").groupBy("name", "check").agg(F.min(F.struct("doc_id", "place")).alias("least"))
    sets = checkpointed(held.select("name", "check", F.col("least.doc_id").alias("doc_id"), F.col("least.place").alias("place")))
    # sets that share a name, of 2**64, are told apart by the other; there are hardly ever any
    shared = frozenset(r["name"] for r in sets.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").limit(1_000_001).collect())
    if len(shared) > 1_000_000:
        raise ValueError("more sets than names of 64 bits can tell apart")
    if shared:
        numbers = F.udf(lambda a, b: other_name(a, b) if a in shared else a, "long")
        sets = checkpointed(sets.withColumn("node", numbers("name", "check")))
    else:
        sets = sets.withColumn("node", F.col("name"))
    tables = texts.sparkSession.sparkContext.broadcast(frequency_table(texts, n, total))
    entries = _incidence(texts.where("doc_id is not null"), n, percent, tables, shared, buckets)
    product = checkpointed(entries.groupBy("bucket").applyInArrow(_product(percent, tables), PRODUCT))
    tables.unpersist()  # the product is written
    bridges = product.where("bridge").withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(buckets))).groupBy("bucket").applyInArrow(_bridged(percent), "a long, b long")
    links = _verified(product.where("b is not null").select("a", "b").union(bridges).distinct(), texts, sets, n, percent)
    first = components(links)
    # what may still link: rows of columns that hold several components, clustered over these columns
    entry = product.where("gram is not null").select("gram", F.col("a").alias("owner"), "size").join(first.withColumnRenamed("node", "owner"), "owner", "left")
    entry = entry.withColumn("component", F.coalesce("component", "owner"))
    mixed_columns = entry.groupBy("gram").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most").select("gram", F.col("least").alias("hub"))
    # a column of many rows is dealt out by its rows as well
    open_rows = checkpointed(entry.withColumn("salt", F.pmod(F.xxhash64("owner"), F.lit(SALTS)).cast("int")).join(spread(mixed_columns), ["gram", "salt"]).select("owner", "component", "size", "hub").distinct())
    dropped(product)
    groups = first
    if open_rows.limit(1).count():
        clusters = components(open_rows.select(F.col("component").alias("a"), F.col("hub").alias("b")))
        clustered = checkpointed(open_rows.select("owner", "component", "size").distinct().join(clusters.select(F.col("node").alias("component"), F.col("component").alias("cluster")), "component"))
        more = checkpointed(_open_links(clustered, texts, sets, n, percent))
        groups = components(first.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
        dropped(clustered, more)
    dropped(open_rows)
    member = sets.join(groups, "node", "left").select("name", "check", "doc_id", F.coalesce("component", "node").alias("group"))
    smallest = member.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    classes = member.join(smallest, "group").select("name", "check", "component_id")
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return named.join(classes, ["name", "check"], "left").select("doc_id", "n_shingles", own.alias("component_id"))

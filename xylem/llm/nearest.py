"""Approximate nearest neighbours by a forest of random-projection trees.

A tree splits at each level along one random direction (a tree's directions are
orthonormal) at the median of the node's sampled vectors, so the squared margins
that lead to a leaf add up to a lower bound of the squared distance to it. A
query puts the leaves of all trees in one priority queue by that bound and takes
the nearest until they hold its share of candidates. Cells are dealt to shards;
in a shard, each cell's vectors meet the queries that took the cell, and the best
are ranked again by their exact cosine. Equal vectors are indexed once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from xylem.llm.shared import checkpointed

#: Trees; vectors that the splits are fitted on, at most; levels of a tree, at most; share of all vectors that a query
#: may look at (with repeats over trees), the same at every size; cosines that differ by less are compared exactly.
TREES, SAMPLE, LEVELS, SHARE, CLOSE = 6, 16_384, 12, 0.55, 1e-9
#: Vectors in a shard and queries in a block.
SHARD, QUERIES = 40_000, 20_000


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), dimension)


def _unit(x: np.ndarray) -> np.ndarray:
    # scaled first, so that squares neither overflow nor vanish
    x = x / np.abs(x).max(1, keepdims=True, initial=1e-300)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@dataclass
class Forest:
    directions: np.ndarray  # tree, dimension, level
    splits: list[list[np.ndarray]]  # tree, level: by node

    @classmethod
    def fit(cls, sample: np.ndarray, trees: int, levels: int, seed: int = 7) -> Forest:
        rng = np.random.default_rng(seed)
        dimension = sample.shape[1]
        directions, splits = [], []
        for _ in range(trees):
            basis = np.linalg.qr(rng.normal(size=(dimension, dimension)))[0]
            own = basis[:, np.arange(levels) % dimension]
            at, node, cuts = sample @ own, np.zeros(len(sample), np.int64), []
            for level in range(levels):
                order = np.lexsort((at[:, level], node))
                size = np.bincount(node, minlength=1 << level)
                middle = np.cumsum(size) - size + size // 2
                cut = np.where(size > 0, at[order, level][np.minimum(middle, len(sample) - 1)], 0.0)
                cuts.append(cut)
                node = 2 * node + (at[:, level] > cut[node])
            directions.append(own)
            splits.append(cuts)
        return cls(np.stack(directions), splits)

    @property
    def levels(self) -> int:
        return len(self.splits[0])

    def cells(self, x: np.ndarray) -> np.ndarray:
        """For each vector, its cell in each tree."""
        out = []
        for t, cuts in enumerate(self.splits):
            at, node = x @ self.directions[t], np.zeros(len(x), np.int64)
            for level, cut in enumerate(cuts):
                node = 2 * node + (at[:, level] > cut[node])
            out.append(node + (t << self.levels))
        return np.stack(out, 1)

    def bounds(self, x: np.ndarray) -> np.ndarray:
        """For each vector and cell of all trees, the bound of their squared distance."""
        out = []
        for t, cuts in enumerate(self.splits):
            at, total = x @ self.directions[t], np.zeros((len(x), 1))
            for level, cut in enumerate(cuts):
                margin = at[:, level : level + 1] - cut
                square = margin * margin
                total = np.stack([total + np.where(margin > 0, square, 0), total + np.where(margin > 0, 0, square)], 2).reshape(len(x), -1)
            out.append(total)
        return np.concatenate(out, 1)


def _largest(near: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each row's ``keep`` largest numbers, and of those that are as large but for rounding."""
    if near.shape[1] <= keep:
        return tuple(x.ravel() for x in np.indices(near.shape))
    limit = np.partition(near, near.shape[1] - keep, 1)[:, near.shape[1] - keep]
    return np.nonzero(near >= limit[:, None] - CLOSE)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, trees: int = TREES, share: float = SHARE, seed: int = 7) -> DataFrame:
    """The k nearest found of vectors (vec_id, embedding), by cosine in double precision, for each row of queries (the same
    columns), its own vec_id left out.

    Returns query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id, and a query with fewer candidates gets
    all. Vectors that are null, zero, hold a null or non-finite component, or differ from the most frequent dimension take
    no part, neither do null ids; repeated rows of an id and vector are one; other columns are ignored; without vectors or
    queries the result is empty. Splits are fitted on ``SAMPLE`` vectors at most; every vector is indexed."""
    valid = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.where(valid).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    sizes = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    out = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return vectors.sparkSession.createDataFrame([], out)
    dimension = sizes[0]["d"]
    rows = rows.where(F.size("embedding") == dimension).distinct()
    # only a vector's k + 1 smallest ids can be among the k nearest of a query
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    distinct = checkpointed(first.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    count = distinct.count()
    # the vectors with the smallest hashes; what is far from them doesn't travel
    hashed = distinct.select("embedding", F.xxhash64("embedding").alias("hash"))
    if count > 2 * SAMPLE:
        hashed = hashed.where(F.col("hash") < int(-(2**63) + 2**64 * (1.2 * SAMPLE / count)))
    sample = hashed.orderBy("hash").limit(SAMPLE).select("embedding").toArrow().column("embedding").combine_chunks()
    levels = int(np.clip(np.log2(max(2, count) / 6), 1, LEVELS))
    forest = vectors.sparkSession.sparkContext.broadcast(Forest.fit(_unit(_matrix(sample, dimension)), trees, levels, seed))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells = forest.value.cells(_unit(_matrix(batch.column("embedding"), dimension)))
                yield pa.RecordBatch.from_arrays([batch.column("embedding"), batch.column("ids"), pa.array(list(cells.astype(np.int32)), pa.list_(pa.int32()))], names=["embedding", "ids", "cells"])

    indexed = checkpointed(distinct.mapInArrow(place, "embedding array<double>, ids array<long>, cells array<int>"))
    held = np.zeros(trees << levels, np.int64)
    for r in indexed.select(F.explode("cells").alias("cell")).groupBy("cell").count().collect():
        held[r["cell"]] = r["count"]
    shards = max(8, count * trees // SHARD)
    asked = queries.where(valid).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(F.size("embedding") == dimension).distinct()
    parts = max(1, -(-asked.count() // QUERIES))
    budget = share * count

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                bounds = forest.value.bounds(_unit(_matrix(part.column("embedding"), dimension)))
                queue = np.argsort(bounds, 1, kind="stable")
                total = np.cumsum(held[queue], 1)
                taken = np.r_["1", np.ones((len(queue), 1), bool), total[:, :-1] < budget] & (held[queue] > 0)
                row, cell = np.nonzero(taken)[0], queue[taken]
                shard = cell % shards
                order = np.lexsort((cell, shard, row))
                row, cell, shard = row[order], cell[order], shard[order]
                cuts = np.r_[0, np.flatnonzero((row[1:] != row[:-1]) | (shard[1:] != shard[:-1])) + 1, len(row)]
                source = pa.array(row[cuts[:-1]])
                yield pa.RecordBatch.from_arrays([pa.array(shard[cuts[:-1]], pa.int32()), part.column("vec_id").take(source), part.column("embedding").take(source), pa.array([cell[a:b].astype("<i4").tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], names=["shard", "query_id", "embedding", "cells"])

    def search(asks: pa.Table, index: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int64())), "score": pa.array([], pa.float64())})
        if not asks.num_rows or not index.num_rows:
            return empty
        original_q, original_x = (_matrix(t.column("embedding").combine_chunks(), dimension) for t in (asks, index))
        q, x = _unit(original_q), _unit(original_x)
        cell = index.column("cell").to_numpy()
        by_cell = np.argsort(cell, kind="stable")
        begin = np.flatnonzero(np.r_[True, np.diff(cell[by_cell]) != 0])
        wanted = [np.frombuffer(c, "<i4") for c in asks.column("cells").to_pylist()]
        who = np.repeat(np.arange(len(wanted)), [len(c) for c in wanted])
        what = np.concatenate(wanted)
        by_what = np.argsort(what, kind="stable")
        found: list[tuple[np.ndarray, ...]] = []
        keep = k + 1
        what, who = what[by_what], who[by_what]
        for some in np.split(by_cell, begin[1:]):
            c = cell[some[0]]
            ask = who[np.searchsorted(what, c, "left") : np.searchsorted(what, c, "right")]
            if not len(ask):
                continue
            near = q[ask] @ x[some].T
            row, best = _largest(near, keep)
            found.append((ask[row], some[best], near[row, best]))
        if not found:
            return empty
        ask, some, near = (np.concatenate(f) for f in zip(*found, strict=True))
        # a vector that comes from several trees' cells counts once
        vector = pc.list_element(index.column("ids"), 0).to_numpy()[some]
        order = np.lexsort((vector, ask))
        first = np.r_[True, (ask[order][1:] != ask[order][:-1]) | (vector[order][1:] != vector[order][:-1])]
        ask, some, near = (x[order[first]] for x in (ask, some, near))
        # all that may be among the nearest by their rounded cosines are ranked by the exact ones, ties by id
        order = np.lexsort((-near, ask))
        ask, some, near = ask[order], some[order], near[order]
        begin = np.searchsorted(ask, ask)
        limit = near[np.minimum(begin + keep - 1, np.searchsorted(ask, ask, "right") - 1)]
        ask, some = ask[near >= limit - CLOSE], some[near >= limit - CLOSE]
        scores = np.array([cosine(original_q[i], original_x[j]) for i, j in zip(ask.tolist(), some.tolist(), strict=True)])
        order = np.lexsort((pc.list_element(index.column("ids"), 0).to_numpy()[some], -scores, ask))
        ask, some, scores = ask[order], some[order], scores[order]
        at = np.arange(len(ask)) - np.searchsorted(ask, ask) < keep
        ask, some, scores = ask[at], some[at], scores[at]
        return pa.table({"query_id": asks.column("query_id").take(pa.array(ask)), "ids": index.column("ids").take(pa.array(some)), "score": pa.array(scores, pa.float64())})

    index = indexed.select("embedding", "ids", F.explode("cells").alias("cell")).withColumn("shard", F.pmod("cell", F.lit(shards)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    asks = asked.mapInArrow(probe, "shard int, query_id long, embedding array<double>, cells binary").withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int"))
    hits = asks.groupBy("shard", "part").cogroup(index.groupBy("shard", "part")).applyInArrow(search, "query_id long, ids array<long>, score double")
    single = hits.select("query_id", F.explode("ids").alias("vec_id"), "score").where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = single.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    """The cosine of two vectors in double precision; the same for a pair wherever it is computed."""
    return float(a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)))

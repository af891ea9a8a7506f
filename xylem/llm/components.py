"""Connected components of a graph of links, without gathering it anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xylem.llm.shared import checkpointed, dropped
from xylem.llm.words import U, mixed

#: Links that a bucket holds, about.
BUCKET = 250_000
PACKED = "bucket int, a binary, b binary, changed long"
PACKED_ARROW = pa.schema([("bucket", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("changed", pa.int64())])


def _packed(a: np.ndarray, b: np.ndarray, changed: int, buckets: int) -> pa.Table:
    """Distinct links as arrays, a row for each bucket of a; the first row tells how many links have changed."""
    bucket = (mixed(a.astype(U)) % U(buckets)).astype(np.int32)
    order = np.lexsort((b, a, bucket))
    a, b, bucket = a[order], b[order], bucket[order]
    keep = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(a)]
    a, b, bucket = a[keep], b[keep], bucket[keep]
    begin = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]][: len(a)])
    spans = list(zip(begin.tolist(), [*begin[1:].tolist(), len(a)], strict=False))
    cut = lambda x: pa.array([x[i:j].tobytes() for i, j in spans], pa.binary())
    return pa.table([pa.array(bucket[begin], pa.int32()), cut(a), cut(b), pa.array([changed, *[0] * len(spans)][: len(spans)], pa.int64())], schema=PACKED_ARROW)


def _links(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A bucket's distinct links by a and b, where each a begins, and how many links it has."""
    a, b = (np.frombuffer(b"".join(table.column(c).to_pylist()), np.int64) for c in ("a", "b"))
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    keep = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(a)]
    a, b = a[keep], b[keep]
    begin = np.flatnonzero(np.r_[True, a[1:] != a[:-1]][: len(a)])
    return a, b, begin, np.diff(np.r_[begin, len(a)])


def _small_star(table: pa.Table, buckets: int) -> pa.Table:
    """Links each node, and its smaller neighbours b, to the least of them. Returns links in both directions."""
    a, b, begin, count = _links(table)
    least = np.repeat(b[begin], count)
    rest = np.ones(len(a), bool)
    rest[begin] = False
    x, y = np.r_[a[begin], b[rest]], np.r_[b[begin], least[rest]]
    return _packed(np.r_[x, y], np.r_[y, x], int(rest.sum()), buckets)


def _large_star(table: pa.Table, buckets: int) -> pa.Table:
    """Links each larger neighbour of a node to the least of the node and its neighbours. Returns links to smaller nodes."""
    a, b, begin, count = _links(table)
    least = np.repeat(np.minimum(a[begin], b[begin]), count)
    larger = b > a
    changed = int((least[larger] != a[larger]).sum()) + sum(table.column("changed").to_pylist())
    if changed and not larger.any():  # the number goes on without links
        return pa.table([pa.array([int(table.column("bucket")[0].as_py())], pa.int32()), *(pa.array([b""], pa.binary()) for _ in range(2)), pa.array([changed], pa.int64())], schema=PACKED_ARROW)
    return _packed(b[larger], least[larger], changed, buckets)


def components(links: DataFrame) -> DataFrame:
    """(node, component): for each node of links (a, b), longs, the smallest node that links reach from it. links is read twice.

    Small and large stars in turn, until every node but the smallest of its component has one link, to that one; rounds
    grow with the logarithm of a component's diameter. Links travel as arrays, a row for each pair of buckets, so that a
    round is one plan of two exchanges without a join: driver and tasks hold little besides. A hub's links meet in one
    task, as an array of 16 bytes a link. Null nodes and self-links are ignored."""
    buckets = max(32, -(-links.count() // BUCKET))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            yield from _packed(np.maximum(a, b), np.minimum(a, b), 0, buckets).to_batches()

    edges = checkpointed(links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").mapInArrow(pack, PACKED))
    while True:
        turned = edges.groupBy("bucket").applyInArrow(lambda t: _small_star(t, buckets), PACKED)
        new = checkpointed(turned.groupBy("bucket").applyInArrow(lambda t: _large_star(t, buckets), PACKED))
        dropped(edges)
        edges = new
        if not edges.agg(F.sum("changed").alias("n")).first()["n"]:
            break

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, np.int64)) for x in (a, b)], names=["node", "component"])

    stars = edges.mapInArrow(unpack, "node long, component long")
    found = checkpointed(stars.union(stars.select(F.col("component").alias("node"), "component").distinct()))
    dropped(edges)
    return found

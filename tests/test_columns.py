"""Binding by columns against binding by events."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from xylem.operators import bind
from xylem.operators import events as ev
from xylem.operators.bind import _REFUSED, _bound, _fields, _in_columns
from xylem.operators.events import Maker, tokens_of
from xylem.operators.scanner import scan
from xylem.operators.schema import XmlSchema, attr, elem, value
from xylem.options import XmlOptions

INNER = T.StructType([attr("n", T.IntegerType()), elem("part", T.LongType()), elem("qty", T.IntegerType(), default=7), elem("tag", T.ArrayType(T.StringType())), elem("when", T.DateType()), elem("b", T.BinaryType())])
SCHEMAS = [
    XmlSchema("order", T.StructType([attr("id", T.LongType()), elem("line", T.ArrayType(INNER)), elem("one", INNER), elem("x", T.DecimalType(10, 2)), T.StructField("free", T.StringType())])),
    XmlSchema("order", T.StructType([attr("id"), value("v"), elem("line", INNER, ns="urn:a"), elem("k", T.ArrayType(T.IntegerType()), nillable=True)]), ns="urn:a"),
    XmlSchema("order", T.StructType([value("v", T.IntegerType())])),
]
XSI = ' xsi:nil="true" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance"'


def piece(r: random.Random, depth: int) -> str:
    k = r.choice(["line", "one", "x", "part", "qty", "tag", "when", "b", "k", "odd", "p:line", "text", "amp"] if depth < 4 else ["text"])
    if k in ("text", "amp"):
        return r.choice(["", "1", " 2 ", "z", "é", "9999999999"] if k == "text" else ["&amp;", "&#49;"])
    simple = {"part": ["1", " +3 ", ""], "qty": ["2", ""], "x": ["1.5", "1e9"], "k": ["1"], "tag": ["a", "", "&lt;b"], "when": ["2020-01-02"]}
    if k in simple and r.random() < 0.8:
        return f"<{k}>{r.choice(simple[k])}</{k}>"
    at = r.choice(["", "", ' n="3"', " n='x'", ' p:n="1"', ' xmlns="urn:a"', ' xmlns:p="urn:a"', XSI])
    return f"<{k}{at}/>" if r.random() < 0.15 else f"<{k}{at}>" + "".join(piece(r, depth + 1) for _ in range(r.randint(0, 3))) + f"</{k}>"


@pytest.mark.parametrize("schema", SCHEMAS)
def test_columns_bind_as_events_do(schema):
    r, options = random.Random(5), XmlOptions()
    roots = ["", ' id="5"', ' xmlns="urn:a"', ' xmlns:p="urn:a"', ' xmlns="urn:a" xmlns:p="urn:a" id="7"']
    docs = [f"<order{r.choice(roots)}>" + "".join(piece(r, 1) for _ in range(r.randint(0, 4))) + "</order>" for _ in range(1500)] + ["<other/>", "<order", "<order>1</order>"]
    column, one, found = pa.array([d.encode() for d in docs], pa.binary()), _bound(schema), []
    for plain in (None, _in_columns(schema)):
        maker = Maker(_fields(schema), lambda data: one(scan(data, options)), plain, _REFUSED, options)
        found.append({i: row for at, columns in maker.batches(column) for i, *row in zip(at.tolist(), *(c.to_pylist() for c in columns), strict=True)})
    assert found[0] == found[1] and len(found[0]) == len(docs)
    accepted = sum(row[1] for row in found[0].values())
    assert len(_in_columns(schema)(tokens_of(column, options))[0]) > 0.7 * accepted


@pytest.mark.parametrize("schema", SCHEMAS[:2])
@pytest.mark.parametrize("of_nodes", [False, True])
def test_rows_bind_by_columns_as_one_by_one(spark, monkeypatch, schema, of_nodes):
    """Relations of events and nodes, whole and broken ones, a few rows of a document in a batch."""
    r = random.Random(6)
    docs = [(i, f"<order{r.choice(['', ' id=\"5\"', ' xmlns=\"urn:a\"'])}>" + "".join(piece(r, 1) for _ in range(r.randint(0, 4))) + "</order>") for i in range(600)]
    rows = ev.xml_events(spark.createDataFrame(docs, "doc_id long, content string"))
    part = F.pmod(F.xxhash64("doc_id", "seq"), F.lit(40))
    broken = rows.where(part != 0).withColumn("text", F.when(part != 1, F.col("text"))).withColumn("name", F.when(part != 2, F.col("name")))
    rows = rows.unionByName(broken.withColumn("doc_id", F.col("doc_id") + 1000))
    bind_rows = bind.unmarshal_events
    if of_nodes:
        rows, bind_rows = ev.xml_nodes(rows), bind.unmarshal_nodes
        astray = (F.pmod(F.xxhash64("doc_id", "node_id"), F.lit(50)) == 0) & (F.col("doc_id") % 2 == 0)
        rows = rows.withColumn("parent_id", F.when(astray, F.col("parent_id") - 1).otherwise(F.col("parent_id")))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        by_columns = {x.doc_id: str(x) for x in bind_rows(rows, schema).collect()}
        monkeypatch.setattr(bind._Columns, "able", staticmethod(lambda _: False))
        assert by_columns == {x.doc_id: str(x) for x in bind_rows(rows, schema).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sum("ok=True" in x for x in by_columns.values()) > 100


def test_rows_of_a_document_are_not_read_one_by_one(spark, monkeypatch):
    """The query's documents are all bound by columns: reading them one by one would fail."""
    monkeypatch.setattr(bind, "_events_of", lambda _: 1 / 0)
    from xylem.plans import queries

    for name in ("unmarshal_from_events", "unmarshal_from_nodes"):
        assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").count() == 6000

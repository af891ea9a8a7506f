import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from xylem.functions import guards
from xylem.operators import events as ev
from xylem.operators import records
from xylem.operators.bind import unmarshal
from xylem.operators.marshal import marshal, marshal_binary, marshal_events
from xylem.operators.schema import XmlContext, XmlSchema, attr, elem, value
from xylem.options import XmlOptions
from xylem.sources import files
from xylem.streaming import streams


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, content string")


def test_null_and_empty_documents(spark):
    df = docs(spark, None, "", "<a/>")
    assert {r.doc_id: r.ok for r in ev.xml_status(df).collect()} == {1: False, 2: True}
    assert ev.xml_events(df.where("false")).count() == 0


def test_modes(spark):
    df = docs(spark, "<a", "<Document><CstmrCdtTrfInitn/></Document>")
    assert records.payments(df).count() == 2
    assert records.payments(df, XmlOptions(mode="dropmalformed")).count() == 1
    with pytest.raises(Exception, match="Malformed"):
        records.payments(df, XmlOptions(mode="failfast")).collect()


def test_a_narrow_scan_reads_two_columns(spark):
    plan = ev.xml_events(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"), columns=["event"], key="page_id", content="html")._jdf.queryExecution().toString()
    assert "ReadSchema: struct<page_id:bigint,html:string>" in plan


def test_profiles_agree(spark):
    pain = '<Document xmlns="urn:iso:std:iso:20022:tech:xsd:pain.001.001.09"><CstmrCdtTrfInitn><GrpHdr><MsgId>M</MsgId><NbOfTxs>2</NbOfTxs></GrpHdr></CstmrCdtTrfInitn></Document>'
    df = docs(spark, pain)
    auto, fixed = records.inspect(df).collect(), records.inspect(df, XmlOptions(profile="payments")).collect()
    assert auto == fixed
    assert records.inspect(df, XmlOptions(profile="none")).first().error == "No profile"


def test_healthcare_with_xcpd_payload(spark):
    text = '<e:Envelope xmlns:e="http://www.w3.org/2003/05/soap-envelope" xmlns:h="urn:hl7-org:v3"><e:Header><a:Action xmlns:a="urn:a"> x </a:Action></e:Header><e:Body><h:PRPA_IN201305UV02/></e:Body></e:Envelope>'
    row = records.healthcare(docs(spark, text)).first()
    assert (row.soap_version, row.protocol, row.action, row.payload_name) == ("SOAP_1_2", "HL7_V3", " x ", "h:PRPA_IN201305UV02")
    assert records.healthcare(docs(spark, text), trimmed=True).first().action == "x"


def test_binding_errors(spark):
    schema = XmlSchema("r", T.StructType([attr("n", T.IntegerType()), elem("x", T.IntegerType()), value("t")]))
    found = unmarshal(docs(spark, "<r n='1'>a<x>2</x></r>", "<q/>", "<r n='x'/>", "<r><x><y/></x></r>", "<z:r/>", "<r><x>99999999999</x></r>"), schema).orderBy("doc_id").collect()
    assert [r.ok for r in found] == [True, False, False, False, False, False]
    assert (found[0].value.n, found[0].value.x, found[0].value.t) == (1, 2, "a")
    assert found[1].error == "Expected root <r>"


def test_context_and_schema_checks():
    schema = XmlSchema("r", T.StructType([elem("x")]))
    with pytest.raises(ValueError, match="twice"):
        XmlContext(schema, schema)
    with pytest.raises(KeyError):
        XmlContext(schema).require("", "q")
    with pytest.raises(TypeError):
        XmlSchema("r", T.StructType([elem("x", T.CalendarIntervalType())]))


def test_marshalling(spark):
    schema = XmlSchema("r", T.StructType([elem("d", T.ArrayType(T.DoubleType()))]))
    df = spark.sql("SELECT 1L AS doc_id, named_struct('d', array(double('NaN'), double('Infinity'), -1.5D)) AS v")
    assert df.select(marshal(F.col("v"), schema, fragment=True)).first()[0] == "<r><d>NaN</d><d>INF</d><d>-1.5</d></r>"
    assert bytes(df.select(marshal_binary(F.col("v"), schema)).first()[0]).startswith(b"<?xml")
    assert marshal_events(df, "v", schema).where("event = 'TEXT'").count() == 3
    with pytest.raises(ValueError):
        marshal(F.col("v"), schema, formatted=True)


def test_guards(spark):
    row = spark.sql("SELECT '﻿<a b=\"1\"/>' AS t, encode('abc', 'UTF-8') AS c").select(guards.strip_bom(F.col("t")).alias("t"), guards.bounded(F.col("c"), 2).alias("c"), guards.fnv1a(F.lit("a")).alias("f"), guards.xml_declaration_ok(F.lit('<?xml version="1.0" encoding="utf-8"?><a/>')).alias("d"), guards.xml_declaration_ok(F.lit('<?xml version="2.0"?><a/>')).alias("e"), guards.local_name(F.lit("a:b:c")).alias("l"), guards.local_name(F.lit("a:b:c"), last=False).alias("m"), guards.prefix_of(F.lit("a:b")).alias("p")).first()
    assert (row.t, bytes(row.c), row.f, row.d, row.e, row.l, row.m, row.p) == ('<a b="1"/>', b"ab", 0xE40C292C, True, False, "c", "b:c", "a")


def test_files_and_registration(spark, tmp_path):
    (tmp_path / "a.xml").write_bytes(b"<a>1</a>")
    (tmp_path / "b.xml").write_bytes(b"<a>")
    found = files.read_documents(spark, str(tmp_path), glob="*.xml")
    assert sorted(r.ok for r in ev.xml_status(found).collect()) == [False, True]
    assert files.read_text_documents(spark, str(tmp_path)).count() == 2
    stream = files.stream_documents(spark, str(tmp_path), glob="*.xml", per_trigger=1)
    streams.run_available(stream, lambda df: ev.xml_status(df, key="path"), "files_status", str(tmp_path / "checkpoint")).awaitTermination()
    assert sorted(r.ok for r in spark.table("files_status").collect()) == [False, True]
    assert found.select(guards.utf8_text(F.col("content")).alias("t"), guards.too_big(F.col("content"), 3).alias("b")).orderBy("t").first() == ("<a>", False)
    streams.register(spark)
    found.createOrReplaceTempView("files")
    assert spark.sql("SELECT count_if(xml_ok(content)) FROM files").first()[0] == 1
    assert spark.sql("SELECT e.name FROM files, LATERAL xml_events_of(content) e WHERE e.event = 'START_ELEMENT'").first()[0] == "a"


def test_any_fault_is_the_documents_own(spark):
    made = ev.Maker(ev.STATUS, lambda raw: [(True, None, 1 if raw != b"big" else 1 << 70)] if raw != b"bad" else 1 / 0, refused=lambda e: [(False, type(e).__name__, None)])
    found = {r.doc_id: (r.ok, r.error) for r in ev.per_document(docs(spark, "good", "bad", "big", None), made).collect()}
    assert found == {0: (True, None), 1: (False, "ZeroDivisionError"), 2: (False, "OverflowError")}


def test_options_of_the_session_take_effect(spark):
    spark.conf.set("xylem.max_depth", "1")
    try:
        assert not ev.xml_status(docs(spark, "<a><b></b></a>")).first().ok
        assert ev.xml_status(docs(spark, "<a><b></b></a>"), XmlOptions()).first().ok
    finally:
        spark.conf.unset("xylem.max_depth")


def test_profiles_can_be_added(spark):
    first = lambda events: (next(e.name for e in events if e.event == "START_ELEMENT"),)
    records.register_profile("Roots", lambda options: records.Profile(first, [T.StructField("root", T.StringType())]))
    try:
        found = records.inspect(docs(spark, "<a/>", "<b"), XmlOptions(profile="roots")).orderBy("doc_id").collect()
        assert [(r.profile, r.ok, r.record) for r in found] == [("roots", True, '{"root":"a"}'), ("roots", False, None)]
    finally:
        records.PROFILES.pop("roots")
        records.PROFILE_NAMES.remove("roots")


def test_sinks_and_observation(spark, tmp_path):
    lines = docs(spark, "<a>1</a>", "<a>\n</a>")
    with pytest.raises(Exception, match="line feed"):
        files.write_documents(lines, str(tmp_path / "lines"))
    files.write_documents(lines, str(tmp_path / "rows"), format="parquet")
    assert spark.read.parquet(str(tmp_path / "rows")).count() == 2
    seen, observation = files.observed(ev.xml_status(docs(spark, "<a/>", "<a")))
    seen.collect()
    assert observation.get == {"rows": 2, "refused": 1}
    plain, observation = files.observed(lines)
    plain.collect()
    assert observation.get == {"rows": 2, "refused": 0}


def test_marshalled_events_are_those_of_the_document(spark):
    pet = T.StructType([T.StructField("_type", T.StringType()), elem("name", ns="urn:n"), elem("day", T.DateType(), nillable=True)])
    schema = XmlSchema("o", T.StructType([attr("id", T.IntegerType(), ns="urn:m"), elem("pet", T.ArrayType(pet), subtypes={"{urn:p}dog": []}, wrapper="pets"), elem("n", T.ArrayType(T.IntegerType()), nillable=True), value("t")]), ns="urn:o")
    df = spark.sql("SELECT 1L AS doc_id, named_struct('id', 3, 'pet', array(named_struct('_type', '{urn:p}dog', 'name', 'a<&', 'day', date'2020-01-02'), named_struct('_type', null, 'name', null, 'day', null)), 'n', array(1, null), 't', 'x & y') AS v")
    keep = ["seq", "event", "depth", "name", "ns", "text", "attrs"]
    scanned = ev.xml_events(df.select("doc_id", marshal(F.col("v"), schema, fragment=True).alias("content")), columns=keep).where("event not like '%DOCUMENT'")
    rows = lambda d: [(r.seq, r.event, r.depth, r.name, r.ns, r.text, sorted(r.attrs or [])) for r in d.orderBy("seq").collect()]
    assert rows(marshal_events(df, "v", schema)) == rows(scanned)


def test_windows_make_the_tree_of_foreign_events(spark):
    events = ev.xml_events(docs(spark, "<!-- c --><a>x<b/>y</a><?p q?>", "<a/>"))
    columns = ["doc_id", "node_id", "parent_id", "ordinal", "kind", "section"]
    assert sorted(map(tuple, ev.xml_nodes(events).select(columns).collect()), key=repr) == sorted(((*r[:3], r[3], *r[4:]) for r in ev.xml_nodes(events.drop("ordinal", "section")).select(columns).collect()), key=repr)


def test_options(spark):
    spark.conf.set("xylem.max_depth", "7")
    assert XmlOptions.from_session(spark, utf8="off") == XmlOptions(max_depth=7, utf8="none")
    spark.conf.unset("xylem.max_depth")
    with pytest.raises(ValueError):
        XmlOptions(profile="other")


@pytest.mark.parametrize("other_store", [False, True])
def test_one_document_a_file(spark, tmp_path, monkeypatch, other_store):
    """Folders don't grow in number with the documents, equal and null ones included; by the workers, or by Spark's writer."""
    monkeypatch.setattr(files, "FILES", 50)
    docs = spark.range(300).selectExpr("id % 7 AS doc_id", "if(id % 3 = 0, NULL, concat('<é>', id % 10, '\\n</é>')) AS content").coalesce(1)
    path = f"{'' if other_store else 'file://'}{tmp_path}/a b"
    files.write_files(docs, path)
    found = files.read_documents(spark, path, glob="*.txt", recursive=True)
    texts = [bytes(r["content"]).decode().rstrip("\n") for r in found.collect()]
    assert sorted(texts) == sorted(f"<é>{i % 10}\n</é>" for i in range(300) if i % 3)
    assert len([x for x in (tmp_path / "a b").rglob("*") if x.is_dir()]) <= 6


@pytest.mark.parametrize("name", ["text_files", "binary_files"])
def test_files_without_a_folder_each(spark, name):
    from pathlib import Path

    from xylem.plans import queries

    base = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(base.rglob("*"))
    n = queries.QUERIES[name](spark, "/root/testdata/sf0.01").count()
    new = set(base.rglob("*")) - before
    assert n == len([x for x in new if x.suffix == ".txt"]) == 100
    assert len([x for x in new if x.is_dir()]) <= 3


def test_rows_in_files_of_bounded_size(spark, tmp_path, monkeypatch):
    """Each file is a document of its own and holds a bounded part of the rows, whatever their number."""
    from xml.etree import ElementTree

    monkeypatch.setattr(files, "LINES", 12)
    rows = spark.range(0, 95, 1, 3).selectExpr("if(id = 50, NULL, concat('<item><a>', id, '</a></item>')) AS content")
    files.write_rows(rows, str(tmp_path / "rows"), "items")
    found = [ElementTree.fromstring(x.read_text()) for x in (tmp_path / "rows").glob("*.txt")]
    assert {x.tag for x in found} == {"items"} and max(map(len, found)) == 10
    want = [i for i in range(95) if i != 50]
    assert sorted(int(e[0].text) for x in found for e in x) == want
    assert sorted(r.a for r in files.read_rows(spark, str(tmp_path / "rows"), "item").collect()) == want
    assert sorted(r.a for r in files.read_rows(spark, str(tmp_path / "rows"), "item", "a string").collect()) == sorted(map(str, want))


def test_framed_rows_write_no_file_in_one_row(spark, monkeypatch):
    from pathlib import Path

    from xylem.plans import queries

    monkeypatch.setattr(files, "LINES", 10_000)
    base = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(base.rglob("*.txt"))
    assert queries.QUERIES["framed_rows"](spark, "/root/testdata/sf0.01").count() == 60_000
    new = set(base.rglob("*.txt")) - before
    assert max(len(x.read_text().splitlines()) for x in new) == 10_000 and max(len(line) for x in new for line in x.open()) < 200

"""What array operations make of plain documents is what the scan of one document gives."""

import random

import pyarrow as pa
import pytest

from pyspark.sql import types as T

from xylem.operators import bind, records
from xylem.operators import events as ev
from xylem.operators.batches import Tokens
from xylem.operators.schema import XmlContext, XmlSchema, attr, elem, value
from xylem.options import XmlOptions

NAMES = ["a", "b:c", "d-e", "f.g", "é", "p:x", "Action", "MsgId", "IBAN", "NbOfTxs", "BIC", "BICFI", "CstmrCdtTrfInitn"]
PLAIN = ["text", "&amp;x", "&#65;", "é", " ", "12", "\n"]
ODD = ["<![CDATA[<x>]]>", "<!-- c -->", "<?p i?>", "&bad;", ">", "<b>", "</a>", "<x y='>'/>"]


def document(rng, texts, depth=0):
    name = rng.choice(NAMES)
    given = [("k", "'", rng.choice(["", "x", "&lt;", "1 2"])), ("l:m", '"', "v"), ("xmlns", '"', rng.choice(["", "urn:a"])), ("xmlns:b", "'", "urn:b"), ("xmlns:p", '"', rng.choice(["u1", "u2"]))]
    attrs = "".join(f" {k}={q}{v}{q}" for k, q, v in given if rng.random() < 0.15)
    inner = "".join(rng.choice(texts) if depth > 3 or rng.random() < 0.5 else document(rng, texts, depth + 1) for _ in range(rng.randint(0, 4)))
    return f"<{name}{attrs}>{inner}</{name}>" if inner or rng.random() < 0.5 else f"<{name}{attrs}/>"


def envelope(rng):
    ns = rng.choice([*records.SOAP_VERSIONS, "x"])
    action = rng.choice(["a", "&amp;", "", " z "])
    header = rng.choice(["", "<s:Header/>", f"<s:Header><w:Action>{action}</w:Action><w:MessageID> m </w:MessageID></s:Header>", "<Header/>", "<s:Header><Action><Action>q</Action></Action></s:Header>"])
    body = rng.choice(["<s:Body/>", "<s:Body><x/></s:Body>", "<s:Body><fhir:Bundle xmlns:fhir='u'/><y><Action>late</Action></y></s:Body>", '<s:Body><P xmlns="urn:hl7-org:v3"/></s:Body>', "", "<s:Body/><s:Body/>", "<s:Body>t<c:ClinicalDocument/></s:Body>"])
    return f'<s:Envelope xmlns:s="{ns}"{rng.choice(["", " xmlns:c='urn:hl7-org:v3'"])}>{header}{body}</s:Envelope>'


@pytest.fixture(scope="module")
def contents():
    rng = random.Random(5)
    texts = [document(rng, PLAIN) for _ in range(500)] + [document(rng, PLAIN + ODD) for _ in range(300)] + [envelope(rng) for _ in range(300)]
    texts += ["", " ", "<a/><b/>", "﻿<a/>", "<?xml version='1.0'?><a>x</a>\n", " <a/> ", "<a>", "x<a/>", "<a/>x", "<a b='>'/>", '<a b="><"/>', "<?xml-x?><a/>", "<?XML?><a/>", "<a><?xml?></a>", "<a b='1'b='2'/>", "<a b='1' b='1'/>", "<a\x00/>"]
    raw = [t.encode() for t in texts] + [b"<a>\xc3(</a>", b"\xc3", b"\xa9<a/>", b"<a>\xed\xa0\x80</a>", None]
    rng.shuffle(raw)
    return pa.array(raw, pa.binary())


PART = T.StructType([attr("k"), value("text"), elem("d-e", T.ArrayType(T.StringType()), ns="urn:a"), elem("IBAN"), elem("NbOfTxs", T.IntegerType())])
ROOT = XmlSchema("a", T.StructType([attr("k"), elem("MsgId"), elem("c", T.ArrayType(PART), ns="urn:b"), elem("BIC", T.DecimalType(5, 1))]))
OPERATORS = {
    "bound": lambda o: bind.unmarshal(None, ROOT, o),
    "any": lambda o: bind.unmarshal_any(None, XmlContext(ROOT, XmlSchema("a", PART, ns="urn:a"), XmlSchema("IBAN", PART)), o),
    "events": lambda o: ev.xml_events(None, o, list(ev.EVENT_COLUMNS)),
    "some events": lambda o: ev.xml_events(None, o, ["seq", "event", "text", "owner_seq", "ordinal"], ["TEXT", "START_ELEMENT"]),
    "status": lambda o: ev.xml_status(None, o),
    "declared": lambda o: ev.xml_status(None, o, declaration=True),
    "elements": lambda o: ev.xml_elements(None, o, path=True),
    "roots": lambda o: ev.root_qname(None, options=o),
    "payments": lambda o: records.payments(None, o),
    "soap": lambda o: records.soap_messages(None, o),
    "healthcare": lambda o: records.healthcare(None, o),
    "trimmed": lambda o: records.healthcare(None, o.with_(region="anywhere"), trimmed=True),
}


@pytest.mark.parametrize("name", OPERATORS)
@pytest.mark.parametrize("options", [XmlOptions(), XmlOptions(max_depth=2, utf8="none")], ids=["strict", "shallow"])
def test_like_the_scan(contents, monkeypatch, name, options):
    made = []
    for module in (ev, records, bind):
        monkeypatch.setattr(module, "per_document", lambda docs, maker, *_: made.append(maker))
    OPERATORS[name](options)
    fast = made[0]
    slow = ev.Maker(fast.fields, fast.each, None, fast.refused, fast.options)

    def rows(maker):
        out = {}
        for at, columns in maker.batches(contents):
            for r in zip(at.tolist(), *(c.to_pylist() for c in columns), strict=True):
                out.setdefault(r[0], []).append(r[1:])
        return out

    assert rows(fast) == rows(slow)


def test_most_documents_are_plain(contents):
    tokens: Tokens = ev.tokens_of(contents, XmlOptions())
    assert tokens.plain.sum() > len(contents) / 2


def test_slices_of_a_batch(contents, monkeypatch):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(contents))), contents], names=["k", "c"])
    whole = ev.Maker(ev.STATUS, lambda _: [(False, "slow", None)], lambda t: (t.docs, t.docs, [pa.array([True] * len(t.docs)), pa.nulls(len(t.docs), pa.string()), pa.nulls(len(t.docs), pa.int64())]))
    found = lambda b, base: {base + int(i): ok for at, (ok, *_) in whole.batches(b.column(1)) for i, ok in zip(at, ok.to_pylist(), strict=True)}
    want = found(batch, 0)
    monkeypatch.setattr(ev, "BATCH_BYTES", 2000)
    parts, got, base = list(ev.parts_of(batch)), {}, 0
    for part in parts:
        got |= found(part, base)
        base += part.num_rows
    assert len(parts) > 3 and got == want

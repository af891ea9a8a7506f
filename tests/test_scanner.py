import random
import xml.parsers.expat

import pytest

from xylem.operators.scanner import XmlError, decode, scan
from xylem.options import XmlOptions


def kinds(data):
    return [e.event for e in scan(data)]


def test_order_of_events():
    assert kinds(b"<r id='1'>hello<x/>world</r>") == ["START_DOCUMENT", "START_ELEMENT", "TEXT", "START_ELEMENT", "END_ELEMENT", "TEXT", "END_ELEMENT", "END_DOCUMENT"]


@pytest.mark.parametrize(
    ("data", "message"),
    [
        (b"<a><b></a>", "Mismatched end tag"),
        (b"<a x='1'x='2'/>", "White space required"),
        (b"<a x='1' x='2'/>", "Duplicate attribute"),
        (b'<!DOCTYPE a SYSTEM "x"><a/>', "DTD"),
        (b"<!doctype a><a/>", "DTD"),
        (b"<!ELEMENT a>", "Unsupported declaration"),
        (b"<a>&unknown;</a>", "Unknown entity"),
        (b"<a>&amp</a>", "Unterminated entity"),
        (b"<a>&#0;</a>", "Invalid character reference"),
        (b"<a>&#-5;</a>", "Malformed character reference"),
        (b"", "No root"),
        (b"<a>", "Unclosed"),
        (b"<a/><b/>", "Multiple roots"),
        (b"x<a/>", "Text outside root"),
        (b"<a/>&#32;", "Text outside root"),
        (b"<![CDATA[x]]><a/>", "CDATA outside root"),
        (b"<a><!-- -- --></a>", "Double hyphen"),
        (b"<a><!-- x---></a>", "Double hyphen"),
        (b"<a><?xml version='1.0'?></a>", "Misplaced"),
        (b"<1/>", "Malformed start tag"),
        (b"<a b=c/>", "Malformed attribute"),
        (b"\xc3(", "Invalid UTF-8"),
        (b"<a>\xc0\x80</a>", "Invalid UTF-8"),
        (b"<a>\xed\xa0\x80</a>", "Invalid UTF-8"),
        (b"<a>\xf4\x90\x80\x80</a>", "Invalid UTF-8"),
    ],
)
def test_rejected(data, message):
    with pytest.raises(XmlError, match=message):
        list(scan(data))


@pytest.mark.parametrize("data", [b"<a b='<'/>", b"<a>]]></a>", b"\xef\xbb\xbf<?xml version='1.0'?><a/>", b" \n<a/>\t", b"<a:b c:d='1'/>", b"<\xc3\xa9/>", b"<a><?x?></a>"])
def test_accepted(data):
    assert kinds(data)[-1] == "END_DOCUMENT"


def test_limits():
    assert list(scan(b"<a><b><c/></b></a>", XmlOptions(max_depth=2)))
    with pytest.raises(XmlError, match="depth"):
        list(scan(b"<a><b><c></c></b></a>", XmlOptions(max_depth=2)))
    with pytest.raises(XmlError, match="capacity"):
        list(scan(b"<abc/>", XmlOptions(capacity=5)))
    assert any(e.text == "�(" for e in scan(b"<a>\xc3(</a>", XmlOptions(utf8="none")))


def test_references():
    assert decode("caffè &#x1F600;&lt;&#65;", 0) == "caffè \U0001f600<A"


def test_namespaces():
    found = [(e.ns, e.local) for e in scan(b'<r xmlns="d" xmlns:p="u"><p:a/><b xmlns=""/><q:c/></r>') if e.event == "START_ELEMENT"]
    assert found == [("d", "r"), ("u", "a"), ("", "b"), (None, "c")]


def random_document(rng, depth=0):
    name = rng.choice(["a", "b:c", "d-e", "f.g"])
    attrs = "".join(f" {k}={q}{rng.choice(['', 'x', '&lt;', '1 2'])}{q}" for k, q in (("k", "'"), ("l:m", '"')) if rng.random() < 0.4)
    inner = "".join(rng.choice(["text", "&amp;", "&#65;", "<![CDATA[<x>]]>", "<!-- c -->", "<?p i?>", "é"]) if depth > 3 or rng.random() < 0.5 else random_document(rng, depth + 1) for _ in range(rng.randint(0, 4)))
    return f"<{name}{attrs}>{inner}</{name}>" if inner or rng.random() < 0.5 else f"<{name}{attrs}/>"


def test_like_expat():
    rng = random.Random(7)
    for _ in range(300):
        data = random_document(rng).encode()
        want = []
        parser = xml.parsers.expat.ParserCreate()
        parser.buffer_text = True
        parser.StartElementHandler = lambda n, a, w=want: w.append(("S", n, sorted(a.items())))
        parser.EndElementHandler = lambda n, w=want: w.append(("E", n))
        parser.CharacterDataHandler = lambda t, w=want: w.append(("T", t))
        parser.Parse(data, True)
        got = []
        for e in scan(data):
            if e.event == "START_ELEMENT":
                got.append(("S", e.name, sorted(e.attrs)))
            elif e.event == "END_ELEMENT":
                got.append(("E", e.name))
            elif e.event in ("TEXT", "CDATA"):
                got.append(("T", e.text))
        join = lambda events: "".join(f"[{x}]" if x[0] != "T" else x[1] for x in events)
        assert join(got) == join(want)

"""The strict grammar: one document's bytes to its events.

Forward only, no DTD, no entities but the five predefined and numeric ones,
strict UTF-8, bounded depth and size. Line ends and white space in attribute
values stay as they are; ``<`` in attribute values and ``]]>`` in text pass.
Namespaces are resolved on a stack of scopes; an unbound prefix has a null
namespace here and is an error only where objects are bound.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

from xylem.options import XmlOptions

START_DOCUMENT, START_ELEMENT, TEXT, CDATA = "START_DOCUMENT", "START_ELEMENT", "TEXT", "CDATA"
COMMENT, INSTRUCTION, END_ELEMENT, END_DOCUMENT = "COMMENT", "PROCESSING_INSTRUCTION", "END_ELEMENT", "END_DOCUMENT"
XML_NS = "http://www.w3.org/XML/1998/namespace"
BOM = b"\xef\xbb\xbf"

_NAME = rb"[:A-Z_a-z\x80-\xff][:A-Z_a-z\x80-\xff.0-9-]*"
_OPEN = re.compile(rb"<(" + _NAME + rb")")
_ATTRIBUTE = re.compile(rb"([ \t\r\n]*)(" + _NAME + rb")[ \t\r\n]*=[ \t\r\n]*(\"[^\"]*\"|'[^']*')")
_OPEN_END = re.compile(rb"[ \t\r\n]*(/?)>")
_CLOSE = re.compile(rb"</(" + _NAME + rb")[ \t\r\n]*>")
_TARGET = re.compile(_NAME)
_BLANK = re.compile(rb"[ \t\r\n]*")
_REFERENCE = re.compile(r"&([^;&]*)(;?)")
_PREDEFINED = {"lt": "<", "gt": ">", "amp": "&", "quot": '"', "apos": "'"}


class XmlError(ValueError):
    def __init__(self, message: str, offset: int):
        super().__init__(message)
        self.offset = offset


class Event(NamedTuple):
    seq: int
    event: str
    depth: int
    name: str | None
    ns: str | None
    text: str | None
    raw: str | list[str] | None  # of a start tag: of each attribute
    attrs: list[tuple[str, str]] | None
    byte_start: int
    byte_end: int
    owner: int | None
    scope: dict[str, str] | None

    @property
    def local(self) -> str | None:
        return self.name and self.name.rpartition(":")[2]

    @property
    def prefix(self) -> str | None:
        return self.name and self.name.rpartition(":")[0]


def decode(raw: str, offset: int) -> str:
    """Text with its references resolved."""
    if "&" not in raw:
        return raw

    def one(m: re.Match) -> str:
        name, closed = m.groups()
        if not closed:
            raise XmlError("Unterminated entity reference", offset)
        if name in _PREDEFINED:
            return _PREDEFINED[name]
        if not name.startswith("#"):
            raise XmlError(f"Unknown entity &{name};", offset)
        hexadecimal = name[1:2] in ("x", "X")
        digits = name[2:] if hexadecimal else name[1:]
        if not (re.fullmatch(r"[0-9A-Fa-f]+", digits) if hexadecimal else digits.isdecimal()):
            raise XmlError(f"Malformed character reference &{name[:40]};", offset)
        # no more digits than the largest code has, so that their number costs nothing
        code = int(digits[-8:], 16 if hexadecimal else 10) if not digits[:-8].strip("0") else 1 << 30
        if code > 0x10FFFF:
            raise XmlError(f"Malformed character reference &{name[:40]};", offset)
        if code not in (9, 10, 13) and not (0x20 <= code <= 0xD7FF or 0xE000 <= code <= 0xFFFD or 0x10000 <= code <= 0x10FFFF):
            raise XmlError(f"Invalid character reference &{name};", offset)
        return chr(code)

    return _REFERENCE.sub(one, raw)


def scan(data: bytes, options: XmlOptions = XmlOptions()) -> Iterator[Event]:
    """The events of a document; XmlError where it breaks the grammar, after the events before that place."""
    size = len(data)
    if size > options.capacity:
        raise XmlError("Document exceeds capacity", options.capacity)
    if options.utf8 == "strict":
        try:
            data.decode("utf-8")
        except UnicodeDecodeError as e:
            raise XmlError("Invalid UTF-8", e.start) from None
    errors = "strict" if options.utf8 == "strict" else "replace"
    seq = 0
    yield Event(seq, START_DOCUMENT, 0, None, None, None, None, None, 0, 0, None, None)
    begin = at = 3 if data.startswith(BOM) else 0
    stack: list[tuple[bytes, str, int, dict[str, str]]] = []  # raw name, name, seq of the start, scope
    scope: dict[str, str] = {"xml": XML_NS}
    rooted = False
    while at < size:
        mark = data.find(b"<", at)
        mark = size if mark < 0 else mark
        if mark > at:
            if stack:
                raw = data[at:mark].decode("utf-8", errors)
                seq += 1
                yield Event(seq, TEXT, len(stack), None, None, decode(raw, at), raw, None, at, mark, stack[-1][2], None)
            elif _BLANK.fullmatch(data, at, mark) is None:
                raise XmlError("Text outside root", at)
            at = mark
            if at == size:
                break
        kind = data[at + 1 : at + 2]
        if kind == b"!":
            if data.startswith(b"<!--", at):
                end = data.find(b"-->", at + 4)
                if end < 0:
                    raise XmlError("Unterminated comment", at)
                if data.find(b"--", at + 4, end) >= 0 or data[end - 1 : end] == b"-" and end - 1 >= at + 4:
                    raise XmlError("Double hyphen in comment", at)
                text = data[at + 4 : end].decode("utf-8", errors)
                seq += 1
                yield Event(seq, COMMENT, len(stack), None, None, text, text, None, at, end + 3, stack[-1][2] if stack else None, None)
                at = end + 3
            elif data.startswith(b"<![CDATA[", at):
                if not stack:
                    raise XmlError("CDATA outside root", at)
                end = data.find(b"]]>", at + 9)
                if end < 0:
                    raise XmlError("Unterminated CDATA", at)
                text = data[at + 9 : end].decode("utf-8", errors)
                seq += 1
                yield Event(seq, CDATA, len(stack), None, None, text, text, None, at, end + 3, stack[-1][2], None)
                at = end + 3
            elif data[at : at + 9].upper() == b"<!DOCTYPE":
                raise XmlError("DTD is not supported", at)
            else:
                raise XmlError("Unsupported declaration", at)
        elif kind == b"?":
            end = data.find(b"?>", at + 2)
            if end < 0:
                raise XmlError("Unterminated processing instruction", at)
            target = _TARGET.match(data, at + 2, end)
            if target is None:
                raise XmlError("Malformed processing instruction", at)
            if target[0].lower() == b"xml":
                if at not in (0, begin):
                    raise XmlError("Misplaced XML declaration", at)
            else:
                text = data[target.end() : end].decode("utf-8", errors).strip(" \t\r\n")
                seq += 1
                yield Event(seq, INSTRUCTION, len(stack), target[0].decode("utf-8", errors), None, text, text, None, at, end + 2, stack[-1][2] if stack else None, None)
            at = end + 2
        elif kind == b"/":
            m = _CLOSE.match(data, at)
            if m is None:
                raise XmlError("Malformed end tag", at)
            if not stack or stack[-1][0] != m[1]:
                raise XmlError("Mismatched end tag", at)
            _, name, owner, inner = stack.pop()
            seq += 1
            yield Event(seq, END_ELEMENT, len(stack) + 1, name, _space(name, inner), None, None, None, at, m.end(), owner, None)
            scope = stack[-1][3] if stack else {"xml": XML_NS}
            at = m.end()
        else:
            m = _OPEN.match(data, at)
            if m is None:
                raise XmlError("Malformed start tag", at)
            if not stack and rooted:
                raise XmlError("Multiple roots", at)
            attrs: list[tuple[str, str]] = []
            raws: list[str] = []
            seen: set[bytes] = set()
            to, inner = m.end(), scope
            while (end := _OPEN_END.match(data, to)) is None:
                a = _ATTRIBUTE.match(data, to)
                if a is None:
                    raise XmlError("Malformed attribute", to)
                if not a[1]:
                    raise XmlError("White space required before attribute", to)
                if a[2] in seen:
                    raise XmlError("Duplicate attribute", to)
                seen.add(a[2])
                raw = a[3][1:-1].decode("utf-8", errors)
                key, value = a[2].decode("utf-8", errors), decode(raw, a.start(3))
                attrs.append((key, value))
                raws.append(raw)
                if key == "xmlns" or key.startswith("xmlns:"):
                    inner = {**inner, key[6:]: value}
                to = a.end()
            name = m[1].decode("utf-8", errors)
            seq += 1
            start, owner = seq, stack[-1][2] if stack else None
            if not end[1] and len(stack) >= options.max_depth:
                raise XmlError("Maximum depth exceeded", at)
            rooted = True
            yield Event(seq, START_ELEMENT, len(stack) + 1, name, _space(name, inner), None, raws, attrs, at, end.end(), owner, inner)
            if end[1]:
                seq += 1
                yield Event(seq, END_ELEMENT, len(stack) + 1, name, _space(name, inner), None, None, None, at, end.end(), start, None)
            else:
                stack.append((m[1], name, start, inner))
                scope = inner
            at = end.end()
    if stack:
        raise XmlError("Unclosed element", size)
    if not rooted:
        raise XmlError("No root element", size)
    yield Event(seq + 1, END_DOCUMENT, 0, None, None, None, None, None, size, size, None, None)


def _space(name: str, scope: dict[str, str]) -> str | None:
    """The namespace of a name: empty for none, null for an unbound prefix."""
    prefix, colon, _ = name.partition(":")
    return scope.get(prefix) if colon else scope.get("", "")

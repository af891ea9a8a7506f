"""Checks and byte-level functions as Columns: they run in the JVM, before any scan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The bytes that the structural index lists.
STRUCTURAL = "<>/='\"&?!"
#: Bytes of a document that decide its profile.
PROBE = 8192


def utf8_ok(content: Column) -> Column:
    return F.is_valid_utf8(content.cast("string"))


def utf8_text(content: Column, policy: str = "strict") -> Column:
    """Text of binary content: null where it is not UTF-8 (strict), or with U+FFFD there (none)."""
    return F.try_validate_utf8(content.cast("string")) if policy == "strict" else F.make_valid_utf8(content.cast("string"))


def bounded(content: Column, length: Column | int) -> Column:
    """The first ``length`` bytes; an error where there are fewer."""
    n = length if isinstance(length, Column) else F.lit(length)
    return F.when(n <= F.length(content), F.substring(content, F.lit(1), n)).otherwise(F.raise_error("length is out of bounds"))


def too_big(content: Column, capacity: int) -> Column:
    return F.length(content) > capacity


def has_dtd(text: Column) -> Column:
    """Conservative: also true where a comment or CDATA section holds the words."""
    return text.rlike("(?i)<!DOCTYPE")


def strip_bom(text: Column) -> Column:
    return F.regexp_replace(text, "^﻿", "")


def xml_declaration_ok(text: Column) -> Column:
    """No declaration, or one of version 1.0 or 1.1, UTF-8 and yes or no standalone."""
    q = lambda x: f"(?:\"{x}\"|'{x}')"
    pattern = rf"^<\?xml\s+version\s*=\s*{q('1[.][01]')}(?:\s+encoding\s*=\s*{q('(?i:utf-8)')})?(?:\s+standalone\s*=\s*{q('(?:yes|no)')})?\s*\?>"
    return ~strip_bom(text).rlike(r"^<\?xml\s") | strip_bom(text).rlike(pattern)


def detect_profile(content: Column) -> Column:
    """payments, soap_healthcare or none, from the first bytes; payments come first."""
    head = F.substring(content, 1, PROBE)
    holds = lambda x: F.contains(head, F.lit(x.encode()))
    payment = holds("urn:iso:std:iso:20022") | holds("CstmrCdtTrfInitn") | holds("FIToFICstmrCdtTrf") | holds("BkToCstmrStmt")
    return F.when(payment, "payments").when(holds("Envelope"), "soap_healthcare").otherwise("none")


def structural_count(text: Column) -> Column:
    """How many structural bytes a text has (all are ASCII)."""
    return (F.length(text) - F.length(F.translate(text, STRUCTURAL, ""))).cast("long")


def token_count(text: Column, token: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, token, ""))).cast("long")


def structural_positions(text: Column) -> Column:
    """Byte offsets of the structural characters in a text's UTF-8, ascending."""
    codes = [f"{ord(c):02X}" for c in STRUCTURAL]
    each = F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit(".."), F.lit(0))
    marked = F.transform(each, lambda c, i: F.when(c.isin(*codes), i.cast("long")))
    return F.filter(marked, lambda i: i.isNotNull())


def find(text: Column, token: str, start: int = 0) -> Column:
    """Offset of the first occurrence from ``start`` on, or the text's length."""
    at = F.locate(token, text, start + 1)
    return F.when(at > 0, at - 1).otherwise(F.length(text)).cast("long")


def starts_ignore_case(text: Column, token: str) -> Column:
    return F.upper(F.left(text, F.lit(len(token)))) == token.upper()


def checksum(values: Column, modulus: int = (1 << 31) - 1) -> Column:
    """An order-sensitive fold of an array of numbers, seeded with its size."""
    return F.aggregate(values, F.size(values).cast("long"), lambda h, p: (h * 31 + p) % modulus)


def fnv1a(text: Column) -> Column:
    """The 32-bit FNV-1a hash of an ASCII text."""
    prime, mask = 16777619, (1 << 32) - 1
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(2166136261).cast("long"), lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("long")) * prime).bitwiseAND(mask))


def local_name(name: Column, last: bool = True) -> Column:
    """After the last colon, or after the first."""
    return F.substring_index(name, ":", -1) if last else F.regexp_replace(name, "^[^:]*:", "")


def prefix_of(name: Column) -> Column:
    return F.when(F.contains(name, F.lit(":")), F.substring_index(name, ":", 1)).otherwise("")


def attribute(attrs: Column, name: str) -> Column:
    """The value of the first attribute of that name, or null."""
    return F.try_element_at(F.transform(F.filter(attrs, lambda a: a["name"] == name), lambda a: a["value"]), F.lit(1))


def has_namespace_declarations(attrs: Column) -> Column:
    return F.exists(attrs, lambda a: (a["name"] == "xmlns") | a["name"].startswith("xmlns:"))


def entities(text: Column) -> Column:
    """Names of all entity references, by class: predefined, numeric or unknown."""
    names = F.regexp_extract_all(text, F.lit("&(#?[A-Za-z0-9]+);"), F.lit(1))
    known = F.array(*map(F.lit, ("lt", "gt", "amp", "quot", "apos")))
    kind = lambda n: F.when(F.array_contains(known, n), "predefined").when(n.startswith("#"), "numeric").otherwise("unknown")
    return F.transform(names, lambda n: F.struct(n.alias("name"), kind(n).alias("kind")))

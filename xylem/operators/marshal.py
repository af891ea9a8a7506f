"""Marshalling: a bound type compiles to one Column expression, of a document's text or of its events; no Python runs on
the data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from xylem.functions.codecs import escape_attribute, escape_text, lexical
from xylem.operators.bind import XSI
from xylem.operators.schema import XmlSchema

DECLARATION = '<?xml version="1.0" encoding="UTF-8"?>'
_SUPPORTED = {"encoding": "UTF-8", "formatted": False}
#: An attribute or declaration of a start tag: its name, its value (null: it is left out).
Head = tuple[Column, Column]


class _Text:
    """Writes elements as text."""

    nothing = staticmethod(lambda: F.lit(""))
    text = staticmethod(lambda x, depth: F.coalesce(escape_text(x), F.lit("")))
    join = staticmethod(lambda items: F.array_join(items, ""))

    @staticmethod
    def element(local: str, ns: str, depth: int, heads: list[Head], content: list[Column]) -> Column:
        attrs = [F.when(v.isNotNull(), F.concat(F.lit(" "), n, F.lit('="'), escape_attribute(v), F.lit('"'))).otherwise("") for n, v in heads]
        return F.concat(F.lit(f"<{local}"), *attrs, F.lit(">"), *content, F.lit(f"</{local}>"))


class _Events:
    """Writes elements as arrays of events."""

    kind = "array<struct<event:string,depth:int,name:string,ns:string,text:string,attrs:array<struct<name:string,value:string>>>>"

    @classmethod
    def nothing(cls) -> Column:
        return F.array().cast(cls.kind)

    @classmethod
    def _one(cls, event: str, depth: int, name: str | None, ns: str | None, text: Column, attrs: Column) -> Column:
        return F.array(F.struct(F.lit(event).alias("event"), F.lit(depth).alias("depth"), F.lit(name).alias("name"), F.lit(ns).alias("ns"), text.alias("text"), attrs.alias("attrs"))).cast(cls.kind)

    @classmethod
    def element(cls, local: str, ns: str, depth: int, heads: list[Head], content: list[Column]) -> Column:
        given = F.filter(F.array(*(F.when(v.isNotNull(), F.struct(n.alias("name"), v.alias("value"))) for n, v in heads)), lambda x: x.isNotNull()) if heads else F.array()
        return F.concat(cls._one("START_ELEMENT", depth, local, ns, F.lit(None), given), *content, cls._one("END_ELEMENT", depth, local, ns, F.lit(None), F.lit(None)))

    @classmethod
    def text(cls, x: Column, depth: int) -> Column:
        return F.when(F.length(x) > 0, cls._one("TEXT", depth, None, None, x, F.lit(None))).otherwise(cls.nothing())

    join = staticmethod(F.flatten)


def _space(ns: str, outer: str) -> list[Head]:
    return [(F.lit("xmlns"), F.lit(ns))] if ns != outer else []


def _nil(out, local: str, ns: str, outer: str, depth: int) -> Column:
    """Within a default namespace, an unqualified nil element undoes it."""
    return out.element(local, ns, depth, [*_space(ns, outer), (F.lit("xmlns:xsi"), F.lit(XSI)), (F.lit("xsi:nil"), F.lit("true"))], [])


def _qualified(value: Column, prefix: Column) -> tuple[Head, Column]:
    """The declaration that a qualified name needs, and its lexical form."""
    spaced = F.coalesce(value["ns"], F.lit("")) != ""
    return (F.concat(F.lit("xmlns:"), prefix), F.when(spaced, value["ns"])), F.when(spaced, F.concat(prefix, F.lit(":"), value["local"])).otherwise(value["local"])


def _item(out, value: Column, kind: T.DataType, xml: dict, outer: str, schema: XmlSchema, depth: int) -> Column:
    """One element; null items are nil elements or nothing."""
    local, ns = xml["local"], xml.get("ns", "")
    if xml.get("qname"):
        given = F.coalesce(value["prefix"], F.lit(""))
        head, text = _qualified(value, F.when(given == "", F.lit("q")).otherwise(given))
        body = out.element(local, ns, depth, [*_space(ns, outer), head], [out.text(text, depth)])
    elif isinstance(kind, T.StructType):
        body = _element(out, value, kind, local, ns, outer, schema, xml.get("subtypes"), depth)
    else:
        body = out.element(local, ns, depth, _space(ns, outer), [out.text(lexical(value, kind, xml), depth)])
    return F.when(value.isNotNull(), body).otherwise(_nil(out, local, ns, outer, depth) if xml.get("nillable") else out.nothing())


def _items(out, kind: T.DataType, xml: dict, outer: str, schema: XmlSchema, depth: int) -> Callable[[Column], Column]:
    return lambda x: _item(out, x, kind, xml, outer, schema, depth)


def _element(out, value: Column, struct: T.StructType, local: str, ns: str, outer: str, schema: XmlSchema, subtypes: dict | None = None, depth: int = 1) -> Column:
    heads, spaces, names = _space(ns, outer), [], 0
    content: list[Column] = []
    for f in struct.fields:
        xml = f.metadata.get("xml")
        if xml is None:
            continue
        own = value[f.name]
        if name := xml.get("adapter"):
            own = schema.adapters[name].write(own)
        if xml["kind"] in ("attr", "value"):
            if xml.get("qname"):
                names += 1
                head, text = _qualified(own, F.lit(f"q{names}"))
                heads.append(head)
            else:
                text = lexical(own, f.dataType, xml)
            if xml["kind"] == "value":
                content.insert(0, out.text(text, depth))
                continue
            prefix = ""
            if xml.get("ns"):
                if xml["ns"] not in spaces:
                    spaces.append(xml["ns"])
                    heads.append((F.lit(f"xmlns:ns{len(spaces)}"), F.lit(xml["ns"])))
                prefix = f"ns{spaces.index(xml['ns']) + 1}:"
            heads.append((F.lit(f"{prefix}{xml['local']}"), text))
            continue
        wrapper = xml.get("wrapper")
        inner, below = (xml.get("wrapper_ns", xml.get("ns", "")), depth + 2) if wrapper else (ns, depth + 1)
        if isinstance(f.dataType, T.ArrayType):
            items = F.array_distinct(own) if xml.get("set") else own
            made = F.when(own.isNotNull(), out.join(F.transform(items, _items(out, f.dataType.elementType, xml, inner, schema, below))))
        else:
            made = _item(out, own, f.dataType, xml, inner, schema, below)
        if wrapper:
            made = F.when(own.isNotNull(), out.element(wrapper, inner, depth + 1, _space(inner, ns), [made]))
        content.append(F.coalesce(made, out.nothing()))
    if subtypes is not None:
        kind = value["_type"]
        space = F.regexp_extract(kind, r"^\{([^}]*)\}", 1)
        typed = F.when(space != "", F.concat(F.lit("t:"), F.regexp_replace(kind, r"^\{[^}]*\}", ""))).otherwise(kind)
        heads += [(F.lit("xmlns:xsi"), F.when(kind.isNotNull(), F.lit(XSI))), (F.lit("xsi:type"), typed), (F.lit("xmlns:t"), F.when(space != "", space))]
    return out.element(local, ns, depth, heads, content)


def _root(out, value: Column, schema: XmlSchema, root: tuple[str, str] | None) -> Column:
    ns, local = root or (schema.ns, schema.root)
    body = _element(out, value, schema.struct, local, ns, "", schema, schema.subtypes.get(schema.root))
    return F.when(value.isNotNull(), body).otherwise(_nil(out, local, ns, "", 1)) if root else body


def marshal(value: Column, schema: XmlSchema, fragment: bool = False, root: tuple[str, str] | None = None, **properties) -> Column:
    """The document of a structure column. fragment leaves the declaration out; root (namespace, name) renames the root
    element, and a null value is then a nil root. Other encodings and formatted output are refused."""
    for name, given in properties.items():
        if _SUPPORTED.get(name) != given:
            raise ValueError(f"unsupported property {name}={given!r}")
    body = _root(_Text, value, schema, root)
    return body if fragment else F.concat(F.lit(DECLARATION), body)


def marshal_scalar(value: Column, kind: T.DataType, root: tuple[str, str], fragment: bool = False, **xml) -> Column:
    """The document of a scalar under an explicit root (namespace, name); a null value is a nil root."""
    body = _item(_Text, value, kind, {"local": root[1], "ns": root[0], "nillable": True, **xml}, "", None, 1)
    return body if fragment else F.concat(F.lit(DECLARATION), body)


def marshal_binary(value: Column, schema: XmlSchema, **options) -> Column:
    return F.encode(marshal(value, schema, **options), "UTF-8")


def marshal_events(df: DataFrame, value: str, schema: XmlSchema, key: str = "doc_id", root: tuple[str, str] | None = None) -> DataFrame:
    """The events (key, seq, event, depth, name, ns, text, attrs) that scanning the marshalled documents would give, made
    without writing them. Comments, instructions and CDATA sections have no part in bound types."""
    made = df.select(F.col(key), F.posexplode(_root(_Events, F.col(value), schema, root)).alias("at", "e"))
    inner = made.select(key, (F.col("at") + 1).cast("long").alias("seq"), "e.event", "e.depth", "e.name", "e.ns", "e.text", "e.attrs")
    return inner

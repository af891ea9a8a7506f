"""Bound types: a StructType whose fields say how they stand in XML.

Field metadata ``xml`` holds kind (attr, elem or value), local, ns, wrapper,
wrapper_ns, default, nillable, hex, enum, set and the name of an adapter. Both
directions compile from it. ``XmlContext`` checks bound roots and reads a
document by its root.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import types as T

from xylem.functions import codecs


def _field(name: str, kind: T.DataType, how: str, **xml) -> T.StructField:
    return T.StructField(name, kind, True, {"xml": {"kind": how, "local": xml.pop("local", name)} | {k: v for k, v in xml.items() if v is not None}})


def attr(name: str, kind: T.DataType = T.StringType(), **xml) -> T.StructField:
    return _field(name, kind, "attr", **xml)


def elem(name: str, kind: T.DataType = T.StringType(), **xml) -> T.StructField:
    return _field(name, kind, "elem", **xml)


def value(name: str, kind: T.DataType = T.StringType(), **xml) -> T.StructField:
    return _field(name, kind, "value", **xml)


def qname(name: str, how: str = "elem", **xml) -> T.StructField:
    """A field that holds a qualified name: a structure of ns, local and prefix."""
    return _field(name, codecs.QNAME, how, qname=True, **xml)


def decimal_text(name: str, how: str = "elem", **xml) -> T.StructField:
    """A field that holds a decimal of any size, as text."""
    return _field(name, T.StringType(), how, decimal=True, **xml)


@dataclass(frozen=True)
class Adapter:
    """A pair of functions between the XML form of a column and what users see."""

    read: Callable[[Column], Column]
    write: Callable[[Column], Column]


@dataclass
class XmlSchema:
    """A bound root: its name, namespace and type. subtypes: by ``xsi:type`` name (``local``, or ``{namespace}local``),
    the fields it has beyond the others; the value gets a ``_type`` column with that name. adapters: by the name that fields give."""

    root: str
    struct: T.StructType
    ns: str = ""
    subtypes: dict[str, dict[str, list[str]]] = field(default_factory=dict)
    adapters: dict[str, Adapter] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self._check(self.struct)

    def _check(self, struct: T.StructType) -> None:
        """Every type must be one that can be read and written, and every adapter known."""
        values = 0
        for f in struct.fields:
            xml = f.metadata.get("xml")
            if xml is None:
                continue
            kind = f.dataType.elementType if isinstance(f.dataType, T.ArrayType) else f.dataType
            values += xml["kind"] == "value"
            if isinstance(kind, T.StructType) and not xml.get("qname"):
                if xml["kind"] != "elem":
                    raise TypeError(f"{f.name}: a structure must be an element")
                self._check(kind)
            else:
                codecs.parser(kind, xml)
            if (name := xml.get("adapter")) and name not in self.adapters:
                raise KeyError(f"{f.name}: unknown adapter {name}")
        if values > 1:
            raise TypeError("an element has one text")


class XmlContext:
    """Bound roots by expanded name."""

    def __init__(self, *schemas: XmlSchema):
        self.schemas: dict[tuple[str, str], XmlSchema] = {}
        for s in schemas:
            if (s.ns, s.root) in self.schemas:
                raise ValueError(f"{{{s.ns}}}{s.root} is bound twice")
            self.schemas[s.ns, s.root] = s
        #: Of each root, the column that has its values: its local name, numbered where two have the same.
        self.columns: dict[tuple[str, str], str] = {}
        for name in self.schemas:
            column, n = name[1], 1
            while column.lower() in {c.lower() for c in self.columns.values()} | {"root_ns", "root_local", "ok", "error"}:
                n += 1
                column = f"{name[1]}_{n}"
            self.columns[name] = column

    def require(self, ns: str, root: str) -> XmlSchema:
        if (ns, root) not in self.schemas:
            raise KeyError(f"{{{ns}}}{root} is not bound")
        return self.schemas[ns, root]

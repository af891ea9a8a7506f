"""Unmarshalling: events to typed columns, in the scan that makes the events, or from a relation of events or nodes."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from xylem.functions import codecs
from xylem.operators.batches import Tokens
from xylem.operators.events import Made, Maker, per_document
from xylem.operators.records import OUTCOME, RecordError
from xylem.operators.scanner import CDATA, END_ELEMENT, START_ELEMENT, TEXT, XML_NS, Event, _space, scan
from xylem.operators.schema import XmlContext, XmlSchema
from xylem.options import XmlOptions

XSI = "http://www.w3.org/2001/XMLSchema-instance"


class _Plan:
    """What a structure's names lead to."""

    def __init__(self, struct: T.StructType, subtypes: dict[str, list[str]] | None = None):
        self.attrs: dict[tuple[str, str], tuple[str, Callable]] = {}
        self.elems: dict[tuple[str, str], _Property] = {}
        self.wrappers: dict[tuple[str, str], dict[tuple[str, str], _Property]] = {}
        self.value: tuple[str, Callable] | None = None
        self.sets: list[str] = []
        self.subtypes = subtypes
        self.empty = dict.fromkeys(struct.names)
        for f in struct.fields:
            xml = f.metadata.get("xml")
            if xml is None:
                continue
            name = xml.get("ns", ""), xml["local"]
            if xml["kind"] == "attr":
                self.attrs[name] = f.name, _reader(f.dataType, xml)
            elif xml["kind"] == "value":
                self.value = f.name, _reader(f.dataType, xml)
            elif "wrapper" in xml:
                self.wrappers.setdefault((xml.get("wrapper_ns", xml.get("ns", "")), xml["wrapper"]), {})[name] = _Property(f, xml)
            else:
                self.elems[name] = _Property(f, xml)
            if xml.get("set"):
                self.sets.append(f.name)


def _reader(kind: T.DataType, xml: dict) -> Callable[[str, dict[str, str]], object]:
    """A parser that gets the namespaces in scope."""
    parse = codecs.parser(kind, xml)
    return parse if xml.get("qname") else lambda text, _: parse(text)


class _Property:
    def __init__(self, f: T.StructField, xml: dict):
        self.name, self.many = f.name, isinstance(f.dataType, T.ArrayType)
        kind = f.dataType.elementType if self.many else f.dataType
        self.nillable, self.default = bool(xml.get("nillable")), xml.get("default")
        self.plan = _Plan(kind, xml.get("subtypes")) if isinstance(kind, T.StructType) and not xml.get("qname") else None
        self.parse = None if self.plan else _reader(kind, xml)


def _expanded(e: Event) -> tuple[str, str]:
    if e.ns is None:
        raise RecordError(f"Unbound prefix in {e.name}")
    return e.ns, e.local


def _attributes(e: Event) -> dict[tuple[str, str], str]:
    out = {}
    for name, text in e.attrs or ():
        prefix, colon, local = name.rpartition(":")
        if name == "xmlns" or prefix == "xmlns":
            continue
        if colon and prefix not in e.scope:
            raise RecordError(f"Unbound prefix in {name}")
        out[e.scope[prefix] if colon else "", local if colon else name] = text
    return out


def _skip(events: Iterator[Event]) -> None:
    depth = 1
    while depth:
        e = next(events)
        depth += (e.event == START_ELEMENT) - (e.event == END_ELEMENT)


def _scalar(events: Iterator[Event], p: _Property, scope: dict[str, str]) -> object:
    chunks = []
    for e in events:
        if e.event in (TEXT, CDATA):
            chunks.append(e.text)
        elif e.event == START_ELEMENT:
            raise RecordError(f"Element {e.name} inside a scalar")
        elif e.event == END_ELEMENT:
            break
    text = "".join(chunks)
    if not text and p.default is not None:
        text = str(p.default)
    return p.parse(text, scope)


def _put(target: dict, p: _Property, events: Iterator[Event], start: Event) -> None:
    attrs = _attributes(start)
    if attrs.get((XSI, "nil")) in ("true", "1"):
        _skip(events)
        if p.many and p.nillable:
            target[p.name] = [*(target[p.name] or []), None]
        return
    found = _object(events, start, p.plan, attrs) if p.plan else _scalar(events, p, start.scope)
    if p.many:
        if target[p.name] is None:
            target[p.name] = []
        target[p.name].append(found)
    else:
        target[p.name] = found  # the last one wins


def _object(events: Iterator[Event], start: Event, plan: _Plan, attrs: dict[tuple[str, str], str]) -> dict:
    out, chunks = dict(plan.empty), []
    if plan.subtypes is not None:
        given = attrs.get((XSI, "type"), "")
        kind = None
        if given:
            name = codecs.qname(given, start.scope)
            kind = f"{{{name['ns']}}}{name['local']}" if name["ns"] else name["local"]
            if kind not in plan.subtypes:
                raise RecordError(f"Unknown xsi:type {kind}")
        out["_type"] = kind
    for name, text in attrs.items():
        if name in plan.attrs:
            column, parse = plan.attrs[name]
            out[column] = parse(text, start.scope)
    for e in events:
        if e.event == START_ELEMENT:
            name = _expanded(e)
            if name in plan.elems:
                _put(out, plan.elems[name], events, e)
            elif name in plan.wrappers:
                items = plan.wrappers[name]
                for p in items.values():
                    if p.many and out[p.name] is None:
                        out[p.name] = []
                for inner in events:
                    if inner.event == END_ELEMENT:
                        break
                    if inner.event == START_ELEMENT:
                        if (p := items.get(_expanded(inner))) is not None:
                            _put(out, p, events, inner)
                        else:
                            _skip(events)
            else:
                _skip(events)
        elif e.event in (TEXT, CDATA):
            chunks.append(e.text)
        elif e.event == END_ELEMENT:
            break
    if plan.value:
        out[plan.value[0]] = plan.value[1]("".join(chunks), start.scope)
    for name in plan.sets:
        if out[name]:
            out[name] = list(dict.fromkeys(out[name]))
    return out


def _with_adapters(column: Column, struct: T.StructType, schema: XmlSchema) -> Column:
    """The structure with each adapted field as its adapter reads it."""
    if not any(_adapted(f) for f in struct.fields):
        return column
    parts = []
    for f in struct.fields:
        name = f.metadata.get("xml", {}).get("adapter")
        if name:
            parts.append(schema.adapters[name].read(column[f.name]).alias(f.name))
        elif _adapted(f) and isinstance(f.dataType, T.ArrayType):
            parts.append(F.transform(column[f.name], _each_with_adapters(f.dataType.elementType, schema)).alias(f.name))
        elif _adapted(f):
            parts.append(_with_adapters(column[f.name], f.dataType, schema).alias(f.name))
        else:
            parts.append(column[f.name].alias(f.name))
    return F.when(column.isNotNull(), F.struct(*parts))


def _each_with_adapters(kind: T.StructType, schema: XmlSchema) -> Callable[[Column], Column]:
    return lambda x: _with_adapters(x, kind, schema)


def _adapted(f: T.StructField) -> bool:
    """Whether a field, or one that it reaches, also through lists, has an adapter."""
    kind = f.dataType.elementType if isinstance(f.dataType, T.ArrayType) else f.dataType
    return bool(f.metadata.get("xml", {}).get("adapter")) or isinstance(kind, T.StructType) and any(map(_adapted, kind.fields))


def _bound(schema: XmlSchema) -> Callable[[Iterator[Event]], Iterable[tuple]]:
    """What makes the row of a document's events."""
    plan, root = _Plan(schema.struct, schema.subtypes.get(schema.root)), (schema.ns, schema.root)

    def one(events: Iterator[Event]) -> Iterable[tuple]:
        start = _root(events)
        if _expanded(start) != root:
            raise RecordError(f"Expected root <{schema.root}>")
        return [(_object(events, start, plan, _attributes(start)), True, None)]

    return one


def _root(events: Iterator[Event]) -> Event:
    for e in events:
        if e.event == START_ELEMENT:
            return e
    raise RecordError("No root element")


class _Tree:
    """The elements of a batch's documents, in document order: for each its document, the element around it (-1: none), the
    number of its own chunks of text, and a position that finds the text of one that has one chunk. odd: elements of which more
    than this has to be known: attributes with a prefix, or a name whose prefix is unbound."""

    def __init__(self, docs: int, doc: np.ndarray, parent: np.ndarray, chunks: np.ndarray, odd: np.ndarray):
        self.docs, self.doc, self.parent, self.chunks, self.odd = docs, doc, parent, chunks, odd
        self.children = np.bincount(parent[parent >= 0], minlength=len(doc))

    def named(self, ns: str, local: str) -> np.ndarray:
        """Which elements have that name."""
        raise NotImplementedError

    def attribute(self, at: np.ndarray, local: str) -> pa.Array:
        """For each of the elements its attribute of that name without a prefix, null where it has none."""
        raise NotImplementedError

    def text(self, at: np.ndarray) -> pa.Array:
        """For each of the elements, which have at most one chunk, their text; null where there is none."""
        raise NotImplementedError


class _TokenTree(_Tree):
    """That of a batch of plain documents."""

    def __init__(self, t: Tokens):
        self.t, self.tags = t, np.flatnonzero(t.starts)
        number = np.full(len(t) + 1, -1)
        number[self.tags] = np.arange(len(self.tags))
        with_text = np.flatnonzero(t.has_text)
        owner = number[t.owner[with_text]]
        self.chunk = np.zeros(len(self.tags), np.int64)
        self.chunk[owner] = with_text
        prefixed = t.per_shape(lambda s: any(":" in k and not k.startswith("xmlns:") for k, _ in s.attrs), bool)
        self.shape = t.shape[self.tags]
        self.space = t.space.take(pa.array(self.tags))
        odd = prefixed[self.shape] | self.space.is_null().to_numpy(zero_copy_only=False) if len(self.tags) else np.zeros(0, bool)
        super().__init__(len(t.docs), t.place[self.tags], number[t.parent[self.tags]], np.bincount(owner, minlength=len(self.tags)), odd)

    def named(self, ns: str, local: str) -> np.ndarray:
        same = self.t.per_shape(lambda s: s.local == local, bool)[self.shape]
        return same & pc.fill_null(pc.equal(self.space, ns), False).to_numpy(zero_copy_only=False) if len(same) else same.astype(bool)

    def attribute(self, at: np.ndarray, local: str) -> pa.Array:
        return self.t.shaped(lambda s: dict(s.attrs).get(local), pa.string(), self.shape[at])

    def text(self, at: np.ndarray) -> pa.Array:
        return pc.if_else(pa.array(self.chunks[at] > 0), self.t.texts(self.chunk[at]), pa.scalar(None, pa.string()))


class _Columns:
    """Binds all documents of a tree by columns. ``bad``: documents that it leaves to the binding by events, which has the last
    word on all errors."""

    def __init__(self, tree: _Tree):
        self.tree, self.bad = tree, np.zeros(tree.docs, bool)

    @staticmethod
    def able(struct: T.StructType) -> bool:
        """Whether a structure has attributes, texts, elements and lists of them only."""
        for f in struct.fields:
            xml = f.metadata.get("xml")
            if xml is None:
                continue
            kind = f.dataType.elementType if isinstance(f.dataType, T.ArrayType) else f.dataType
            if xml.get("qname") or xml.get("set") or xml.get("subtypes") or "wrapper" in xml or xml["kind"] == "attr" and xml.get("ns"):
                return False
            if isinstance(kind, T.StructType) and not _Columns.able(kind):
                return False
        return True

    def refuse(self, elements: np.ndarray) -> None:
        self.bad[self.tree.doc[elements]] = True

    def parsed(self, texts: pa.Array, kind: T.DataType, xml: dict, at: np.ndarray) -> pa.Array:
        """The values of texts of the elements; each distinct text is read once."""
        if isinstance(kind, T.StringType) and not xml.get("decimal") and not xml.get("enum"):
            return texts.cast(to_arrow_type(kind))
        parse = codecs.parser(kind, xml)
        coded = pc.dictionary_encode(texts)
        values, wrong = [], []
        for i, text in enumerate(coded.dictionary.to_pylist()):
            try:
                values.append(parse(text))
            except Exception:  # the binding by events tells why
                values.append(None)
                wrong.append(i)
        if wrong:
            self.refuse(at[pc.fill_null(pc.is_in(coded.indices, pa.array(wrong, coded.indices.type)), False).to_numpy(zero_copy_only=False)])
        return pa.array(values, to_arrow_type(kind)).take(coded.indices)

    def struct(self, at: np.ndarray, struct: T.StructType) -> pa.Array:
        """The structures of the elements, which are in document order."""
        tree, arrays = self.tree, []
        self.refuse(at[tree.odd[at]])
        place = np.full(len(tree.doc) + 1, -1)
        place[at] = np.arange(len(at))
        inner = np.flatnonzero(place[tree.parent] >= 0)
        self.refuse(inner[tree.odd[inner]])
        # of fields with one name the last one counts, as in _Plan
        last = {(f.metadata["xml"]["kind"], f.metadata["xml"].get("ns", ""), f.metadata["xml"].get("local")): f.name for f in struct.fields if f.metadata.get("xml")}
        for f in struct.fields:
            xml = f.metadata.get("xml")
            if xml is None or last[xml["kind"], xml.get("ns", ""), xml.get("local")] != f.name:
                arrays.append(pa.nulls(len(at), to_arrow_type(f.dataType)))
            elif xml["kind"] == "attr":
                arrays.append(self.parsed(tree.attribute(at, xml["local"]), f.dataType, xml, at))
            elif xml["kind"] == "value":
                self.refuse(at[tree.chunks[at] > 1])
                arrays.append(self.parsed(pc.fill_null(tree.text(at), ""), f.dataType, xml, at))
            else:
                own = inner[tree.named(xml.get("ns", ""), xml["local"])[inner]]
                arrays.append(self.element(own, place[tree.parent[own]], len(at), f, xml))
        kind = to_arrow_type(struct)
        return pa.StructArray.from_arrays(arrays, fields=[kind.field(i) for i in range(kind.num_fields)])

    def element(self, own: np.ndarray, owner: np.ndarray, n: int, f: T.StructField, xml: dict) -> pa.Array:
        many = isinstance(f.dataType, T.ArrayType)
        kind = f.dataType.elementType if many else f.dataType
        if isinstance(kind, T.StructType):
            found = self.struct(own, kind)
        else:
            self.refuse(own[(self.tree.chunks[own] > 1) | (self.tree.children[own] > 0)])
            texts = pc.fill_null(self.tree.text(own), "")
            if (default := xml.get("default")) is not None:
                texts = pc.if_else(pc.equal(texts, ""), str(default), texts)
            found = self.parsed(texts, kind, xml, own)
        if not many:
            at = np.full(n, -1)
            np.maximum.at(at, owner, np.arange(len(own)))  # the last one wins
            return found.take(pa.array(at, mask=at < 0))
        order = np.argsort(owner, kind="stable")
        counts = np.bincount(owner, minlength=n)
        ends = pa.array(np.r_[0, np.cumsum(counts)], pa.int32(), mask=np.r_[counts == 0, False])
        return pa.ListArray.from_arrays(ends, found.take(pa.array(order)), type=to_arrow_type(f.dataType))

    def roots_of(self, schema: XmlSchema) -> pa.Array:
        """The value of each document; null of one without a root."""
        root = np.flatnonzero(self.tree.parent < 0)
        if self.bad.any():  # some may have no root, or several
            root = root[~self.bad[self.tree.doc[root]]]
        fits = self.tree.named(schema.ns, schema.root)[root]
        self.refuse(root[~fits])
        at = np.full(self.tree.docs, -1)
        at[self.tree.doc[root]] = np.arange(len(root))
        return self.struct(root, schema.struct).take(pa.array(at, mask=at < 0))


def _in_columns(schema: XmlSchema) -> Callable[[Tokens], Made] | None:
    """The rows of a batch's plain documents by columns, for schemas that it can bind so."""
    if schema.subtypes.get(schema.root) or not _Columns.able(schema.struct):
        return None

    def plain(t: Tokens) -> Made:
        bound = _Columns(_TokenTree(t))
        value = bound.roots_of(schema)
        good = np.flatnonzero(~bound.bad)
        return t.docs[good], t.docs[good], [value.take(pa.array(good)), pa.array(np.ones(len(good), bool)), pa.nulls(len(good), pa.string())]

    return plain


def _plainly(one: Callable[[Iterator[Event]], Iterable[tuple]], fields: list[T.StructField]) -> Callable[[Tokens], Made]:
    """The rows of a batch's plain documents; those that are refused are left to the scan."""
    types = [to_arrow_type(f.dataType) for f in fields]

    def plain(t: Tokens) -> Made:
        done, rows = [], []
        for doc, events in zip(t.docs.tolist(), t.element_events(), strict=True):
            try:
                found = list(one(events))
            except Exception:  # the scan tells why
                continue
            done.append(doc)
            rows += found
        columns = list(zip(*rows, strict=True)) or [()] * len(fields)
        at = np.array(done, np.int64)
        return at, at, [pa.array(c, kind) for c, kind in zip(columns, types, strict=True)]

    return plain


_REFUSED = lambda e: [(None, False, str(e))]


def _fields(schema: XmlSchema) -> list[T.StructField]:
    return [T.StructField("value", schema.struct), *OUTCOME]


def _finished(bound: DataFrame, columns: dict[str, XmlSchema]) -> DataFrame:
    """With the adapters of the columns' schemas applied."""
    for name, schema in columns.items():
        if any(map(_adapted, schema.struct.fields)):
            bound = bound.withColumn(name, _with_adapters(F.col(name), schema.struct, schema))
    return bound


def unmarshal(docs: DataFrame, schema: XmlSchema, options: XmlOptions | None = None, key: str = "doc_id", content: str = "content") -> DataFrame:
    """(key, value, ok, error): each document as the bound type. It reads as far as the root's end tag; a document that
    breaks the grammar before, has another root or a value of the wrong form has a null value and the reason."""
    options = options or XmlOptions.of(docs)
    one = _bound(schema)
    return _finished(per_document(docs, Maker(_fields(schema), lambda data: one(scan(data, options)), _in_columns(schema) or _plainly(one, _fields(schema)), _REFUSED, options), key, content), {"value": schema})


def unmarshal_any(docs: DataFrame, context: XmlContext, options: XmlOptions | None = None, key: str = "doc_id", content: str = "content") -> DataFrame:
    """(key, root_ns, root_local, one column for each bound root, ok, error): documents by the root they have."""
    options = options or XmlOptions.of(docs)
    plans = {name: (i, _Plan(s.struct, s.subtypes.get(s.root))) for i, (name, s) in enumerate(context.schemas.items())}
    fields = [T.StructField(context.columns[name], s.struct) for name, s in context.schemas.items()]

    def one(events: Iterator[Event], seen: list) -> Iterable[tuple]:
        values: list = [None] * len(plans)
        start = _root(events)
        name = _expanded(start)
        seen[:] = name
        if name not in plans:
            raise RecordError(f"Unbound root <{start.name}>")
        i, plan = plans[name]
        values[i] = _object(events, start, plan, _attributes(start))
        return [(*name, *values, True, None)]

    def each(data: bytes) -> Iterable[tuple]:
        seen = [None, None]
        try:
            return one(scan(data, options), seen)
        except Exception as e:
            if options.mode != "PERMISSIVE":
                raise
            return [(*seen, *[None] * len(plans), False, str(e))]

    names = [T.StructField("root_ns", T.StringType()), T.StructField("root_local", T.StringType())]
    columns = [*names, *fields, *OUTCOME]
    made = per_document(docs, Maker(columns, each, _plainly(lambda events: one(events, []), columns), lambda e: [(None, None, *[None] * len(plans), False, str(e))], options), key, content)
    return _finished(made, {context.columns[name]: s for name, s in context.schemas.items()})


def _events_of(rows: Iterable[dict]) -> Iterator[Event]:
    """Events with depths, owners and namespaces, from rows (seq, event, name, text, attrs) of one document in order. SPACE is
    text; kinds that are not known are left out."""
    stack: list[tuple[int, dict[str, str]]] = []
    for r in rows:
        kind, attrs = {"SPACE": TEXT}.get(r["event"], r["event"]), [(a["name"], a["value"]) for a in r["attrs"] or ()]
        scope = stack[-1][1] if stack else {"xml": XML_NS}
        owner = stack[-1][0] if stack else None
        if kind == START_ELEMENT:
            scope = {**scope, **declared} if (declared := {k[6:]: v for k, v in attrs if k == "xmlns" or k.startswith("xmlns:")}) else scope
            stack.append((r["seq"], scope))
            yield Event(r["seq"], kind, len(stack), r["name"], _space(r["name"], scope), None, None, attrs, 0, 0, owner, scope)
        elif kind == END_ELEMENT:
            if not stack:
                raise RecordError("Mismatched end of an element")
            yield Event(r["seq"], kind, len(stack), r["name"], _space(r["name"], scope), None, None, None, 0, 0, owner, None)
            stack.pop()
        elif kind in (TEXT, CDATA):
            yield Event(r["seq"], kind, len(stack), None, None, r["text"] or "", r["text"] or "", None, 0, 0, owner, None)
    if stack:
        raise RecordError("Unclosed element")


class _RowTree(_Tree):
    """That of rows (seq, event, name, text, attrs, and of nodes parent_id) of whole documents, each in order of seq; ``begin`` is
    where each begins. wrong: documents whose rows are no tree with one root, or texts outside; names have no namespace, as
    elements with a prefix or a declaration are odd."""

    def __init__(self, rows: pa.Table, begin: np.ndarray):
        n, docs = rows.num_rows, len(begin)
        doc = np.repeat(np.arange(docs), np.diff(np.r_[begin, n]))
        self.rows, self.wrong = rows, np.zeros(docs, bool)
        kinds = rows.column("event").combine_chunks().dictionary_encode()
        number = {START_ELEMENT: 1, END_ELEMENT: 2, TEXT: 3, CDATA: 3, "SPACE": 3}
        kind = np.array([number.get(k, 0) for k in kinds.dictionary.to_pylist()] + [0])[pc.fill_null(kinds.indices, -1).to_numpy()]
        self.at, text = np.flatnonzero(kind == 1), np.flatnonzero(kind == 3)
        place = np.full(n + 1, -1)
        place[self.at] = np.arange(len(self.at))
        if "parent_id" in rows.column_names:
            parent, level = self._by_parents(doc, kind, place)
        else:
            step = (kind == 1).astype(np.int64) - (kind == 2)
            before = np.cumsum(step) - step
            before -= np.repeat(before[begin], np.diff(np.r_[begin, n]))
            last = np.r_[begin[1:], n] - 1
            self.wrong[doc[(kind == 2) & (before < 1)]] = True
            self.wrong |= (before + step)[last] != 0
            level = np.maximum(np.where(kind == 1, before + 1, before), 0)
            parent = None
        self.wrong[doc[text[level[text] < 1]]] = True
        nameless = rows.column("name").combine_chunks().is_null().to_numpy(zero_copy_only=False)
        self.wrong[doc[((kind == 1) | (kind == 2)) & nameless]] = True
        self.wrong |= np.bincount(doc[self.at[level[self.at] == 1]], minlength=docs) != 1
        # the element around a row is the last one of the level above, before it
        base = int(level.max(initial=0)) + 2
        key = (doc[self.at] * base + level[self.at]) << 32 | self.at
        order = np.argsort(key)
        key, sorted_at = key[order], self.at[order]
        around = np.full(n, -1)
        for own, above in ((self.at, level[self.at] - 1), (text, level[text])):
            if len(sorted_at):
                found = sorted_at[np.maximum(np.searchsorted(key, (doc[own] * base + above) << 32 | own) - 1, 0)]
                around[own] = np.where(above > 0, found, -1)
        if parent is not None:  # an element that is closed already
            own = np.r_[self.at, text]
            self.wrong[doc[own[around[own] != parent[own]]]] = True
        owner = place[around[text]]
        text, owner = text[owner >= 0], owner[owner >= 0]
        self.chunk = np.zeros(len(self.at), np.int64)
        self.chunk[owner] = text
        names = rows.column("name").combine_chunks().take(pa.array(self.at)).dictionary_encode()
        self.names, self.name = names.dictionary.to_pylist(), pc.fill_null(names.indices, -1).to_numpy()
        odd = np.array([":" in x for x in self.names] + [True])[self.name]
        attrs = rows.column("attrs").combine_chunks().take(pa.array(self.at))
        pairs, self.element = attrs.flatten(), pc.list_parent_indices(attrs).to_numpy()
        self.keys, self.values = (pc.struct_field(pairs, i) for i in range(2))
        self.wrong[doc[self.at[self.element[self.keys.is_null().to_numpy(zero_copy_only=False)]]]] = True
        strange = pc.or_(pc.or_(pc.match_substring(self.keys, ":"), pc.equal(self.keys, "xmlns")), self.values.is_null())
        odd[self.element[pc.fill_null(strange, True).to_numpy(zero_copy_only=False)]] = True
        super().__init__(docs, doc[self.at], place[around[self.at]], np.bincount(owner, minlength=len(self.at)), odd)

    def _by_parents(self, doc: np.ndarray, kind: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each row of nodes the row of its parent (-1: none), and its level; of a text that of its parent."""
        ids = self.rows.column("parent_id").combine_chunks()
        seq, orphan = self.rows.column("seq").to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)
        self.wrong[doc[1:][(doc[1:] == doc[:-1]) & (seq[1:] == seq[:-1])]] = True
        self.wrong[doc[kind == 2]] = True
        known, ranks = np.unique(np.r_[seq, pc.fill_null(ids, 0).to_numpy()], return_inverse=True)
        have, ask = doc * len(known) + ranks[: len(seq)], doc * len(known) + ranks[len(seq) :]
        found = np.minimum(np.searchsorted(have, ask), len(have) - 1)
        fits = (have[found] == ask) & (kind[found] == 1) & (found < np.arange(len(seq)))
        some = (kind == 1) | (kind == 3)
        self.wrong[doc[some & ~orphan & ~fits]] = True
        parent = np.where(orphan | ~fits, -1, found)
        level = ((kind == 1) & (parent < 0)).astype(np.int64)
        rest = np.flatnonzero((kind == 1) & (parent >= 0))
        while len(rest):  # parents come before, so each round leaves fewer
            ready = level[parent[rest]] > 0
            level[rest[ready]] = level[parent[rest[ready]]] + 1
            rest = rest[~ready]
        text = (kind == 3) & (parent >= 0)
        level[text] = level[parent[text]]
        return parent, level

    def named(self, ns: str, local: str) -> np.ndarray:
        return np.array([not ns and x == local for x in self.names] + [False])[self.name]

    def attribute(self, at: np.ndarray, local: str) -> pa.Array:
        own = np.flatnonzero(pc.fill_null(pc.equal(self.keys, local), False).to_numpy(zero_copy_only=False))
        where = np.full(len(self.at), -1)
        where[self.element[own]] = own  # the last one wins
        return self.values.take(pa.array(where[at], mask=where[at] < 0))

    def text(self, at: np.ndarray) -> pa.Array:
        texts = pc.fill_null(self.rows.column("text").combine_chunks().take(pa.array(self.chunk[at])), "")
        return pc.if_else(pa.array(self.chunks[at] > 0), texts, pa.scalar(None, pa.string()))


def _begins(keys: pa.Array) -> np.ndarray:
    """Where rows differ in key from the row before."""
    try:
        apart = pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)
    except pa.ArrowNotImplementedError:
        values = keys.to_pylist()
        apart = np.array([x != y for x, y in zip(values[1:], values[:-1], strict=True)], bool)
    return np.flatnonzero(apart) + 1


#: Rows of whole documents that are bound at a time.
ROWS = 100_000


def _by_document(rows: DataFrame, one: Callable[[list[dict]], Iterable[tuple]], schema: XmlSchema, options: XmlOptions, key: str) -> DataFrame:
    """Rows (key, seq, event, name, text, attrs; of nodes also parent_id) brought together by document, in order of seq, each
    document made into its row: by columns, or one by one where these leave it."""
    maker = Maker(_fields(schema), one, None, _REFUSED, options)
    fields = T.StructType([rows.schema[key], *maker.fields])
    able = not schema.subtypes.get(schema.root) and _Columns.able(schema.struct)

    def made(table: pa.Table) -> Iterator[pa.RecordBatch]:
        keys = table.column(key).combine_chunks()
        begin = np.r_[0, _begins(keys)]
        rest = np.arange(len(begin))
        if able and not table.column("seq").null_count:
            try:
                tree = _RowTree(table, begin)
                bound = _Columns(tree)
                bound.bad |= tree.wrong
                values, good = bound.roots_of(schema), np.flatnonzero(~bound.bad)
                done = pa.RecordBatch.from_arrays([keys.take(pa.array(begin[good])), values.take(pa.array(good)), pa.array(np.ones(len(good), bool)), pa.nulls(len(good), pa.string())], names=fields.names)
                rest = np.flatnonzero(bound.bad)
                yield done
            except (pa.ArrowException, ValueError, TypeError, OverflowError):  # one by one shows whose fault it is
                rest = np.arange(len(begin))
        ends = np.r_[begin[1:], table.num_rows]
        groups = [table.slice(begin[i], ends[i] - begin[i]).to_pylist() for i in rest.tolist()]
        if groups:
            found = [(g[0][key], *r) for g in groups for r in maker.one(g)]
            columns = list(zip(*found, strict=True)) or [()] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], keys.type), *(pa.array(c, t) for c, t in zip(columns[1:], maker.types, strict=True))], names=fields.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[pa.RecordBatch] = []  # whole documents
        held: list[pa.RecordBatch] = []  # rows of the last one so far
        for batch in batches:
            if not batch.num_rows:
                continue
            begin = _begins(batch.column(key))
            if held and batch.column(key)[0].as_py() != held[0].column(key)[0].as_py():
                begin = np.r_[0, begin]
            if not len(begin):
                held.append(batch)
                continue
            last = int(begin[-1])
            ready += [*held, batch.slice(0, last)]
            held = [batch.slice(last)]
            if sum(x.num_rows for x in ready) >= ROWS:
                yield from made(pa.Table.from_batches(ready))
                ready = []
        if ready or held:
            yield from made(pa.Table.from_batches([*ready, *held]))

    return rows.where(F.col(key).isNotNull()).repartition(key).sortWithinPartitions(key, "seq").mapInArrow(run, fields)


def unmarshal_events(events: DataFrame, schema: XmlSchema, options: XmlOptions | None = None, key: str = "doc_id") -> DataFrame:
    """(key, value, ok, error) of a relation of events (key, seq, event, name, text, attrs), whatever made it: a document's
    events come together by one exchange, are read in order of seq, and no document is written. Null keys are left out."""
    one, options = _bound(schema), options or XmlOptions.of(events)
    rows = events.select(key, "seq", "event", "name", "text", "attrs")
    return _finished(_by_document(rows, lambda group: one(_events_of(group)), schema, options, key), {"value": schema})


def unmarshal_nodes(nodes: DataFrame, schema: XmlSchema, options: XmlOptions | None = None, key: str = "doc_id") -> DataFrame:
    """(key, value, ok, error) of a relation of nodes (key, node_id, parent_id, kind, name, value, attrs) in document order."""
    one, options = _bound(schema), options or XmlOptions.of(nodes)

    def events(group: list[dict]) -> Iterator[dict]:
        open_: list[tuple[int, str]] = []
        close = lambda: {"seq": 0, "event": END_ELEMENT, "name": open_.pop()[1], "text": None, "attrs": None}
        for r in group:
            while open_ and open_[-1][0] != r["parent_id"]:
                yield close()
            yield r
            if r["event"] == START_ELEMENT:
                open_.append((r["seq"], r["name"]))
        while open_:
            yield close()

    event = F.when(F.col("kind") == "ELEMENT", START_ELEMENT).otherwise(F.col("kind")).alias("event")
    rows = nodes.select(key, F.col("node_id").alias("seq"), "parent_id", event, "name", F.col("value").alias("text"), "attrs")
    return _finished(_by_document(rows, lambda group: one(_events_of(events(group))), schema, options, key), {"value": schema})


def entries_adapter(key: str = "key", item: str = "value") -> tuple[Callable[[Column], Column], Callable[[Column], Column]]:
    """Entry structures to a map (the last of equal keys wins) and back."""
    read = lambda c: F.map_from_entries(F.transform(F.filter(c, lambda e, i: ~F.exists(F.slice(c, i + 2, F.greatest(F.size(c) - i - 1, F.lit(0))), lambda later: later[key] == e[key])), lambda e: F.struct(e[key], e[item])))
    write = lambda c: F.transform(F.map_entries(c), lambda e: F.struct(e["key"].alias(key), e["value"].alias(item)))
    return read, write

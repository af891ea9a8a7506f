"""Documents to relations: events, status, elements and nodes.

``docs`` has a key column and a binary or string column. Only these two and the
columns asked for reach Python; one pass makes the relation, without a shuffle.
Plain documents are handled by array operations over whole batches (``Tokens``),
others one by one.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from xylem.functions.codecs import escape_attribute, escape_text
from xylem.operators.batches import CLOSE, EMPTY, OPEN, Tokens
from xylem.operators.scanner import BOM, CDATA, END_DOCUMENT, END_ELEMENT, START_DOCUMENT, START_ELEMENT, TEXT, Event, XmlError, scan
from xylem.options import XmlOptions

ATTRS = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.StringType())]))
_PAIRS = to_arrow_type(ATTRS)
_pairs = lambda pairs: [{"name": k, "value": v} for k, v in pairs]
#: Column, Spark type, and how an event, its ordinal and its section give it.
EVENT_COLUMNS: dict[str, tuple[T.DataType, Callable[[Event, int | None, str | None], object]]] = {
    "seq": (T.LongType(), lambda e, *_: e.seq),
    "event": (T.StringType(), lambda e, *_: e.event),
    "depth": (T.IntegerType(), lambda e, *_: e.depth),
    "name": (T.StringType(), lambda e, *_: e.name),
    "prefix": (T.StringType(), lambda e, *_: e.prefix),
    "local": (T.StringType(), lambda e, *_: e.local),
    "ns": (T.StringType(), lambda e, *_: e.ns),
    "text": (T.StringType(), lambda e, *_: e.text),
    "raw": (T.StringType(), lambda e, *_: e.raw if e.event in (TEXT, CDATA) else None),
    "attrs": (ATTRS, lambda e, *_: None if e.attrs is None else _pairs(e.attrs)),
    "raw_attrs": (ATTRS, lambda e, *_: None if e.attrs is None else _pairs(zip((k for k, _ in e.attrs), e.raw, strict=True))),
    "byte_start": (T.LongType(), lambda e, *_: e.byte_start),
    "byte_end": (T.LongType(), lambda e, *_: e.byte_end),
    "zero_copy": (T.BooleanType(), lambda e, *_: e.event in (TEXT, CDATA) and e.text == e.raw),
    "owner_seq": (T.LongType(), lambda e, *_: e.owner),
    "ordinal": (T.IntegerType(), lambda e, ordinal, section: ordinal),
    "section": (T.StringType(), lambda e, ordinal, section: section),
}
#: Bytes of documents that are handled at a time.
BATCH_BYTES = 2 << 20
#: What a function over a batch's tokens gives: documents that it handled, each row's document, and columns.
Made = tuple[np.ndarray, np.ndarray, list[pa.Array]]


def keyed(docs: DataFrame, key: str, content: str, *more: str) -> DataFrame:
    """(key, content as binary, more columns); strings enter as UTF-8."""
    column = F.col(content)
    if isinstance(docs.schema[content].dataType, T.StringType):
        column = F.encode(column, "UTF-8")
    return docs.select(F.col(key), column.alias("content"), *more)


def parts_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch of (key, content, ...) in slices of about BATCH_BYTES."""
    if batch.column(1).type != pa.binary():
        batch = batch.set_column(1, batch.schema.names[1], batch.column(1).cast(pa.binary()))
    ends = np.frombuffer(batch.column(1).buffers()[1], np.int32, batch.num_rows + 1, batch.column(1).offset * 4).astype(np.int64)
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + BATCH_BYTES, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def tokens_of(column: pa.Array, options: XmlOptions) -> Tokens:
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return Tokens(data[offsets[0] : offsets[-1]], offsets - offsets[0], column.is_valid().to_numpy(zero_copy_only=False), options)


class Maker:
    """Makes the rows of documents: ``plain`` over a batch's tokens, where it can; ``each`` of one document, which may raise;
    ``refused`` what then stands for it, in the modes that don't fail."""

    def __init__(self, fields: list[T.StructField], each: Callable[[bytes], Iterable[tuple]], plain: Callable[[Tokens], Made] | None = None, refused: Callable[[Exception], Iterable[tuple]] | None = None, options: XmlOptions | None = None):
        self.fields, self.each, self.plain, self.refused = fields, each, plain, refused or (lambda _: ())
        self.options = options or XmlOptions()
        self.types = [to_arrow_type(f.dataType) for f in fields]

    def one(self, raw: bytes) -> list[tuple]:
        try:
            return list(self.each(raw))
        except Exception as e:  # whatever a document brings about is that document's error
            return self._failed(e)

    def _failed(self, e: Exception) -> list[tuple]:
        if self.options.mode == "FAILFAST":
            raise e
        return list(self.refused(e)) if self.options.mode == "PERMISSIVE" else []

    def _columns(self, rows: list[tuple]) -> list[pa.Array]:
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(self.fields)
        return [pa.array(c, t) for c, t in zip(columns, self.types, strict=True)]

    def batches(self, column: pa.Array) -> Iterator[tuple[np.ndarray, list[pa.Array]]]:
        """For a slice of contents: rows' documents, and columns."""
        rest = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
        if self.plain:
            tokens = tokens_of(column, self.options)
            try:
                done, at, columns = self.plain(tokens) if len(tokens) else (rest[:0], rest[:0], [])
            except (pa.ArrowException, ValueError, TypeError, OverflowError):  # one by one shows whose fault it is
                done, at = rest[:0], rest[:0]
            if len(at):
                yield at, columns
            rest = rest[~np.isin(rest, done)]
        at, rows = [], []
        for i in rest.tolist():
            found = self.one(column[i].as_py())
            at += [i] * len(found)
            rows += found
        if not rows:
            return
        try:
            yield np.array(at), self._columns(rows)
        except (pa.ArrowException, ValueError, TypeError, OverflowError):
            for i in dict.fromkeys(at):  # a value that its column can't hold
                own = [r for j, r in zip(at, rows, strict=True) if j == i]
                try:
                    columns = self._columns(own)
                except (pa.ArrowException, ValueError, TypeError, OverflowError) as e:
                    own = self._failed(e)
                    columns = self._columns(own)
                yield np.full(len(own), i), columns


def per_document(docs: DataFrame, made: Maker, key: str = "doc_id", content: str = "content") -> DataFrame:
    """The rows that are made of each document, after its key. Null documents make none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [key, *(f.name for f in made.fields)]
        for batch in batches:
            for part in parts_of(batch):
                for at, columns in made.batches(part.column(1)):
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int64())), *columns], names=names)

    return keyed(docs, key, content).mapInArrow(run, T.StructType([docs.schema[key], *made.fields]))


# ---- events

_KINDS = pa.array([START_DOCUMENT, START_ELEMENT, TEXT, END_ELEMENT, END_DOCUMENT])
_BEGIN, _START, _CHUNK, _STOP, _FINISH = range(5)


class _Rows:
    """The events of a batch's plain documents: for each its kind, its tag and its number."""

    def __init__(self, t: Tokens):
        n_text = t.has_text.astype(np.int64)
        per = n_text + np.select([t.kind == EMPTY, (t.kind == OPEN) | (t.kind == CLOSE)], [2, 1], 0)
        before = np.cumsum(per) - per
        size = np.bincount(t.place, per, len(t.docs)).astype(np.int64) + 2
        self.begin = np.cumsum(size) - size
        at = before + 2 * t.place + 1
        total = int(size.sum())
        self.kind, self.tag = np.zeros(total, np.int8), np.zeros(total, np.int64)
        self.place = np.repeat(np.arange(len(t.docs)), size)
        chunk, start = np.flatnonzero(t.has_text), np.flatnonzero(t.starts)
        stop, empty = np.flatnonzero(t.kind == CLOSE), np.flatnonzero(t.kind == EMPTY)
        for kind, tags, where in ((_CHUNK, chunk, at[chunk]), (_START, start, at[start] + n_text[start]), (_STOP, stop, at[stop] + n_text[stop]), (_STOP, empty, at[empty] + n_text[empty] + 1)):
            self.kind[where], self.tag[where] = kind, tags
        self.tag[self.begin], self.tag[self.begin + size - 1] = t.first, t.first
        self.kind[self.begin + size - 1] = _FINISH
        self.seq = np.arange(total) - np.repeat(self.begin, size)
        #: Of each start tag, the number of its event.
        self.start_seq = np.zeros(len(t) + 1, np.int64)
        self.start_seq[start] = at[start] + n_text[start] - self.begin[t.place[start]]


def _ranks(owner: np.ndarray) -> np.ndarray:
    """For each element its number among those with the same owner before it."""
    order = np.argsort(owner, kind="stable")
    first = np.flatnonzero(np.r_[True, np.diff(owner[order]) != 0][: len(order)])
    out = np.empty(len(owner), np.int64)
    out[order] = np.arange(len(owner)) - np.repeat(first, np.diff(np.r_[first, len(owner)]))
    return out


def _event_columns(t: Tokens, chosen: list[str], wanted: frozenset[str] | None) -> Made:
    rows = _Rows(t)
    pick = np.arange(len(rows.kind)) if wanted is None else np.flatnonzero(np.isin(rows.kind, [i for i, k in enumerate(_KINDS.to_pylist()) if k in wanted]))
    kind, tag, place = rows.kind[pick], rows.tag[pick], rows.place[pick]
    named, chunk = (kind == _START) | (kind == _STOP), kind == _CHUNK
    head = np.where(kind == _STOP, t.partner[tag], tag)  # the start tag of a start or end
    edge = (kind == _BEGIN) | (kind == _FINISH)
    owner = lambda tags, k: np.select([k == _START, k == _STOP, k == _CHUNK], [t.parent[tags], t.partner[tags], t.owner[tags]], -1)
    shaped = lambda of: t.shaped(of, pa.string(), t.shape[head], ~named)

    def texts(raw: bool) -> pa.Array:
        found = t.texts(tag[chunk], raw)
        return found.take(pa.array(np.cumsum(chunk) - 1, mask=~chunk))

    def offsets(of_tag: np.ndarray, of_text: np.ndarray, at_end: bool) -> pa.Array:
        base = t.first_offset[t.docs[place]]
        size = np.where(kind == _FINISH, t.size[t.docs[place]], 0)
        return pa.array(np.select([named, chunk], [of_tag[tag] - base, of_text[tag] - base], size))

    def ordinals() -> pa.Array:
        node = (rows.kind == _START) | (rows.kind == _CHUNK)
        at = np.flatnonzero(node)
        own = owner(rows.tag[at], rows.kind[at])
        out = np.zeros(len(rows.kind), np.int64)
        out[at] = _ranks(np.where(own < 0, -1 - rows.place[at], own))
        return pa.array(out[pick], pa.int32(), mask=~node[pick])

    def owner_seq() -> pa.Array:
        own = owner(tag, kind)
        return pa.array(rows.start_seq[own], pa.int64(), mask=edge | (own < 0))

    make = {
        "seq": lambda: pa.array(rows.seq[pick]),
        "event": lambda: _KINDS.take(pa.array(kind)),
        "depth": lambda: pa.array(np.select([named, chunk], [t.level[head], t.before[tag]], 0), pa.int32()),
        "name": lambda: shaped(lambda s: s.name),
        "prefix": lambda: shaped(lambda s: s.prefix),
        "local": lambda: shaped(lambda s: s.local),
        "ns": lambda: t.space.take(pa.array(head, mask=~named)),
        "text": lambda: texts(False),
        "raw": lambda: texts(True),
        "attrs": lambda: t.shaped(lambda s: _pairs(s.attrs), _PAIRS, t.shape[tag], kind != _START),
        "raw_attrs": lambda: t.shaped(lambda s: _pairs(zip((k for k, _ in s.attrs), s.raws, strict=True)), _PAIRS, t.shape[tag], kind != _START),
        "byte_start": lambda: offsets(t.at, t.text_at, False),
        "byte_end": lambda: offsets(t.end, t.at, True),
        "zero_copy": lambda: pa.array(chunk & t.plain_text(tag)),
        "owner_seq": owner_seq,
        "ordinal": ordinals,
        "section": lambda: pa.array(["root"]).take(pa.array(np.zeros(len(kind), np.int64), mask=edge)),
    }
    return t.docs, t.docs[place], [make[c]() for c in chosen]


def _placed(events: Iterable[Event]) -> Iterator[tuple[Event, int | None, str | None]]:
    """Events with their ordinals among the nodes around them, and their sections."""
    count: dict[int | None, int] = {}
    section = "prolog"
    for e in events:
        if e.event == START_ELEMENT and e.depth == 1:
            section = "root"
        if e.event in (START_DOCUMENT, END_DOCUMENT):
            yield e, None, None
        elif e.event == END_ELEMENT:
            yield e, None, section
            section = "epilog" if e.depth == 1 else section
        else:
            yield e, count.get(e.owner, 0), section
            count[e.owner] = count.get(e.owner, 0) + 1


def xml_events(docs: DataFrame, options: XmlOptions | None = None, columns: list[str] | None = None, events: list[str] | None = None, key: str = "doc_id", content: str = "content") -> DataFrame:
    """One row for each event of each document, in document order by seq. columns and events narrow what is made, inside
    the scan. PERMISSIVE and DROPMALFORMED give no events of a malformed document; FAILFAST fails the job."""
    options = options or XmlOptions.of(docs)
    chosen = columns or [c for c in EVENT_COLUMNS if c != "raw_attrs"]
    makers = [EVENT_COLUMNS[c][1] for c in chosen]
    wanted = frozenset(events) if events else None

    def each(data: bytes) -> Iterable[tuple]:
        return [tuple(m(*e) for m in makers) for e in _placed(scan(data, options)) if wanted is None or e[0].event in wanted]

    fields = [T.StructField(c, EVENT_COLUMNS[c][0]) for c in chosen]
    return per_document(docs, Maker(fields, each, lambda t: _event_columns(t, chosen, wanted), options=options), key, content)


STATUS = [T.StructField("ok", T.BooleanType()), T.StructField("error", T.StringType()), T.StructField("byte_offset", T.LongType())]


def xml_status(docs: DataFrame, options: XmlOptions | None = None, key: str = "doc_id", content: str = "content", declaration: bool = False) -> DataFrame:
    """Whether each document is accepted, else why not and where; never fails. declaration: a declaration in front has to be
    well-formed as well, as for a tree."""
    options = options or XmlOptions.of(docs)

    def each(data: bytes) -> Iterable[tuple]:
        try:
            if declaration:
                check_declaration(data)
            for _ in scan(data, options):
                pass
            return [(True, None, None)]
        except XmlError as e:
            return [(False, str(e), e.offset)]

    def plain(t: Tokens) -> Made:
        done = t.docs[t.kind[t.first] != 0] if declaration else t.docs
        n = len(done)
        return done, done, [pa.array(np.ones(n, bool)), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64())]

    return per_document(docs, Maker(STATUS, each, plain, lambda e: [(False, str(e), None)], options.with_(mode="PERMISSIVE")), key, content)


_ELEMENT = [("start_seq", T.LongType()), ("end_seq", T.LongType()), ("parent_seq", T.LongType()), ("ordinal", T.IntegerType()), ("depth", T.IntegerType()), ("name", T.StringType()), ("local", T.StringType()), ("ns", T.StringType()), ("attrs", ATTRS), ("text", T.StringType()), ("n_chunks", T.IntegerType()), ("zero_copy", T.BooleanType())]
_PATH = T.ArrayType(T.StructType([T.StructField("seq", T.LongType()), T.StructField("name", T.StringType())]))


def _subtree_texts(t: Tokens, starts: np.ndarray) -> pa.Array:
    """All text in each element, in order; null where there is none."""
    chunks = np.flatnonzero(t.has_text)
    texts = t.texts(chunks).cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    a, b = np.searchsorted(chunks, starts, "right"), np.searchsorted(chunks, t.partner[starts], "right")
    size = ends[b] - ends[a]
    total = np.r_[0, np.cumsum(size)]
    gathered = data[np.arange(total[-1]) + np.repeat(ends[a] - total[:-1], size)]
    full = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(total), pa.py_buffer(gathered)])
    return full.take(pa.array(np.arange(len(starts)), mask=a == b)).cast(pa.string())


def _element_columns(t: Tokens, path: bool) -> Made:
    rows = _Rows(t)
    starts = np.flatnonzero(t.starts)
    parent = t.parent[starts]
    chunks = np.flatnonzero(t.has_text)
    own = np.bincount(t.owner[chunks], minlength=len(t))
    coded = np.bincount(t.owner[chunks[~t.plain_text(chunks)]], minlength=len(t))
    end = np.zeros(len(t), np.int64)
    stop = rows.kind == _STOP
    end[t.partner[rows.tag[stop]]] = rows.seq[stop]
    shaped = lambda of, kind: t.shaped(of, kind, t.shape[starts])
    columns = [
        pa.array(rows.start_seq[starts]), pa.array(end[starts]), pa.array(rows.start_seq[parent], mask=parent < 0),
        pa.array(_ranks(np.where(parent < 0, -1 - t.place[starts], parent)), pa.int32()), pa.array(t.level[starts], pa.int32()),
        shaped(lambda s: s.name, pa.string()), shaped(lambda s: s.local, pa.string()), t.space.take(pa.array(starts)), shaped(lambda s: _pairs(s.attrs), _PAIRS),
        _subtree_texts(t, starts), pa.array(own[starts], pa.int32()), pa.array((own[starts] == 1) & (coded[starts] == 0)),
    ]
    if path:
        size = t.level[starts] - 1
        ends = np.r_[0, np.cumsum(size)]
        above, at, k = np.zeros(ends[-1], np.int64), parent, 1
        while (more := np.flatnonzero(size >= k)).size:  # the k-th element above
            above[ends[more + 1] - k] = at[more]
            at, k = t.parent[at], k + 1
        values = pa.StructArray.from_arrays([pa.array(rows.start_seq[above]), t.shaped(lambda s: s.name, pa.string(), t.shape[above])], names=["seq", "name"])
        columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values))
    return t.docs, t.docs[t.place[starts]], columns


def xml_elements(docs: DataFrame, options: XmlOptions | None = None, key: str = "doc_id", content: str = "content", path: bool = False) -> DataFrame:
    """One row for each element: its interval of seq, parent, names, attributes, descendant text (null where there is no
    chunk at all), number of own chunks, and whether its own text is one plain chunk; with path, the elements around it."""
    options = options or XmlOptions.of(docs)
    fields = [T.StructField(n, t) for n, t in _ELEMENT] + [T.StructField("path", _PATH)] * path

    def each(data: bytes) -> Iterable[tuple]:
        out: list[list] = []
        open_: list[list] = []  # row, chunks of descendants, own chunks, plain, children
        children = 0
        for e in scan(data, options):
            if e.event == START_ELEMENT:
                if open_:
                    ordinal, open_[-1][4] = open_[-1][4], open_[-1][4] + 1
                else:
                    ordinal, children = children, children + 1
                row = [e.seq, None, e.owner, ordinal, e.depth, e.name, e.local, e.ns, _pairs(e.attrs), None, 0, False]
                if path:
                    row.append([{"seq": x[0][0], "name": x[0][5]} for x in open_])
                out.append(row)
                open_.append([row, [], 0, True, 0])
            elif e.event in (TEXT, CDATA):
                open_[-1][1].append(e.text)
                open_[-1][2] += 1
                open_[-1][3] &= e.event == TEXT and e.text == e.raw
            elif e.event == END_ELEMENT:
                row, chunks, own, plain, _ = open_.pop()
                row[1] = e.seq
                row[9] = "".join(chunks) if chunks else None
                row[10], row[11] = own, plain and own == 1
                if open_ and chunks:
                    open_[-1][1].append(row[9])
        return list(map(tuple, out))

    return per_document(docs, Maker(fields, each, lambda t: _element_columns(t, path), options=options), key, content)


def xml_nodes(events: DataFrame, key: str = "doc_id") -> DataFrame:
    """The tree of a relation of events as nodes: node_id (the seq of the event), parent_id, ordinal among its siblings,
    depth, kind, name, value, attrs and section (prolog, root or epilog). The scan's relation has all of that; of other
    relations, which lack ordinal or section, windows make it."""
    rows = events.where(~F.col("event").isin(START_DOCUMENT, END_DOCUMENT, END_ELEMENT))
    kind = F.when(F.col("event") == START_ELEMENT, "ELEMENT").otherwise(F.col("event"))
    ready = {"ordinal", "section"} <= set(events.columns)
    ordinal = F.col("ordinal") if ready else F.row_number().over(Window.partitionBy(key, "owner_seq").orderBy("seq")) - 1
    more = ["section"] if ready else []
    rows = rows.select(F.col(key), F.col("seq").alias("node_id"), F.col("owner_seq").alias("parent_id"), ordinal.alias("ordinal"), "depth", kind.alias("kind"), "name", F.col("text").alias("value"), "attrs", *more)
    if ready:
        return rows
    root = F.min(F.when((F.col("kind") == "ELEMENT") & F.col("parent_id").isNull(), F.col("node_id"))).over(Window.partitionBy(key))
    inside = F.col("parent_id").isNotNull() | (F.col("node_id") == root)
    return rows.withColumn("section", F.when(inside, "root").when(F.col("node_id") < root, "prolog").otherwise("epilog"))


def children(nodes: DataFrame, name: str | None = None, key: str = "doc_id") -> DataFrame:
    """(key, parent_id, child columns) of element children, by name if given."""
    found = nodes.where("kind = 'ELEMENT' and parent_id is not null")
    return found.where(F.col("name") == name) if name else found


def first_child(nodes: DataFrame, name: str, key: str = "doc_id") -> DataFrame:
    """For each parent its first child element of that name: (key, parent_id, node_id)."""
    return children(nodes, name, key).groupBy(key, "parent_id").agg(F.min_by("node_id", "ordinal").alias("node_id"))


def descendants(elements: DataFrame, key: str = "doc_id") -> DataFrame:
    """Pairs of elements that contain each other: (key, ancestor, ancestor_name, descendant, descendant_name), from the paths
    of a relation of elements."""
    pairs = elements.select(F.col(key), F.explode("path").alias("above"), F.col("start_seq").alias("descendant"), F.col("name").alias("descendant_name"))
    return pairs.select(key, F.col("above.seq").alias("ancestor"), F.col("above.name").alias("ancestor_name"), "descendant", "descendant_name")


def events_to_documents(events: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, content): documents rebuilt from a relation of their events (seq, event, name, text, attrs), whatever made it, so
    that events of other sources can be bound. Empty elements get end tags; declarations are not kept."""
    attrs = F.array_join(F.transform("attrs", lambda a: F.concat(F.lit(" "), a["name"], F.lit('="'), escape_attribute(a["value"]), F.lit('"'))), "")
    name, text = F.col("name"), F.col("text")
    kind = F.col("event")
    piece = F.when(kind == "START_ELEMENT", F.concat(F.lit("<"), name, F.coalesce(attrs, F.lit("")), F.lit(">"))).when(kind == "END_ELEMENT", F.concat(F.lit("</"), name, F.lit(">"))).when(kind == TEXT, escape_text(text))
    piece = piece.when(kind == CDATA, F.concat(F.lit("<![CDATA["), text, F.lit("]]>"))).when(kind == "COMMENT", F.concat(F.lit("<!--"), text, F.lit("-->"))).when(kind == "PROCESSING_INSTRUCTION", F.concat(F.lit("<?"), name, F.lit(" "), text, F.lit("?>")))
    made = events.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("seq", piece.alias("piece")))).alias("pieces"))
    return made.select(key, F.array_join(F.transform("pieces", lambda x: x["piece"]), "").alias("content"))


def root_qname(docs: DataFrame, key: str = "doc_id", content: str = "content", options: XmlOptions | None = None, max_depth: int = 64) -> DataFrame:
    """(prefix, local, ns) of each root, read up to its start tag only; what follows is not looked at."""
    options = (options or XmlOptions.of(docs)).with_(max_depth=max_depth)

    def each(data: bytes) -> Iterable[tuple]:
        e = next(e for e in scan(data, options) if e.event == START_ELEMENT)
        return [(e.prefix, e.local, e.ns)]

    def plain(t: Tokens) -> Made:
        at = np.flatnonzero(t.starts & (t.level == 1))
        shaped = lambda of: t.shaped(of, pa.string(), t.shape[at])
        return t.docs, t.docs, [shaped(lambda s: s.prefix), shaped(lambda s: s.local), t.space.take(pa.array(at))]

    return per_document(docs, Maker([T.StructField(n, T.StringType()) for n in ("prefix", "local", "ns")], each, plain, lambda _: [(None, None, None)], options), key, content)


_DECLARED = re.compile(rb"<\?xml\s+version\s*=\s*(?:\"1[.][01]\"|'1[.][01]')(?:\s+encoding\s*=\s*(?:\"(?i:utf-8)\"|'(?i:utf-8)'))?(?:\s+standalone\s*=\s*(?:\"(?:yes|no)\"|'(?:yes|no)'))?\s*\?>")


def check_declaration(data: bytes) -> None:
    """An error where a declaration is not of version 1.0 or 1.1, UTF-8, and yes or no standalone."""
    begin = 3 if data.startswith(BOM) else 0
    if data[begin : begin + 5].lower() == b"<?xml" and data[begin + 5 : begin + 6] in (b" ", b"\t", b"\r", b"\n", b"?") and not _DECLARED.match(data, begin):
        raise XmlError("Malformed XML declaration", begin)

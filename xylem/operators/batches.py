"""The strict grammar over whole batches of documents, by array operations.

Documents whose markup is tags alone (and a declaration in front) are cut at
their ``<`` and ``>``; each distinct tag of a batch is parsed once, by the rules
of ``scanner.scan``; depths, matching end tags, parents and texts come from
sorts and running sums. A document that holds anything else, or breaks a rule,
is not *plain* and is left to ``scan``, which has the last word on all errors.
What is made here for a plain document is what ``scan`` would give.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from xylem.functions.hashing import named_spans
from xylem.operators.scanner import _ATTRIBUTE, _CLOSE, _OPEN, _OPEN_END, _TARGET, BOM, END_ELEMENT, START_ELEMENT, TEXT, XML_NS, Event, XmlError, decode
from xylem.options import XmlOptions

BAD, DECLARATION, OPEN, CLOSE, EMPTY = range(-1, 4)
#: Distinct tags that a worker remembers, and prefixes that a batch may declare.
SHAPES, PREFIXES = 50_000, 64
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 13, 32]] = True


@dataclass(frozen=True)
class Shape:
    """A distinct tag."""

    kind: int
    name: str = ""
    attrs: tuple[tuple[str, str], ...] = ()
    raws: tuple[str, ...] = ()

    @property
    def local(self) -> str:
        return self.name.rpartition(":")[2]

    @property
    def prefix(self) -> str:
        return self.name.rpartition(":")[0]

    @property
    def space_prefix(self) -> str:
        return self.name.partition(":")[0] if ":" in self.name else ""

    @cached_property
    def declares(self) -> dict[str, str]:
        return {k[6:]: v for k, v in self.attrs if k == "xmlns" or k.startswith("xmlns:")}


_shapes: dict[bytes, Shape] = {}


def _parse(raw: bytes) -> Shape:
    try:
        if raw[1:2] == b"?":
            target = _TARGET.match(raw, 2, len(raw) - 2)
            return Shape(DECLARATION if raw.endswith(b"?>") and target and target[0].lower() == b"xml" else BAD)
        if raw[1:2] == b"/":
            m = _CLOSE.fullmatch(raw)
            return Shape(CLOSE, m[1].decode()) if m else Shape(BAD)
        m = _OPEN.match(raw)
        if m is None:
            return Shape(BAD)
        at, attrs, raws = m.end(), [], []
        while (end := _OPEN_END.match(raw, at)) is None:
            a = _ATTRIBUTE.match(raw, at)
            if a is None or not a[1]:
                return Shape(BAD)
            text = a[3][1:-1].decode()
            attrs.append((a[2].decode(), decode(text, 0)))
            raws.append(text)
            at = a.end()
        if end.end() != len(raw) or len({k for k, _ in attrs}) < len(attrs):
            return Shape(BAD)
        return Shape(EMPTY if end[1] else OPEN, m[1].decode(), tuple(attrs), tuple(raws))
    except (XmlError, UnicodeDecodeError):
        return Shape(BAD)


def shape_of(raw: bytes) -> Shape:
    if (found := _shapes.get(raw)) is None:
        if len(_shapes) >= SHAPES:
            _shapes.clear()
        found = _shapes[raw] = _parse(raw)
    return found


def _utf8(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which documents are UTF-8."""
    n = len(offsets) - 1
    ok = np.ones(n, bool)
    if not len(data) or data.max() < 128:
        return ok
    try:
        data.tobytes().decode()
    except UnicodeDecodeError:
        for i in range(n):
            try:
                data[offsets[i] : offsets[i + 1]].tobytes().decode()
            except UnicodeDecodeError:
                ok[i] = False
        return ok
    # a character may not reach over a document's end
    inside = np.flatnonzero((np.diff(offsets) > 0) & ((data[np.minimum(offsets[:-1], len(data) - 1)] & 0xC0) == 0x80))
    for i in inside.tolist():
        ok[i] = False
        ok[np.searchsorted(offsets, offsets[i], "left") - 1] = False
    return ok


def _filled(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which spans hold more than blanks."""
    size = ends - starts
    total = np.r_[0, np.cumsum(size)]
    seen = np.r_[0, np.cumsum(~_BLANK[data[np.arange(total[-1]) + np.repeat(starts - total[:-1], size)]])]
    return seen[total[1:]] > seen[total[:-1]]


class Tokens:
    """The tags of a batch's plain documents, in order, each with the text before it."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, valid: np.ndarray, options: XmlOptions):
        n = len(offsets) - 1
        self.data, self.size, self.first_offset = data, np.diff(offsets), offsets[:-1]
        plain = valid & (self.size > 0) & (self.size <= options.capacity) & _utf8(data, offsets)
        begin = offsets[:-1].copy()
        marked = np.flatnonzero(plain & (self.size >= 3))
        marked = marked[(data[begin[marked]] == BOM[0]) & (data[begin[marked] + 1] == BOM[1]) & (data[begin[marked] + 2] == BOM[2])]
        begin[marked] += 3
        at, to = np.flatnonzero(data == 60), np.flatnonzero(data == 62)
        doc, doc_to = np.searchsorted(offsets, at, "right") - 1, np.searchsorted(offsets, to, "right") - 1
        count = np.bincount(doc, minlength=n)
        plain &= (count == np.bincount(doc_to, minlength=n)) & (count > 0)
        some = plain[doc]
        at, doc, to = at[some], doc[some], to[plain[doc_to]]
        second = data[np.minimum(at + 1, len(data) - 1)]
        bad = (at >= to) | np.r_[to[:-1] >= at[1:], np.zeros(min(1, len(at)), bool)] | (second == 33) | ((second == 63) & (at != begin[doc]))
        plain[doc[bad]] = False
        some = plain[doc]
        at, doc, end = at[some], doc[some], to[some] + 1
        # distinct tags
        names, checks = named_spans(data, at, end)
        _, one, shape = np.unique(names, return_index=True, return_inverse=True)
        self.shapes = [shape_of(data[at[i] : end[i]].tobytes()) for i in one.tolist()]
        kind = self.per_shape(lambda s: s.kind, np.int8)[shape]
        plain[doc[(kind == BAD) | (checks != checks[one][shape])]] = False
        prefixes = sorted({p for s in self.shapes for p in s.declares})
        if len(prefixes) > PREFIXES:
            plain[doc[self.per_shape(lambda s: not set(s.declares) <= set(prefixes[:PREFIXES]), bool)[shape]]] = False
        self.prefixes = prefixes[:PREFIXES]
        # depths
        step = (kind == OPEN).astype(np.int64) - (kind == CLOSE)
        first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]][: len(doc)])
        counts = np.diff(np.r_[first, len(doc)])
        total = np.cumsum(step)
        before = total - step
        before -= np.repeat(before[first], counts)
        level = np.where(kind == CLOSE, before, before + 1)
        element = kind != DECLARATION
        plain[doc[element & (level < 1) | (kind == OPEN) & (before >= options.max_depth)]] = False
        last = first + counts - 1
        plain[doc[last[(before + step)[last] != 0]]] = False
        plain &= np.bincount(doc[(level == 1) & ((kind == OPEN) | (kind == EMPTY))], minlength=n) == 1
        # start and end tags alternate among the tags of a document and level
        of = {name: i for i, name in enumerate(sorted({s.name for s in self.shapes}))}
        self.names = list(of)
        name = self.per_shape(lambda s: of[s.name], np.int64)[shape]
        some = np.flatnonzero(element)
        order = some[np.argsort(doc[some] * (int(level.max(initial=0)) + 2) + level[some], kind="stable")]
        close = np.flatnonzero(kind[order] == CLOSE)
        start, stop = order[np.maximum(close - 1, 0)], order[close]
        apart = (close == 0) | (kind[start] != OPEN) | (level[start] != level[stop]) | (doc[start] != doc[stop]) | (name[start] != name[stop])
        plain[doc[stop[apart]]] = False
        start, stop = start[~apart], stop[~apart]
        partner = np.arange(len(doc))
        partner[stop], partner[start] = start, stop
        # the text before each tag
        text_at = np.r_[0, end[:-1]][: len(end)]
        text_at[first] = begin[doc[first]]
        outside = np.flatnonzero((before == 0) & (at > text_at))
        plain[doc[outside[_filled(data, text_at[outside], at[outside])]]] = False
        plain[doc[last[_filled(data, end[last], offsets[doc[last] + 1])]]] = False
        has_text = (before > 0) & (at > text_at)
        amp = np.flatnonzero(data == 38)
        k = np.searchsorted(at, amp, "right")
        k = np.unique(k[(k < len(at)) & (amp >= text_at[np.minimum(k, len(at) - 1)])]) if len(at) else k[:0]
        coded: dict[int, str] = {}
        for i in k[has_text[k] & plain[doc[k]]].tolist():
            try:
                coded[i] = decode(data[text_at[i] : at[i]].tobytes().decode(), 0)
            except XmlError:
                plain[doc[i]] = False
        # only plain documents stay
        keep = plain[doc]
        new = np.cumsum(keep) - 1
        self.plain, self.docs = plain, np.flatnonzero(plain)
        self.doc, self.at, self.end, self.kind, self.shape, self.name = doc[keep], at[keep], end[keep], kind[keep], shape[keep], name[keep]
        self.level, self.before, self.text_at, self.has_text = level[keep], before[keep], text_at[keep], has_text[keep]
        self.partner = new[partner[keep]]
        self.coded = {int(new[i]): x for i, x in coded.items() if keep[i]}
        self.first = np.flatnonzero(np.r_[True, self.doc[1:] != self.doc[:-1]][: len(self.doc)])
        #: For each tag, the place of its document among the plain ones.
        self.place = np.repeat(np.arange(len(self.docs)), np.diff(np.r_[self.first, len(self.doc)]))

    def __len__(self) -> int:
        return len(self.doc)

    def per_shape(self, of, kind) -> np.ndarray:
        return np.array([of(s) for s in self.shapes], kind) if self.shapes else np.zeros(0, kind)

    def shaped(self, of, kind: pa.DataType, shapes: np.ndarray, mask: np.ndarray | None = None) -> pa.Array:
        """of(shape) for each of the shapes' numbers, null where the mask says so."""
        values = pa.array([of(s) for s in self.shapes], kind)
        return values.take(pa.array(shapes, mask=mask))

    @cached_property
    def starts(self) -> np.ndarray:
        """Which tags start an element."""
        return (self.kind == OPEN) | (self.kind == EMPTY)

    @cached_property
    def _opens(self) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.kind == OPEN)
        key = (self.place[at] * (int(self.level.max(initial=0)) + 2) + self.level[at]) << 32 | at
        order = np.argsort(key)
        return key[order], at[order]

    def enclosing(self, tags: np.ndarray, level: np.ndarray) -> np.ndarray:
        """For each of the tags, the last start tag of the given level before it in its document; -1 for level 0."""
        key, at = self._opens
        if not len(at):
            return np.full(len(tags), -1)
        ask = (self.place[tags] * (int(self.level.max(initial=0)) + 2) + level) << 32 | tags
        return np.where(level > 0, at[np.maximum(np.searchsorted(key, ask) - 1, 0)], -1)

    @cached_property
    def parent(self) -> np.ndarray:
        """Of each start tag, the start tag of the element around it (-1: none); of an end tag, its own start tag."""
        out = np.full(len(self), -1)
        at = np.flatnonzero(self.starts)
        out[at] = self.enclosing(at, self.level[at] - 1)
        stop = self.kind == CLOSE
        out[stop] = self.partner[stop]
        return out

    @cached_property
    def owner(self) -> np.ndarray:
        """The start tag of the element that the text before each tag stands in."""
        return self.enclosing(np.arange(len(self)), self.before)

    def texts(self, tags: np.ndarray, raw: bool = False) -> pa.Array:
        """The text before each of the tags, references resolved unless raw; null where there is none."""
        if not len(tags):
            return pa.array([], pa.string())
        ends = np.empty(2 * len(self) + 1, np.int64)
        ends[0:-1:2], ends[1::2], ends[-1] = self.text_at, self.at, self.at[-1] if len(self) else 0
        # spans between the texts are values as well, so that all lie in a row
        every = pa.Array.from_buffers(pa.large_string(), 2 * len(self), [None, pa.py_buffer(np.maximum.accumulate(ends)), pa.py_buffer(self.data)])
        out = every.take(pa.array(2 * tags, mask=~self.has_text[tags])).cast(pa.string())
        if raw or not self.coded:
            return out
        coded = np.fromiter(self.coded, np.int64, len(self.coded))
        mask = np.isin(tags, coded)
        return pc.replace_with_mask(out, pa.array(mask), pa.array([self.coded[t] for t in tags[mask].tolist()], pa.string())) if mask.any() else out

    def plain_text(self, tags: np.ndarray) -> np.ndarray:
        """Whether the text before each of the tags holds no reference."""
        coded = np.zeros(len(self), bool)
        coded[list(self.coded)] = True
        return ~coded[tags]

    @cached_property
    def space(self) -> pa.Array:
        """The namespace of each start tag's name: empty for none, null for an unbound prefix; null for other tags."""
        uris: list[str | None] = ["", None, XML_NS]
        starts = np.flatnonzero(self.starts)
        prefix = self.per_shape(lambda s: s.space_prefix, object)[self.shape] if len(self) else np.zeros(0, object)
        out = np.full(len(self), 1)
        out[starts] = np.where(prefix[starts] == "", 0, np.where(prefix[starts] == "xml", 2, 1))
        levels = self.level[starts]
        by_level = np.split(starts[np.argsort(levels, kind="stable")], np.cumsum(np.bincount(levels))[:-1]) if len(starts) else []
        for p in self.prefixes:
            asked = starts[prefix[starts] == p]
            if not len(asked):
                continue
            own = np.array([uris.append(s.declares[p]) or len(uris) - 1 if p in s.declares else -1 for s in self.shapes])
            value = np.full(len(self) + 1, -1)
            value[starts] = own[self.shape[starts]]
            for tags in by_level:
                missing = tags[value[tags] < 0]
                value[missing] = value[self.parent[missing]]  # -1 is the last place, which stays -1
            found = value[asked]
            out[asked[found >= 0]] = found[found >= 0]
        return pa.array(uris, pa.string()).take(pa.array(out))

    def element_events(self) -> Iterator[Iterator[Event]]:
        """For each plain document its starts, texts and ends, without their places in the document."""
        kinds, shapes, levels = self.kind.tolist(), self.shape.tolist(), self.level.tolist()
        spaces, texts = self.space.to_pylist(), self.texts(np.arange(len(self))).to_pylist()
        attrs, declares = [list(s.attrs) for s in self.shapes], [s.declares for s in self.shapes]
        names = [s.name for s in self.shapes]

        def of(first: int, last: int) -> Iterator[Event]:
            scopes: list[dict[str, str]] = [{"xml": XML_NS}]
            for i in range(first, last):
                kind, shape, level = kinds[i], shapes[i], levels[i]
                if texts[i] is not None:
                    yield Event(0, TEXT, level, None, None, texts[i], texts[i], None, 0, 0, None, None)
                if kind == CLOSE:
                    scopes.pop()
                    yield Event(0, END_ELEMENT, level, names[shape], None, None, None, None, 0, 0, None, None)
                elif kind != DECLARATION:
                    scope = {**scopes[-1], **declares[shape]} if declares[shape] else scopes[-1]
                    yield Event(0, START_ELEMENT, level, names[shape], spaces[i], None, None, attrs[shape], 0, 0, None, scope)
                    if kind == EMPTY:
                        yield Event(0, END_ELEMENT, level, names[shape], None, None, None, None, 0, 0, None, None)
                    else:
                        scopes.append(scope)

        for first, last in zip(self.first.tolist(), [*self.first[1:].tolist(), len(self)], strict=True):
            yield of(first, last)

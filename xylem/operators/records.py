"""Message projections: one record for each document, made inside the scan, so nothing is shuffled.

Plain documents in which the wanted elements are leaves are projected by array
operations over whole batches; all others, and all that are refused, one by one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from xylem.functions.codecs import TRIMMED
from xylem.functions.guards import detect_profile
from xylem.operators.batches import OPEN, Tokens
from xylem.operators.events import Made, Maker, keyed, parts_of, per_document
from xylem.operators.scanner import CDATA, END_ELEMENT, START_ELEMENT, TEXT, Event, XmlError, scan
from xylem.options import PROFILE_NAMES, XmlOptions

# Message roots and the protocol each belongs to.
PAYMENT_TYPES = {
    "CstmrCdtTrfInitn": "SEPA",
    "CstmrPmtStsRpt": "SEPA",
    "FIToFICstmrCdtTrf": "ISO_20022",
    "FIToFIPmtStsRpt": "ISO_20022",
    "BkToCstmrStmt": "ISO_20022",
    "BkToCstmrDbtCdtNtfctn": "ISO_20022",
}
#: Protocols that are named but never produced.
DECLARED_PROTOCOLS = ("SWIFT_MX", "EBICS", "FIXML", "FPML", "UBL_PAYMENT")
PAYMENT_FIELDS = {"MsgId": "message_id", "CtrlSum": "control_sum", "IBAN": "first_iban", "BICFI": "first_bic", "BIC": "first_bic"}
# Envelope namespaces, and those that tell payloads apart.
SOAP_VERSIONS = {"http://schemas.xmlsoap.org/soap/envelope/": "SOAP_1_1", "http://www.w3.org/2003/05/soap-envelope": "SOAP_1_2"}
FHIR_NS, HL7_NS = "http://hl7.org/fhir", "urn:hl7-org:v3"

_S, _L, _B = T.StringType(), T.LongType(), T.BooleanType()
OUTCOME = [T.StructField("ok", _B), T.StructField("error", _S)]
PAYMENT = [T.StructField(n, t) for n, t in (("protocol", _S), ("message_type", _S), ("message_id", _S), ("transaction_count", _L), ("control_sum", _S), ("first_iban", _S), ("first_bic", _S), ("id_zero_copy", _B), ("iban_zero_copy", _B))]
HEALTHCARE = [T.StructField(n, _S) for n in ("soap_version", "protocol", "action", "message_id", "payload_name")]
SOAP = [T.StructField(n, t) for n, t in (("version", _S), ("has_header", _B), ("header_children", _L), ("body_children", _L), ("payload_name", _S))]


class RecordError(XmlError):
    def __init__(self, message: str):
        super().__init__(message, -1)


def payment_record(events: Iterator[Event]) -> tuple:
    """Type of the first known message element; first MsgId, CtrlSum, IBAN and BIC that have a chunk of text, trimmed;
    NbOfTxs as the raw digits of its last chunk. A field is open up to the first end tag of its name; a field that is still
    wanted and begins inside another takes its place."""
    kind, count = None, -1
    found: dict[str, tuple[str, bool]] = {}
    field: str | None = None  # local name of the open one
    chunks: list[str] = []
    plain = True
    for e in events:
        if e.event == START_ELEMENT:
            local = e.local
            if kind is None and local in PAYMENT_TYPES:
                kind = local
            if local in PAYMENT_FIELDS and PAYMENT_FIELDS[local] not in found or local == "NbOfTxs" and count < 0:
                field, chunks, plain = local, [], True
        elif e.event in (TEXT, CDATA):
            if field == "NbOfTxs":
                count = _count(e.raw)
            elif field:
                chunks.append(e.text)
                plain &= e.event == TEXT and e.text == e.raw
        elif e.event == END_ELEMENT and field and e.local == field:
            if chunks:
                found.setdefault(PAYMENT_FIELDS[field], ("".join(chunks).strip(TRIMMED), plain and len(chunks) == 1))
            field = None
    value = lambda n: found.get(n, (None, None))
    return PAYMENT_TYPES.get(kind, "UNKNOWN"), kind, value("message_id")[0], count, value("control_sum")[0], value("first_iban")[0], value("first_bic")[0], value("message_id")[1], value("first_iban")[1]


def _count(raw: str) -> int:
    if not raw:
        raise RecordError("Empty NbOfTxs")
    if not (raw.isascii() and raw.isdigit()):
        raise RecordError("Invalid NbOfTxs")
    digits = raw.lstrip("0") or "0"
    if len(digits) > 19 or int(digits) >= 1 << 63:
        raise RecordError("NbOfTxs overflow")
    return int(digits)


def _leaves(t: Tokens, tags: np.ndarray) -> np.ndarray:
    """Which of the start tags are followed by their own end tag."""
    return (t.kind[tags] != OPEN) | (t.partner[tags] == tags + 1)


def _by_place(n: int, place: np.ndarray, tags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of n documents the last of the tags given for its place, and whether there is one."""
    out = np.full(n, -1)
    out[place] = tags
    return np.maximum(out, 0), out >= 0


def _trim(x: pa.Array) -> pa.Array:
    return pc.utf8_trim(x, TRIMMED)


def plain_payments(t: Tokens) -> Made:
    n, types = len(t.docs), list(PAYMENT_TYPES)
    names = ["NbOfTxs", *dict.fromkeys(PAYMENT_FIELDS.values())]
    field = t.per_shape(lambda s: names.index(PAYMENT_FIELDS.get(s.local, s.local)) if s.local in PAYMENT_FIELDS or s.local == "NbOfTxs" else -1, np.int64)
    message = t.per_shape(lambda s: types.index(s.local) if s.local in PAYMENT_TYPES else -1, np.int64)
    tags = np.flatnonzero(t.starts)
    kinds = tags[message[t.shape[tags]] >= 0][::-1]
    first, typed = _by_place(n, t.place[kinds], kinds)
    wanted = tags[field[t.shape[tags]] >= 0]
    able = np.ones(n, bool)
    able[t.place[wanted[~_leaves(t, wanted)]]] = False
    held = wanted[(t.kind[wanted] == OPEN)]
    held = held[_leaves(t, held)]
    held = held[t.has_text[held + 1]][::-1]
    of = field[t.shape[held]]
    values = []
    for i in range(len(names)):
        at, there = _by_place(n, t.place[held[of == i]], held[of == i])
        text = t.texts(np.where(there, at + 1, t.first), raw=i == 0)
        values.append((pc.if_else(pa.array(there), text, pa.scalar(None, pa.string())), at, there))
    digits, _, there = values[0]
    number = pc.fill_null(pc.match_substring_regex(digits, "^[0-9]{1,18}$"), False).to_numpy(zero_copy_only=False)
    able &= number | ~there
    count = pc.fill_null(pc.cast(pc.if_else(pa.array(number & there), digits, pa.scalar(None, pa.string())), pa.int64()), -1)
    plain = lambda i: pa.array(t.plain_text(np.where(values[i][2], values[i][1] + 1, t.first)), mask=~values[i][2])
    kind = message[t.shape[first]]
    protocol = pa.array([*PAYMENT_TYPES.values(), "UNKNOWN"]).take(pa.array(np.where(typed, kind, len(types))))
    columns = [protocol, pa.array(types).take(pa.array(np.maximum(kind, 0), mask=~typed)), _trim(values[1][0]), count, *(_trim(v) for v, *_ in values[2:]), plain(1), plain(names.index("first_iban"))]
    return _accepted(t, able, columns)


def _accepted(t: Tokens, able: np.ndarray, columns: list[pa.Array]) -> Made:
    """The records of the documents that could be projected."""
    done, keep = t.docs[able], pa.array(able)
    return done, done, [*(c.filter(keep) for c in columns), pa.array(np.ones(len(done), bool)), pa.nulls(len(done), pa.string())]


def _envelope(e: Event) -> str:
    version = SOAP_VERSIONS.get(dict((k, v) for k, v in e.attrs or ()).get("xmlns" + (f":{e.prefix}" if e.prefix else "")))
    if e.local != "Envelope" or version is None:
        raise RecordError("Not a SOAP envelope")
    return version


def _part(e: Event, prefix: str, parts: list[str]) -> None:
    """An element under the envelope: Header, then Body, with the envelope's prefix."""
    if e.prefix != prefix or e.local not in ("Header", "Body") or e.local == "Header" and parts or "Body" in parts:
        raise RecordError("Invalid SOAP structure")
    parts.append(e.local)


def soap_record(events: Iterator[Event]) -> tuple:
    """The envelope's version and what it has, if it has an optional Header, a Body and nothing else."""
    version, prefix, parts, count, payload = "", "", [], {"Header": 0, "Body": 0}, None
    for e in events:
        if e.event == START_ELEMENT and e.depth == 1:
            version, prefix = _envelope(e), e.prefix
        elif e.event == START_ELEMENT and e.depth == 2:
            _part(e, prefix, parts)
        elif e.event == START_ELEMENT and e.depth == 3:
            count[parts[-1]] += 1
            if parts[-1] == "Body" and payload is None:
                payload = e.name
    if "Body" not in parts:
        raise RecordError("SOAP Body is missing")
    return version, "Header" in parts, count["Header"] if "Header" in parts else None, count["Body"], payload


def _payload_protocol(name: str, ns: str | None) -> str:
    local = name.partition(":")[2] or name
    if ns == FHIR_NS or local == "Bundle" and "fhir" in name:
        return "FHIR_XML"
    if ns == HL7_NS:
        return "CDA" if local == "ClinicalDocument" else "HL7_V3"
    return "SOAP"


def healthcare_record(events: Iterator[Event], region: str = "header", trimmed: bool = False, direct: bool = False) -> tuple:
    """Version, protocol of the payload, and the last WS-Addressing Action and MessageID of the header (or anywhere). The
    payload's namespace is looked up on itself, then on the envelope. direct: the prefixes of Header and Body are not
    checked, namespaces are those of the envelope only, and a field is its last chunk of text as it stands."""
    version, prefix, parts, outer, payload, protocol = "", "", [], {}, None, "SOAP"
    found: dict[str, str | None] = {"Action": None, "MessageID": None}
    field, depth, chunks = None, 0, []
    for e in events:
        if e.event == START_ELEMENT:
            if e.depth == 1:
                version, prefix, outer = _envelope(e), e.prefix, dict(e.attrs or ())
            elif e.depth == 2 and direct:
                parts.append(e.local)
            elif e.depth == 2:
                _part(e, prefix, parts)
            elif e.depth == 3 and parts[-1] == "Body" and payload is None:
                payload, key = e.name, "xmlns" + (f":{e.prefix}" if e.prefix else "")
                own = {} if direct else dict(e.attrs or ())
                protocol = _payload_protocol(e.name, own.get(key, outer.get(key)))
            if e.depth > 2 and e.local in found and field is None and (region == "anywhere" or parts[-1] == "Header"):
                field, depth, chunks = e.local, e.depth, []
        elif e.event in (TEXT, CDATA):
            if field and direct:
                chunks = [e.raw]
            elif field:
                chunks.append(e.text)
        elif e.event == END_ELEMENT and field and e.depth == depth:
            if chunks:
                found[field] = "".join(chunks)
            field = None
    if "Body" not in parts:
        raise RecordError("SOAP Body is missing")
    clean = lambda x: x.strip(TRIMMED) if trimmed and x else x
    return version, protocol, clean(found["Action"]), clean(found["MessageID"]), payload


_HEADER, _BODY = 1, 2


class _Envelopes:
    """The parts of the envelopes among a batch's plain documents; able: those that are valid."""

    def __init__(self, t: Tokens):
        n = len(t.docs)
        self.t, self.tags = t, np.flatnonzero(t.starts)
        level = t.level[self.tags]
        self.root = self.tags[level == 1]  # one for each document

        def version(s) -> int:
            uri = dict(s.attrs).get("xmlns" + (f":{s.prefix}" if s.prefix else "")) if s.local == "Envelope" else None
            return list(SOAP_VERSIONS).index(uri) if uri in SOAP_VERSIONS else -1

        self.version = t.per_shape(version, np.int64)[t.shape[self.root]]
        prefix = t.per_shape(lambda s: s.prefix, object)
        part = t.per_shape(lambda s: {"Header": _HEADER, "Body": _BODY}.get(s.local, 0), np.int64)
        two = self.tags[level == 2]
        kind, place = part[t.shape[two]], t.place[two]
        kind = np.where(prefix[t.shape[two]] == prefix[t.shape[self.root[place]]], kind, 0)
        self.body, has_body = _by_place(n, place[kind == _BODY], two[kind == _BODY])
        self.header, self.has_header = _by_place(n, place[kind == _HEADER], two[kind == _HEADER])
        count = lambda k: np.bincount(place[kind == k], minlength=n)
        self.able = (self.version >= 0) & has_body & (count(_BODY) == 1) & (count(_HEADER) <= 1) & (count(0) == 0) & (~self.has_header | (self.header < self.body))
        three = self.tags[level == 3]
        under_body = three > self.body[t.place[three]]
        self.children = [np.bincount(t.place[three[x]], minlength=n) for x in (~under_body, under_body)]
        inside = three[under_body][::-1]
        self.payload, self.has_payload = _by_place(n, t.place[inside], inside)

    def versions(self) -> pa.Array:
        return pa.array(list(SOAP_VERSIONS.values())).take(pa.array(np.maximum(self.version, 0)))

    def payload_names(self) -> pa.Array:
        return self.t.shaped(lambda s: s.name, pa.string(), self.t.shape[self.payload], ~self.has_payload)


def plain_soap(t: Tokens) -> Made:
    e = _Envelopes(t)
    return _accepted(t, e.able, [e.versions(), pa.array(e.has_header), pa.array(e.children[0], mask=~e.has_header), pa.array(e.children[1]), e.payload_names()])


def plain_healthcare(t: Tokens, region: str, trimmed: bool) -> Made:
    e, n = _Envelopes(t), len(t.docs)
    able = e.able.copy()
    # a payload's protocol hangs on its tag and the envelope's
    pairs, back = np.unique(np.stack([t.shape[e.payload], t.shape[e.root]], 1), axis=0, return_inverse=True) if n else (np.zeros((0, 2), int), np.zeros(0, int))
    protocols = []
    for own, outer in pairs.tolist():
        payload, key = t.shapes[own], "xmlns" + (f":{t.shapes[own].prefix}" if t.shapes[own].prefix else "")
        protocols.append(_payload_protocol(payload.name, dict(payload.attrs).get(key, dict(t.shapes[outer].attrs).get(key))))
    protocol = pc.if_else(pa.array(e.has_payload), pa.array(protocols, pa.string()).take(pa.array(back.reshape(-1))), "SOAP")
    fields = ["Action", "MessageID"]
    field = t.per_shape(lambda s: fields.index(s.local) if s.local in fields else -1, np.int64)
    tags = e.tags[(field[t.shape[e.tags]] >= 0) & (t.level[e.tags] > 2)]
    if region != "anywhere":
        tags = tags[e.has_header[t.place[tags]] & (tags > e.header[t.place[tags]]) & (tags < e.body[t.place[tags]])]
    able[t.place[tags[~_leaves(t, tags)]]] = False
    held = tags[(t.kind[tags] == OPEN) & _leaves(t, tags)]
    held = held[t.has_text[held + 1]]
    values = []
    for i in range(len(fields)):
        own = held[field[t.shape[held]] == i]
        at, there = _by_place(n, t.place[own], own)  # the last one wins
        text = pc.if_else(pa.array(there), t.texts(np.where(there, at + 1, t.first)), pa.scalar(None, pa.string()))
        values.append(_trim(text) if trimmed else text)
    return _accepted(t, able, [e.versions(), protocol, *values, e.payload_names()])


@dataclass(frozen=True)
class Profile:
    """A projection: what it makes of a document's events, of a batch's plain documents if it can, and the columns."""

    record: Callable[[Iterator[Event]], tuple]
    fields: list[T.StructField]
    plain: Callable[[Tokens], Made] | None = None

    def maker(self, options: XmlOptions) -> Maker:
        def each(data: bytes) -> Iterable[tuple]:
            return [(*self.record(scan(data, options)), True, None)]

        return Maker(self.fields + OUTCOME, each, self.plain, lambda e: [(*[None] * len(self.fields), False, str(e))], options)


def healthcare_profile(region: str, trimmed: bool = False, direct: bool = False) -> Profile:
    plain = None if direct else lambda t: plain_healthcare(t, region, trimmed)
    return Profile(lambda events: healthcare_record(events, region, trimmed, direct), HEALTHCARE, plain)


def payments(docs: DataFrame, options: XmlOptions | None = None, key: str = "doc_id", content: str = "content") -> DataFrame:
    options = options or XmlOptions.of(docs)
    return per_document(docs, PROFILES["payments"](options).maker(options), key, content)


def soap_messages(docs: DataFrame, options: XmlOptions | None = None, key: str = "doc_id", content: str = "content") -> DataFrame:
    options = options or XmlOptions.of(docs)
    return per_document(docs, Profile(soap_record, SOAP, plain_soap).maker(options), key, content)


def healthcare(docs: DataFrame, options: XmlOptions | None = None, key: str = "doc_id", content: str = "content", trimmed: bool = False, direct: bool = False) -> DataFrame:
    options = options or XmlOptions.of(docs)
    return per_document(docs, healthcare_profile(options.region, trimmed, direct).maker(options), key, content)


#: What each profile projects, by the options.
PROFILES: dict[str, Callable[[XmlOptions], Profile]] = {"payments": lambda _: Profile(payment_record, PAYMENT, plain_payments), "soap_healthcare": lambda o: healthcare_profile(o.region)}


def register_profile(name: str, profile: Callable[[XmlOptions], Profile]) -> None:
    """Adds a profile that options can name; automatic detection does not choose it."""
    PROFILES[name.lower()] = profile
    if name.lower() not in PROFILE_NAMES:
        PROFILE_NAMES.append(name.lower())


def inspect(docs: DataFrame, options: XmlOptions | None = None, key: str = "doc_id", content: str = "content") -> DataFrame:
    """(key, profile, ok, error, record as JSON) by the profile that the options name, or that each document's first bytes
    tell; documents of no profile are not scanned and have an error. One pass over the documents."""
    options = options or XmlOptions.of(docs)
    chosen = detect_profile(F.col(content).cast("binary")) if options.profile == "auto" else F.lit(options.profile)
    makers = {name: make(options).maker(options) for name, make in PROFILES.items() if options.profile in ("auto", name)}
    structs = {name: T.StructType(m.fields[:-2]) for name, m in makers.items()}
    out = T.StructType([docs.schema[key], T.StructField("profile", _S), *OUTCOME, *(T.StructField(f"__{name}", s) for name, s in structs.items())])
    types = [pa.struct([pa.field(f.name, t) for f, t in zip(m.fields[:-2], m.types, strict=False)]) for m in makers.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts_of(batch):
                for name, group in _groups(part):
                    ids, ok = group.column(0), None
                    if name not in makers:
                        n = group.num_rows
                        yield pa.RecordBatch.from_arrays([ids, pa.array([name] * n), pa.array([False] * n), pa.array(["No profile"] * n), *(pa.nulls(n, t) for t in types)], names=out.names)
                        continue
                    for at, (*columns, ok, error) in makers[name].batches(group.column(1)):
                        n = len(at)
                        records = [pa.StructArray.from_arrays(columns, fields=list(t)) if name == x else pa.nulls(n, t) for x, t in zip(makers, types, strict=True)]
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array([name] * n), ok, error, *records], names=out.names)

    made = keyed(docs.withColumn("__profile", chosen), key, content, "__profile").mapInArrow(run, out)
    record = F.lit(None).cast("string")
    for name in makers:
        record = F.when(F.col("ok") & (F.col("profile") == name), F.to_json(F.col(f"__{name}"))).otherwise(record)
    return made.select(key, "profile", "ok", "error", record.alias("record"))


def _groups(part: pa.RecordBatch) -> Iterator[tuple[str, pa.RecordBatch]]:
    profiles = part.column(2)
    for name in pc.unique(profiles).to_pylist():
        yield name, part.filter(pc.and_(pc.equal(profiles, name), part.column(1).is_valid()))

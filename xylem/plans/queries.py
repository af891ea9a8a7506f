"""Queries over the test tables: documents are built from relational columns (or taken from pages), an operator reads
them, and the oracle states the answer from the original columns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from xylem.functions import guards
from xylem.operators import events as ev
from xylem.operators import records
from xylem.operators.bind import entries_adapter, unmarshal, unmarshal_any, unmarshal_events, unmarshal_nodes
from xylem.operators.marshal import marshal, marshal_events, marshal_scalar
from xylem.operators.schema import Adapter, XmlContext, XmlSchema, attr, decimal_text, elem, qname, value
from xylem.options import XmlOptions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_S, _L, _I, _D, _B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()
PAIN = "urn:iso:std:iso:20022:tech:xsd:pain.001.001.09"


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def built(spark: SparkSession, sf_dir: str, name: str, key: str, xml: str, *more: str) -> DataFrame:
    """(doc_id, content) from one table by a SQL expression."""
    return table(spark, sf_dir, name).selectExpr(f"{key} AS doc_id", f"{xml} AS content", *more)


# ---- payments

_CUSTOMER_PAYMENTS = """
SELECT o_custkey AS doc_id, count(*) AS n, CAST(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS {text}) AS total
FROM orders GROUP BY o_custkey"""


@query(f"SELECT doc_id, 'SEPA' AS protocol, 'CstmrCdtTrfInitn' AS message_type, 'MSG-' || doc_id AS message_id, n AS transaction_count, total AS control_sum, 'IT' || lpad(CAST(doc_id AS VARCHAR), 20, '0') AS first_iban, 'BIC' || (doc_id % 9) AS first_bic FROM ({_CUSTOMER_PAYMENTS.format(text='VARCHAR')})")
def payments_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("decimal(18,2)").cast("string").alias("total"))
    docs = orders.selectExpr("doc_id", f"concat('<Document xmlns=\"{PAIN}\"><CstmrCdtTrfInitn><GrpHdr><MsgId> MSG-', doc_id, ' </MsgId><NbOfTxs>', n, '</NbOfTxs><CtrlSum>', total, '</CtrlSum></GrpHdr><PmtInf><DbtrAcct><Id><IBAN>IT', lpad(cast(doc_id AS string), 20, '0'), '</IBAN></Id></DbtrAcct><BICFI>BIC', doc_id % 9, '</BICFI></PmtInf></CstmrCdtTrfInitn></Document>') AS content")
    return records.payments(docs).select("doc_id", "protocol", "message_type", "message_id", "transaction_count", "control_sum", "first_iban", "first_bic")


_TYPES = [*records.PAYMENT_TYPES, "Other"]


@query("SELECT protocol, message_type, count(*) AS n FROM (SELECT CASE o_orderkey % 7 WHEN 0 THEN 'SEPA' WHEN 1 THEN 'SEPA' WHEN 6 THEN 'UNKNOWN' ELSE 'ISO_20022' END AS protocol, CASE o_orderkey % 7 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_TYPES[:-1])) + " END AS message_type FROM orders) GROUP BY 1, 2")
def payments_types_protocol(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = f"element_at(array({', '.join(map(repr, _TYPES))}), cast(o_orderkey % 7 AS int) + 1)"
    docs = built(spark, sf_dir, "orders", "o_orderkey", f"concat('<p:Document xmlns:p=\"urn:x\"><p:', {name}, '><p:MsgId>', o_orderkey, '</p:MsgId></p:', {name}, '></p:Document>')")
    return records.payments(docs).groupBy("protocol", "message_type").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 2 = 0 THEN 'A&B-' ELSE 'AB-' END || o_orderkey AS message_id, o_orderkey % 2 = 1 AS id_zero_copy, CAST(NULL AS VARCHAR) AS first_iban FROM orders")
def payments_flyweight_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = built(spark, sf_dir, "orders", "o_orderkey", "concat('<Document><CstmrCdtTrfInitn><MsgId>', if(o_orderkey % 2 = 0, 'A&amp;B-', 'AB-'), o_orderkey, '</MsgId><IBAN/></CstmrCdtTrfInitn></Document>')")
    return records.payments(docs).select("doc_id", "message_id", "id_zero_copy", "first_iban")


@query("SELECT o_orderkey AS doc_id, o_orderkey % 5 IN (0, 3) AS ok, CASE o_orderkey % 5 WHEN 0 THEN 5 WHEN 3 THEN -1 END::BIGINT AS transaction_count, CASE WHEN o_orderkey % 5 IN (1, 2) THEN 'Invalid NbOfTxs' WHEN o_orderkey % 5 = 4 THEN 'NbOfTxs overflow' END AS error FROM orders")
def nbtxs_invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = "element_at(array('<NbOfTxs>5</NbOfTxs>', '<NbOfTxs> 5 </NbOfTxs>', '<NbOfTxs>x</NbOfTxs>', '', '<NbOfTxs>99999999999999999999</NbOfTxs>'), cast(o_orderkey % 5 AS int) + 1)"
    docs = built(spark, sf_dir, "orders", "o_orderkey", f"concat('<Document><CstmrCdtTrfInitn>', {count}, '</CstmrCdtTrfInitn></Document>')")
    return records.payments(docs).select("doc_id", "ok", "transaction_count", "error")


@query("SELECT c_custkey AS doc_id, 'IBAN' || c_custkey AS first_iban, '' AS first_bic FROM customer")
def payments_first_nonnull(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = built(spark, sf_dir, "customer", "c_custkey", "concat('<Document><BkToCstmrStmt><IBAN/><IBAN></IBAN><IBAN>IBAN<!-- split -->', c_custkey, '</IBAN><IBAN>late</IBAN><BIC>  </BIC><BICFI>late</BICFI></BkToCstmrStmt></Document>')")
    return records.payments(docs).select("doc_id", "first_iban", "first_bic")


# ---- SOAP and healthcare

_SOAP_NS = list(records.SOAP_VERSIONS)
_WSA = "http://www.w3.org/2005/08/addressing"


def _soap(payload: str, header: str = "", ns: str = f"if(event_id % 2 = 0, '{_SOAP_NS[0]}', '{_SOAP_NS[1]}')") -> str:
    return f"concat('<s:Envelope xmlns:s=\"', {ns}, '\" xmlns:wsa=\"{_WSA}\">', {header or repr('')}, '<s:Body>', {payload}, '</s:Body></s:Envelope>')"


@query("SELECT event_id AS doc_id, CASE WHEN event_id % 2 = 0 THEN 'SOAP_1_1' ELSE 'SOAP_1_2' END AS soap_version, 'SOAP' AS protocol, 'urn:' || event_type AS action, 'id-' || event_id AS message_id, 'o:Get' AS payload_name FROM events")
def healthcare_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    header = "concat('<s:Header><wsa:Action>first</wsa:Action><wsa:Action>urn:', event_type, '</wsa:Action><wsa:MessageID>id-', event_id, '</wsa:MessageID></s:Header>')"
    docs = built(spark, sf_dir, "events", "event_id", _soap("concat('<o:Get xmlns:o=\"urn:o\"><o:User>', user_id, '</o:User></o:Get>')", header))
    return records.healthcare(docs).drop("ok", "error")


@query("SELECT event_id AS doc_id, 'urn:' || event_type AS action, CAST(NULL AS VARCHAR) AS message_id FROM events")
def healthcare_flyweight(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = built(spark, sf_dir, "events", "event_id", _soap("'<x/>'", "concat('<s:Header><wsa:Action>  urn:', event_type, ' </wsa:Action><wsa:MessageID/></s:Header>')"))
    return records.healthcare(docs, trimmed=True).select("doc_id", "action", "message_id")


@query("SELECT CASE event_id % 5 WHEN 0 THEN 'HL7_V3' WHEN 1 THEN 'CDA' WHEN 2 THEN 'FHIR_XML' WHEN 3 THEN 'FHIR_XML' ELSE 'SOAP' END AS protocol, count(*) AS n FROM events GROUP BY 1")
def healthcare_protocols(spark: SparkSession, sf_dir: str) -> DataFrame:
    payload = "element_at(array('<PRPA_IN201305UV02 xmlns=\"urn:hl7-org:v3\"/>', '<c:ClinicalDocument xmlns:c=\"urn:hl7-org:v3\"/>', '<Patient xmlns=\"http://hl7.org/fhir\"/>', '<fhir:Bundle xmlns:fhir=\"urn:f\"/>', '<Bundle/>'), cast(event_id % 5 AS int) + 1)"
    docs = built(spark, sf_dir, "events", "event_id", _soap(payload))
    return records.healthcare(docs).groupBy("protocol").agg(F.count("*").alias("n"))


@query("SELECT event_id AS doc_id, 'head-' || event_id AS vertical_action, CASE WHEN event_id % 3 = 0 THEN 'body-' || event_id ELSE 'head-' || event_id END AS generic_action FROM events")
def healthcare_action_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    header = "concat('<s:Header><wsa:Action>head-', event_id, '</wsa:Action></s:Header>')"
    docs = built(spark, sf_dir, "events", "event_id", _soap("concat('<x>', if(event_id % 3 = 0, concat('<Action>body-', event_id, '</Action>'), ''), '</x>')", header))
    a = records.healthcare(docs).select("doc_id", F.col("action").alias("vertical_action"))
    b = records.healthcare(docs, XmlOptions(region="anywhere")).select("doc_id", F.col("action").alias("generic_action"))
    return a.join(b, "doc_id")


@query("SELECT event_id AS doc_id, event_id % 6 IN (0, 1) AS ok, CASE event_id % 6 WHEN 0 THEN 'SOAP_1_1' WHEN 1 THEN 'SOAP_1_2' END AS version, CASE event_id % 6 WHEN 0 THEN false WHEN 1 THEN true END AS has_header, CASE event_id % 6 WHEN 1 THEN 2 END::BIGINT AS header_children, CASE event_id % 6 WHEN 0 THEN 1 WHEN 1 THEN 0 END::BIGINT AS body_children, CASE event_id % 6 WHEN 2 THEN 'SOAP Body is missing' WHEN 3 THEN 'Invalid SOAP structure' WHEN 4 THEN 'Invalid SOAP structure' WHEN 5 THEN 'Not a SOAP envelope' END AS error FROM events")
def soap_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, two = _SOAP_NS
    shapes = [
        f'<s:Envelope xmlns:s="{one}"><s:Body><a/></s:Body></s:Envelope>',
        f'<Envelope xmlns="{two}"><Header><a/><b/></Header><Body/></Envelope>',
        f'<s:Envelope xmlns:s="{one}"><s:Header/></s:Envelope>',
        f'<s:Envelope xmlns:s="{one}"><s:Body/><s:Extra/></s:Envelope>',
        f'<s:Envelope xmlns:s="{one}" xmlns:t="{one}"><t:Body/></s:Envelope>',
        '<s:Envelope xmlns:s="urn:other"><s:Body/></s:Envelope>',
    ]
    docs = built(spark, sf_dir, "events", "event_id", f"element_at(array({', '.join(map(repr, shapes))}), cast(event_id % 6 AS int) + 1)")
    return records.soap_messages(docs).select("doc_id", "ok", "version", "has_header", "header_children", "body_children", "error")


@query("SELECT event_id AS doc_id, CASE event_id % 4 WHEN 0 THEN 'payments' WHEN 1 THEN 'soap_healthcare' WHEN 2 THEN 'payments' ELSE 'none' END AS profile, event_id % 4 <> 3 AS ok FROM events")
def profile_autodetect(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = ["<Document><CstmrCdtTrfInitn/></Document>", f'<s:Envelope xmlns:s="{_SOAP_NS[0]}"><s:Body/></s:Envelope>', f'<s:Envelope xmlns:s="{_SOAP_NS[0]}"><s:Body><x xmlns="{PAIN}"/></s:Body></s:Envelope>', "<other/>"]
    docs = built(spark, sf_dir, "events", "event_id", f"element_at(array({', '.join(map(repr, shapes))}), cast(event_id % 4 AS int) + 1)")
    return records.inspect(docs).select("doc_id", "profile", "ok")


@query("SELECT event_id AS doc_id, 'SOAP' AS protocol, 'b &amp; ' || event_type AS action FROM events")
def healthcare_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    header = "concat('<t:Header><wsa:Action>a<!-- -->b &amp; ', event_type, '</wsa:Action></t:Header>')"
    docs = built(spark, sf_dir, "events", "event_id", _soap("'<PRPA xmlns=\"urn:hl7-org:v3\"/>'", header))
    return records.healthcare(docs, direct=True).select("doc_id", "protocol", "action")


# ---- bytes

_BYTES = "concat(encode(concat('<a>', event_id, '<b/>'), 'UTF-8'), element_at(array(unhex('C3A9'), unhex('C328'), unhex('EDA080'), unhex('F09F9880'), unhex('F4908080'), unhex('C080')), cast(event_id % 6 AS int) + 1), encode('</a>', 'UTF-8'))"


@query("SELECT event_id AS doc_id, event_id % 6 IN (0, 3) AS guard_ok, event_id % 6 IN (0, 3) AS ok, CASE WHEN event_id % 6 NOT IN (0, 3) THEN 'Invalid UTF-8' END AS error, CASE WHEN event_id % 6 NOT IN (0, 3) THEN length(CAST(event_id AS VARCHAR)) + 7 END::BIGINT AS byte_offset FROM events")
def utf8_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = built(spark, sf_dir, "events", "event_id", _BYTES)
    return ev.xml_status(docs).join(docs.select("doc_id", guards.utf8_ok(F.col("content")).alias("guard_ok")), "doc_id").select("doc_id", "guard_ok", "ok", "error", "byte_offset")


@query("SELECT event_id AS doc_id, true AS ok, event_id % 6 NOT IN (0, 3) AS replaced FROM events")
def utf8_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = built(spark, sf_dir, "events", "event_id", _BYTES)
    texts = ev.xml_events(docs, XmlOptions(utf8="off"), ["event", "text"], ["TEXT"])
    made = texts.groupBy("doc_id").agg(F.max(F.contains("text", F.lit("�"))).alias("replaced"))
    return ev.xml_status(docs, XmlOptions(utf8="none")).join(made, "doc_id").select("doc_id", "ok", "replaced")


@query("SELECT page_id, CAST(length(html) - length(regexp_replace(html, '[<>/=''\"&?!]', '', 'g')) AS BIGINT) AS n_structural, CAST(length(html) - length(replace(html, '<', '')) AS BIGINT) AS n_less, CAST(length(html) - length(replace(html, '&', '')) AS BIGINT) AS n_amp FROM pages")
def structural_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", guards.structural_count(html).alias("n_structural"), guards.token_count(html, "<").alias("n_less"), guards.token_count(html, "&").alias("n_amp"))


_PART = "'<p k=\"' || p_partkey || '\">' || p_type || '</p>'"


@query(f"SELECT p_partkey AS doc_id, i - 1 AS pos, substr(x, i, 1) AS token FROM (SELECT p_partkey, x, unnest(generate_series(1, length(x))) AS i FROM (SELECT p_partkey, {_PART} AS x FROM part)) WHERE substr(x, i, 1) IN ('<', '>', '/', '=', '''', '\"', '&', '?', '!')")
def structural_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = built(spark, sf_dir, "part", "p_partkey", _PART)
    at = docs.select("doc_id", "content", F.explode(guards.structural_positions(F.col("content"))).alias("pos"))
    return at.select("doc_id", "pos", F.expr("substring(content, cast(pos AS int) + 1, 1)").alias("token"))


@query("SELECT page_id, CAST(CASE WHEN position('<body' IN html) > 0 THEN position('<body' IN html) - 1 ELSE length(html) END AS BIGINT) AS body_at, CAST(CASE WHEN position('<marquee' IN html) > 0 THEN position('<marquee' IN html) - 1 ELSE length(html) END AS BIGINT) AS absent_at, upper(substr(html, 1, 9)) = '<!DOCTYPE' AS starts_doctype, regexp_matches(html, '(?i)<!DOCTYPE') AS has_dtd FROM pages")
def find_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", guards.find(html, "<body").alias("body_at"), guards.find(html, "<marquee").alias("absent_at"), guards.starts_ignore_case(html, "<!doctype").alias("starts_doctype"), guards.has_dtd(html).alias("has_dtd"))


_BROKEN = ["<a><b></b></a>", "<a><b></a>", "<a x='1'x='2'/>", "<a>&unknown;</a>", "<a/><b/>", "<a>", " text <a/>", "<!-- a -- b --><a/>"]
_WHY = [None, "Mismatched end tag", "White space required before attribute", "Unknown entity &unknown;", "Multiple roots", "Unclosed element", "Text outside root", "Double hyphen in comment"]


@query("SELECT page_id AS doc_id, false AS ok, 'DTD is not supported' AS error, 0::BIGINT AS byte_offset FROM pages UNION ALL SELECT 1000000 + o_orderkey, o_orderkey % 8 = 0, CASE o_orderkey % 8 " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(_WHY) if w) + " END, CASE o_orderkey % 8 WHEN 1 THEN 6 WHEN 2 THEN 8 WHEN 3 THEN 3 WHEN 4 THEN 4 WHEN 5 THEN 3 WHEN 6 THEN 0 WHEN 7 THEN 0 END FROM orders")
def doc_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = built(spark, sf_dir, "orders", "1000000 + o_orderkey", "element_at(array(" + ", ".join(f'"{x}"' for x in _BROKEN) + "), cast(o_orderkey % 8 AS int) + 1)")
    return ev.xml_status(table(spark, sf_dir, "pages").selectExpr("page_id AS doc_id", "html AS content").unionByName(made))


@query("SELECT kind, name, count(*) AS n FROM (SELECT name, CASE WHEN name IN ('lt', 'gt', 'amp', 'quot', 'apos') THEN 'predefined' WHEN name[1] = '#' THEN 'numeric' ELSE 'unknown' END AS kind FROM (SELECT unnest(regexp_extract_all(html, '&(#?[A-Za-z0-9]+);', 1)) AS name FROM pages)) GROUP BY 1, 2")
def entity_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "pages").select(F.explode(guards.entities(F.col("html"))).alias("e"))
    return found.groupBy("e.kind", "e.name").agg(F.count("*").alias("n")).select("kind", "name", "n")


# ---- events


def order_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document for each order, its lines in order."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity"))), lambda x: F.concat(F.lit('<line n="'), x["l_linenumber"], F.lit('"><part>'), x["l_partkey"], F.lit("</part><qty>"), x["l_quantity"].cast("int"), F.lit("</qty></line>"))), "").alias("lines"))
    return lines.select("doc_id", F.concat(F.lit('<order id="'), "doc_id", F.lit('">'), "lines", F.lit("</order>")).alias("content"))


@query("SELECT l_orderkey AS doc_id, 1 + 3 * count(*) AS n_start, 1 + 3 * count(*) AS n_end, 2 * count(*) AS n_text, 4 + 8 * count(*) AS n_events FROM lineitem GROUP BY 1")
def event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = ev.xml_events(order_documents(spark, sf_dir), columns=["event"])
    n = lambda e: F.count_if(F.col("event") == e)
    return made.groupBy("doc_id").agg(n("START_ELEMENT").alias("n_start"), n("END_ELEMENT").alias("n_end"), n("TEXT").alias("n_text"), F.count("*").alias("n_events"))


_STREAM = [("START_DOCUMENT", "NULL", "NULL"), ("START_ELEMENT", "'r'", "NULL"), ("TEXT", "NULL", "'hello & ' || c_name"), ("START_ELEMENT", "'x'", "NULL"), ("END_ELEMENT", "'x'", "NULL"), ("CDATA", "NULL", "'<raw>'"), ("END_ELEMENT", "'r'", "NULL"), ("END_DOCUMENT", "NULL", "NULL")]


@query(" UNION ALL ".join(f"SELECT c_custkey AS doc_id, {i}::BIGINT AS seq, '{e}' AS event, CAST({n} AS VARCHAR) AS name, CAST({t} AS VARCHAR) AS text FROM customer" for i, (e, n, t) in enumerate(_STREAM)))
def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = built(spark, sf_dir, "customer", "c_custkey", "concat(\"<r id='1'>hello &amp; \", c_name, '<x/><![CDATA[<raw>]]></r>')")
    return ev.xml_events(docs, columns=["seq", "event", "name", "text"])


@query("SELECT o_orderkey AS doc_id, CAST(1 + o_orderkey % 10 AS INTEGER) AS max_depth, o_orderkey % 10 < 6 AS ok FROM orders")
def event_depth_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = built(spark, sf_dir, "orders", "o_orderkey", "concat('<r>', repeat('<d>', cast(o_orderkey % 10 AS int)), repeat('</d>', cast(o_orderkey % 10 AS int)), '</r>')")
    deep = ev.xml_events(docs, columns=["event", "depth"], events=["START_ELEMENT"]).groupBy("doc_id").agg(F.max("depth").alias("max_depth"))
    return deep.join(ev.xml_status(docs, XmlOptions(max_depth=6)).select("doc_id", "ok"), "doc_id")


@query(f"SELECT doc_id, list_reduce(list_prepend(CAST(len(p) AS BIGINT), p), lambda h, y: (h * 31 + y) % 2147483647) AS checksum FROM (SELECT p_partkey AS doc_id, list_filter(list_transform(generate_series(1, length(x)), lambda i: CASE WHEN substr(x, i, 1) IN ('<', '>', '/', '=', '''', '\"', '&', '?', '!') THEN i - 1 END), lambda v: v IS NOT NULL) AS p FROM (SELECT p_partkey, {_PART} AS x FROM part))")
def event_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(spark, sf_dir, "part", "p_partkey", _PART).select("doc_id", guards.checksum(guards.structural_positions(F.col("content"))).alias("checksum"))


@query("SELECT s_suppkey AS doc_id, 'a &amp; ' || s_name AS raw, 'a & ' || s_name AS text, '&lt;' || s_suppkey AS raw_attr, '<' || s_suppkey AS attr FROM supplier")
def direct_scan_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = built(spark, sf_dir, "supplier", "s_suppkey", "concat('<r k=\"&lt;', s_suppkey, '\">a &amp; ', s_name, '</r>')")
    made = ev.xml_events(docs, columns=["event", "raw", "text", "attrs", "raw_attrs"], events=["TEXT", "START_ELEMENT"])
    return made.groupBy("doc_id").agg(F.max("raw").alias("raw"), F.max("text").alias("text"), F.max(guards.attribute(F.col("raw_attrs"), "k")).alias("raw_attr"), F.max(guards.attribute(F.col("attrs"), "k")).alias("attr"))


@query("SELECT p_partkey AS doc_id, CAST(p_size AS VARCHAR) AS size, p_brand AS brand, CAST(NULL AS VARCHAR) AS absent, 3::BIGINT AS n_attrs, true AS has_ns FROM part")
def attributes_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = built(spark, sf_dir, "part", "p_partkey", "concat('<p xmlns:u=\"urn:u\" size=\"', p_size, \"\\\" u:brand = '\", p_brand, \"'/>\")")
    made = ev.xml_events(docs, columns=["attrs"], events=["START_ELEMENT"])
    a = F.col("attrs")
    return made.select("doc_id", guards.attribute(a, "size").alias("size"), guards.attribute(a, "u:brand").alias("brand"), guards.attribute(a, "none").alias("absent"), F.size(a).cast("long").alias("n_attrs"), guards.has_namespace_declarations(a).alias("has_ns"))


@query("SELECT s_suppkey AS doc_id, s_suppkey % 4 = 0 AS ok, CASE s_suppkey % 4 WHEN 1 THEN 'Duplicate attribute' WHEN 2 THEN 'Malformed attribute' WHEN 3 THEN 'White space required before attribute' END AS error FROM supplier")
def attribute_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = ["<a b='<' c=\\\"2\\\"/>", "<a b='1' b='2'/>", "<a b=1/>", "<a b='1'c='2'/>"]
    docs = built(spark, sf_dir, "supplier", "s_suppkey", "element_at(array(" + ", ".join(f'"{x}"' for x in shapes) + "), cast(s_suppkey % 4 AS int) + 1)")
    return ev.xml_status(docs).select("doc_id", "ok", "error")


@query("SELECT c_custkey AS doc_id, 'A & <B>' || c_name || c_mktsegment AS text, 3 AS n_chunks FROM customer")
def mixed_content_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = built(spark, sf_dir, "customer", "c_custkey", "concat('<r>A &amp; <!-- no --><![CDATA[<B>]]><?no way?><i>', c_name, '</i>', c_mktsegment, '</r>')")
    return ev.xml_elements(docs).where("depth = 1").select("doc_id", "text", "n_chunks")


@query("SELECT s_suppkey AS doc_id, CASE WHEN s_suppkey % 2 = 0 THEN 2 ELSE 1 END::BIGINT AS prolog, 1::BIGINT AS epilog, s_name AS first_comment, 'work' AS target, 'yes' AS data FROM supplier")
def prolog_epilog(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = built(spark, sf_dir, "supplier", "s_suppkey", "concat('<?xml version=\"1.0\"?>', if(s_suppkey % 2 = 0, concat('<!--', s_name, '-->'), ''), '<?work   yes ?><root/><!--', s_name, '-->')")
    nodes = ev.xml_nodes(ev.xml_events(docs))
    of = lambda s: F.count_if(F.col("section") == s)
    kind = lambda k, c: F.max(F.when(F.col("kind") == k, F.col(c)))
    return nodes.groupBy("doc_id").agg(of("prolog").alias("prolog"), of("epilog").alias("epilog"), kind("COMMENT", "value").alias("first_comment"), kind("PROCESSING_INSTRUCTION", "name").alias("target"), kind("PROCESSING_INSTRUCTION", "value").alias("data"))


@query("SELECT l_orderkey AS doc_id, count(*) AS n_lines, CAST(min(l_linenumber) AS VARCHAR) AS first_line FROM lineitem GROUP BY 1")
def tree_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = ev.xml_nodes(ev.xml_events(order_documents(spark, sf_dir), columns=["seq", "event", "depth", "name", "text", "attrs", "owner_seq", "ordinal", "section"]))
    lines = ev.children(nodes, "line")
    first = ev.first_child(nodes, "line").join(lines.select("doc_id", "node_id", "attrs"), ["doc_id", "node_id"]).select("doc_id", guards.attribute(F.col("attrs"), "n").alias("first_line"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("n_lines")).join(first, "doc_id")


@query("SELECT l_orderkey AS doc_id, 5 * count(*) AS n_pairs, 3 * count(*) AS under_root FROM lineitem GROUP BY 1")
def descendant_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = ev.descendants(ev.xml_elements(order_documents(spark, sf_dir), path=True))
    return pairs.groupBy("doc_id").agg(F.count("*").alias("n_pairs"), F.count_if(F.col("ancestor_name") == "order").alias("under_root"))


@query("SELECT p_partkey AS doc_id, CASE p_partkey % 3 WHEN 0 THEN 'p' ELSE '' END AS prefix, 'item' AS local, CASE p_partkey % 3 WHEN 0 THEN 'urn:p' WHEN 1 THEN 'urn:d' ELSE '' END AS ns FROM part")
def root_qname(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = ['<p:item xmlns:p="urn:p">broken', '<?pi?><item xmlns="urn:d"/>', "<!-- c --><item/>"]
    return ev.root_qname(built(spark, sf_dir, "part", "p_partkey", f"element_at(array({', '.join(map(repr, shapes))}), cast(p_partkey % 3 AS int) + 1)"))


@query("SELECT s_suppkey AS doc_id, 'urn:x' AS ns, 'v' AS local, s_name AS text, CAST(NULL AS VARCHAR) AS unbound_ns FROM supplier")
def namespace_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = "if(s_suppkey % 2 = 0, concat('<a:r xmlns:a=\"urn:x\"><a:v>', s_name, '</a:v><z:u/></a:r>'), concat('<r xmlns=\"urn:x\"><b:v xmlns:b=\"urn:x\">', s_name, '</b:v><z:u/></r>'))"
    elements = ev.xml_elements(built(spark, sf_dir, "supplier", "s_suppkey", shapes)).where("depth = 2")
    v = elements.where("local = 'v'").select("doc_id", "ns", "local", "text")
    return v.join(elements.where("local = 'u'").select("doc_id", F.col("ns").alias("unbound_ns")), "doc_id")


@query("SELECT c_custkey AS doc_id, '<r k=\"&lt;' || c_nationkey || '\">a &amp; ' || c_name || '<x></x><!--c--><?p d?><![CDATA[<]]></r>' AS content FROM customer")
def events_to_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = built(spark, sf_dir, "customer", "c_custkey", "concat('<?xml version=\"1.0\"?><r k=\"&lt;', c_nationkey, '\">a &#38; ', c_name, '<x/><!--c--><?p d?><![CDATA[<]]></r>')")
    return ev.events_to_documents(ev.xml_events(docs))


# ---- binding

_CUSTOMER = XmlSchema("customer", T.StructType([attr("key", _L), elem("name"), elem("balance", T.DecimalType(18, 2)), elem("nation", _I)]))


@query("SELECT c_custkey AS doc_id, c_custkey AS key, 'last ' || c_name AS name, CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) AS balance, c_nationkey AS nation, true AS ok FROM customer")
def unmarshal_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = built(spark, sf_dir, "customer", "c_custkey", "concat('<customer key=\" ', c_custkey, ' \"><name>first</name><skip><name>no</name></skip><name>last ', c_name, '</name><balance> ', cast(c_acctbal AS decimal(18,2)), '</balance><nation>+', c_nationkey, '</nation></customer>trailing <junk')")
    made = unmarshal(docs, _CUSTOMER)
    return made.select("doc_id", "value.key", "value.name", F.col("value.balance").cast("string").alias("balance"), "value.nation", "ok")


@query("SELECT p_partkey AS doc_id, p_partkey AS id, ' ' || p_name || '&' AS title FROM part")
def unmarshal_attrs_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = XmlSchema("book", T.StructType([attr("id", _L), value("title")]))
    docs = built(spark, sf_dir, "part", "p_partkey", "concat('<book id=\"', p_partkey, '\"> ', p_name, '<x>no</x><![CDATA[&]]></book>')")
    return unmarshal(docs, schema).select("doc_id", "value.id", "value.title")


_ORDER = XmlSchema("order", T.StructType([attr("id", _L), elem("line", T.ArrayType(T.StructType([attr("n", _I), elem("part", _L), elem("qty", _I)])))]))


@query("SELECT l_orderkey AS doc_id, l_linenumber AS n, l_partkey AS part, CAST(l_quantity AS INTEGER) AS qty FROM lineitem")
def unmarshal_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unmarshal(order_documents(spark, sf_dir), _ORDER).select("doc_id", F.explode("value.line").alias("l")).select("doc_id", "l.n", "l.part", "l.qty")


@query("SELECT c_custkey AS doc_id, c_name || '|' || c_mktsegment AS texts, 2::BIGINT AS n_numbers FROM customer")
def unmarshal_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = XmlSchema("wrapped", T.StructType([elem("texts", T.ArrayType(_S), local="value", wrapper="values"), elem("numbers", T.ArrayType(_I), local="number", wrapper="numbers")]))
    docs = built(spark, sf_dir, "customer", "c_custkey", "concat('<wrapped><values><value>', c_name, '</value><other/><value>', c_mktsegment, '</value></values><value>no</value><numbers><number>1</number><number>2</number></numbers></wrapped>')")
    return unmarshal(docs, schema).select("doc_id", F.array_join("value.texts", "|").alias("texts"), F.size("value.numbers").cast("long").alias("n_numbers"))


@query("SELECT c_custkey AS doc_id, CASE WHEN c_nationkey = 3 THEN '3' ELSE c_nationkey || ',3' END AS tags FROM customer")
def unmarshal_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = XmlSchema("tags", T.StructType([elem("tag", T.ArrayType(_S), set=True)]))
    docs = built(spark, sf_dir, "customer", "c_custkey", "concat('<tags><tag>', c_nationkey, '</tag><tag>3</tag><tag>', c_nationkey, '</tag></tags>')")
    return unmarshal(docs, schema).select("doc_id", F.array_join("value.tag", ",").alias("tags"))


@query("SELECT s_suppkey AS doc_id, CASE s_suppkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE s_name END AS optional, CASE s_suppkey % 3 WHEN 0 THEN 7 WHEN 1 THEN s_nationkey END AS count FROM supplier")
def unmarshal_nil_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = XmlSchema("defaults", T.StructType([elem("optional", nillable=True), elem("count", _I, default=7)]))
    xsi = 'xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance" xsi:nil="true"'
    docs = built(spark, sf_dir, "supplier", "s_suppkey", f"concat('<defaults>', element_at(array('<optional {xsi}/><count/>', concat('<optional/><count>', s_nationkey, '</count>'), concat('<optional>', s_name, '</optional>')), cast(s_suppkey % 3 AS int) + 1), '</defaults>')")
    return unmarshal(docs, schema).select("doc_id", "value.optional", "value.count")


@query("SELECT o_orderkey AS doc_id, CASE o_orderkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS root_local, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey END AS x, CASE WHEN o_orderkey % 3 = 1 THEN o_orderstatus END AS y, o_orderkey % 3 < 2 AS ok FROM orders")
def unmarshal_root_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    context = XmlContext(XmlSchema("a", T.StructType([elem("x", _L)]), ns="urn:a"), XmlSchema("b", T.StructType([elem("y")])))
    docs = built(spark, sf_dir, "orders", "o_orderkey", "element_at(array(concat('<a xmlns=\"urn:a\"><x xmlns=\"\">', o_orderkey, '</x></a>'), concat('<b><y>', o_orderstatus, '</y></b>'), '<c/>'), cast(o_orderkey % 3 AS int) + 1)")
    return unmarshal_any(docs, context).select("doc_id", "root_local", "a.x", "b.y", "ok")


_PET = T.StructType([T.StructField("_type", _S), elem("name"), elem("bark", _B)])
_PETS = XmlSchema("owner", T.StructType([elem("pet", _PET, subtypes={"dogType": ["bark"]})]))


@query("SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 3 = 0 THEN 'dogType' END AS type, CASE WHEN c_custkey % 3 < 2 THEN c_name END AS name, CASE WHEN c_custkey % 3 = 0 THEN true END AS bark, c_custkey % 3 < 2 AS ok FROM customer")
def unmarshal_xsi_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    xsi = 'xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance"'
    docs = built(spark, sf_dir, "customer", "c_custkey", f"concat('<owner><pet {xsi}', element_at(array(' xsi:type=\"dogType\"><bark>1</bark>', '>', ' xsi:type=\"catType\">'), cast(c_custkey % 3 AS int) + 1), '<name>', c_name, '</name></pet></owner>')")
    return unmarshal(docs, _PETS).select("doc_id", F.col("value.pet._type").alias("type"), "value.pet.name", "value.pet.bark", "ok")


_ENTRY = T.ArrayType(T.StructType([elem("key"), elem("value", _I)]))


@query("SELECT c_custkey AS doc_id, k, CASE k WHEN 'a' THEN CAST(c_nationkey AS INTEGER) ELSE 2 END AS v, 'C:' || c_mktsegment AS code FROM customer, (VALUES ('a'), ('b')) t(k)")
def unmarshal_adapter_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = XmlSchema("m", T.StructType([elem("entry", _ENTRY, adapter="map"), elem("code", adapter="code")]), adapters={"map": Adapter(*entries_adapter()), "code": Adapter(lambda c: F.concat(F.lit("C:"), c), lambda c: F.substring(c, 3, 1 << 20))})
    docs = built(spark, sf_dir, "customer", "c_custkey", "concat('<m><entry><key>a</key><value>1</value></entry><entry><key>b</key><value>2</value></entry><entry><key>a</key><value>', c_nationkey, '</value></entry><code>', c_mktsegment, '</code></m>')")
    made = unmarshal(docs, schema).select("doc_id", F.explode("value.entry").alias("k", "v"), F.col("value.code").alias("code"))
    return made.select("doc_id", "k", "v", "code")


_SCALARS = XmlSchema("s", T.StructType([attr("active", _B), elem("long", _L), elem("decimal", T.DecimalType(38, 10)), elem("infinite", _D), elem("binary", T.BinaryType()), elem("hex", T.BinaryType(), hex=True), elem("day", T.DateType()), elem("state", enum={"READY": "ready", "STOPPED": "stopped"})]))


@query("SELECT o_orderkey AS doc_id, o_orderkey % 2 = 0 AS active, o_orderkey AS long, CAST(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DECIMAL(38,10)) AS VARCHAR) AS decimal, CASE WHEN o_orderkey % 2 = 0 THEN 'Infinity' ELSE '-Infinity' END AS infinite, o_orderpriority AS binary, o_orderstatus AS hex, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, 'READY' AS state FROM orders")
def scalar_codecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = built(spark, sf_dir, "orders", "o_orderkey", "concat('<s active=\"', if(o_orderkey % 2 = 0, '1', 'false'), '\"><long> ', o_orderkey, ' </long><decimal>', cast(o_totalprice AS decimal(18,2)), '</decimal><infinite>', if(o_orderkey % 2 = 0, 'INF', '-INF'), '</infinite><binary>', base64(encode(o_orderpriority, 'UTF-8')), '</binary><hex>', hex(o_orderstatus), '</hex><day>', date_format(o_orderdate, 'yyyy-MM-dd'), '</day><state> ready </state></s>')")
    v = unmarshal(docs, _SCALARS).select("doc_id", "value.*")
    return v.select("doc_id", "active", "long", F.col("decimal").cast("string").alias("decimal"), F.col("infinite").cast("string").alias("infinite"), F.col("binary").cast("string").alias("binary"), F.col("hex").cast("string").alias("hex"), F.col("day").cast("string").alias("day"), "state")


# ---- marshalling

_DECL = '<?xml version="1.0" encoding="UTF-8"?>'


@query(f"SELECT doc_id, '{_DECL}<document id=\"' || doc_id || '\" source=\"' || replace(replace(replace(source, '&', '&amp;'), '<', '&lt;'), '\"', '&quot;') || '\"><lang>' || lang || '</lang><text>' || replace(replace(text, '&', '&amp;'), '<', '&lt;') || '</text></document>' AS xml FROM documents")
def marshal_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = XmlSchema("document", T.StructType([attr("id", _L), attr("source"), elem("lang"), elem("text")]))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.struct(F.col("doc_id").alias("id"), "source", "lang", "text").alias("v"))
    return docs.select("doc_id", marshal(F.col("v"), schema).alias("xml"))


@query(f"SELECT c_custkey AS doc_id, '{_DECL}<order xmlns=\"urn:orders\" xmlns:ns1=\"urn:meta\" ns1:id=\"' || c_custkey || '\"><customer xmlns=\"urn:people\"><name>' || c_name || '</name></customer><note xmlns=\"\">' || c_mktsegment || '</note></order>' AS xml FROM customer")
def marshal_namespaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = XmlSchema("order", T.StructType([attr("id", _L, ns="urn:meta"), elem("customer", T.StructType([elem("name", ns="urn:people")]), ns="urn:people"), elem("note")]), ns="urn:orders")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), marshal(F.struct(F.col("c_custkey").alias("id"), F.struct(F.col("c_name").alias("name")).alias("customer"), F.col("c_mktsegment").alias("note")), schema).alias("xml"))


@query(f"SELECT c_custkey AS doc_id, '{_DECL}<d>' || CASE WHEN c_custkey % 2 = 0 THEN '<a>' || c_name || '</a><b>1</b>' ELSE '<a xmlns:xsi=\"http://www.w3.org/2001/XMLSchema-instance\" xsi:nil=\"true\"></a>' END || '</d>' AS xml FROM customer")
def marshal_nil(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = XmlSchema("d", T.StructType([elem("a", nillable=True), elem("b", _I)]))
    even = F.col("c_custkey") % 2 == 0
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), marshal(F.struct(F.when(even, F.col("c_name")).alias("a"), F.when(even, F.lit(1)).alias("b")), schema).alias("xml"))


@query(f"SELECT c_custkey AS doc_id, '{_DECL}<w><values><value>' || c_name || '</value><value>x</value></values><empty></empty><plain>' || c_nationkey || '</plain><plain>9</plain></w>' AS xml FROM customer")
def marshal_list_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = XmlSchema("w", T.StructType([elem("v", T.ArrayType(_S), local="value", wrapper="values"), elem("e", T.ArrayType(_S), local="value", wrapper="empty"), elem("p", T.ArrayType(_I), local="plain")]))
    row = F.struct(F.array("c_name", F.lit(None).cast("string"), F.lit("x")).alias("v"), F.array().cast("array<string>").alias("e"), F.array(F.col("c_nationkey"), F.lit(9)).alias("p"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), marshal(row, schema).alias("xml"))


def _part_struct():
    return F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))


_PART_SCHEMA = XmlSchema("part", T.StructType([attr("id", _L), elem("name")]))


@query("SELECT p_partkey AS doc_id, '<part id=\"' || p_partkey || '\"><name>' || p_name || '</name></part>' AS xml FROM part")
def marshal_fragment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), marshal(_part_struct(), _PART_SCHEMA, fragment=True).alias("xml"))


@query("SELECT p_partkey AS doc_id, CASE WHEN p_partkey % 2 = 0 THEN '<piece xmlns=\"urn:e\" id=\"' || p_partkey || '\"><name xmlns=\"\">' || p_name || '</name></piece>' ELSE '<piece xmlns=\"urn:e\" xmlns:xsi=\"http://www.w3.org/2001/XMLSchema-instance\" xsi:nil=\"true\"></piece>' END AS xml FROM part")
def marshal_element(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.when(F.col("p_partkey") % 2 == 0, _part_struct())
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), marshal(row, _PART_SCHEMA, fragment=True, root=("urn:e", "piece")).alias("xml"))


@query("SELECT c_custkey AS doc_id, '<owner><pet' || CASE WHEN c_custkey % 2 = 0 THEN ' xmlns:xsi=\"http://www.w3.org/2001/XMLSchema-instance\" xsi:type=\"dogType\"' ELSE '' END || '><name>' || c_name || '</name>' || CASE WHEN c_custkey % 2 = 0 THEN '<bark>true</bark>' ELSE '' END || '</pet></owner>' AS xml FROM customer")
def marshal_xsi_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    dog = F.col("c_custkey") % 2 == 0
    pet = F.struct(F.when(dog, F.lit("dogType")).alias("_type"), F.col("c_name").alias("name"), F.when(dog, F.lit(True)).alias("bark"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), marshal(F.struct(pet.alias("pet")), _PETS, fragment=True).alias("xml"))


@query("SELECT p_partkey AS doc_id, '<b><b64>' || base64(encode(p_name)) || '</b64><hex>' || hex(encode(p_brand)) || '</hex></b>' AS xml FROM part")
def marshal_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = XmlSchema("b", T.StructType([elem("b64", T.BinaryType()), elem("hex", T.BinaryType(), hex=True)]))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), marshal(F.struct(F.encode("p_name", "UTF-8").alias("b64"), F.encode("p_brand", "UTF-8").alias("hex")), schema, fragment=True).alias("xml"))


@query("SELECT s_suppkey AS doc_id, s_name AS name, s_nationkey AS nation, s_acctbal AS balance FROM supplier")
def roundtrip_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = XmlSchema("supplier", T.StructType([elem("name"), attr("nation", _I), elem("balance", _D)]))
    made = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"), marshal(F.struct(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance")), schema).alias("content"))
    return unmarshal(made, schema).select("doc_id", "value.name", "value.nation", "value.balance")


# ---- relations over projections


@query("SELECT protocol, kind, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'SEPA' ELSE 'ISO_20022' END AS protocol, CASE WHEN o_orderkey % 2 = 0 THEN 'CstmrCdtTrfInitn' ELSE 'BkToCstmrStmt' END AS kind FROM orders) GROUP BY ROLLUP (protocol, kind)")
def xml_protocol_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = built(spark, sf_dir, "orders", "o_orderkey", "if(o_orderkey % 2 = 0, '<D><CstmrCdtTrfInitn/></D>', '<D><BkToCstmrStmt/></D>')")
    return records.payments(docs).withColumnRenamed("message_type", "kind").rollup("protocol", "kind").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey AS doc_id, o_orderstatus FROM orders WHERE o_orderkey % 3 = 0")
def reject_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = built(spark, sf_dir, "orders", "o_orderkey", "if(o_orderkey % 3 = 0, '<a>', '<a/>')", "o_orderstatus")
    return docs.join(ev.xml_status(docs).where("ok"), "doc_id", "left_anti").select("doc_id", "o_orderstatus")


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share; on one machine, a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
        folder = "file://" + tempfile.mkdtemp(prefix="xylem-")
    return f"{folder.rstrip('/')}/queries-{uuid.uuid4().hex}"


def _put(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file where executors can read it."""
    file = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = file.getFileSystem(spark._jsc.hadoopConfiguration()).create(file, True)
    out.write(bytearray(text.encode()))
    out.close()


_CUSTOMER_XML = "concat('<r id=\"', c_custkey, '\">', c_name, '<x/></r>')"
_CUSTOMER_EVENTS = [("START_DOCUMENT", "NULL", "NULL"), ("START_ELEMENT", "'r'", "NULL"), ("TEXT", "NULL", "c_name"), ("START_ELEMENT", "'x'", "NULL"), ("END_ELEMENT", "'x'", "NULL"), ("END_ELEMENT", "'r'", "NULL"), ("END_DOCUMENT", "NULL", "NULL")]


@query(" UNION ALL ".join(f"SELECT c_custkey AS doc_id, {i}::BIGINT AS seq, '{e}' AS event, CAST({n} AS VARCHAR) AS name, CAST({t} AS VARCHAR) AS text FROM customer" for i, (e, n, t) in enumerate(_CUSTOMER_EVENTS)))
def stream_events_available_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of a table of documents, read as a stream until there are no more files."""
    from xylem.streaming.streams import run_available

    folder = shared_folder(spark)
    built(spark, sf_dir, "customer", "c_custkey", _CUSTOMER_XML).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema("doc_id long, content string").parquet(f"{folder}/in")
    run_available(stream, lambda df: ev.xml_events(df, columns=["seq", "event", "name", "text"]), "xylem_stream", f"{folder}/checkpoint", f"{folder}/out").awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type AS name, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by day and root, counted over a stream with a watermark."""
    from xylem.streaming.streams import windowed_counts

    folder, name = shared_folder(spark), f"xylem_{uuid.uuid4().hex}"
    table(spark, sf_dir, "events").selectExpr("event_id AS doc_id", "cast(ts AS timestamp) AS time", "concat('<', event_type, '/>') AS content").write.parquet(f"{folder}/in")
    stream = spark.readStream.schema("doc_id long, time timestamp, content string").parquet(f"{folder}/in")
    roots = stream.select("time", F.regexp_extract("content", "^<([^/]+)/>$", 1).alias("name"))
    windowed_counts(roots, "time", ["name"], "1 day").writeStream.trigger(availableNow=True).option("checkpointLocation", f"{folder}/checkpoint").format("memory").queryName(name).outputMode("complete").start().awaitTermination()
    return spark.table(name).select(F.to_timestamp_ntz(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss")).alias("day"), "name", "n")


# ---- sources and sinks


@query("SELECT p_partkey AS doc_id, substr('<p>' || p_name || '</p>', 1, 8) AS head FROM part")
def bounded_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = built(spark, sf_dir, "part", "p_partkey", "encode(concat('<p>', p_name, '</p>'), 'UTF-8')")
    return docs.select("doc_id", guards.bounded(F.col("content"), 8).cast("string").alias("head"))


@query("SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 2 = 0 THEN 'é-' ELSE 'bytes-' END || c_name AS text FROM customer")
def first_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes where they are given, else characters, as UTF-8."""
    from xylem.sources import files

    both = built(spark, sf_dir, "customer", "c_custkey", "concat('<r>é-', c_name, '</r>')", "if(c_custkey % 2 = 1, encode(concat('<r>bytes-', c_name, '</r>'), 'UTF-8'), NULL) AS bytes")
    docs = both.select("doc_id", files.first_source(F.col("bytes"), F.col("content")).alias("content"))
    return ev.xml_events(docs, columns=["text"], events=["TEXT"])


@query("SELECT s_suppkey AS id, s_name AS name FROM supplier")
def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as text files, one a file, and read again whole."""
    from xylem.sources import files

    folder = shared_folder(spark)
    files.write_files(built(spark, sf_dir, "supplier", "s_suppkey", "concat('<s id=\"', s_suppkey, '\"><name>', s_name, '</name></s>')"), folder)
    docs = files.read_text_documents(spark, f"{folder}/*")
    schema = XmlSchema("s", T.StructType([attr("id", _L), elem("name")]))
    return unmarshal(docs, schema).select("value.id", "value.name")


@query("SELECT s_suppkey AS id, s_nationkey AS nation FROM supplier")
def binary_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by bytes."""
    from xylem.sources import files

    folder = shared_folder(spark)
    files.write_files(built(spark, sf_dir, "supplier", "s_suppkey", "concat('<s id=\"', s_suppkey, '\">', s_nationkey, '</s>')"), folder)
    docs = files.read_documents(spark, folder, glob="*.txt", recursive=True)
    schema = XmlSchema("s", T.StructType([attr("id", _L), value("nation", _I)]))
    return unmarshal(docs, schema).select("value.id", "value.nation")


@query("SELECT c_custkey AS doc_id, c_name || chr(10) || c_mktsegment AS text FROM customer")
def sink_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with line feeds, written one a row and read again."""
    from xylem.sources import files

    folder = shared_folder(spark)
    files.write_documents(built(spark, sf_dir, "customer", "c_custkey", "concat('<r>', c_name, '\n', c_mktsegment, '</r>')"), folder, format="parquet")
    return ev.xml_events(spark.read.parquet(folder), columns=["text"], events=["TEXT"])


@query("SELECT c_custkey AS id, c_name AS name FROM customer")
def sink_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written one a line and read again."""
    from xylem.sources import files

    folder = shared_folder(spark)
    files.write_documents(built(spark, sf_dir, "customer", "c_custkey", "concat('<r id=\"', c_custkey, '\">', c_name, '</r>')"), folder)
    docs = spark.read.text(folder).select(F.xxhash64("value").alias("doc_id"), F.col("value").alias("content"))
    return unmarshal(docs, XmlSchema("r", T.StructType([attr("id", _L), value("name")]))).select("value.id", "value.name")


@query("SELECT l_orderkey AS orderkey, l_linenumber AS line, l_partkey AS part FROM lineitem")
def framed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large files of repeated elements, read by Spark's own source."""
    from xylem.sources import files

    folder = shared_folder(spark)
    items = "concat('<item><orderkey>', l_orderkey, '</orderkey><line>', l_linenumber, '</line><part>', l_partkey, '</part></item>')"
    files.write_rows(built(spark, sf_dir, "lineitem", "l_orderkey", items), folder, "items")
    return files.read_rows(spark, folder, "item", "orderkey long, line int, part long")


@query("SELECT o_orderkey AS doc_id, o_orderkey % 3 = 0 AS ok FROM orders")
def xsd_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from xylem.sources import files

    path = shared_folder(spark) + "/order.xsd"
    _put(spark, path, '<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:element name="o"><xs:complexType><xs:sequence><xs:element name="n" type="xs:long"/></xs:sequence></xs:complexType></xs:element></xs:schema>')
    docs = built(spark, sf_dir, "orders", "o_orderkey", "element_at(array(concat('<o><n>', o_orderkey, '</n></o>'), '<o><n>x</n></o>', '<!DOCTYPE o><o><n>1</n></o>'), cast(o_orderkey % 3 AS int) + 1)")
    return files.validate_xsd(docs, path)


@query(" UNION ALL ".join(f"SELECT c_custkey AS doc_id, {i + 1}::BIGINT AS seq, '{e}' AS event, {d} AS depth, CAST({n} AS VARCHAR) AS name, CAST({t} AS VARCHAR) AS text, CAST({k} AS VARCHAR) AS key FROM customer" for i, (e, d, n, t, k) in enumerate([("START_ELEMENT", 1, "'c'", "NULL", "CAST(c_custkey AS VARCHAR)"), ("START_ELEMENT", 2, "'name'", "NULL", "NULL"), ("TEXT", 2, "NULL", "'<&' || c_name", "NULL"), ("END_ELEMENT", 2, "'name'", "NULL", "NULL"), ("START_ELEMENT", 2, "'tag'", "NULL", "NULL"), ("TEXT", 2, "NULL", "c_mktsegment", "NULL"), ("END_ELEMENT", 2, "'tag'", "NULL", "NULL"), ("START_ELEMENT", 2, "'tag'", "NULL", "NULL"), ("END_ELEMENT", 2, "'tag'", "NULL", "NULL"), ("END_ELEMENT", 1, "'c'", "NULL", "NULL")])))
def marshal_events_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of marshalled documents, without the documents."""
    schema = XmlSchema("c", T.StructType([attr("key", _L), elem("name"), elem("tag", T.ArrayType(_S))]))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.struct(F.col("c_custkey").alias("key"), F.concat(F.lit("<&"), "c_name").alias("name"), F.array("c_mktsegment", F.lit("")).alias("tag")).alias("v"))
    made = marshal_events(rows, "v", schema)
    return made.select("doc_id", "seq", "event", "depth", "name", "text", guards.attribute(F.col("attrs"), "key").alias("key"))


# ---- grammar and messages, odd cases


@query("SELECT o_orderkey AS doc_id, o_orderkey % 6 IN (0, 1, 5) AS ok, CASE o_orderkey % 6 WHEN 0 THEN 'A' WHEN 1 THEN 'A' WHEN 5 THEN 'x' END AS text, CASE o_orderkey % 6 WHEN 5 THEN 3 END::BIGINT AS attr_size FROM orders")
def hostile_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References in odd forms and of absurd length, and a NUL in an attribute: a document's fault is its own."""
    shapes = ["'<a>&#X41;</a>'", "'<a>&#0000000000000000000065;</a>'", "concat('<a>&#', repeat('9', 5000), ';</a>')", "'<a>&#x110000;</a>'", "concat('<a>&#x', repeat('F', 6000), ';</a>')", "concat('<a k=\"1', char(0), '2\">x</a>')"]
    docs = built(spark, sf_dir, "orders", "o_orderkey", f"element_at(array({', '.join(shapes)}), cast(o_orderkey % 6 AS int) + 1)")
    made = ev.xml_events(docs, columns=["text", "raw_attrs"], events=["START_ELEMENT", "TEXT"]).groupBy("doc_id").agg(F.max("text").alias("text"), F.max(F.length(guards.attribute(F.col("raw_attrs"), "k"))).cast("long").alias("attr_size"))
    return ev.xml_status(docs).select("doc_id", "ok").join(made, "doc_id", "left")


@query("SELECT o_orderkey AS doc_id, o_orderkey % 6 IN (0, 5) AS ok, CASE o_orderkey % 6 WHEN 0 THEN '1.20' WHEN 5 THEN '-1200.00' END AS amount, CASE o_orderkey % 6 WHEN 0 THEN '1E+400' WHEN 5 THEN '0.1' END AS big FROM orders")
def unmarshal_decimals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decimals that their column can't hold, and decimals of any size."""
    schema = XmlSchema("d", T.StructType([elem("amount", T.DecimalType(18, 2)), decimal_text("big")]))
    shapes = [("1.2", "1E+400"), ("1.234", "1"), ("NaN", "1"), ("1e30", "1"), ("1", "one"), ("-1.2E3", "0.1")]
    docs = built(spark, sf_dir, "orders", "o_orderkey", "element_at(array(" + ", ".join(f"'<d><amount>{x}</amount><big> {y} </big></d>'" for x, y in shapes) + "), cast(o_orderkey % 6 AS int) + 1)")
    return unmarshal(docs, schema).select("doc_id", "ok", F.col("value.amount").cast("string").alias("amount"), "value.big")


@query("SELECT o_orderkey AS doc_id, o_orderkey % 5 IN (0, 3, 4) AS ok, CASE o_orderkey % 5 WHEN 0 THEN -1 WHEN 3 THEN 6 WHEN 4 THEN 7 END::BIGINT AS transaction_count, CASE o_orderkey % 5 WHEN 1 THEN 'Invalid NbOfTxs' WHEN 2 THEN 'Empty NbOfTxs' END AS error FROM orders")
def nbtxs_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk of NbOfTxs has to be digits, and the last one counts; an empty element has none."""
    shapes = ["<NbOfTxs/>", "<NbOfTxs>x<!-- -->5</NbOfTxs>", "<NbOfTxs><![CDATA[]]></NbOfTxs>", "<NbOfTxs>5<!-- -->6</NbOfTxs>", "<NbOfTxs></NbOfTxs><NbOfTxs>7</NbOfTxs><NbOfTxs>x</NbOfTxs>"]
    docs = built(spark, sf_dir, "orders", "o_orderkey", "element_at(array(" + ", ".join(f"'{x}'" for x in shapes) + "), cast(o_orderkey % 5 AS int) + 1)").selectExpr("doc_id", "concat('<Document><CstmrCdtTrfInitn>', content, '</CstmrCdtTrfInitn></Document>') AS content")
    return records.payments(docs).select("doc_id", "ok", "transaction_count", "error")


@query("SELECT c_custkey AS doc_id, CAST(NULL AS VARCHAR) AS message_id, 'b' || c_custkey AS first_iban, chr(160) || c_name || chr(12288) AS first_bic, '5' AS control_sum FROM customer")
def payments_nested_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wanted field inside another takes its place; values lose characters up to the blank at their ends, and no others."""
    docs = built(spark, sf_dir, "customer", "c_custkey", "concat('<Document><FIToFIPmtStsRpt><MsgId>a<IBAN>b', c_custkey, '</IBAN>c</MsgId><BIC>\t', char(160), c_name, '\u3000 \n</BIC><CtrlSum> 5\r</CtrlSum></FIToFIPmtStsRpt></Document>')")
    return records.payments(docs).select("doc_id", "message_id", "first_iban", "first_bic", "control_sum")


@query("SELECT s_suppkey AS doc_id, s_suppkey % 5 IN (0, 1, 4) AS ok, s_suppkey % 5 IN (0, 1, 4) OR s_suppkey % 5 IN (2, 3) AS stream_ok FROM supplier")
def declaration_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = ['<?xml version="1.0" encoding="utf-8" standalone="yes"?><a/>', "<a/>", '<?xml version="2.0"?><a/>', '<?xml version="1.0" encoding="latin1"?><a/>', "<?xml version=\\'1.1\\'?><!-- c --><a/>"]
    docs = built(spark, sf_dir, "supplier", "s_suppkey", "element_at(array(" + ", ".join(f"'{x}'" for x in shapes) + "), cast(s_suppkey % 5 AS int) + 1)")
    return ev.xml_status(docs, declaration=True).select("doc_id", "ok").join(ev.xml_status(docs).select("doc_id", F.col("ok").alias("stream_ok")), "doc_id")


@query("SELECT s_suppkey AS doc_id, s_name AS text, CASE WHEN s_suppkey % 2 = 0 THEN 3 ELSE 0 END::BIGINT AS byte_start FROM supplier")
def byte_order_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = built(spark, sf_dir, "supplier", "s_suppkey", "concat(if(s_suppkey % 2 = 0, unhex('EFBBBF'), unhex('')), encode(concat('<a>', s_name, '</a>'), 'UTF-8'))")
    made = ev.xml_events(docs, columns=["event", "text", "byte_start"], events=["START_ELEMENT", "TEXT"])
    return made.groupBy("doc_id").agg(F.max("text").alias("text"), F.min("byte_start").alias("byte_start"))


@query("SELECT p_partkey AS doc_id, i - 1 AS pos FROM (SELECT p_partkey, x, unnest(generate_series(1, octet_length(x))) AS i FROM (SELECT p_partkey, encode('<é>' || p_name || '日</é>') AS x FROM part)) WHERE hex(x[i:i]) IN ('3C', '3E', '2F', '3D', '27', '22', '26', '3F', '21')")
def structural_index_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte offsets also where characters are longer."""
    return built(spark, sf_dir, "part", "p_partkey", "concat('<é>', p_name, '日</é>')").select("doc_id", F.explode(guards.structural_positions(F.col("content"))).alias("pos"))


@query("SELECT p_partkey AS doc_id, list_reduce([2166136261::HUGEINT] || list_transform(generate_series(1, length(p_name)), lambda i: ascii(substr(p_name, i, 1))::HUGEINT), lambda h, c: (xor(h::BIGINT, c::BIGINT)::HUGEINT * 16777619) % 4294967296)::BIGINT AS hash, 'local' AS local_last, 'b:local' AS local_first, 'a' AS prefix, p_name LIKE '%a%' AS has_a FROM part")
def slice_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.lit("a:b:local")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), guards.fnv1a(F.col("p_name")).alias("hash"), guards.local_name(name).alias("local_last"), guards.local_name(name, last=False).alias("local_first"), guards.prefix_of(name).alias("prefix"), (guards.find(F.col("p_name"), "a") < F.length("p_name")).alias("has_a"))


# ---- binding, odd cases

_CODE = Adapter(lambda c: F.concat(F.lit("C:"), c), lambda c: F.substring(c, 3, 1 << 20))


@query("SELECT l_orderkey AS doc_id, l_linenumber AS n, 'C:' || l_partkey AS code FROM lineitem")
def unmarshal_adapter_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adapters on fields of repeated elements."""
    schema = XmlSchema("order", T.StructType([elem("line", T.ArrayType(T.StructType([attr("n", _I), elem("part", adapter="code")])))]), adapters={"code": _CODE})
    return unmarshal(order_documents(spark, sf_dir), schema).select("doc_id", F.explode("value.line").alias("l")).select("doc_id", "l.n", F.col("l.part").alias("code"))


@query("SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 2 = 0 THEN 'C:' || c_name END AS one, CASE WHEN c_custkey % 2 = 1 THEN c_name END AS two FROM customer")
def unmarshal_any_adapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adapters where documents are bound by their roots, two of which have one local name."""
    context = XmlContext(XmlSchema("a", T.StructType([elem("v", adapter="code")]), adapters={"code": _CODE}), XmlSchema("a", T.StructType([elem("v")]), ns="urn:two"))
    docs = built(spark, sf_dir, "customer", "c_custkey", "concat(if(c_custkey % 2 = 0, '<a>', '<a xmlns=\"urn:two\">'), '<v xmlns=\"\">', c_name, '</v></a>')")
    return unmarshal_any(docs, context).select("doc_id", F.col("a.v").alias("one"), F.col("a_2.v").alias("two"))


_NAMED = XmlSchema("r", T.StructType([qname("kind"), qname("of", "attr")]))


@query("SELECT c_custkey AS doc_id, 'urn:' || c_nationkey AS ns, c_mktsegment AS local, 'p' AS prefix, CASE WHEN c_custkey % 3 < 2 THEN 'urn:d' END AS attr_ns, c_custkey % 3 < 2 AS ok FROM customer WHERE c_custkey % 3 < 2 UNION ALL SELECT c_custkey, NULL, NULL, NULL, NULL, false FROM customer WHERE c_custkey % 3 = 2")
def unmarshal_qname(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Qualified names as values, by the namespaces in scope; an unbound prefix refuses the document."""
    docs = built(spark, sf_dir, "customer", "c_custkey", "concat('<q:r xmlns:q=\"\" xmlns:p=\"urn:', c_nationkey, '\" xmlns=\"urn:d\" of=\"name\"><kind xmlns=\"\"> ', if(c_custkey % 3 < 2, 'p:', 'z:'), c_mktsegment, ' </kind></q:r>')")
    made = unmarshal(docs, _NAMED)
    return made.select("doc_id", "value.kind.ns", "value.kind.local", "value.kind.prefix", F.col("value.of.ns").alias("attr_ns"), "ok")


@query("SELECT c_custkey AS doc_id, '<r xmlns:q1=\"urn:a\" of=\"q1:x\"><kind' || CASE WHEN c_custkey % 2 = 0 THEN ' xmlns:q=\"urn:' || c_nationkey || '\">q:' ELSE '>' END || c_mktsegment || '</kind></r>' AS xml FROM customer")
def marshal_qname(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.struct(F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("urn:"), "c_nationkey")).otherwise("").alias("ns"), F.col("c_mktsegment").alias("local"), F.lit("").alias("prefix"))
    of = F.struct(F.lit("urn:a").alias("ns"), F.lit("x").alias("local"), F.lit("").alias("prefix"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), marshal(F.struct(kind.alias("kind"), of.alias("of")), _NAMED, fragment=True).alias("xml"))


@query("SELECT p_partkey AS doc_id, CASE WHEN p_partkey % 2 = 0 THEN '<n xmlns=\"urn:n\">' || p_size || '</n>' ELSE '<n xmlns=\"urn:n\" xmlns:xsi=\"http://www.w3.org/2001/XMLSchema-instance\" xsi:nil=\"true\"></n>' END AS xml FROM part")
def marshal_scalar_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.when(F.col("p_partkey") % 2 == 0, F.col("p_size"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), marshal_scalar(size, _I, ("urn:n", "n"), fragment=True).alias("xml"))


@query("SELECT l_orderkey AS doc_id, l_linenumber AS n, l_partkey AS part, CAST(l_quantity AS INTEGER) AS qty FROM lineitem")
def unmarshal_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binding from a relation of events, in any order of its rows."""
    events = ev.xml_events(order_documents(spark, sf_dir), columns=["seq", "event", "name", "text", "attrs"])
    return unmarshal_events(events, _ORDER).select("doc_id", F.explode("value.line").alias("l")).select("doc_id", "l.n", "l.part", "l.qty")


@query("SELECT l_orderkey AS doc_id, l_linenumber AS n, l_partkey AS part, CAST(l_quantity AS INTEGER) AS qty FROM lineitem")
def unmarshal_from_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binding from a relation of nodes."""
    nodes = ev.xml_nodes(ev.xml_events(order_documents(spark, sf_dir), columns=["seq", "event", "depth", "name", "text", "attrs", "owner_seq", "ordinal", "section"]))
    return unmarshal_nodes(nodes, _ORDER).select("doc_id", F.explode("value.line").alias("l")).select("doc_id", "l.n", "l.part", "l.qty")


@query("SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 4 = 0 THEN '{urn:pets}dogType' END AS type, c_custkey % 4 IN (0, 3) AS ok FROM customer")
def unmarshal_xsi_type_qname(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A type's name is qualified: its prefix counts, not only its local part."""
    pets = XmlSchema("owner", T.StructType([elem("pet", _PET, subtypes={"{urn:pets}dogType": ["bark"]})]))
    kinds = [' xmlns:p="urn:pets" xsi:type="p:dogType"', ' xsi:type="dogType"', ' xsi:type="p:dogType"', ""]
    docs = built(spark, sf_dir, "customer", "c_custkey", "concat('<owner xmlns:xsi=\"http://www.w3.org/2001/XMLSchema-instance\"><pet', element_at(array(" + ", ".join(f"'{k}'" for k in kinds) + "), cast(c_custkey % 4 AS int) + 1), '><name>n</name></pet></owner>')")
    return unmarshal(docs, pets).select("doc_id", F.col("value.pet._type").alias("type"), "ok")


@query("SELECT c_custkey AS doc_id, CASE c_custkey % 3 WHEN 1 THEN 'Expected root <customer>' WHEN 2 THEN 'Element b inside a scalar' END AS error FROM customer")
def unmarshal_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = built(spark, sf_dir, "customer", "c_custkey", "element_at(array('<customer><name>n</name></customer>', '<client/>', '<customer><name>n<b/></name></customer>'), cast(c_custkey % 3 AS int) + 1)")
    return unmarshal(docs, _CUSTOMER).select("doc_id", "error")


# ---- relational operators over the relations


@query("SELECT l_orderkey AS doc_id, 4 + 8 * count(*) AS n_events FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def largest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = ev.xml_events(order_documents(spark, sf_dir), columns=["event"]).groupBy("doc_id").agg(F.count("*").alias("n_events"))
    return counts.orderBy(F.desc("n_events"), "doc_id").limit(10)


@query("SELECT o_orderkey AS doc_id, 'M' || o_orderkey AS message_id FROM orders WHERE o_orderkey % 4 = 0")
def record_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that only one of two relations has, compared by value, nulls included."""
    docs = lambda change: built(spark, sf_dir, "orders", "o_orderkey", f"concat('<D><MsgId>', {change}, '</MsgId></D>')")
    a, b = (records.payments(docs(x)).drop("ok", "error") for x in ("concat('M', o_orderkey)", "if(o_orderkey % 4 = 0, 'other', concat('M', o_orderkey))"))
    return a.exceptAll(b).select("doc_id", "message_id")


# ---- options and checks


@query("SELECT s_suppkey AS doc_id, s_suppkey % 3 < 2 AS ok, true AS given_ok FROM supplier")
def session_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings of a session hold where no options are given."""
    session = spark.newSession()
    session.conf.set("xylem.max_depth", "2")
    docs = built(session, sf_dir, "supplier", "s_suppkey", "element_at(array('<a/>', '<a><b>x</b></a>', '<a><b><c>x</c></b></a>'), cast(s_suppkey % 3 AS int) + 1)")
    return ev.xml_status(docs).select("doc_id", "ok").join(ev.xml_status(docs, XmlOptions()).select("doc_id", F.col("ok").alias("given_ok")), "doc_id")


@query("SELECT count(*) AS rows, count(*) FILTER (o_orderkey % 3 = 0) AS refused FROM orders")
def observed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a listener sees of a pass over documents."""
    from xylem.sources import files

    seen, observation = files.observed(ev.xml_status(built(spark, sf_dir, "orders", "o_orderkey", "if(o_orderkey % 3 = 0, '<a>', '<a/>')")), f"seen_{uuid.uuid4().hex}")
    seen.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(observation.get["rows"], observation.get["refused"])], "rows long, refused long")


_REFUSALS: dict[str, Callable[[], object]] = {
    "a root bound twice": lambda: XmlContext(_CUSTOMER, _CUSTOMER),
    "a root that is not bound": lambda: XmlContext(_CUSTOMER).require("", "other"),
    "an adapter that is not known": lambda: XmlSchema("r", T.StructType([elem("x", adapter="none")])),
    "a type without a lexical form": lambda: XmlSchema("r", T.StructType([elem("x", T.CalendarIntervalType())])),
    "two texts of one element": lambda: XmlSchema("r", T.StructType([value("x"), value("y")])),
    "formatted output": lambda: marshal(F.lit(None), _CUSTOMER, formatted=True),
    "another encoding": lambda: marshal(F.lit(None), _CUSTOMER, encoding="latin1"),
    "an unknown profile": lambda: XmlOptions(profile="other"),
    "no depth": lambda: XmlOptions(max_depth=0),
    "a known root": lambda: XmlContext(_CUSTOMER).require("", "customer"),
    "options": lambda: XmlOptions(utf8="ON", profile="PAYMENTS", max_depth=3, capacity=100),
}


@query(" UNION ALL ".join(f"SELECT '{name}' AS what, {str(i < len(_REFUSALS) - 2).lower()} AS refused" for i, name in enumerate(_REFUSALS)))
def refused_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schemas, contexts, properties and options that are refused before any document is read, and some that are not."""

    def refused(make: Callable[[], object]) -> bool:
        try:
            make()
        except (ValueError, KeyError, TypeError):
            return True
        return False

    return spark.createDataFrame([(name, refused(make)) for name, make in _REFUSALS.items()], "what string, refused boolean")

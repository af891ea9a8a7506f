"""Document fingerprints: Merkle trees, in DataFrame functions alone.

Leaves are pieces of paragraphs (lines): of up to SMALL characters in the first
HEAD characters of a text's first paragraph, so that short texts have several,
and of up to LARGE elsewhere. A paragraph's node hashes its leaves' hashes, a
section's node those of its paragraphs, and the root those of its sections, all
by SHA-256, so equal roots mean equal texts. A section ends with a paragraph
whose own hash says so, wherever that stands: an inserted line changes the
section that it is in, and the others keep their nodes. A fingerprint is
``root/sections/paragraphs/head leaves/tail leaves``, nodes as their first eight
digits, with the numbers of their children: branches that differ locate edits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from xylem.llm.shared import let

HEAD, SMALL, LARGE = 256, 16, 128
#: First digits of the hashes of paragraphs that end a section: one of four.
ENDS = ("0", "1", "2", "3")
#: Text in one bucket of neighbours, and ranges of ids that one step cuts.
BUCKET_BYTES, RANGES = 2 << 20, 256
_LEAST = -(1 << 63)


def _leaves(text: Column, size: int) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{size}}}"), F.lit(0)), lambda x: F.sha2(x, 256))


def _node(hashes: Column) -> Column:
    return F.sha2(F.array_join(hashes, ""), 256)


def _short(hashes: Column) -> Column:
    return F.transform(hashes, lambda x: F.left(x, F.lit(8)))


def _counted(short: Column, counts: Column) -> Column:
    return F.array_join(F.zip_with(short, counts, lambda x, n: F.concat_ws(":", x, n)), ",")


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with the fingerprint of a text column; a null text is empty. An empty text has one paragraph without leaves."""

    def paragraph(p: Column, i: Column) -> Column:
        head = F.when(i == 0, _leaves(F.left(p, F.lit(HEAD)), SMALL)).otherwise(F.array().cast("array<string>"))
        tail = _leaves(F.when(i == 0, F.substring(p, F.lit(HEAD + 1), F.char_length(p))).otherwise(p), LARGE)
        made = F.struct(head.alias("head"), tail.alias("tail"))
        return let(made, lambda x: F.struct(_node(F.concat(x["head"], x["tail"])).alias("hash"), _short(x["head"]).alias("head"), _short(x["tail"]).alias("tail")))

    def tree(nodes: Column) -> Column:
        n = F.size(nodes)
        ends = F.filter(F.transform(nodes, lambda x, i: F.when(F.left(x["hash"], F.lit(1)).isin(*ENDS) | (i == n - 1), i + 1)), lambda i: i.isNotNull())
        sections = let(ends, lambda e: F.zip_with(F.concat(F.array(F.lit(0)), F.slice(e, 1, F.size(e) - 1)), e, lambda a, b: F.struct(_node(F.transform(F.slice(nodes, a + 1, b - a), lambda x: x["hash"])).alias("hash"), (b - a).alias("n"))))
        paragraphs = _counted(_short(F.transform(nodes, lambda x: x["hash"])), F.transform(nodes, lambda x: F.size(x["head"]) + F.size(x["tail"])))
        leaves = [F.array_join(F.flatten(F.transform(nodes, of)), ",") for of in (lambda x: x["head"], lambda x: x["tail"])]
        hashes = lambda s: F.transform(s, lambda x: x["hash"])
        return let(sections, lambda s: F.concat_ws("/", _node(hashes(s)), _counted(_short(hashes(s)), F.transform(s, lambda x: x["n"])), paragraphs, *leaves))

    nodes = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1), paragraph)
    return df.withColumn(name, let(nodes, tree))


def _branch(fingerprint: Column, i: int) -> Column:
    """The i-th list in a fingerprint, as text."""
    return F.filter(F.split(F.split(fingerprint, "/")[i], ","), lambda x: x != "")


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: 1 if the roots are equal, else the share of leaves in common (Dice), those of the tail weighing as much more
    as they are larger."""
    weight = LARGE // SMALL
    common = lambda i: F.size(F.array_intersect(_branch(a, i), _branch(b, i)))
    size = lambda x, i: F.size(F.array_distinct(_branch(x, i)))
    whole = size(a, 3) + size(b, 3) + weight * (size(a, 4) + size(b, 4))
    part = 2.0 * (common(3) + weight * common(4)) / F.greatest(whole, F.lit(1))
    return F.when(F.split(a, "/")[0] == F.split(b, "/")[0], F.lit(1.0)).otherwise(part)


def differing_sections(a: Column, b: Column) -> Column:
    """Numbers (from 0) of the sections of ``a`` whose nodes ``b`` does not have: where ``a`` was edited. An inserted or
    removed line marks the section that it is in, however it moves those behind it."""
    there = _branch(b, 1)
    return F.filter(F.transform(_branch(a, 1), lambda x, i: F.when(~F.array_contains(there, x), i)), lambda i: i.isNotNull())


def differing_paragraphs(a: Column, b: Column) -> Column:
    """Numbers (from 0) of the paragraphs of ``a`` that were edited: those, in sections that differ, which ``b`` does not have."""
    there = _branch(b, 2)
    paragraphs, sections = _branch(a, 2), F.transform(_branch(a, 1), lambda x: F.split(x, ":")[1].cast("int"))
    begin = F.transform(sections, lambda n, i: F.aggregate(F.slice(sections, 1, i), F.lit(0), lambda s, x: s + x))
    inside = F.flatten(F.transform(differing_sections(a, b), lambda i: F.sequence(F.get(begin, i), F.get(begin, i) + F.get(sections, i) - 1)))
    return F.filter(inside, lambda i: ~F.array_contains(there, F.get(paragraphs, i)))


def _spot(key: Column, rest: Column, bounds: Column) -> Column:
    """(at, rest): how many of the sorted bounds lie at or before the key. A key that is several of the bounds is dealt over
    their ranges by ``rest``, a number from 0 to below 1 that orders its rows; what is left of that comes back as rest."""
    below, upto = F.size(F.filter(bounds, lambda x: x < key)), F.size(F.filter(bounds, lambda x: x <= key))
    many = F.greatest(upto - below, F.lit(1))
    part = F.floor(rest * many).cast("int")
    return F.struct(F.when(upto - below > 1, below + 1 + part).otherwise(upto).alias("at"), (rest * many - part).alias("rest"))


def _bounds(key: Column, n: int) -> Column:
    """The n - 1 ids that part the rows in n ranges of about the same number."""
    return F.percentile_approx(key, F.array(*(F.lit(i / n) for i in range(1, n))), F.lit(max(10_000, 8 * n)))


def with_next(docs: DataFrame, columns: list[str], buckets: int) -> DataFrame:
    """docs with next_<column>: the values of the next row by ascending doc_id (after the last: the first). Rows are dealt
    once, by ranges of doc_id; the first row of each range also goes to the range before, where it closes the order. Rows
    without an id come first; rows of one id come in the order of the first column's hashes, and are dealt by these if they
    are many. Ranges are cut in two steps of RANGES at most, so that no plan and no task holds more than that many bounds."""
    if not isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        raise ValueError("ids have to be whole numbers")
    key, tie = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)), F.xxhash64(columns[0])
    rows = docs.withColumns({"__key": key, "__tie": tie})
    start = (F.col("__tie").cast("double") + 2.0**63) / 2.0**64
    coarse, fine = min(RANGES, buckets), min(RANGES, -(-buckets // RANGES))
    spot = F.struct(F.lit(0).alias("at"), start.alias("rest"))
    if coarse > 1:
        found = docs.agg(_bounds(key, coarse).alias("q")).first()["q"]
        spot = _spot(F.col("__key"), start, F.array(*map(F.lit, found or [_LEAST])))
    rows = rows.withColumn("__spot", spot)
    if fine > 1:
        cuts = docs.select("doc_id").withColumn("__key", key).select("__key", _spot(F.col("__key"), F.rand(0), F.array(*map(F.lit, found or [_LEAST])))["at"].alias("__at"))
        # RANGES rows of RANGES numbers at most
        cuts = F.broadcast(cuts.groupBy("__at").agg(_bounds(F.col("__key"), fine).alias("__cuts")))
        within = _spot(F.col("__key"), F.col("__spot.rest"), F.col("__cuts"))["at"]
        rows = rows.withColumn("__at", F.col("__spot.at")).join(cuts, "__at").withColumn("__bucket", F.col("__at") * fine + within).drop("__at", "__cuts")
    else:
        rows = rows.withColumn("__bucket", F.col("__spot.at"))
    rows = rows.drop("__spot")
    # what closes each range: the first row of the next range that has rows; a table of one row for each range
    least = rows.groupBy("__bucket").agg(F.min(F.struct("__key", "__tie")).alias("least"))
    order = Window.partitionBy(F.lit(0)).orderBy("__bucket")
    last = Window.partitionBy(F.lit(0))
    closing = least.select("__bucket", "least", F.coalesce(F.lag("__bucket").over(order), F.max("__bucket").over(last)).alias("__before"))
    met = rows.join(F.broadcast(closing), "__bucket")
    place = F.struct(F.col("__bucket").alias("bucket"), F.lit(0).alias("closing"))
    ahead = F.struct(F.col("__before").alias("bucket"), F.lit(1).alias("closing"))
    both = F.when(F.struct("__key", "__tie") == F.col("least"), F.array(place, ahead)).otherwise(F.array(place))
    dealt = met.withColumn("__to", F.explode(both))
    sorted_rows = Window.partitionBy("__to.bucket").orderBy("__to.closing", "__key", "__tie")
    made = dealt.select("*", *(F.lead(c).over(sorted_rows).alias(f"next_{c}") for c in columns)).where("__to.closing = 0")
    return made.drop("__key", "__tie", "__bucket", "least", "__before", "__to")


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every row of docs (doc_id, text) and of its edited text: the last half of its characters (rounded
    down) replaced by the first as many (or all) of the next document.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next and edited_sections
    (those of the text's sections in which it was edited). Null texts are empty; an empty text's fingerprint has no leaves,
    and two of them are alike; rows of one id, and rows without one, follow each other by their texts' hashes; a single row
    is its own next. Other columns are ignored; an empty table gives an empty result. The longest text is held by one task."""
    total = int(docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0)
    buckets = min(RANGES * RANGES, max(1, -(-total // BUCKET_BYTES)))
    texts = with_fingerprint(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text", "fingerprint")
    pairs = with_next(texts, ["text", "fingerprint"], buckets)
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = pairs.withColumn("edited", F.concat(F.left("text", n - half), F.left("next_text", half)))
    both = with_fingerprint(edited, "edited", "edited_fingerprint")
    a, b, c = F.col("fingerprint"), F.col("edited_fingerprint"), F.col("next_fingerprint")
    return both.select("doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), a, b, likeness(a, b).alias("near_edited"), likeness(a, c).alias("near_next"), differing_sections(a, b).alias("edited_sections"))

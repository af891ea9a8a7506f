"""One query for each operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from xylem.llm.chat_format import chat_format
from xylem.llm.fingerprints import document_fingerprints
from xylem.llm.jaccard_join import jaccard_join
from xylem.llm.language_id import language_id, learn
from xylem.llm.license_scan import license_scan
from xylem.llm.lm_scoring import lm_scoring
from xylem.llm.nearest import nearest
from xylem.llm.packing import pack
from xylem.llm.sentencepiece_codec import sentencepiece_codec
from xylem.llm.substring_dedup import substring_dedup


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """The place of a public vocabulary file on this machine; executors have the same package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = tokenizer_file("piece_bpe_32k.model")
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return sentencepiece_codec(docs, model).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.xxhash64("ids").alias("ids_xxhash64"), F.sha2("decoded", 256).alias("decoded_sha256"), (F.col("decoded") == F.col("text")).alias("round_trip"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_table(spark, sf_dir, "documents"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(_table(spark, sf_dir, "documents"), n=4, percent=85)


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring(_table(spark, sf_dir, "documents"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format(_table(spark, sf_dir, "conversations"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return language_id(docs.select("doc_id", held_out.alias("held_out"), "text"), learn(docs.where(~held_out))).drop("text")


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_fingerprints(_table(spark, sf_dir, "documents"))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 50 = 0"), k=5)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_substring_dedup, op2_packing, op3_sentencepiece, op4_license_scan, op5_jaccard_join, op6_lm_scoring, op7_nearest, op8_chat_format, op9_language_id, op10_document_fingerprints)}

_WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"
#: DuckDB SQL of the same rows, where SQL can state them.
ORACLES: dict[str, str] = {
    "op1_substring_dedup": f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("coalesce(text, '')")} AS words FROM documents),
starts AS (SELECT r, words, unnest(generate_series(1, len(words) - 34)) AS i FROM docs WHERE len(words) >= 35),
windows AS (SELECT r, i, array_to_string(words[i:i + 34], ' ') AS w FROM starts),
hits AS (SELECT r, i FROM windows WHERE w IN (SELECT w FROM windows GROUP BY w HAVING count(*) > 1)),
gone AS (SELECT DISTINCT r, i + k AS p FROM hits, (SELECT unnest(generate_series(0, 34)) AS k)),
every AS (SELECT r, unnest(words) AS word, unnest(generate_series(1, len(words))) AS p FROM docs),
kept AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text FROM every ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM docs LEFT JOIN kept USING (r)""",
    "op5_jaccard_join": f"""
WITH RECURSIVE docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS words FROM documents),
starts AS (SELECT r, words, unnest(generate_series(1, greatest(len(words) - 3, 1))) AS i FROM docs WHERE len(words) > 0),
shingles AS MATERIALIZED (SELECT DISTINCT r, array_to_string(words[i:i + 3], ' ') AS s FROM starts),
sizes AS (SELECT r, count(*) AS n FROM shingles GROUP BY r),
common AS (SELECT a.r AS a, b.r AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.r < b.r GROUP BY 1, 2),
links AS MATERIALIZED (SELECT c.a, c.b FROM common c JOIN sizes x ON x.r = c.a JOIN sizes y ON y.r = c.b WHERE 100 * c.n >= 85 * (x.n + y.n - c.n)),
linked AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a AS r, b AS dest FROM linked UNION SELECT reach.r, linked.b FROM reach JOIN linked ON linked.a = reach.dest),
least AS (SELECT reach.r, min(d.doc_id) AS least FROM reach JOIN docs d ON d.r = reach.dest GROUP BY reach.r)
SELECT doc_id, CAST(coalesce(sizes.n, 0) AS BIGINT) AS n_shingles, least(doc_id, coalesce(least.least, doc_id)) AS component_id FROM docs LEFT JOIN sizes USING (r) LEFT JOIN least USING (r)""",
}

"""Language ID with language-bitmask n-gram filters.

Training counts letter n-grams by language and keeps, for each language, those
that are typical of it. One table of slots holds all languages' Bloom filters,
sliced by bit: a slot has a bit for each language (a number for 64 of them), an n-gram sets
its languages' bits in its few slots, and the conjunction of an n-gram's slots
is the set of all languages that may hold it, found with one read of each slot.
A text's hits are counted for each language, the hits that the filter's fill
gives by chance are taken off, and the largest corrected share decides. The
table has a fixed size, whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from xylem.llm.blocks import text_size
from xylem.llm.shared import checkpointed, dropped, give_back, mapped
from xylem.llm.words import U, distinct_counts, mixed, slices, text_bytes, window_names

#: Bytes in an n-gram; slots in the table; slots of an n-gram; n-grams that a task holds before it passes them on.
SIZE, SLOTS, HASHES, HELD = 5, 1 << 20, 3, 2_000_000
#: Bytes of text whose n-grams are in memory at a time.
PART = 1 << 20
#: An n-gram is typical of a language that uses it at least 1 / SPREAD as often, by share, as the language that uses it
#: most, and so often (by share) at least.
SPREAD, LEAST = 4.0, 2e-6
_SEEDS = [U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Names of all n-grams of the texts' lower-cased letters, each run of other characters one blank, and their rows."""
    folded = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts.cast(pa.string()), "")), r"[^\p{L}]+", " ")
    data, offsets = text_bytes(folded)
    size = np.diff(offsets)
    # a blank on either side of each row
    out = np.full(len(data) + 2 * len(size), 32, np.uint8)
    row = np.repeat(np.arange(len(size)), size)
    out[np.arange(len(data)) + 2 * row + 1] = data
    names = window_names(out.astype(U) + U(1), SIZE)
    owner = np.repeat(np.arange(len(size)), size + 2)
    inside = owner[: len(names)] == owner[SIZE - 1 :] if len(names) else np.zeros(0, bool)
    return names[inside], owner[: len(names)][inside]


def has_letter(texts: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.match_substring_regex(texts.cast(pa.string()), r"\p{L}"), False).to_numpy(zero_copy_only=False)


def slots(names: np.ndarray, k: int) -> np.ndarray:
    return (mixed(names ^ _SEEDS[k]) & U(SLOTS - 1)).astype(np.int64)


class LanguageFilter:
    """All languages' filters in one table, and how full each is."""

    def __init__(self, languages: list[str]):
        self.languages = languages
        self.planes = -(-len(languages) // 64)
        self.table = np.zeros((self.planes, SLOTS), U)
        self.prior = np.zeros(len(languages))

    def add(self, names: np.ndarray, masks: np.ndarray, plane: int = 0) -> None:
        for k in range(HASHES):
            np.bitwise_or.at(self.table[plane], slots(names, k), masks)

    def _bits(self, words: np.ndarray) -> Iterator[np.ndarray]:
        """For each language, its bit of all words (plane, word)."""
        for i in range(len(self.languages)):
            yield (words[i // 64] >> U(i % 64)) & U(1)

    def close(self) -> LanguageFilter:
        """The chance that a strange n-gram seems to be in each language."""
        fill = np.array([np.count_nonzero(x) for x in self._bits(self.table)]) / SLOTS
        self.chance = fill**HASHES
        return self

    def hits(self, names: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """For each of n rows, how many of its n-grams each language may hold."""
        found = self.table[:, slots(names, 0)]
        for k in range(1, HASHES):
            found &= self.table[:, slots(names, k)]
        return np.stack([np.bincount(owner, x.astype(float), n) for x in self._bits(found)], 1) if self.languages else np.zeros((n, 0))

    def decide(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        n = len(texts)
        names, owner = grams(texts)
        total = np.bincount(owner, minlength=n)[:, None]
        share = np.clip((self.hits(names, owner, n) - total * self.chance) / np.maximum(total * (1 - self.chance), 1e-9), 0, 1)
        letter = has_letter(texts) & bool(self.languages)
        if not self.languages:
            return ["und"] * n, np.zeros(n)
        best = (share + 1e-9 * self.prior).argmax(1)
        return [self.languages[i] if ok else "und" for i, ok in zip(best, letter, strict=True)], np.where(letter, share[np.arange(n), best], 0.0)


def learn(docs: DataFrame) -> LanguageFilter:
    """Filters from all rows of docs (text, lang) with both; any number of languages. The driver gets the n-grams that are typical of some language,
    as parts of the table, of SLOTS numbers for 64 languages whatever the corpus, and one total for each language. Null texts
    and languages teach nothing; repeated rows count each."""
    rows = docs.where("text is not null and lang is not null").select("text", "lang")
    languages = sorted(r["lang"] for r in rows.groupBy("lang").count().collect())
    out = LanguageFilter(languages)
    if not languages:
        return out.close()
    number = {x: i for i, x in enumerate(languages)}
    total_bytes = text_size(rows)
    salts = max(64, total_bytes >> 25)
    rounds = max(1, total_bytes >> 31)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def total():
            for i, parts in held.items():
                names, inverse = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
                yield i, names, np.bincount(inverse, np.concatenate([x for _, x in parts]), len(names)).astype(np.int64)

        def dealt():
            for i, names, counts in total():
                salt = (names % U(salts)).astype(np.int32)
                order = np.argsort(salt, kind="stable")
                names, counts, salt = names[order], counts[order], salt[order]
                cuts = np.r_[0, np.flatnonzero(salt[1:] != salt[:-1]) + 1, len(salt)].tolist()
                spans = list(zip(cuts[:-1], cuts[1:], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array([int(salt[a]) for a, _ in spans], pa.int32()), pa.array([i] * len(spans), pa.int32()), pa.array([names[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([counts[a:b].tobytes() for a, b in spans], pa.binary())], names=["bucket", "lang", "names", "counts"])

        for batch in batches:
            for part in slices(batch, "text", PART):
                lang = np.array([number[x] for x in part.column("lang").to_pylist()], np.int64)
                names, owner = grams(part.column("text"))
                for i in np.unique(lang):
                    found, n = distinct_counts(names[lang[owner] == i])
                    if len(found):
                        held.setdefault(int(i), []).append((found, n))
                        size += len(found)
                if size > HELD:
                    held = {i: [(names, counts)] for i, names, counts in list(total())}
                    size = sum(len(x[0][0]) for x in held.values())
                    if size > HELD // 2:
                        yield from dealt()
                        held, size = {}, 0
        yield from dealt()
        held = {}
        give_back()

    counted = "bucket int, lang int, names binary, counts binary"

    def merge(table: pa.Table) -> pa.Table:
        names = np.concatenate([np.frombuffer(x, U) for x in table.column("names").to_pylist()])
        counts = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("counts").to_pylist()])
        names, inverse = np.unique(names, return_inverse=True)
        counts = np.bincount(inverse, counts, len(names)).astype(np.int64)
        return pa.table({"bucket": table.column("bucket")[:1], "lang": table.column("lang")[:1], "names": pa.array([names.tobytes()], pa.binary()), "counts": pa.array([counts.tobytes()], pa.binary()), "n": pa.array([int(counts.sum())], pa.int64())})

    # in two steps, so that no group grows with the number of tasks
    parts = rows.mapInArrow(count, counted).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(rounds)))
    merged = parts.groupBy("bucket", "lang", "part").applyInArrow(lambda t: merge(t), counted + ", n long")
    sums = checkpointed(merged.groupBy("bucket", "lang").applyInArrow(lambda t: merge(t), counted + ", n long"))
    totals = np.ones(len(languages))
    for r in sums.groupBy("lang").agg(F.sum("n").alias("n")).collect():
        totals[r["lang"]] = r["n"]

    def typical(table: pa.Table) -> pa.Table:
        """This bucket's part of the slots: (plane, slot, mask)."""
        langs = table.column("lang").to_pylist()
        held = [np.frombuffer(x, U) for x in table.column("names").to_pylist()]
        counts = [np.frombuffer(x, np.int64) for x in table.column("counts").to_pylist()]
        names = np.unique(np.concatenate(held))
        most = np.zeros(len(names))
        shares = []
        for i, x, c in zip(langs, held, counts, strict=True):
            at, share = np.searchsorted(names, x), c / totals[i]
            shares.append((i, at, share))
            most[at] = np.maximum(most[at], share)
        masks = np.zeros((out.planes, len(names)), U)
        for i, at, share in shares:
            at = at[(share >= LEAST) & (share * SPREAD >= most[at])]
            masks[i // 64, at] |= U(1) << U(i % 64)
        plane, at = np.nonzero(masks)
        slot = np.concatenate([slots(names[at], k) for k in range(HASHES)])
        return pa.table({"plane": pa.array(np.tile(plane, HASHES), pa.int32()), "slot": slot, "mask": np.tile(masks[plane, at], HASHES).astype(np.int64)})

    table = sums.groupBy("bucket").applyInArrow(typical, "plane int, slot long, mask long").groupBy("plane", "slot").agg(F.bit_or("mask").alias("mask")).toArrow()
    out.prior = totals / totals.sum()
    out.table[table.column("plane").to_numpy(), table.column("slot").to_numpy()] = table.column("mask").to_numpy().astype(U)
    dropped(sums)
    return out.close()


def language_id(docs: DataFrame, model: LanguageFilter, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs (with text, and any other columns) with the columns ``names``, the predicted language and its score (0 to 1): the
    language whose share of the text's n-grams, less chance hits, is the largest; ties go to the one with more training text.

    A null text or one without a letter is ``und`` with score 0; so is every text when nothing was learned. Whole texts count,
    also very long ones; repeated rows are judged each; columns that are called like one of ``names`` are replaced; an empty
    table stays empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    kept = [f for f in docs.schema.fields if f.name.lower() not in {n.lower() for n in names}]
    text = next(f"c{i}" for i, f in enumerate(kept) if f.name.lower() == "text")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        for batch in batches:
            for part in slices(batch, text, PART):
                lang, score = shared.value.decide(part.column(text))
                yield [*part.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())]
        give_back()

    made = [T.StructField(n, t) for n, t in zip(names, (T.StringType(), T.DoubleType()), strict=True)]
    return mapped(docs, kept, made, decide)

"""The dealt methods against their definitions, without a cluster where that is possible."""

import collections
import hashlib
import itertools
import os
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_text_operators import SF, brute_dedup, brute_join, brute_scores, documents, rows_of
from xylem.functions.hashing import span_names
from xylem.llm import blocks, fingerprints, wordpool
from xylem.llm import license_scan as licences
from xylem.llm.fingerprints import differing_paragraphs, differing_sections, document_fingerprints, likeness, with_fingerprint, with_next
from xylem.llm.jaccard_join import jaccard_join, node_of, other_name, set_names
from xylem.llm.language_id import HASHES, SLOTS, LanguageFilter, language_id, learn
from xylem.llm.lm_scoring import lm_scoring
from xylem.llm.nearest import nearest
from xylem.llm.packing import pack
from xylem.llm.queries import ORACLES, QUERIES, tokenizer_file
from xylem.llm.sentencepiece_codec import sentencepiece_codec
from xylem.llm.substring_dedup import longest_inside, parsed, recompress, substring_dedup

U = np.uint64


def morse(n):
    """A word of two letters and its letter-swapped partner, whose polynomials modulo 2**64 are equal from 1024 letters on."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


# ---- names


@pytest.mark.parametrize("n", [64, 256, 1024, 4096])
def test_regular_words_have_names_of_their_own(n):
    words = [*morse(n), "a" * n, "a" * (n - 1), "ab" * (n // 2), "ba" * (n // 2)]
    data = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    for lane in (0, 1):
        assert len(set(span_names(data, ends - [len(w) for w in words], ends, lane).tolist())) == len(words)


def test_names_hang_on_the_word_alone():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcé") for _ in range(rng.choice([1, 7, 8, 9, 30, 300]))).encode() for _ in range(300)]
    names = {}
    for _ in range(3):
        rng.shuffle(words)
        data = np.frombuffer(b" ".join(words), np.uint8)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        for w, x in zip(words, span_names(data, ends - [len(w) for w in words], ends).tolist(), strict=True):
            assert names.setdefault(w, x) == x
    assert len(set(names.values())) == len(names)


def test_regular_words_through_the_operators(spark):
    a, b = morse(1024)
    say = lambda w, i: f"{w} " + " ".join(f"{w}{j % 7}" for j in range(i))
    texts = [say(a, 39), say(b, 39), say(a, 39) + " end", say(b, 20), a, b, f"{a} {b} {a}", f"{b} {a} {b}"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    dedup = sorted(tuple(r) for r in substring_dedup(df).select("doc_id", "n_words", "n_removed", "kept_sha256").collect())
    assert dedup == brute_dedup(rows_of(df), 35)
    assert sorted(map(tuple, jaccard_join(df, 4, 85).collect())) == brute_join(rows_of(df), 4, 85)
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    path = tokenizer_file("word_bpe_49k.json")
    want = {i: len(Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids) + 1 for i, t in enumerate(texts)}
    assert {r.doc_id: r.doc_tokens for r in pack(df, path).collect()} == want
    path = tokenizer_file("piece_bpe_32k.model")
    library = SentencePieceProcessor(model_file=path)
    assert all(r.ids == library.encode(r.text) and r.decoded == r.text for r in sentencepiece_codec(df, path).collect())
    scored = {r.doc_id: tuple(r)[:7] for r in lm_scoring(df, depth=2).collect()}
    for w in brute_scores(rows_of(df), 2):
        assert scored[w[0]] == pytest.approx(w, rel=1e-9)


def test_a_pool_verifies_its_words(monkeypatch):
    names = wordpool.word_names
    monkeypatch.setattr(wordpool, "word_names", lambda *a: names(*a) if len(a) > 3 else names(*a) & U(3))
    pool = wordpool.WordPool(lambda words: (np.array([len(w) for w in words]), np.array([ord(c) for w in words for c in w], np.uint32)), most=20)
    rng = random.Random(2)
    for _ in range(20):
        texts = [" ".join(rng.choice(["a", "bc", "def", "xy", "z" * 9, "q", "rst"]) for _ in range(6)) for _ in range(4)]
        data = np.frombuffer("".join(texts).encode(), np.uint8)
        ids, offsets = pool.texts(data, np.r_[0, np.cumsum([len(t) for t in texts])])
        assert ["".join(map(chr, ids[a:b])) for a, b in itertools.pairwise(offsets)] == [t.replace(" ", "") for t in texts]


def test_places_need_both_names():
    names, checks = np.array([5, 5, 7, 9, 9], U), np.array([1, 2, 1, 3, 3], U)
    table = pa.concat_tables([blocks.placed_table(0, names, checks, np.arange(5), 5, 1), blocks.placed_table(1, np.array([7, 5], U), np.array([2, 2], U), np.array([3, 4]), 6, 1)])
    found = blocks._found(table)
    of = lambda b, n: blocks.places(found.filter(pa.compute.equal(found.column("block"), b)), n).tolist()
    assert of(0, 5) == [False, True, False, True, True]
    assert of(1, 6) == [False, False, False, False, True, False]


def test_sets_of_one_name_are_told_apart():
    a, b = np.arange(3, dtype=U), np.arange(4, dtype=U)
    assert set_names(a) != set_names(b) and node_of(a, frozenset()) == set_names(a)[0]
    assert node_of(a, frozenset(set_names(a)[:1])) == other_name(*set_names(a)) != set_names(a)[0]
    assert other_name(1, 2) != other_name(1, 3)


# ---- recompression


def texts_of_kinds(rng):
    say = lambda n, of: [rng.choice(of) for _ in range(n)]
    shared = say(60, range(40))
    return [say(200, range(3)), say(300, range(2)), [1] * 90, [1, 2] * 60, [1, 1, 2] * 40, say(30, range(40)) + shared, shared + say(9, range(40)), say(4, range(40)) + shared[3:50] + [7] * 40, say(150, range(500)), [], [5], [1, 2, 3] * 33 + [1]]


@pytest.mark.parametrize("window", [2, 3, 8, 35])
def test_parses_name_windows_exactly(window):
    rng = random.Random(window)
    letters = [np.random.default_rng(s).integers(1, 1 << 63, 500).astype(U) for s in (1, 2)]
    parses, symbols, words_of, total = {}, {}, {}, 0
    for _ in range(6):
        rows = texts_of_kinds(rng)
        rng.shuffle(rows)
        flat = np.array([w for r in rows for w in r], np.int64)
        first = np.r_[0, np.cumsum([len(r) for r in rows])]
        parse = recompress([x[flat] for x in letters], first, window)
        best = longest_inside(parse, first, len(flat), window)
        begin = np.flatnonzero(np.arange(len(flat)) + window <= np.repeat(first[1:], np.diff(first)))
        for p, a, b in zip(begin.tolist(), *(x.tolist() for x in parsed(parse, begin, window)), strict=True):
            content = tuple(flat[p : p + window].tolist())
            symbol = (int(parse.made[0][best[p]]), int(parse.low[best[p]]) - p, int(parse.high[best[p]]) - p) if best[p] >= 0 else None
            assert parses.setdefault(content, (a, b)) == (a, b)
            assert words_of.setdefault((a, b), content) == content
            assert symbols.setdefault(content, symbol) == symbol
            assert symbol is None or 0 <= symbol[1] < symbol[2] <= window
            total += 1
    assert total > len(parses)


def test_symbols_reach_the_scale_of_windows():
    rng = np.random.default_rng(3)
    names = [rng.integers(1, 1 << 63, 4000).astype(U) for _ in range(2)]
    parse = recompress(names, np.array([0, 4000]), 35)
    best = longest_inside(parse, np.array([0, 4000]), 4000, 35)[: 4000 - 34]
    assert (best >= 0).mean() > 0.9 and parse.length[best[best >= 0]].mean() > 4
    assert len(parse.last[0]) < 4000 * 0.8**5


def test_dedup_over_many_blocks(odd, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 3000)
    got = [tuple(r) for r in substring_dedup(odd, 35).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]
    assert sorted(got, key=repr) == brute_dedup(rows_of(odd), 35)


# ---- oracles


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    path = f"{SF}/documents.parquet"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/*.parquet')" if os.path.isdir(path) else f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}')")
    df = QUERIES[name](spark, SF)
    cursor = con.execute(ORACLES[name])
    assert [d[0] for d in cursor.description] == df.columns
    assert sorted(map(tuple, df.collect())) == sorted(cursor.fetchall())


# ---- joins


def test_a_column_over_many_buckets(docs_of, monkeypatch):
    """Near copies whose columns are dealt to several buckets form the same groups."""
    from xylem.llm import jaccard_join as join

    monkeypatch.setattr(join, "COLUMN", 5)
    rng = random.Random(6)
    texts = []
    for g in range(3):
        base = [f"g{g}w{i}" for i in range(60)]
        for _ in range(40):
            x = base.copy()
            for _ in range(rng.randint(0, 2)):
                x[rng.randrange(60)] = f"n{rng.randrange(30)}"
            texts.append(" ".join(x))
    df = docs_of(texts)
    assert sorted((tuple(r) for r in jaccard_join(df, 4, 85).collect()), key=repr) == brute_join(rows_of(df), 4, 85)


def test_rows_among_wanted(spark):
    df = spark.range(5000).withColumnRenamed("id", "place").withColumn("x", F.lit("y"))
    wanted = spark.range(0, 5000, 50).withColumnRenamed("id", "place")
    kept = {r.place for r in blocks.among(df, wanted, "place").collect()}
    assert kept >= set(range(0, 5000, 50)) and len(kept) < 1000


def test_freed_memory_is_given_back():
    import gc
    import re
    from pathlib import Path

    from xylem.llm.shared import give_back

    own = lambda: int(re.search(r"\nRssAnon:\s+(\d+)", Path("/proc/self/status").read_text())[1]) >> 10
    held = [np.ones(1 << 12) for _ in range(6000)]  # 192 MB in pieces that malloc keeps, under one that stays
    del held[:-1]
    gc.collect()
    before = own()
    give_back()
    assert own() < before - 100


# ---- scores


def test_scores_at_the_production_depth(odd):
    df = odd.where("length(text) < 700 or text is null")
    got = sorted((tuple(r)[:7] for r in lm_scoring(df).collect()), key=repr)
    for g, w in zip(got, sorted(brute_scores(rows_of(df), 5), key=repr), strict=True):
        assert g[:5] == w[:5]
        assert g[5:] == pytest.approx(w[5:], rel=1e-9)


# ---- languages


def test_more_than_64_languages(spark):
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz"
    lexicon = {f"l{i:02}": ["".join(rng.choice(letters) for _ in range(6)) for _ in range(12)] for i in range(70)}
    rows = [(lang, " ".join(rng.choice(words) for _ in range(40))) for lang, words in lexicon.items() for _ in range(3)] + [("rare", "einmalig")]
    model = learn(spark.createDataFrame(rows, "lang string, text string"))
    asked = spark.createDataFrame([(lang, " ".join(rng.choice(words) for _ in range(20))) for lang, words in lexicon.items()] + [("rare", "einmalig")], "lang string, text string")
    assert all(r.lang == r.lang_pred for r in language_id(asked, model).collect())


def test_filters_against_exact_sets():
    rng = np.random.default_rng(5)
    model = LanguageFilter(["a", "b", "c"])
    held = [rng.integers(1, 1 << 62, 40_000).astype(U) for _ in range(3)]
    held[1][:10_000] = held[0][:10_000]
    for i, names in enumerate(held):
        model.add(names, np.full(len(names), 1 << i, U))
    model.close()
    asked = np.concatenate([held[0][:5000], held[1][-3000:], rng.integers(1, 1 << 62, 20_000).astype(U)])
    exact = np.array([np.isin(asked, x).sum() for x in held])
    hits = model.hits(asked, np.zeros(len(asked), np.int64), 1)[0]
    assert (hits >= exact).all()
    corrected = (hits - len(asked) * model.chance) / (1 - model.chance)
    assert np.abs(corrected - exact).max() < 30
    for k in range(HASHES):
        assert model.table.shape == (1, SLOTS) and ((model.table[0] >> U(k)) & U(1)).mean() < 0.12


# ---- fingerprints


def tree(text):
    """The fingerprint by its definition."""
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    cut = lambda x, n: [x[i : i + n] for i in range(0, len(x), n)]
    nodes = []
    for i, p in enumerate((text or "").split("\n")):
        head, tail = (cut(p[:256], 16), cut(p[256:], 128)) if i == 0 else ([], cut(p, 128))
        nodes.append((sha("".join(map(sha, head + tail))), [sha(x)[:8] for x in head], [sha(x)[:8] for x in tail]))
    sections, part = [], []
    for i, n in enumerate(nodes):
        part.append(n[0])
        if n[0][0] in "0123" or i == len(nodes) - 1:
            sections.append((sha("".join(part)), len(part)))
            part = []
    listed = [",".join(f"{h[:8]}:{n}" for h, n in sections), ",".join(f"{h[:8]}:{len(a) + len(b)}" for h, a, b in nodes), ",".join(x for _, a, _ in nodes for x in a), ",".join(x for _, _, b in nodes for x in b)]
    return "/".join([sha("".join(h for h, _ in sections)), *listed])


def alike(a, b):
    a, b = a.split("/"), b.split("/")
    if a[0] == b[0]:
        return 1.0
    sets = [[set(filter(None, x[i].split(","))) for x in (a, b)] for i in (3, 4)]
    common, size = (len(sets[0][0] & sets[0][1]) + 8 * len(sets[1][0] & sets[1][1])), sum(w * (len(x) + len(y)) for w, (x, y) in zip((1, 8), sets, strict=True))
    return 2.0 * common / max(size, 1)


def test_trees_and_likeness_by_definition(odd):
    df = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = sorted(rows_of(df))
    found = {r.doc_id: r for r in document_fingerprints(df).collect()}
    for i, (doc_id, text) in enumerate(rows):
        text, following = text or "", rows[(i + 1) % len(rows)][1] or ""
        edited = text[: len(text) - len(text) // 2] + following[: len(text) // 2]
        r = found[doc_id]
        assert (r.fingerprint, r.edited_fingerprint) == (tree(text), tree(edited))
        assert r.near_edited == pytest.approx(alike(r.fingerprint, r.edited_fingerprint))
        assert r.near_next == pytest.approx(alike(r.fingerprint, tree(following)))


def test_an_inserted_line_is_located(spark):
    lines = [f"line {i} says something of its own, number {i * i}" for i in range(120)]
    edits = {"inserted": lines[:40] + ["a new line"] + lines[40:], "removed": lines[:40] + lines[41:], "changed": lines[:40] + ["other"] + lines[41:]}
    for name, changed in edits.items():
        df = spark.createDataFrame([("\n".join(lines), "\n".join(changed))], "a string, b string")
        both = with_fingerprint(with_fingerprint(df, "a", "x"), "b", "y")
        x, y = F.col("x"), F.col("y")
        r = both.select(differing_sections(x, y).alias("old"), differing_sections(y, x).alias("new"), differing_paragraphs(x, y).alias("gone"), differing_paragraphs(y, x).alias("come"), likeness(x, y).alias("near")).first()
        assert len(r.old) <= 2 and len(r.new) <= 2 and r.near > 0.95
        assert r.gone == ([] if name == "inserted" else [40]) and r.come == ([] if name == "removed" else [40])


@pytest.mark.parametrize(("ranges", "buckets"), [(256, 1), (256, 7), (4, 16), (4, 9)])
def test_next_rows(spark, monkeypatch, ranges, buckets):
    monkeypatch.setattr(fingerprints, "RANGES", ranges)
    rng = random.Random(8)
    ids = [rng.randrange(-50, 1000) for _ in range(120)] + [7] * 60 + [None] * 50
    df = spark.createDataFrame([(i, f"text {n}") for n, i in enumerate(ids)], "doc_id long, text string").withColumn("h", F.xxhash64("text"))
    rows = sorted(((r.doc_id is not None, r.doc_id, r.h, r.text) for r in df.collect()), key=lambda r: (r[0], r[1] or 0, r[2]))
    want = {r[3]: rows[(i + 1) % len(rows)][3] for i, r in enumerate(rows)}
    assert {r.text: r.next_text for r in with_next(df.drop("h"), ["text"], buckets).collect()} == want


# ---- neighbours


def test_ties_go_to_the_smaller_id(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=8)
    rows = [(i, [float(v) for v in rng.normal(size=8)]) for i in range(300)]
    rows += [(1000 + i, [float(v) for v in base * 2.0 ** (i % 9)]) for i in range(40)]
    rows[50] = (50, [float(v) for v in base])
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = nearest(df, df.where("vec_id = 50"), k=5).orderBy("rank").collect()
    assert [r.vec_id for r in found] == [1000, 1001, 1002, 1003, 1004]


def test_recall_under_one_rule(spark):
    rng = np.random.default_rng(3)
    for n in (500, 6000):
        x = rng.normal(size=(n, 16))
        df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
        got = collections.defaultdict(list)
        for r in nearest(df, df.where("vec_id % 50 = 0")).orderBy("rank").collect():
            got[r.query_id].append(r.vec_id)
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        hits = []
        for i in range(0, n, 50):
            near = unit @ unit[i]
            near[i] = -2
            hits.append(len(set(np.argsort(-near)[:5].tolist()) & set(got[i])) / 5)
        assert np.mean(hits) >= 0.9


# ---- licences


def test_logits_by_numpy(spark):
    model = licences.train(documents(spark))
    lines = ["Released under the GPL v3", "Distributed under the MIT Licence", "Code available under Apache 2.0 terms", "This is free software under the GNU GPL", "Licensed under CC BY 4.0.", "nothing of the kind", "All rights reserved.", "licensed", "his driving license is here"]
    lines += [x for group in licences.NOTICES.values() for x in group]
    number = {g: i for i, g in enumerate(model.vocabulary)}
    want = {}
    for i, line in enumerate(lines):
        found = licences.words(line)
        at = [number[g] for g in set(found) | set(licences.pairs(found)) if g in number]
        logits = (model.bias + model.weights[at].sum(0)) / model.temperature
        p = np.exp(logits - logits.max())
        p /= p.sum()
        label = model.classes[int(p.argmax())]
        if label != licences.NOTHING:
            want[i] = label if p.max() >= licences.SURE else "unknown", float(p.max())
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {r.doc_id: (r.family, r.probability) for r in licences.license_scan(df, model).collect()}
    assert got.keys() == want.keys()
    for i, (family, p) in want.items():
        assert got[i][0] == family and got[i][1] == pytest.approx(p, abs=1e-3)


# ---- empty tables, odd columns


def test_more_empty_tables(spark, odd):
    none = odd.where("false")
    assert sentencepiece_codec(none, tokenizer_file("piece_bpe_32k.model")).count() == 0
    assert language_id(none, learn(none)).count() == 0
    docs = none.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.checkpointed(stage(spark, docs, SF))
        assert docs.count() == 0


def test_stages_keep_all_columns(spark):
    say = lambda x: " ".join(f"{x}{i}" for i in range(60))
    df = spark.createDataFrame([(i, say(x), "en" if x == "c" else None, "s", 3, 7.5, "mine", "dot", "kept", 4) for i, x in enumerate("aabc")], "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, `a.b` string, kept string, place int")
    docs = df
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.checkpointed(stage(spark, docs, SF))
        assert docs.columns == df.columns
    rows = docs.collect()
    assert sorted(r.doc_id for r in rows) == [0, 2, 3]
    assert {(r.score, r.lang_pred, r["a.b"], r.kept, r.place, r.source) for r in rows} == {(7.5, "mine", "dot", "kept", 4, "s")}
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 3


def test_plans_hold_no_long_literals(spark):
    text = QUERIES["op10_document_fingerprints"](spark, SF)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", text)

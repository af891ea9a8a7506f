import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from xylem.llm import fingerprints
from xylem.llm.components import components
from xylem.llm.fingerprints import differing_sections, document_fingerprints, likeness, with_fingerprint
from xylem.llm.jaccard_join import jaccard_join
from xylem.llm.language_id import language_id, learn
from xylem.llm.license_scan import license_scan, train
from xylem.llm.lm_scoring import lm_scoring
from xylem.llm.packing import column_generation, knapsack, pack, plan
from xylem.llm.queries import QUERIES, tokenizer_file
from xylem.llm.sentencepiece_codec import Viterbi, sentencepiece_decode, sentencepiece_encode
from xylem.llm.substring_dedup import substring_dedup

SF = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def words(text, lower=False):
    raw = (text or "").encode()
    return WORD.findall(raw.translate(LOWER) if lower else raw)


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


# ---- substring dedup


def brute_dedup(rows, window):
    found = [words(t) for _, t in rows]
    count = collections.Counter(tuple(x[i : i + window]) for x in found for i in range(len(x) - window + 1))
    out = []
    for (doc_id, _), x in zip(rows, found, strict=True):
        gone = [False] * len(x)
        for i in range(len(x) - window + 1):
            if count[tuple(x[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((doc_id, len(x), sum(gone), hashlib.sha256(b" ".join(w for w, g in zip(x, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("window", [2, 5, 35])
def test_substring_dedup_like_brute_force(odd, window):
    got = [tuple(r) for r in substring_dedup(odd, window).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]
    assert sorted(got, key=repr) == brute_dedup(rows_of(odd), window)


def test_substring_dedup_on_documents(spark):
    df = documents(spark)
    got = [tuple(r) for r in QUERIES["op1_substring_dedup"](spark, SF).collect()]
    assert sorted(got, key=repr) == brute_dedup(rows_of(df), 35)


def test_substring_dedup_text(docs_of):
    shared = " ".join(f"p{i}" for i in range(40))
    found = {r.doc_id: r for r in substring_dedup(docs_of([f"one\n{shared}\ntwo  three", shared, "other"]), 35, True, ["source"]).collect()}
    assert (found[0].kept_text, found[1].kept_text, found[2].kept_text) == ("one\ntwo  three", "", "other")
    assert [(s.start, s.end) for s in found[0].removed] == [(1, 41)]
    assert found[0].kept.source == "s"


# ---- packing


def test_knapsack_and_plan():
    rng = np.random.default_rng(1)
    weights = np.unique(rng.integers(3, 30, 9))
    values = rng.random(len(weights))
    best = max(sum(values[list(c)]) for n in range(12) for c in itertools.combinations_with_replacement(range(len(weights)), n) if sum(weights[list(c)]) <= 31)
    assert knapsack(values, weights, 31, 4)[0] == pytest.approx(best)
    demand = rng.integers(1, 400, len(weights))
    steps = plan(weights, demand, 31)
    assert (sum(t * p for t, p in steps) == demand).all()
    assert all(p @ weights <= 31 for _, p in steps)
    _, used = column_generation(weights, demand.astype(float), 31)
    assert used.sum() - 1e-6 <= sum(t for t, _ in steps) <= used.sum() * 1.1 + 3


def test_packing(spark, odd):
    from tokenizers import Tokenizer

    path = tokenizer_file("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    special = spark.createDataFrame([(100, "a<|endoftext|>B, c. <|ENDOFTEXT|> It's 12.5,. (x)."), (101, "İstanbul ﬁ é  x")], "doc_id long, text string")
    df = documents(spark).select((F.col("doc_id") + 1000).alias("doc_id"), "text").union(odd.select("doc_id", "text")).union(special)
    pieces = pack(df, path).collect()
    want = collections.Counter()
    for doc_id, text in rows_of(df):
        ids = np.array(tok.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        for at in range(0, len(ids), 4096):
            part = ids[at : at + 4096]
            want[doc_id, at, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1
    assert collections.Counter((p.doc_id, p.start, p.length, p.ids_crc32, p.doc_tokens) for p in pieces) == want
    sequences = collections.defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(p.length for p in pieces)
    assert total / (4096 * len(sequences)) > 0.95


# ---- SentencePiece


def test_sentencepiece_like_the_library(spark, odd):
    import sentencepiece

    path = tokenizer_file("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    more = spark.createDataFrame([(200, "  a  b "), (201, "▁x▁▁y"), (202, "\n\t x\r\ny"), (203, "日本 😀 é́ﬁ"), (204, "<s> <0x41> </s><unk>"), (205, "\x00\x1f\x7f")], "doc_id long, text string")
    for df in (odd, more, documents(spark)):
        for r in sentencepiece_decode(sentencepiece_encode(df, path), path).collect():
            text = r.text or ""
            assert r.ids == library.encode(text)
            assert r.decoded == library.decode(r.ids) == text.replace("▁", " ")


def test_viterbi_with_scores():
    class Model:
        kind, scores, longest = 1, {"a": -1.0, "b": -2.0, "ab": -2.5, "aba": -3.0, "bab": -3.1, "ba": -2.2}, 3

    search = Viterbi(Model)
    for word in sorted("".join(x) for n in range(1, 8) for x in itertools.product("abc", repeat=n)):
        cost = lambda parts: sum(Model.scores.get(p, search.worst if len(p) == 1 else -math.inf) for p in parts)
        every = [[word[i:j] for i, j in itertools.pairwise([0, *cuts, len(word)])] for n in range(len(word)) for cuts in itertools.combinations(range(1, len(word)), n)]
        assert cost(search.segment(word)) == pytest.approx(max(map(cost, every)))


# ---- licences


def test_license_scan(spark, odd):
    model = train(documents(spark))
    texts = {1: "prose here\nReleased under the MIT License.", 2: "Released under the Foo Bar License", 3: None, 4: "", 5: "x " * 3000 + "Licensed under the Apache License, Version 2.0.", 6: "his driving was permitted", 7: "This work is licensed under the GNU General Public License, version 3.\nLicensed under CC BY-NC 4.0."}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {(r.doc_id, r.paragraph): (r.family, r.confirmed) for r in license_scan(df, model).collect()}
    assert found == {(1, 1): ("MIT", True), (2, 0): ("unknown", False), (5, 0): ("Apache-2.0", True), (7, 0): ("GPL", True), (7, 1): ("CC-BY-NC", True)}
    assert license_scan(odd, model).count() == 0
    plan_text = license_scan(df, model)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan_text)


def test_license_scan_on_documents(spark):
    want = {r.doc_id for r in documents(spark).where("text rlike 'Licensed under|Released under|is licensed under'").collect()}
    reserved = {r.doc_id for r in documents(spark).where("text rlike 'All rights reserved'").collect()}
    found = QUERIES["op4_license_scan"](spark, SF).collect()
    assert {r.doc_id for r in found} == want | reserved
    assert {r.doc_id for r in found if r.confirmed} == want
    assert {r.doc_id for r in found if r.family == "unknown"} == reserved


# ---- n-gram join


def brute_join(rows, n, percent):
    sets = [frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if (w := words(t, True)) else frozenset() for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * len(sets[i] | sets[j]) and None not in (rows[i][0], rows[j][0]):
            parent[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return sorted(((d, len(sets[i]), least.get(root(i)) if d is not None else None) for i, (d, _) in enumerate(rows)), key=repr)


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_jaccard_join_on_odd_texts(odd, n, percent):
    df = odd.where("doc_id is null or doc_id <> 10")
    got = sorted((tuple(r) for r in jaccard_join(df, n, percent).collect()), key=repr)
    assert got == brute_join(rows_of(df), n, percent)


def test_jaccard_join_with_a_group_near_the_threshold(docs_of):
    import random

    rng = random.Random(5)
    base = [f"b{i}" for i in range(80)]
    texts = []
    for _ in range(60):
        x = base.copy()
        for _ in range(rng.randint(0, 3)):
            x[rng.randrange(80)] = f"n{rng.randrange(40)}"
        texts.append(" ".join(x))
    df = docs_of(texts)
    assert sorted((tuple(r) for r in jaccard_join(df, 4, 85).collect()), key=repr) == brute_join(rows_of(df), 4, 85)


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 102), (7, 7), (200, 200), (101, 103)]
    found = dict(tuple(r) for r in components(spark.createDataFrame(links, "a long, b long")).collect())
    assert found == dict.fromkeys(range(41), 0) | dict.fromkeys(range(100, 104), 100)


def test_components_of_random_graphs(spark):
    rng = random.Random(8)
    for n, m in ((5, 4), (60, 50), (400, 500)):
        links = [(rng.randint(-n, n), rng.randint(-n, n)) for _ in range(m)] + [(None, 1), (2, None)]
        least = {x: x for a, b in links if a is not None and b is not None and a != b for x in (a, b)}
        for _ in least:
            for a, b in links:
                if a in least and b in least and a != b:
                    least[a] = least[b] = min(least[a], least[b])
        assert dict(tuple(r) for r in components(spark.createDataFrame(links, "a long, b long")).collect()) == least


def test_a_round_of_components_is_planned_without_joins(spark, monkeypatch):
    from xylem.llm import components as graph

    plans, written = [], graph.checkpointed
    monkeypatch.setattr(graph, "checkpointed", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or written(df))
    found = components(spark.createDataFrame([(i, i + 1) for i in range(100)], "a long, b long"))
    assert found.where("component = 0").count() == 101
    assert len(plans) > 2 and not any("Join" in p for p in plans)


def test_the_driver_gets_a_byte_of_each_counter(docs_of, monkeypatch):
    from pyspark.sql import DataFrame

    from xylem.llm import jaccard_join as join

    monkeypatch.setattr(join, "COLUMN", 5)
    rng = random.Random(9)
    df = docs_of([" ".join(["a b c d e"] * rng.randint(1, 3) + [f"w{rng.randrange(50)}" for _ in range(rng.randrange(40))]) for _ in range(300)])
    got, collect = [], DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: got.extend(rows := collect(self)) or rows)
    rank, parts = join.frequency_table(df, 2, 1)
    assert sum(len(x) for r in got for x in r if isinstance(x, bytes | bytearray)) < 2 * len(rank)
    monkeypatch.undo()
    counts = collections.Counter(int(x) >> (64 - join.BITS) for r in df.collect() for g in join.ngram_sets(pa.array([r.text]), 2) for x in g)
    assert {int(i): (int(rank[i]), int(parts[i])) for i in rank.nonzero()[0]} == {i: (int(4 * math.log2(c + 1) + 1e-12), -(-c // 5)) for i, c in counts.items()}
    assert set(parts[rank == 0]) == {1}


def test_salted_keys_are_not_broadcast(spark, monkeypatch):
    from xylem.llm import jaccard_join as join

    rows = spark.createDataFrame([(c, 10 * c + r, c, 20) for c in range(20) for r in range(10)], "cluster long, owner long, component long, size int")
    dealt = join._dealt(rows, 80, 50_000)
    assert {(r.owner, r.component) for r in dealt.collect()} == {(10 * c + r, c) for c in range(20) for r in range(10)}
    seen, written = [], join.checkpointed
    monkeypatch.setattr(join, "checkpointed", lambda df: seen.append(df) or written(df))
    say = lambda *x: " ".join(f"w{i}" for i in x)
    texts = [say(*range(40), *range(k, k + 12)) for k in range(100, 2000, 100)] * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(map(tuple, join.jaccard_join(docs, 2, 80).collect())) == sorted(brute_join(list(enumerate(texts)), 2, 80))
    salted = [p for df in [dealt, *seen] if "explode" in (p := df._jdf.queryExecution().toString()).lower()]
    assert len(salted) > 1
    for plan in salted:
        joined = [x for x in plan.splitlines() if "HashJoin" in x or "MergeJoin" in x]
        assert not [x for x in joined if "salt" in x and "MergeJoin" not in x]


# ---- language model


def brute_scores(rows, depth):
    texts = [words(t, True) for _, t in rows]
    train = [d is None or zlib.crc32(str(d).encode()) % 5 != 1 for d, _ in rows]
    tokens = collections.Counter(w for x, t in zip(texts, train, strict=True) if t for w in [*x, None])
    total, distinct = sum(tokens.values()), len(tokens)
    counts = collections.defaultdict(lambda: [0, 0])

    def steps(x):
        s = b"\n" * depth + b" ".join(x) + b"\n"
        for i in range(depth, len(s)):
            for k in range(8):
                yield s[i - depth : i][::-1], 1 << k | s[i] >> 8 - k, s[i] >> 7 - k & 1

    for x, t in zip(texts, train, strict=True):
        if t:
            for context, node, bit in steps(x):
                for d in range(depth + 1):
                    counts[context[:d], node][bit] += 1
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(a + b + 1)
    weighted, deeper = {}, collections.defaultdict(float)
    for context, node in sorted(counts, key=lambda c: -len(c[0])):
        own = kt(*counts[context, node])
        weighted[context, node] = own if len(context) == depth else np.logaddexp(own, deeper[context, node]) - math.log(2)
        if context:
            deeper[context[:-1], node] += weighted[context, node]

    def predict(context, node, bit):
        p = None
        for d in range(depth, -1, -1):
            ab = counts.get((context[:d], node), [0, 0])
            own = (ab[bit] + 0.5) / (sum(ab) + 1)
            share = 1 / (1 + math.exp(min(700, deeper.get((context[:d], node), 0.0) - kt(*ab)))) if p is not None else 1
            p = own if p is None else share * own + (1 - share) * p
        return p

    spread = total + 0.5 * (distinct + 1)
    return [(d, not t, len(x) + 1, sum(tokens[w] > 0 for w in [*x, None]), total, sum(math.log10((tokens[w] + 0.5) / spread) for w in [*x, None]), sum(math.log10(predict(*s)) for s in steps(x))) for (d, _), x, t in zip(rows, texts, train, strict=True)]


def test_lm_scoring_like_brute_force(odd):
    df = odd.where("length(text) < 3000 or text is null")
    got = sorted((tuple(r)[:7] for r in lm_scoring(df, depth=2).collect()), key=repr)
    want = sorted(brute_scores(rows_of(df), 2), key=repr)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5]
        assert g[5:] == pytest.approx(w[5:], rel=1e-6)


def test_lm_scoring_of_held_out_texts_gains_from_contexts(spark):
    bits = []
    for depth in (2, 4):
        rows = lm_scoring(documents(spark), depth=depth).where("held_out").select("score", "bits_per_byte").collect()
        bits.append(sum(r.score for r in rows) / sum(r.score / r.bits_per_byte for r in rows))
    assert bits[1] < bits[0] < 4


# ---- languages


def test_language_id_on_held_out_documents(spark):
    truth = documents(spark).select("doc_id", "lang")
    found = QUERIES["op9_language_id"](spark, SF).where("held_out").join(truth, "doc_id")
    assert found.where("lang = lang_pred").count() >= 0.97 * found.count()


def test_language_id_on_odd_texts(spark, odd):
    model = learn(documents(spark))
    found = language_id(odd, model).collect()
    assert len(found) == odd.count()
    for r in found:
        letter = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letter)
        assert 0 <= r.score <= 1
    assert {r.lang_pred for r in language_id(odd, learn(odd.where("false"))).collect()} == {"und"}


# ---- fingerprints


@pytest.mark.parametrize("size", [1 << 10, 1 << 24])
def test_fingerprints_like_brute_force(odd, monkeypatch, size):
    monkeypatch.setattr(fingerprints, "BUCKET_BYTES", size)
    df = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = sorted(rows_of(df))
    found = {r.doc_id: r for r in document_fingerprints(df).collect()}
    assert len(found) == len(rows)
    prints = {}
    for i, (doc_id, text) in enumerate(rows):
        text, following = text or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        r = found[doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint
        assert prints.setdefault(edited, r.edited_fingerprint) == r.edited_fingerprint
    assert len(set(prints.values())) == len(prints)
    assert document_fingerprints(odd).count() == odd.count()


def test_branches(spark):
    lines = [f"line {i} says something of its own and goes on for a while" for i in range(200)]
    changed = lines.copy()
    changed[150] = "changed"
    df = spark.createDataFrame([("\n".join(lines), "\n".join(changed))], "a string, b string")
    r = with_fingerprint(with_fingerprint(df, "a", "x"), "b", "y").select(likeness(F.col("x"), F.col("y")).alias("n"), differing_sections(F.col("x"), F.col("y")).alias("d"), likeness(F.col("x"), F.col("x")).alias("same")).first()
    assert 0.98 < r.n < 1 and r.same == 1 and len(r.d) == 1


def test_native_operators_run_no_python(spark):
    plan_text = QUERIES["op10_document_fingerprints"](spark, SF)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan_text)


# ---- empty tables


def test_empty_tables(odd):
    none = odd.where("false")
    path = tokenizer_file("word_bpe_49k.json")
    for made in (substring_dedup(none), pack(none, path), jaccard_join(none), lm_scoring(none), document_fingerprints(none), license_scan(none)):
        assert made.count() == 0


# ---- licences in any words


def test_license_scan_needs_no_cue_word(spark):
    model = train(documents(spark))
    texts = {"Released under the GPL.": "GPL", "Distributed under GPLv3": "GPL", "CC BY 4.0": "CC-BY", "Released under Apache 2.0": "Apache-2.0", "MIT licence": "MIT", "dedicated to the public domain": "CC0", "All rights reserved.": "unknown", "Mit.": None, "his driving was permitted": None}
    df = spark.createDataFrame([(i, f"prose here\n{x}") for i, x in enumerate(texts)], "doc_id long, text string")
    found = {r.doc_id: (r.paragraph, r.family) for r in license_scan(df, model).collect()}
    assert found == {i: (1, family) for i, family in enumerate(texts.values()) if family}


def test_license_scan_finds_all_planted_lines(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    planted = "This work is licensed under the GNU General Public License, version 3.|Licensed under CC BY-NC 4.0.|Released under the MIT License.|Licensed under the Apache License, Version 2.0.|All rights reserved."
    lines = [(r.doc_id, i) for r in docs.where("text is not null").collect() for i, x in enumerate(r.text.split("\n")) if x in planted.split("|")]
    assert sorted((r.doc_id, r.paragraph) for r in license_scan(docs).collect()) == sorted(lines) and lines


def test_license_scan_gate_is_lossless(spark):
    import numpy as np

    from xylem.llm import license_scan as scan

    model = train(documents(spark))
    number = {g: i for i, g in enumerate(model.vocabulary)}
    weak, gate = model.weak(), re.compile(model.telling().replace(r"[\p{L}\p{N}]", r"[^\W_]"))
    pairs = [g for g in number if " " in g and weak.issuperset(g.split(" "))]
    gain = model.weights[:, :-1] - model.weights[:, -1:]
    assert (np.maximum(gain[[number[g] for g in [*weak, *pairs]]], 0).sum(0) < model.bias[-1] - model.bias[:-1]).all()
    assert all(gate.search(" ".join(scan.words(x))) for group in [*scan.NOTICES.values(), *scan.statements().values()] for x in group)


def test_license_scan_joins_wrapped_notices(spark):
    import textwrap

    model = train(documents(spark))
    notices = {
        "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
        "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "GPL": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    }
    texts, want = [], []
    for family, notice in notices.items():
        for width in (50, 72):
            for mark, top, end in (("", "", ""), ("# ", "#", "#"), (" * ", "/*", " */"), ("// ", "//", "//")):
                want.append(family)
                texts.append("\n".join(["Some prose about the code stands here", "Copyright 2020 Jane Doe", top, *(mark + x for x in textwrap.wrap(notice, width)), end, "", "int main;"]))
    df = spark.createDataFrame(list(enumerate([*texts, *(x.replace("\n", "\r\n") for x in texts)])), "doc_id long, text string")
    rows = license_scan(df, model).where("confirmed").collect()
    assert sorted((r.doc_id, r.paragraph, r.family) for r in rows) == [(i, 3, f) for i, f in enumerate(want * 2)]

import collections

import corpus_pipeline
from xylem.llm.queries import tokenizer_file

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    from tokenizers import Tokenizer

    from tests.llm.test_text_operators import brute_dedup, brute_join, rows_of

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_duplicates", "repeated_passages", "packing"]
    step = [docs]
    for _, stage in corpus_pipeline.STAGES:
        step.append(corpus_pipeline.checkpointed(stage(spark, step[-1], SF)))
    assert all(s.columns == docs.columns for s in step[:-1])
    kept = {r.doc_id for r in step[1].collect()}
    assert kept == {d for d, t in rows_of(docs) if t and any(c.isalpha() for c in t)}
    groups = brute_join(rows_of(step[1]), 5, 80)
    assert {r.doc_id for r in step[2].collect()} == {d for d, _, c in groups if d == c}
    removed = {d: (n - r) for d, n, r, _ in brute_dedup(rows_of(step[2]), 35)}
    after = dict(rows_of(step[3]))
    assert {d: len(t.split()) for d, t in after.items()} == removed
    assert all(r.n_chars == len(r.text) for r in step[3].collect())
    tok = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    got = collections.Counter()
    for p in step[4].collect():
        got[p.doc_id] += p.length
    assert got == {d: len(tok.encode(t, add_special_tokens=False).ids) + 1 for d, t in after.items()}
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "start", "length", "ids_crc32").collect())) == sorted((p.doc_id, p.start, p.length, p.ids_crc32) for p in step[4].collect())


def test_stages_on_odd_rows(spark, odd):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.checkpointed(stage(spark, docs, SF))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= docs.count()


def test_one_row_of_each_group_keeps_its_text(spark):
    say = lambda x: " ".join(f"{x}{i}" for i in range(80))
    texts = [(1, say("a")), (1, say("a")), (None, say("b")), (None, say("b")), (None, say("c")), (5, say("c")), (6, say("d")), (6, say("a")), (7, say("e")), (7, say("f")), (8, None), (8, None)]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    want = [(1, say("a")), (5, say("c")), (6, say("d")), (7, say("e")), (7, say("f")), (None, say("b"))]
    once = corpus_pipeline.checkpointed(corpus_pipeline.near_duplicates(spark, docs, SF))
    assert once.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in once.where("text is not null").collect()), key=repr) == sorted(want, key=repr)
    assert once.where("text is null").count() == 2
    cut = corpus_pipeline.repeated_passages(spark, once, SF).where("text <> ''").collect()
    assert sorted(((r.doc_id, r.text) for r in cut), key=repr) == sorted(want, key=repr)

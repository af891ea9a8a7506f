import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block int, names string, score string, lang_pred string, ids string, salt int, `__bucket` int"


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(texts, start=0):
        rows = [(start + i, t, "en", "s", len(t or ""), i, "n", "s", "l", "i", 1, 2) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, long, repeated, shared and near texts."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, base = say(60), say(120).split()
    near = base.copy()
    near[40] = "Changed"
    return [None, "", " \n\t ", "...", "é", "the " * 50, "the " * 90, "a b " * 40, say(5000), say(3), say(200), say(200), f"{say(20)} {passage}\n{say(9)}", f"{passage} {say(30)}", " ".join(base), " ".join(near), " ".join(base).upper(), "x" * 20_000, passage, passage]


@pytest.fixture(scope="session")
def odd(docs_of, odd_texts):
    """The odd texts, with a repeated row and one without an id."""
    df = docs_of(odd_texts)
    extra = df.where("doc_id = 10")
    return df.union(extra).union(extra.selectExpr("cast(null as long)", *[f"`{c}`" for c in df.columns[1:]]))

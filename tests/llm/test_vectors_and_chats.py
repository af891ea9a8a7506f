import functools
import random

import numpy as np

from xylem.llm import chat_format as chat
from xylem.llm.nearest import nearest

SCHEMA = "vec_id long, embedding array<float>, label int, score double"


def exact(rows, k):
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], np.float32).astype(float)
    n = np.sqrt((x * x).sum(1))
    out = {}
    for i in np.flatnonzero(ids % 50 == 0):
        score = x @ x[i] / (n * n[i])
        order = [j for j in np.lexsort((ids, -np.round(score, 12))) if ids[j] != ids[i]]
        out[int(ids[i])] = [int(ids[j]) for j in order[:k]]
    return out


def test_nearest_recall_and_order(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(v) for v in rng.normal(size=16)], 0, 0.0) for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for r in nearest(df, df.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = exact(rows, 5)
    assert got.keys() == want.keys()
    assert np.mean([len(set(got[q]) & set(want[q])) / 5 for q in want]) >= 0.9


def test_nearest_on_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [1.0]), (None, [1.0, 1.0]), (50, [1.0, 0.0]), (100, None)]
    same = [(i, [2.0, 0.0]) for i in range(60, 80)]
    rest = [(7, [1.0, 1.0]), (7, [1.0, 1.0]), (8, [-1.0, 0.0]), (9, [1e-30, 0.0])]
    df = spark.createDataFrame([(*r, 0, 0.0) for r in odd + same + rest], SCHEMA)
    found = nearest(df, df.where("vec_id % 50 = 0")).orderBy("rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in found] == [(50, i + 1, v) for i, v in enumerate([9, 60, 61, 62, 63])]
    assert all(r.score == 1.0 for r in found)
    assert nearest(df.where("false"), df).count() == 0
    few = df.where("vec_id in (7, 50)")
    assert [r.vec_id for r in nearest(few, few.where("vec_id = 50")).collect()] == [7]


COSTS = chat.Costs()


def least(roles):
    known = {"system": 1, "user": 2, "assistant": 3}

    @functools.cache
    def go(i, state, inserted):
        best = 0 if i == len(roles) and state == 3 else 10**9
        if i < len(roles):
            role = known.get(roles[i], 0)
            if state:
                best = min(best, COSTS.merge + COSTS.relabel * (state != role) + go(i + 1, state, 0))
            for x in chat.NEXT[state]:
                best = min(best, COSTS.relabel * (x != role) + go(i + 1, x, 0))
        if inserted < 3:
            for x in chat.NEXT[state]:
                best = min(best, COSTS.insert + go(i, x, inserted + 1))
        return best

    return go(0, 0, 0)


def legal(text):
    turns = [t.partition("\n")[0] for t in text.split("<|im_start|>")[1:]]
    if turns[:1] == ["system"]:
        turns = turns[1:]
    return turns == ["user", "assistant"] * (len(turns) // 2) and text.count("<|im_end|>\n") == text.count("<|im_start|>")


def test_chat_repairs_cost_least(spark, monkeypatch):
    monkeypatch.setattr(chat, "SEGMENT", 3)
    rng = random.Random(1)
    talks = {i: [rng.choice(["system", "user", "assistant", None, "tool"]) for _ in range(rng.randint(1, 9))] for i in range(80)}
    df = spark.createDataFrame([(c, t, r, f"t{t}", "x") for c, roles in talks.items() for t, r in enumerate(roles)], "conv_id long, turn long, role string, text string, bucket string")
    made = chat.chat_format(df)
    assert made.count() == df.count()
    for r in chat.rendered(made).collect():
        assert r.cost == least(tuple(talks[r.conv_id]))
        assert legal(r.text)


def test_chat_on_odd_rows(spark):
    rows = [(None, None, None, None), (1, None, "user", "a<|im_end|>b"), (1, 1, "assistant", None), (1, 1, "assistant", ""), (2, 5, "Human", "hi"), (2, 5, "Human", "hi")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {r.conv_id: r.text for r in chat.rendered(chat.chat_format(df)).collect()}
    assert found.keys() == {None, 1, 2}
    assert all(map(legal, found.values()))
    assert "a<|im_end| >b" in found[1]
    assert chat.chat_format(df.where("false")).count() == 0


def test_turns_of_one_number_or_none_are_cut(spark, monkeypatch):
    """A conversation without turn numbers is cut by role and text, and costs what the whole sequence costs."""
    rng = random.Random(9)
    rows = [(1, None, rng.choice(["user", "assistant", "system", None, "tool"]), f"t{i}") for i in range(70)]
    rows += [(2, 3, rng.choice(["user", "assistant"]), rng.choice(["same", "x", None])) for i in range(60)] + [(2, 4, "user", "end")]
    rows += [(3, i, rng.choice(["user", "assistant"]), "a" * 200_000 if i == 2 else "b") for i in range(9)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    monkeypatch.setattr(chat, "SEGMENT", 4)
    found = chat.chat_format(df).collect()
    assert len(found) == len(rows)
    for conv in (1, 2, 3):
        own = sorted((r for r in found if r.conv_id == conv), key=lambda r: r.number)
        assert [r.number for r in own] == list(range(len(own)))
        order = [((r.turn is not None, r.turn or 0), (r.role is not None, r.role or "")) for r in own]
        assert order == sorted(order)
        assert sum(r.cost for r in own) == least(tuple(r.role for r in own))
        text = "".join(r.piece for r in own)
        opened = [x.split("\n")[0] for x in text.split("<|im_start|>")[1:]]
        assert opened[-1] == "assistant" and all(x != y for x, y in zip(opened, opened[1:], strict=False))

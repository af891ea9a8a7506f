"""Chat formatting with minimum-cost role repair.

A legal conversation is accepted by a small automaton: a system turn may come
first, then user and assistant turns alternate, and an assistant turn is last.
Each given turn is kept, relabelled, or merged into the turn before, and empty
turns may be inserted; every way has a cost, and dynamic programming over the
automaton's states finds the least. A turn's effect is a small matrix in the
(min, +) algebra, so a long conversation is split into segments by turn number,
and where many turns have one number or none by role and text as well, whose
matrices are multiplied: no conversation has to fit into one task.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NONE, SYSTEM, USER, ASSISTANT = range(4)
ROLES = ("", "system", "user", "assistant")
NEXT = {NONE: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
FAR = np.int64(1) << 40
#: Turn numbers in a segment, and rows that a task handles at a time.
SEGMENT, ROWS = 1024, 20_000


@dataclass
class Costs:
    merge: int = 1
    insert: int = 2
    relabel: int = 3

    def path(self, state: int, target: int) -> tuple[int, ...] | None:
        """The fewest turns to insert in ``state`` so that a ``target`` turn may follow."""
        ways = [(state, ())]
        for _ in range(len(ROLES)):
            for at, inserted in ways:
                if target in NEXT[at]:
                    return inserted
            ways = [(x, (*inserted, x)) for at, inserted in ways for x in NEXT[at] if x != SYSTEM]
        return None

    def ending(self, state: int) -> tuple[int, ...]:
        """What to insert after the last turn."""
        return {NONE: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}[state]

    @cached_property
    def tables(self) -> tuple[np.ndarray, dict[tuple[int, int, int], tuple[str, tuple[int, ...]]]]:
        """For each given role (0: any other) the costs from state to state, and what is done there. Where ways cost the
        same, merging comes first."""
        costs, ways = np.full((4, 4, 4), FAR, np.int64), {}
        for role in range(4):
            for state in range(4):
                for target in (SYSTEM, USER, ASSISTANT):
                    label = self.relabel * (target != role)
                    if target == state:
                        costs[role, state, target] = self.merge + label
                        ways[role, state, target] = ("merge", ())
                    inserted = self.path(state, target)
                    if inserted is not None and (cost := self.insert * len(inserted) + label) < costs[role, state, target]:
                        costs[role, state, target] = cost
                        ways[role, state, target] = ("open", inserted)
        return costs, ways


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[:, :, None] + b[None]).min(1), FAR)


def _start() -> np.ndarray:
    out = np.full((4, 4), FAR, np.int64)
    np.fill_diagonal(out, 0)
    return out


def best_path(matrices: list[np.ndarray], first: int, last: int | np.ndarray) -> tuple[list[int], int]:
    """The states after each step of the cheapest way from state first, and its cost; last: the state to end in, or the
    cost of ending in each. Ties go to the later state."""
    total = np.full(4, FAR, np.int64)
    total[first] = 0
    back = []
    for m in matrices:
        ways = total[:, None] + m
        choice = 3 - ways[::-1].argmin(0)
        back.append(choice)
        total = np.minimum(ways[choice, np.arange(4)], FAR)
    if not isinstance(last, np.ndarray):
        end = last
    else:
        end = int(3 - (total + last)[::-1].argmin())
    cost, states, at = int(total[end]), [], end
    for choice in reversed(back):
        states.append(at)
        at = int(choice[at])
    return states[::-1], cost


def role_number(roles: pa.ChunkedArray) -> np.ndarray:
    known = {name: i for i, name in enumerate(ROLES) if name} | {"human": USER, "bot": ASSISTANT, "gpt": ASSISTANT, "model": ASSISTANT}
    return np.array([known.get((x or "").strip().lower(), NONE) for x in roles.to_pylist()], np.int64)


#: What tells segments apart, in order; and the order of rows.
_KEY = ["conv_id", "segment", "part_turn", "part_role", "part"]
_ORDER = [*_KEY, "turn", "role", "hash", "text"]


def _segments(table: pa.Table) -> list[tuple[int, int]]:
    """Ranges of rows of one conversation and segment, in a table sorted by them."""
    keys = list(zip(*(table.column(k).to_pylist() for k in _KEY), strict=True))
    cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
    return [(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if a < b]


def _sorted(table: pa.Table, keys: list[str]) -> pa.Table:
    return table.take(pc.sort_indices(table, sort_keys=[(k, "ascending") for k in keys], null_placement="at_start"))


def chat_format(turns: DataFrame, costs: Costs | None = None, start: str = "<|im_start|>", end: str = "<|im_end|>") -> DataFrame:
    """Repairs the roles of all conversations in turns (conv_id, turn, role, text) and renders them.

    Returns one row for each given row: conv_id, turn, number (its place in order), role, out_role, action (keep, relabel,
    merge, or merge+relabel), inserted (the empty turns put before it), inserted_after (those after the conversation's last
    row), cost and piece: what it adds to the rendered conversation, so that a conversation's pieces in order, joined, are
    its text (see ``rendered``). Turns are ordered by turn, then role, nulls first, then by their texts' hashes. Unknown and null roles take
    the label that costs least; null texts are empty; markers in a text get a space, so they don't end a turn; repeated
    rows are turns of their own; null conversations are one; a very long text is a turn like others; other columns are
    ignored, whatever their names; an empty table stays empty."""
    costs = costs or Costs()
    table, ways = costs.tables
    closing = np.array([costs.insert * len(costs.ending(s)) for s in range(4)], np.int64)
    rows = turns.select("conv_id", "turn", "role", "text", F.floor(F.col("turn") / SEGMENT).alias("segment"), F.xxhash64("text").alias("hash"))
    buckets = max(8, turns.count() // ROWS)
    # segments of many more rows than turn numbers are cut by turn, role and hash
    full = rows.groupBy("conv_id", "segment").agg(F.ceil(F.count("*") / SEGMENT).cast("int").alias("parts")).where(F.col("parts") > 4)
    a, b = rows.alias("a"), full.alias("b")
    joined = a.join(b, F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & F.col("a.segment").eqNullSafe(F.col("b.segment")), "left")
    cut = F.col("parts").isNotNull()
    share = (F.col("hash").cast("double") + 2.0**63) / 2.0**64
    parts = {"part_turn": F.when(cut, F.col("turn")), "part_role": F.when(cut, F.col("role")), "part": F.when(cut, F.least(F.floor(share * F.col("parts")), F.col("parts") - 1).cast("int"))}
    rows = joined.select("a.*", *(c.alias(n) for n, c in parts.items())).withColumn("bucket", F.pmod(F.xxhash64(*_KEY), F.lit(buckets)))
    types = dict(rows.dtypes)
    key = ", ".join(f"{k} {types[k]}" for k in _KEY)

    def multiply(part: pa.Table) -> pa.Table:
        part = _sorted(part.select([*_ORDER]), _ORDER)
        spans, role, out = _segments(part), role_number(part.column("role")), []
        for a, b in spans:
            m = _start()
            for r in role[a:b].tolist():
                m = _times(m, table[r])
            out.append(m.ravel().tolist())
        first = part.select(_KEY).take([a for a, _ in spans])
        return first.append_column("matrix", pa.array(out, pa.list_(pa.int64()))).append_column("rows", pa.array([b - a for a, b in spans], pa.int64()))

    def route(part: pa.Table) -> pa.Table:
        """The states in which each segment of whole conversations begins and ends, and how many rows come before it."""
        part = _sorted(part.select([*_KEY, "matrix", "rows"]), _KEY)
        conv, n = part.column("conv_id").to_pylist(), part.column("rows").to_numpy()
        matrices = [np.array(m).reshape(4, 4) for m in part.column("matrix").to_pylist()]
        cuts = [0, *(i for i in range(1, len(conv)) if conv[i] != conv[i - 1]), len(conv)]
        states = [(NONE, NONE, 0, False)] * len(conv)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            path, _ = best_path(matrices[a:b], NONE, closing)
            before = np.cumsum(n[a:b]) - n[a:b]
            for i in range(a, b):
                states[i] = (path[i - a - 1] if i > a else NONE, path[i - a], int(before[i - a]), i == b - 1)
        columns = list(zip(*states, strict=True)) or [[]] * 4
        return pa.table([*(part.column(k) for k in _KEY), *(pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.bool_()), strict=True))], names=[*_KEY, "first", "final", "before", "is_end"])

    def render(part: pa.Table) -> pa.Table:
        part = _sorted(part, _ORDER)
        role, text = role_number(part.column("role")), part.column("text").to_pylist()
        first, final, before, is_end = (part.column(c).to_pylist() for c in ("first", "final", "before", "is_end"))
        out: list[tuple] = []
        blank = lambda s: f"{start}{ROLES[s]}\n{end}\n"
        for a, b in _segments(part):
            path, _ = best_path([table[r] for r in role[a:b].tolist()], first[a], final[a])
            state = first[a]
            for i, new in zip(range(a, b), path, strict=True):
                way, inserted = ways[int(role[i]), state, new]
                body = (text[i] or "").replace(start, start[:-1] + " " + start[-1]).replace(end, end[:-1] + " " + end[-1])
                same = new == role[i]
                action = ("keep" if same else "relabel") if way == "open" else ("merge" if same else "merge+relabel")
                piece = "\n\n" + body if way == "merge" else (f"{end}\n" if state else "") + "".join(map(blank, inserted)) + f"{start}{ROLES[new]}\n{body}"
                cost = int(table[int(role[i]), state, new])
                after: tuple[int, ...] = ()
                if is_end[i] and i == b - 1:
                    after = costs.ending(new)
                    piece += f"{end}\n" + "".join(map(blank, after))
                    cost += costs.insert * len(after)
                out.append((before[i] + i - a, ROLES[new], action, [ROLES[x] for x in inserted], [ROLES[x] for x in after], cost, piece))
                state = new
        columns = list(zip(*out, strict=True)) or [[]] * 7
        kinds = (pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.int64(), pa.string())
        done = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
        return pa.table([part.column("conv_id"), part.column("turn"), done[0], part.column("role"), *done[1:]], names=["conv_id", "turn", "number", "role", "out_role", "action", "inserted", "inserted_after", "cost", "piece"])

    parts = rows.groupBy("bucket").applyInArrow(multiply, f"{key}, matrix array<long>, rows long")
    routed = parts.withColumn("bucket", F.pmod(F.xxhash64("conv_id"), F.lit(buckets))).groupBy("bucket").applyInArrow(route, f"{key}, first int, final int, before long, is_end boolean")
    same = functools.reduce(lambda x, y: x & y, (F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in _KEY))
    met = rows.alias("r").join(routed.alias("s"), same).select("r.*", "first", "final", "before", "is_end")
    return met.groupBy("bucket").applyInArrow(render, f"conv_id {types['conv_id']}, turn {types['turn']}, number long, role string, out_role string, action string, inserted array<string>, inserted_after array<string>, cost long, piece string")


def rendered(formatted: DataFrame) -> DataFrame:
    """(conv_id, text, cost) of whole conversations, for tables whose conversations each fit into one row."""
    ordered = F.sort_array(F.collect_list(F.struct("number", "piece")))
    return formatted.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda x: x["piece"]), "").alias("text"), F.sum("cost").alias("cost"))

"""Chat formatting with minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant in turn, ending with the
assistant. Dynamic programming over that automaton finds the cheapest repair of a conversation:
a turn is kept, relabelled, or merged into the turn before it, and empty turns are inserted. The
repaired sequence is rendered turn by turn; the pieces of a conversation, in order, are its text.

Turns are range-partitioned by conversation and turn, so one very long conversation is spread over
many partitions. A stretch of turns acts on the automaton as a small (min, +) matrix. Only the first
and last conversation of each partition can continue in another one: their matrices, two for each
partition, tell on the driver in which state every stretch begins and ends. Then each partition
repairs its own turns.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracesieve.llm.common import stored

START, SYSTEM, USER, ASSISTANT = range(4)
NAMES = ["", "system", "user", "assistant"]
LEGAL = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
#: Other names that sources use for the three roles.
ALIASES = {"human": "user", "prompter": "user", "bot": "assistant", "gpt": "assistant", "model": "assistant", "ai": "assistant", "developer": "system"}
INSERT, MERGE, RELABEL, RELABEL_UNKNOWN = 2, 1, 3, 1
FAR = 1 << 60
STATES = range(4)


def role_number(role: str | None) -> int:
    """1 to 3, or 0 for a role that is not known."""
    name = (role or "").strip().lower()
    name = ALIASES.get(name, name)
    return NAMES.index(name) if name in NAMES[1:] else 0


def _paths(state: int) -> list[tuple[tuple[int, ...], int]]:
    """Up to two empty turns inserted from a state, and where they lead. Two suffice: any role that
    can follow at all can follow after two."""
    one = [((a,), a) for a in LEGAL[state]]
    return [((), state), *one, *(((a, b), b) for (a,), _ in one for b in LEGAL[a])]


def _steps(role: int) -> dict[tuple[int, int], tuple[int, str, tuple[int, ...]]]:
    """For a turn's role: (state, next state) -> (cost, action, inserted roles); first of the cheapest."""
    best: dict = {}
    for state in STATES:
        moves = []
        for inserted, at in _paths(state):
            for to in LEGAL[at]:
                change = 0 if to == role else RELABEL if role else RELABEL_UNKNOWN
                moves.append((len(inserted) * INSERT + change, "keep" if to == role else "relabel", inserted, to))
        if state != START:
            change = 0 if state == role else RELABEL if role else RELABEL_UNKNOWN
            moves.append((MERGE + change, "merge", (), state))
        for cost, action, inserted, to in moves:
            if (state, to) not in best or cost < best[state, to][0]:
                best[state, to] = (cost, action, inserted)
    return best


STEPS = [_steps(role) for role in range(4)]
#: What ends a conversation from each state: the cost, and the empty turns inserted.
ENDS = {START: (0, ()), SYSTEM: (2 * INSERT, (USER, ASSISTANT)), USER: (INSERT, (ASSISTANT,)), ASSISTANT: (0, ())}


def matrix(roles: list[int]) -> list[list[int]]:
    """Costs of the cheapest way through the turns, from each state to each."""
    rows = [[0 if s == t else FAR for t in STATES] for s in STATES]
    for role in roles:
        steps = STEPS[role].items()
        for k, row in enumerate(rows):
            new = [FAR] * 4
            for (s, t), (cost, _, _) in steps:
                if row[s] + cost < new[t]:
                    new[t] = row[s] + cost
            rows[k] = new
    return rows


def repair(roles: list[int], begin: int = START, end: int | None = None) -> tuple[list[tuple[int, int, str, tuple]], int]:
    """(state before, state after, action, inserted roles) for each turn, and the cost with that of
    the end. ``end`` None: the conversation ends here, at the cheapest; ties take the lower state."""
    costs = [FAR] * 4
    costs[begin] = 0
    back: list[list[int]] = []
    for role in roles:
        new, origin = [FAR] * 4, [-1] * 4
        for (s, t), (cost, _, _) in STEPS[role].items():
            if costs[s] + cost < new[t]:
                new[t], origin[t] = costs[s] + cost, s
        costs = new
        back.append(origin)
    state = min(STATES, key=lambda s: costs[s] + ENDS[s][0]) if end is None else end
    total = costs[state] + (ENDS[state][0] if end is None else 0)
    turns = []
    for role, origin in zip(reversed(roles), reversed(back)):
        before = origin[state]
        _, action, inserted = STEPS[role][before, state]
        turns.append((before, state, action, inserted))
        state = before
    return turns[::-1], total


def _turn(role: int, text: str = "") -> str:
    return f"<|{NAMES[role]}|>\n{text}"


CLOSE = "<|end|>\n"


def rendered(before: int, after: int, action: str, inserted: tuple[int, ...], text: str, last: bool) -> str:
    """What a turn adds to the text of its conversation."""
    if action == "merge":
        out = f"\n{text}"
    else:
        close = CLOSE if before != START else ""
        out = close + "".join(_turn(i) + CLOSE for i in inserted) + _turn(after, text)
    if last:
        out += CLOSE + "".join(_turn(i) + CLOSE for i in ENDS[after][1])
    return out


def _segments(batches: Iterator[pa.RecordBatch], columns: list[int]) -> Iterator[tuple[object, list[tuple]]]:
    rows = (row for b in batches for row in zip(*(b.column(i).to_pylist() for i in columns)))
    for conversation, turns in groupby(rows, key=lambda r: r[0]):
        yield conversation, list(turns)


def _edge_matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matrices of the first and the last conversation of a partition."""
    first = last = None
    for conversation, turns in _segments(batches, [0, 1, 2]):
        last = (turns[0][2], conversation, [role_number(t[1]) for t in turns])
        first = first or last
    out = [] if first is None else [first] if first is last else [first, last]
    flat = [[c for row in matrix(roles) for c in row] for _, _, roles in out]
    columns = [pa.array([o[0] for o in out], pa.int32()), pa.array([None if o[1] is None else str(o[1]) for o in out], pa.string())]
    yield pa.RecordBatch.from_arrays([*columns, pa.array(flat, pa.list_(pa.int64()))], ["part", "conv", "costs"])


def _boundaries(edges: list) -> dict[tuple[int, str | None], tuple[int, int | None]]:
    """For stretches of conversations that span partitions: states at their begin and end."""
    found: dict = {}
    for conv, group in groupby(sorted(edges, key=lambda e: (e.conv is not None, e.conv or "", e.part)), key=lambda e: e.conv):
        parts = list(group)
        if len(parts) == 1:
            continue
        costs, tables = [[0, FAR, FAR, FAR]], [[e.costs[4 * s : 4 * s + 4] for s in STATES] for e in parts]
        for table in tables:
            costs.append([min(costs[-1][s] + table[s][t] for s in STATES) for t in STATES])
        state = min(STATES, key=lambda s: costs[-1][s] + ENDS[s][0])
        last: int | None = None
        for k in range(len(parts) - 1, -1, -1):
            end = state
            state = min(STATES, key=lambda s: costs[k][s] + tables[k][s][end])
            found[parts[k].part, conv] = (state, last if k == len(parts) - 1 else end)
    return found


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, action, new_role, n_inserted, rendered), one row per row of ``turns``.

    Turns are ordered by number (null last), then role and text. action is keep, relabel or merge;
    n_inserted counts the empty turns put before the turn, and after it if it is the last one.
    Null texts are empty; null and unknown roles take the cheapest role; null conversation ids are
    one conversation; repeated rows are turns of their own. No rows give no rows."""
    rows = turns.select(
        turns[conv_col].alias("conv_id"), turns[turn_col].alias("turn"), turns[role_col].alias("role"), turns[text_col].cast("string").alias("text")
    )
    order = [F.col("conv_id"), F.col("turn").isNull(), F.col("turn"), F.col("role"), F.col("text")]
    key = [*order[:4], F.xxhash64("text")]
    ordered = stored(
        rows.repartitionByRange(*key).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    )
    edges = ordered.select("conv_id", "role", "part").mapInArrow(_edge_matrices, "part int, conv string, costs array<long>")
    known = _boundaries(edges.collect())
    types = {n: rows.schema[n].dataType.simpleString() for n in ("conv_id", "turn", "role")}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = None

        def seen(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal kinds
            for batch in incoming:
                kinds = [batch.schema.field(i).type for i in range(3)]
                yield batch

        out: list[tuple] = []
        for conversation, own in _segments(seen(batches), [0, 1, 2, 3, 4]):
            name = None if conversation is None else str(conversation)
            begin, end = known.get((own[0][4], name), (START, None))
            steps, _ = repair([role_number(t[2]) for t in own], begin, end)
            for k, (turn, (before, after, action, inserted)) in enumerate(zip(own, steps)):
                last = end is None and k == len(own) - 1
                more = len(ENDS[after][1]) if last else 0
                text = rendered(before, after, action, inserted, turn[3] or "", last)
                out.append((*turn[:3], action, NAMES[after], len(inserted) + more, text))
                if len(out) >= 2000:
                    yield _batch(out, kinds)
                    out = []
        if out:
            yield _batch(out, kinds)

    schema = ", ".join([*(f"{n} {t}" for n, t in types.items()), "action string, new_role string, n_inserted int, rendered string"])
    return ordered.select("conv_id", "turn", "role", "text", "part").mapInArrow(work, schema)


def _batch(rows: list[tuple], kinds: list[pa.DataType]) -> pa.RecordBatch:
    kinds = [*kinds, pa.string(), pa.string(), pa.int32(), pa.string()]
    names = ["conv_id", "turn", "role", "action", "new_role", "n_inserted", "rendered"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

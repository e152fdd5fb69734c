"""Chat formatting by minimum-cost role repair.

A conversation is legal if it has at most one system turn, at its start, and then user
and assistant turns in alternation, beginning with the user and ending with the assistant.
Each turn of a conversation is kept, given another role, or merged into the turn before it,
and empty turns may be put in; each repair has a cost, and dynamic programming over the automaton of
legal turns finds the cheapest ones.  The repaired turns are then rendered in a chat template.

The states are what stood last: nothing (S), the system turn (Y), a user turn (U), an assistant
turn (A).  A stretch of turns is a matrix of least costs from state to state, and two stretches are
the (min, +) product of their matrices.  So a conversation of any length is range-partitioned by its
turns: each partition makes the matrix of its stretch, a small table of stretches gives the state each
begins and ends in, and each partition then retraces its own turns.  No task holds more than a partition's rows.

The result has a row per turn, with the text that it contributes: rendered pieces in the order of turns
are the rendered conversation, also where turns are merged or put in.

Nulls: a missing role is an unknown one; unknown roles fit any state at the cost of a relabel.
A missing text is empty; a missing turn number comes first; rows without a conversation id form one
conversation.  Equal turn numbers are ordered by role and text, repeated rows are turns that repeat.  Role names are
compared in lower case and without spaces around them.

Texts can't forge turns: markers begin with "<|", which is kept out of rendered texts by a backslash put between the
two characters, also where backslashes stand there already; ``unescaped`` takes it out again.  Texts are of any length; one
is held whole in its task.  Extra columns are left out, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import keep

START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = ["", "system", "user", "assistant"]
KEEP, RELABEL, MERGE, INSERT = 0, 3, 2, 2
NEVER = 1 << 40
#: Which role may follow which state.
FOLLOWS = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}


def _roles() -> list[list[tuple[int, int, int, tuple[int, ...]]]]:
    """For each given role (0: unknown) the moves (from, to, cost, roles of the turns it writes; none: merged)."""
    moves: list[list[tuple[int, int, int, tuple[int, ...]]]] = []
    for given in range(4):
        found = []
        for state in range(4):
            # empty turns put in first, at most two are ever needed
            paths: list[tuple[int, ...]] = [()]
            for first in FOLLOWS[state]:
                if first != SYSTEM:
                    paths += [(first,), *((first, second) for second in FOLLOWS[first] if second != SYSTEM)]
            for path in paths:
                last = path[-1] if path else state
                for role in FOLLOWS[last]:
                    cost = INSERT * len(path) + (KEEP if role == given else RELABEL)
                    found.append((state, role, cost, (*path, role)))
            # merged into the turn before, which has the same role or is taken to have it
            if state != START:
                found.append((state, state, MERGE + (0 if state == given else RELABEL), ()))
        best: dict[tuple[int, int], tuple[int, int, int, tuple[int, ...]]] = {}
        for move in sorted(found, key=lambda m: (m[2], len(m[3]), m[3])):
            # a move that writes nothing and one that writes can join the same states: the cheaper stays
            best.setdefault((move[0], move[1]), move)
        moves.append(list(best.values()))
    return moves


MOVES = _roles()
STEP = np.full((4, 4, 4), NEVER, np.int64)
for _given, _moves in enumerate(MOVES):
    for _from, _to, _cost, _ in _moves:
        STEP[_given, _from, _to] = _cost
WRITES = {(given, m[0], m[1]): m for given, moves in enumerate(MOVES) for m in moves}
#: Cost of ending in a state, and what is put in for it.
END_COST = np.array([0, 2 * INSERT, INSERT, 0], np.int64)
END_ROLES: dict[int, tuple[int, ...]] = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), NEVER)


def stretch(given: np.ndarray) -> np.ndarray:
    """Least cost from each state to each over the turns with these roles."""
    costs = STEP[given]
    while len(costs) > 1:
        odd = costs[-1:] if len(costs) % 2 else costs[:0]
        left, right = costs[0 : len(costs) - len(odd) : 2], costs[1 : len(costs) - len(odd) + 1 : 2]
        costs = np.concatenate([np.minimum((left[:, :, :, None] + right[:, None, :, :]).min(axis=2), NEVER), odd])
    return costs[0]


def retrace(given: np.ndarray, begin: int, end: int) -> list[tuple[int, int]]:
    """The cheapest states from ``begin`` to ``end``: (from, to) for each turn; of equal costs the smallest states."""
    cost = np.full(4, NEVER, np.int64)
    cost[begin] = 0
    via = np.zeros((len(given), 4), np.int8)
    for i, role in enumerate(given):
        total = cost[:, None] + STEP[role]
        via[i] = total.argmin(axis=0)
        cost = np.minimum(total.min(axis=0), NEVER)
    out, state = [], end
    for i in range(len(given) - 1, -1, -1):
        before = int(via[i, state])
        out.append((before, state))
        state = before
    return out[::-1]


def choose_states(matrices: list[np.ndarray]) -> list[tuple[int, int]]:
    """The states that each stretch of a conversation begins and ends in, on the cheapest way through all."""
    cost = np.full(4, NEVER, np.int64)
    cost[START] = 0
    via = []
    for matrix in matrices:
        total = cost[:, None] + matrix
        via.append(total.argmin(axis=0))
        cost = np.minimum(total.min(axis=0), NEVER)
    state = int((cost + END_COST).argmin())
    out = []
    for back in reversed(via):
        out.append((int(back[state]), state))
        state = int(back[state])
    return out[::-1]


def _runs(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Neighbouring rows with equal ``key`` columns, as one table each."""
    open_, parts = None, []
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in key]
        keys = list(zip(*columns))
        borders = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
        for a, b in zip(borders, borders[1:]):
            if a == b:
                continue
            if parts and keys[a] != open_:
                yield open_, pa.Table.from_batches(parts)
                parts = []
            open_ = keys[a]
            parts.append(batch.slice(a, b - a))
    if parts:
        yield open_, pa.Table.from_batches(parts)


def _given(run: pa.Table) -> np.ndarray:
    return run.column("given").to_numpy().astype(np.int64)


def _border_stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, conv, given) in order -> the matrices of the first and the last conversation of each part."""

    def row(part: int, conv: str, matrix: np.ndarray) -> pa.RecordBatch:
        lists = pa.array([matrix.ravel().tolist()], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([conv], pa.string()), lists], names=["part", "conv", "matrix"])

    last: tuple | None = None
    for (part, conv), run in _runs(batches, ["part", "conv"]):
        if last and last[0] == part:
            last = (part, conv, run)
            continue
        if last and last[2] is not None:
            yield row(last[0], last[1], stretch(_given(last[2])))
        yield row(part, conv, stretch(_given(run)))
        last = (part, conv, None)
    if last and last[2] is not None:
        yield row(last[0], last[1], stretch(_given(last[2])))


def _ways(stretches: pa.Table) -> pa.Table:
    """The stretches of one conversation, with their beginning and ending states."""
    rows = sorted(stretches.to_pylist(), key=lambda r: r["part"])
    states = choose_states([np.array(r["matrix"], np.int64).reshape(4, 4) for r in rows])
    return pa.table({
        "conv": pa.array([r["conv"] for r in rows], pa.string()),
        "part": pa.array([r["part"] for r in rows], pa.int32()),
        "begins": pa.array([s[0] for s in states], pa.int32()),
        "ends": pa.array([s[1] for s in states], pa.int32()),
        "last": pa.array([i == len(rows) - 1 for i in range(len(rows))]),
    })


def open_turn(role: str) -> str:
    return f"<|{role}|>\n"


CLOSE = "<|end|>\n"


def escaped(text: str) -> str:
    """``text`` without "<|", the beginning of every marker."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescaped(text: str) -> str:
    """The text that ``escaped`` was given."""
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def rendered(text: str, begin: int, to: int, written: tuple[int, ...], after: tuple[int, ...], last: bool) -> str:
    """What a turn adds to the rendered conversation; a turn is closed by the next one that isn't merged into it."""
    empty = lambda roles: "".join(open_turn(ROLES[r]) + CLOSE for r in roles)
    if written:
        piece = (CLOSE if begin != START else "") + empty(written[:-1]) + open_turn(ROLES[to]) + text
    else:
        piece = "\n" + text
    return piece + CLOSE + empty(after) if last else piece


REPAIRED = "conv_id {conv_id}, turn {turn}, role string, position long, new_role string, action string, put_before int, put_after int, cost long, piece string"


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of turns in order, with their stretch's states where another part knows them."""
    for (_, _), run in _runs(batches, ["part", "conv"]):
        given = _given(run)
        begin, end, last = (run.column(c)[0].as_py() for c in ("begins", "ends", "last"))
        if begin is None:
            (begin, end), last = choose_states([stretch(given)])[0], True
        new_role, action, before, after, cost, pieces = [], [], [], [], [], []
        for i, (state, to) in enumerate(retrace(given, begin, end)):
            _, _, price, written = WRITES[int(given[i]), state, to]
            at_end = last and i == len(given) - 1
            put_after = END_ROLES[to] if at_end else ()
            new_role.append(ROLES[to])
            action.append("merge" if not written else "keep" if to == given[i] else "relabel")
            before.append(max(len(written) - 1, 0))
            after.append(len(put_after))
            cost.append(price + INSERT * len(put_after))
            pieces.append(rendered(escaped(run.column("text")[i].as_py() or ""), state, to, written, put_after, at_end))
        own = [run.column(c).combine_chunks() for c in ("conv_id", "turn", "role", "position")]
        made = [
            pa.array(new_role, pa.string()), pa.array(action, pa.string()), pa.array(before, pa.int32()),
            pa.array(after, pa.int32()), pa.array(cost, pa.int64()), pa.array(pieces, pa.string()),
        ]
        names = ["conv_id", "turn", "role", "position", "new_role", "action", "put_before", "put_after", "cost", "piece"]
        yield pa.RecordBatch.from_arrays([*own, *made], names=names)


def repair(turns: DataFrame) -> DataFrame:
    """A row per row of ``turns`` (conv_id, turn, role, text) with its repair and the ``piece`` it renders to.

    ``position`` puts the turns of a conversation in order; ``action`` is keep, relabel or merge;
    ``put_before`` and ``put_after`` count empty turns.  Other columns are left out.
    """
    role = F.lower(F.trim("role"))
    given = F.when(role == "system", SYSTEM).when(role == "user", USER).when(role == "assistant", ASSISTANT).otherwise(0)
    rows = turns.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"),
        "conv_id", "turn", "role", F.col("text").cast("string").alias("text"), given.cast("int").alias("given"),
    )
    # equal turns are told apart by where they lie, so that many of them are not one range
    rows = keep(rows.withColumn("_row", F.monotonically_increasing_id()), "turns")
    order = ["conv", "turn", "role", "text", "_row"]
    at = F.monotonically_increasing_id()
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("_row")
    placed = keep(placed.withColumn("position", at).withColumn("part", F.shiftright(at, 33).cast("int")), "placed_turns")
    light = placed.select("part", "conv", "given", "position").repartition("part").sortWithinPartitions("part", "position")
    borders = light.drop("position").mapInArrow(_border_stretches, "part int, conv string, matrix array<long>")
    ways = borders.groupBy("conv").applyInArrow(_ways, "conv string, part int, begins int, ends int, last boolean")
    # two conversations at most for each partition of the turns
    known = placed.join(F.broadcast(keep(ways, "ways")), ["conv", "part"], "left")
    together = known.repartition("part").sortWithinPartitions("part", "position")
    kinds = dict(turns.dtypes)
    return together.mapInArrow(_repaired, REPAIRED.format(conv_id=kinds["conv_id"], turn=kinds["turn"]))


def render(turns: DataFrame) -> DataFrame:
    """``conv_id``, ``rendered``: whole conversations as text, for those that fit a row."""
    pieces = repair(turns).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("position", "piece"))).alias("p"))
    return pieces.select("conv_id", F.array_join("p.piece", "").alias("rendered"))

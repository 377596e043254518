"""Repair of conversation roles at least cost, and rendering.

A conversation is legal if it reads: at most one system turn first, then user and
assistant in turns, the assistant last. Each turn may keep its role or take another,
merge into the turn before it if both end up in one role, or have empty turns
inserted before it; empty turns may also close the conversation. Costs are whole
numbers, and a dynamic program over the automaton's states finds the cheapest way.

A step of the program is a matrix in the (min, +) algebra, so that stretches can be
worked on apart: turns are range-partitioned by conversation and place, so a
conversation of any length is spread over as many partitions as it fills. Each
partition sums up the conversations at its two ends by a 4 x 4 matrix; the driver
chains these (two per partition) into the states at which every stretch begins
and ends, and each partition then traces its own turns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binroute.sources.scratch import scratch_dir

ROLES = ("system", "user", "assistant")
#: States: before any turn, then the role of the last one.
START, SYSTEM, USER, ASSISTANT = range(4)
MERGE, RELABEL, UNKNOWN, INSERT = 3, 4, 1, 5
FAR = 1 << 40
#: Turns inserted between a state and the next role; None where no way leads.
_BETWEEN: dict[tuple[int, int], tuple[int, ...]] = {
    (START, SYSTEM): (), (START, USER): (), (START, ASSISTANT): (USER,),
    (SYSTEM, USER): (), (SYSTEM, ASSISTANT): (USER,),
    (USER, ASSISTANT): (), (USER, USER): (ASSISTANT,),
    (ASSISTANT, USER): (), (ASSISTANT, ASSISTANT): (USER,),
}
#: Turns that close a conversation in each state.
_CLOSING: dict[int, tuple[int, ...]] = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}
KEEP, MERGED, INSERTED = "keep", "merge", "insert"


def _relabel(role: int, to: int) -> int:
    return UNKNOWN if role == START else 0 if role == to else RELABEL


def _way(state: int, to: int) -> tuple[int, bool, tuple[int, ...]]:
    """Cost, whether it merges, and inserted turns from a state to a turn of a role; merging wins ties."""
    ways = [(INSERT * len(_BETWEEN[state, to]), False, _BETWEEN[state, to])] if (state, to) in _BETWEEN else []
    if state == to:
        ways.append((MERGE, True, ()))
    return min(ways, key=lambda w: (w[0], not w[1]), default=(FAR, False, ()))


_WAYS = {(a, b): _way(a, b) for a in range(4) for b in range(1, 4)}
#: Cost to get from each state, over a turn of each observed role, to each state.
_STEP = np.full((4, 4, 4), FAR, np.int64)
for _role in range(4):
    for (_a, _b), _w in _WAYS.items():
        _STEP[_role, _a, _b] = min(FAR, _w[0] + _relabel(_role, _b))
_CLOSE = np.array([INSERT * len(_CLOSING[s]) for s in range(4)])


def role_code(role: str | None) -> int:
    """1 to 3 for a known role, blanks and case aside; 0 for any other and for null."""
    name = (role or "").strip().lower()
    return ROLES.index(name) + 1 if name in ROLES else 0


def total(roles: list[int]) -> np.ndarray:
    """The (min, +) product of the turns' steps: cheapest way from each state to each."""
    out = np.where(np.eye(4, dtype=bool), 0, FAR)
    for role in roles:
        out = np.minimum((out[:, :, None] + _STEP[role][None]).min(axis=1), FAR)
    return out


def trace(roles: list[int], begin: int, end: int) -> list[int]:
    """The final role of each turn on a cheapest way between two states; of equal ways the lesser states from the end."""
    costs = np.full(4, FAR, np.int64)
    costs[begin] = 0
    history = []
    for role in roles:
        options = costs[:, None] + _STEP[role]
        history.append(options.argmin(axis=0))
        costs = np.minimum(options.min(axis=0), FAR)
    states = [end]
    for back in reversed(history):
        states.append(int(back[states[-1]]))
    return states[-2::-1] if roles else []


def chain(pieces: list[np.ndarray]) -> list[tuple[int, int]]:
    """Begin and end state of each stretch of one conversation on a cheapest legal way."""
    costs = np.full(4, FAR, np.int64)
    costs[START] = 0
    history = []
    for piece in pieces:
        options = costs[:, None] + piece
        history.append(options.argmin(axis=0))
        costs = np.minimum(options.min(axis=0), FAR)
    state = int((costs + _CLOSE).argmin())
    out = []
    for back in reversed(history):
        begin = int(back[state])
        out.append((begin, state))
        state = begin
    return out[::-1]


def _render(role: int, text: str) -> str:
    return f"<|{ROLES[role - 1]}|>\n{text}\n"


def _pieces(conv, turns: list[tuple], states: list[int], begin: int, last: bool) -> Iterator[tuple]:
    """Rows ``(conv, turn, part, role, action, original role, rendered)`` of a traced stretch."""
    state = begin
    for (turn, role, text), to in zip(turns, states, strict=True):
        _, merged, inserted = _WAYS[state, to]
        for part, extra in enumerate(inserted):
            yield conv, turn, part, ROLES[extra - 1], INSERTED, None, _render(extra, "")
        action = MERGED if merged else KEEP if role_code(role) == to else "relabel"
        body = text or ""
        yield conv, turn, len(inserted), ROLES[to - 1], action, role, f"{body}\n" if merged else _render(to, body)
        state = to
    if last:
        for part, extra in enumerate(_CLOSING[state]):
            yield conv, turns[-1][0] if turns else None, 100 + part, ROLES[extra - 1], INSERTED, None, _render(extra, "")


def ordered(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Turns sorted over all partitions, and kept so: a checkpoint preserves partitions and order."""
    spark = turns.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(scratch_dir(spark))
    chosen = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text")
    )
    keys = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.coalesce("role", F.lit("")), F.xxhash64("text")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return chosen.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).checkpoint()


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[tuple]]]:
    """Runs of one conversation in a partition, in order."""
    conv, turns, some = None, [], False
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if some and row[0] != conv:
                yield conv, turns
                turns = []
            conv, some = row[0], True
            turns.append(row[1:])
    if some:
        yield conv, turns


def _ends(rows: DataFrame) -> list:
    """Per partition the first and last conversation and the matrices of their turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        for conv, turns in _stretches(batches):
            matrix = total([role_code(role) for _, role, _ in turns])
            last = (conv, matrix)
            first = first or last
        out = [] if first is None else [first] if first is last else [first, last]
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays(
            [pa.array([part] * len(out), pa.int64()), pa.array(range(len(out)), pa.int64()), pa.array([c for c, _ in out], kind), pa.array([m.ravel().tolist() for _, m in out], pa.list_(pa.int64()))],
            names=["part", "side", "conv_id", "matrix"],
        )

    field = rows.schema["conv_id"]
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(field.dataType)
    return rows.mapInArrow(run, f"part long, side long, conv_id {field.dataType.simpleString()}, matrix array<long>").orderBy("part", "side").collect()


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv_id, turn, part, role, action, original_role, rendered)``: the repaired turns.

    ``action`` is keep, relabel, merge or insert; a merged turn's ``rendered`` continues the
    turn before it, so a conversation's text is the concatenation of its rows by
    ``turn, part``. Turns that close a conversation follow its last turn with parts
    from 100. Null or strange roles count as unknown; null texts as empty. Turns of
    equal number are ordered by role and a hash of the text; repeated rows are turns
    of their own, told apart by nothing, so their rows may be equal. Rows with a
    null conversation form one conversation. No rows: none.
    """
    rows = ordered(turns, conv_col, turn_col, role_col, text_col)
    found = _ends(rows)
    begins_ends: dict[tuple[int, int], tuple[int, int, bool]] = {}
    at = 0
    while at < len(found):
        stop = at + 1
        while stop < len(found) and found[stop]["conv_id"] == found[at]["conv_id"] and found[stop]["part"] != found[stop - 1]["part"]:
            stop += 1
        states = chain([np.array(r["matrix"]).reshape(4, 4) for r in found[at:stop]])
        for row, (begin, end) in zip(found[at:stop], states, strict=True):
            begins_ends[row["part"], row["side"]] = (begin, end, row is found[stop - 1])
        at = stop

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        out: list[tuple] = []
        held, place = None, 0

        def settle(stretch: tuple, side: int | None) -> Iterator[tuple]:
            conv, own = stretch
            roles = [role_code(role) for _, role, _ in own]
            begin, end, last = begins_ends[part, side] if side is not None else (*chain([total(roles)])[0], True)
            return _pieces(conv, own, trace(roles, begin, end), begin, last)

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(names, row, strict=True)) for row in out], schema=schema)

        for stretch in _stretches(batches):
            if held is not None:
                out.extend(settle(held, 0 if place == 0 else None))
                place += 1
                if len(out) >= 5000:
                    yield flush()
                    out.clear()
            held = stretch
        if held is not None:
            out.extend(settle(held, 0 if place == 0 else 1))
        yield flush()

    from pyspark.sql.pandas.types import to_arrow_type

    conv_type, turn_type = rows.schema["conv_id"].dataType, rows.schema["turn"].dataType
    names = ["conv_id", "turn", "part", "role", "action", "original_role", "rendered"]
    schema = pa.schema(list(zip(names, [to_arrow_type(conv_type), to_arrow_type(turn_type), pa.int64(), *[pa.string()] * 4], strict=True)))
    return rows.mapInArrow(
        run, f"conv_id {conv_type.simpleString()}, turn {turn_type.simpleString()}, part long, role string, action string, original_role string, rendered string"
    )

"""Chat formatting by minimum-cost role repair.

A conversation is legal if an optional system turn comes first, then user and
assistant alternate, once at least, from user to assistant. Each given turn is kept, relabelled,
or merged into the turn before, and empty turns may be inserted; dynamic
programming over the last role emitted finds the cheapest way. Ties go to fewer
turns put out, then to the earlier role of ROLES.

The step from one last role to another is a least-cost matrix, and matrices
compose. So conversations are ordered over range partitions of bounded size; a
conversation that spans partitions is summed up as a matrix for each, these are
joined on the driver, two to a partition, and every part is then repaired
between its two end roles. No conversation is gathered in one task, nor rendered
in one string: the result has a row for each given or inserted turn, whose
`rendered` texts in order make up the conversation.

Cases: a null or empty text is an empty turn, a very long one a turn like any; a role is matched in any case, a
null or unknown one may take any role at a lower cost; a null conv_id is a
conversation; equal turn numbers are ordered by role and text, repeated rows are
turns; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equiloom.llm import common as C

ROLES = ("system", "user", "assistant")
# Other names of the roles.
ALIASES = {"human": "user", "prompter": "user", "bot": "assistant", "gpt": "assistant", "model": "assistant", "ai": "assistant"}
MERGE, INSERT, RELABEL, NAME = 1, 2, 3, 1
#: Rows of a partition, about.
ROWS = 50_000
START = 3  # the state before any turn; others are indices of ROLES
STATES = (START, 0, 1, 2)
FORM = "conv_id {}, out_turn long, piece long, role string, text string, action string, rendered string"


#: The roles put in so that a role may follow a state; None where it never may.
_BETWEEN = {
    (START, 0): (), (START, 1): (), (START, 2): (1,),
    (0, 0): None, (0, 1): (), (0, 2): (1,),
    (1, 0): None, (1, 1): (2,), (1, 2): (),
    (2, 0): None, (2, 1): (), (2, 2): (1,),
}
_ENDING = {START: (), 0: (1, 2), 1: (2,), 2: ()}


def role_index(role: str | None) -> int | None:
    name = (role or "").strip().lower()
    name = ALIASES.get(name, name)
    return ROLES.index(name) if name in ROLES else None


def _moves(state: int, given: int | None):
    """(cost, turns put out, next state, merged) of each way to take a turn."""
    for role in range(3):
        cost = NAME if given is None else 0 if role == given else RELABEL
        if role == state:
            yield cost + MERGE, 0, role, True
        between = _BETWEEN[state, role]
        if between is not None:
            yield cost + INSERT * len(between), 1 + len(between), role, False


_MOVES = {(s, g): sorted(_moves(s, g)) for s in STATES for g in (None, 0, 1, 2)}


def _forward(first: dict[int, tuple[int, int]], roles: list) -> list[dict]:
    """Best (cost, turns, back state, merged) by state after each turn."""
    table = [{s: (*c, None, False) for s, c in first.items()}]
    for given in roles:
        now: dict = {}
        for s, (cost, out, *_) in sorted(table[-1].items()):
            for more, turns, to, merged in _MOVES[s, given]:
                got = (cost + more, out + turns, s, merged)
                if to not in now or got < now[to]:
                    now[to] = got
        table.append(now)
    return table


def _trace(table: list[dict], end: int) -> list[tuple[int, int, bool]]:
    """(state before, role, merged) of each turn on the best way to `end`."""
    path = []
    for row in reversed(table[1:]):
        _, _, back, merged = row[end]
        path.append((back, end, merged))
        end = back
    return path[::-1]


def _close(row: dict) -> int:
    return min(row, key=lambda s: (row[s][0] + INSERT * len(_ENDING[s]), row[s][1] + len(_ENDING[s]), s))


def _pieces(conv, turns: list, start: int, end: int, turn: int, piece: int, last: bool) -> list[tuple]:
    """The rows of one part of a conversation between two end states."""
    roles = [role_index(r) for r, _ in turns]
    out = []

    def put(role, text, action, new):
        nonlocal turn
        turn += new
        mark = ("<|end|>\n" if turn else "") + f"<|{ROLES[role]}|>\n" if new else "\n"
        out.append([conv, turn, piece + len(out), ROLES[role], text, action, mark + text])

    for (before, role, merged), given, (_, text) in zip(_trace(_forward({start: (0, 0)}, roles), end), roles, turns, strict=True):
        if merged:
            put(role, text, "merge" if role == given else "relabel+merge", False)
            continue
        for x in _BETWEEN[before, role]:
            put(x, "", "insert", True)
        put(role, text, "keep" if role == given else "relabel", True)
    if last:
        for x in _ENDING[end]:
            put(x, "", "insert", True)
        out[-1][-1] += "<|end|>\n"
    return [tuple(x) for x in out]


def _parts(batches):
    """(conv_id, [(role, text)], first in partition, last in partition)."""
    held, key, first = [], None, True
    for batch in batches:
        for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
            if held and conv != key:
                yield key, held, first, False
                held, first = [], False
            key = conv
            held.append((role, text or ""))
    if held:
        yield key, held, first, True


def _edges(batches):
    """The matrices of the conversations at a partition's two ends."""
    rows = []
    for conv, turns, first, last in _parts(batches):
        if first or last:
            roles = [role_index(r) for r, _ in turns]
            cells = [(s, e, c[0], c[1]) for s in STATES for e, c in _forward({s: (0, 0)}, roles)[-1].items()]
            rows.append((TaskContext.get().partitionId(), first, last, str(conv), conv is None, len(turns), [list(x) for x in cells]))
    if rows:
        columns = zip(*rows, strict=True)
        kinds = (pa.int32(), pa.bool_(), pa.bool_(), pa.string(), pa.bool_(), pa.int64(), pa.list_(pa.list_(pa.int64())))
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], ["part", "first", "last", "conv", "none", "n", "cells"])


def _plan(edges: list) -> dict[tuple[int, bool], tuple]:
    """For each part of a conversation that spans partitions, by partition and
    whether it comes first in it: start, end, turns and pieces before, and
    whether the conversation ends there."""
    chains: list[list] = []
    for e in sorted(edges, key=lambda e: (e.part, not e.first)):
        if chains and e.first and chains[-1][-1].last and (chains[-1][-1].conv, chains[-1][-1].none) == (e.conv, e.none):
            chains[-1].append(e)
        else:
            chains.append([e])
    out = {}
    for chain in (c for c in chains if len(c) > 1):
        table = [{START: (0, 0, None)}]
        for e in chain:
            now: dict = {}
            for s, to, cost, turns in map(tuple, e.cells):
                if s in table[-1]:
                    got = (table[-1][s][0] + cost, table[-1][s][1] + turns, s)
                    if to not in now or got < now[to]:
                        now[to] = got
            table.append(now)
        end = _close(table[-1])
        ends = [end]
        for row in reversed(table[1:]):
            ends.append(row[ends[-1]][2])
        ends = ends[::-1]
        pieces = 0
        for i, e in enumerate(chain):
            start, to = ends[i], ends[i + 1]
            turns = table[i][start][1]
            out[e.part, e.first] = (start, to, turns - 1, pieces, i == len(chain) - 1)
            made = table[i + 1][to][1] - turns
            pieces += e.n + made  # an upper bound that keeps pieces in order
    return out


def repair(conversations: DataFrame) -> DataFrame:
    """conv_id, out_turn, piece (ascending within a conversation), role, text,
    action and rendered, a row for each given or inserted turn."""
    kind = conversations.schema["conv_id"].dataType.simpleString()
    rows = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    parts = max(8, -(-rows.count() // ROWS))
    order = ["conv_id", "turn", "role", "text"]
    laid = C.checkpoint(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order))
    form = "part int, first boolean, last boolean, conv string, none boolean, n long, cells array<array<long>>"
    plan = _plan(laid.mapInArrow(_edges, form).collect())  # two rows a partition at most

    def run(batches):
        part = TaskContext.get().partitionId()
        held: list = []
        for conv, turns, first, last in _parts(batches):
            known = plan.get((part, first)) if first or last else None
            if known:
                held += _pieces(conv, turns, *known)
            else:
                end = _close(_forward({START: (0, 0)}, [role_index(r) for r, _ in turns])[-1])
                held += _pieces(conv, turns, START, end, -1, 0, True)
            if len(held) > 5000:
                yield _batch(held)
                held = []
        if held:
            yield _batch(held)

    def _batch(held):
        names = ["conv_id", "out_turn", "piece", "role", "text", "action", "rendered"]
        kinds = [laid_kind, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*held, strict=True), kinds, strict=True)], names)

    from pyspark.sql.pandas.types import to_arrow_type

    laid_kind = to_arrow_type(conversations.schema["conv_id"].dataType)
    return laid.mapInArrow(run, FORM.format(kind))

"""Chat formatting with minimum-cost role repair.

A legal conversation is an optional system message and then user and assistant turns in alternation, beginning
with a user's and ending with an assistant's. For each conversation a dynamic program over that automaton
chooses, turn by turn, whether to keep a message, merge it into the one before, give it the other role, or put
an empty message in front of it, so that the total cost is least. The repaired sequence is then rendered.

Turns are laid out in order over the cluster (range partitions of conversation and turn), so a conversation of
any length is split like any other. A turn's step is a small cost matrix over states, and steps combine
associatively (min, +): each partition first reports the product for the one conversation that may go on
from the partition before and the one that may go on in the next; the driver chains these (two rows a partition)
and hands every partition the states at its two ends, between which it finds the path by itself.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, partitions, table

#: States: the role of the last message so far. S: none yet.
STATES = ("S", "system", "user", "assistant")
ROLES = ("system", "user", "assistant")
LEGAL = {"S": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
#: Cost of merging into the message before, of an empty message, and of giving a message another role (from, to).
MERGE, INSERT = 2, 3
RELABEL = {("system", "user"): 4, ("system", "assistant"): 6, ("user", "assistant"): 5, ("assistant", "user"): 5, ("user", "system"): 8, ("assistant", "system"): 8, (None, "user"): 1, (None, "assistant"): 1, (None, "system"): 4}
#: Roles by the names in which they come; any other name is unknown (null) and takes the role that costs least.
ALIASES = {"system": "system", "developer": "system", "user": "user", "human": "user", "prompter": "user", "assistant": "assistant", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
TEMPLATE = ("<|", "|>\n", "\n<|end|>\n")
_FAR = 1 << 60


def _steps(role: str | None) -> list[tuple[int, int, int, str, tuple[str, ...], str]]:
    """What a message of ``role`` can do: (from, to, cost, action, roles of empty messages before it, its role)."""
    out = []
    for a, state in enumerate(STATES):
        for to in ROLES:
            cost, action = (0, "keep") if to == role else (RELABEL[(role, to)], "relabel")
            if state == to:
                out.append((a, STATES.index(to), MERGE + cost, "merge", (), to))
            if to in LEGAL[state]:
                out.append((a, STATES.index(to), cost, action, (), to))
            for mid in LEGAL[state]:
                if to in LEGAL[mid]:
                    out.append((a, STATES.index(to), cost + INSERT, action, (mid,), to))
                for mid2 in LEGAL[mid]:
                    if to in LEGAL[mid2]:
                        out.append((a, STATES.index(to), cost + 2 * INSERT, action, (mid, mid2), to))
    best = {}
    for s in out:  # the first of equal cost stays: a merge, then no empty message
        if s[:2] not in best or s[2] < best[s[:2]][2]:
            best[s[:2]] = s
    return sorted(best.values())


STEPS = {r: _steps(r) for r in (*ROLES, None)}
#: Cost of ending in a state: an assistant's turn is put at the end where it is missing.
ENDING = (2 * INSERT, 2 * INSERT, INSERT, 0)
ENDING_ROLES = (("user", "assistant"), ("user", "assistant"), ("assistant",), ())
_ONE = [[0 if a == b else _FAR for b in range(4)] for a in range(4)]


def _times(m: list, role: str | None) -> list:
    out = [[_FAR] * 4 for _ in range(4)]
    for a, b, cost, *_ in STEPS[role]:
        for x in range(4):
            if m[x][a] + cost < out[x][b]:
                out[x][b] = m[x][a] + cost
    return out


def _product(m: list, n: list) -> list:
    return [[min(m[a][c] + n[c][b] for c in range(4)) for b in range(4)] for a in range(4)]


def plan(roles: Sequence[str | None], start: int = 0, end: int | None = None) -> tuple[list, int]:
    """The cheapest steps from state ``start``; to ``end``, or to the cheapest ending if that is None. (steps, their cost with the ending's)"""
    cost, back = [0 if s == start else _FAR for s in range(4)], []
    for r in roles:
        new, how = [_FAR] * 4, [None] * 4
        for step in STEPS[r]:
            if cost[step[0]] + step[2] < new[step[1]]:
                new[step[1]], how[step[1]] = cost[step[0]] + step[2], step
        cost = new
        back.append(how)
    last = end if end is not None else min(range(4), key=lambda s: (cost[s] + ENDING[s], s))
    total, out = cost[last] + (ENDING[last] if end is None else 0), []
    for how in reversed(back):
        out.append(how[last])
        last = how[last][0]
    return out[::-1], total


def render(role: str, text: str) -> str:
    return f"{TEMPLATE[0]}{role}{TEMPLATE[1]}{text}{TEMPLATE[2]}"


_FACTS = "pid int, first int, has_conv boolean, conv long, m array<long>"
_OUT = "has_conv boolean, conv long, has_turn boolean, at long, role string, new_role string, action string, starts_message boolean, inserted string, cost long, rendered string"
#: Plans of conversations of up to so many turns are remembered; rows and letters of a batch of results; roles that are multiplied at a time.
MEMO_TURNS, ROWS, LETTERS, FOLD = 32, 10_000, 1 << 22, 1 << 14


def _merged(held: list, start: int, onward: int | None) -> list[tuple]:
    """The repaired rows of one conversation's turns in a partition, as in _OUT."""
    roles = tuple(h[5] for h in held)
    steps, _ = _remembered(roles, start, onward) if len(roles) <= MEMO_TURNS else plan(roles, start, onward)
    rows = []
    for i, ((has_conv, conv, has_turn, at, role, _, text), (_, state, cost, action, empties, new)) in enumerate(zip(held, steps, strict=True)):
        last = i + 1 == len(held) and onward is None
        tail = ENDING_ROLES[state] if last else ()
        closed = TEMPLATE[2] if action != "merge" and (i > 0 or start) else ""
        part = closed + "".join(render(e, "") for e in empties) + (f"\n\n{text}" if action == "merge" else f"{TEMPLATE[0]}{new}{TEMPLATE[1]}{text}") + (TEMPLATE[2] if last else "") + "".join(render(e, "") for e in tail)
        rows.append((has_conv, conv, has_turn, at, role, new, action, action != "merge", ",".join(empties) + (">" + ",".join(tail) if tail else ""), cost + (ENDING[state] if last else 0), part))
    return rows


@lru_cache(20_000)
def _remembered(roles: tuple, start: int, onward: int | None) -> tuple[list, int]:
    return plan(roles, start, onward)


def repair_conversations(turns: DataFrame) -> DataFrame:
    """A row for each turn of ``turns(conv_id, turn, role, text)``, in its repaired form.

    ``action``: keep, merge or relabel (a merge may relabel too); ``inserted``: roles of the empty messages put
    in front, and after the last turn also behind (after a ``>``); ``cost``: of this row's changes; ``rendered``:
    the row's part of the conversation (it closes the message before, if it starts one): the parts in order are the
    whole. Merged messages are joined by a blank line.

    Order within a conversation: turn (null first), then role and a hash of the text, so ties and repeated rows have a
    defined place. A null conv_id is a conversation of its own. Null text renders as empty; a null or unknown
    role takes the cheapest one. An empty table gives an empty result. Other columns are not read.
    """
    spark = turns.sparkSession
    alias = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    name = F.lower(F.trim("role"))
    conv, turn = F.col("conv_id").cast("long"), F.col("turn").cast("long")
    # flags beside the numbers: pandas would turn longs beside nulls into doubles
    ids = [conv.isNotNull().alias("has_conv"), F.coalesce(conv, F.lit(0)).alias("conv"), turn.isNotNull().alias("has_turn"), F.coalesce(turn, F.lit(0)).alias("at")]
    base = turns.select(*ids, F.col("role").alias("role"), F.when(name.isNotNull(), F.try_element_at(alias, name)).alias("known"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("tie"))
    order = ["has_conv", "conv", "has_turn", "at", "role", "tie"]
    laid = checkpointed(base.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order))

    def report(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The products of the partition's first and last conversation; the roles of the others are passed over."""
        pid, out, seen, m, roles, first = TaskContext.get().partitionId(), [], None, _ONE, [], True
        for pdf in batches:
            for own, role in zip(zip(pdf["has_conv"].tolist(), pdf["conv"].tolist(), strict=True), pdf["known"].tolist(), strict=True):
                if own != seen:
                    if seen is not None and first:
                        out.append((pid, 1, *seen, sum(_folded(m, roles), [])))
                        first = False
                    seen, m, roles = own, _ONE, []
                roles.append(role)
                if len(roles) == FOLD:
                    m, roles = _folded(m, roles), []
        if seen is not None:
            out.append((pid, int(first), *seen, sum(_folded(m, roles), [])))
        yield pd.DataFrame(out, columns=["pid", "first", "has_conv", "conv", "m"])

    facts: dict[int, list] = {}
    for r in laid.select("has_conv", "conv", "known").mapInPandas(report, _FACTS).collect():  # two rows a partition at most
        facts.setdefault(r.pid, []).append((r.first, (r.has_conv, r.conv), [list(r.m[i : i + 4]) for i in range(0, 16, 4)]))
    ends = _chain(facts)
    names = [c.split()[0] for c in _OUT.split(", ")]

    def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        starts_in, goes_to = ends.get(TaskContext.get().partitionId(), ({}, {}))
        held, rows, size = [], [], 0
        for pdf in batches:
            for row in zip(*[pdf[c].tolist() for c in ("has_conv", "conv", "has_turn", "at", "role", "known", "text")], strict=True):
                if held and held[0][:2] != row[:2]:
                    rows += _merged(held, starts_in.get(held[0][:2], 0), goes_to.get(held[0][:2]))
                    held = []
                    if len(rows) >= ROWS or size >= LETTERS:
                        yield pd.DataFrame(rows, columns=names)
                        rows, size = [], 0
                held.append(row)
                size += len(row[6])
        if held:
            rows += _merged(held, starts_in.get(held[0][:2], 0), goes_to.get(held[0][:2]))
        if rows:
            yield pd.DataFrame(rows, columns=names)

    out = laid.select("has_conv", "conv", "has_turn", "at", "role", "known", "text").mapInPandas(rewrite, _OUT)
    return out.select(F.when(F.col("has_conv"), F.col("conv")).alias("conv_id"), F.when(F.col("has_turn"), F.col("at")).alias("turn"), "role", "new_role", "action", "starts_message", "inserted", "cost", "rendered")


def _folded(m: list, roles: list) -> list:
    for r in roles:
        m = _times(m, r)
    return m


def _chain(facts: dict[int, list]) -> dict[int, tuple[dict, dict]]:
    """By partition: the state in which its first conversation comes in, and the state in which its last one goes on."""
    out: dict[int, tuple[dict, dict]] = {p: ({}, {}) for p in facts}
    order = sorted(facts)
    runs, i = [], 0
    while i < len(order):  # runs of partitions that one conversation spans
        conv, j = facts[order[i]][-1][1], i
        pieces = [(order[i], facts[order[i]][-1][2])]
        while j + 1 < len(order) and facts[order[j + 1]][0][1] == conv:
            j += 1
            pieces.append((order[j], facts[order[j]][0][2]))
            if len(facts[order[j]]) > 1:
                break
        if j > i:
            runs.append((conv, pieces))
        i = max(j, i + 1)
    for conv, pieces in runs:
        cost, back = [0, _FAR, _FAR, _FAR], []
        for _, m in pieces:
            new = [min((cost[a] + m[a][b], a) for a in range(4)) for b in range(4)]
            back.append([a for _, a in new])
            cost = [c for c, _ in new]
        state = min(range(4), key=lambda s: (cost[s] + ENDING[s], s))
        for k in range(len(pieces) - 1, 0, -1):
            before = back[k][state]
            out[pieces[k][0]][0][conv] = before
            out[pieces[k - 1][0]][1][conv] = before
            state = before
    return out


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(table(spark, sf_dir, "conversations"))


def _oracle() -> str:
    """The dynamic program as a recursion over turns: for each state the least cost and its path of step numbers, ties by the state before."""
    q = lambda x: "'" + x.replace("'", "''") + "'"
    steps = [(r or "?", *step) for r in (*ROLES, None) for step in STEPS[r]]
    rows = ", ".join(f"({i}, {q(r)}, {a}, {b}, {cost}, {q(action)}, {q(','.join(empties))}, {q(''.join(render(e, '') for e in empties))}, {q(new)})" for i, (r, a, b, cost, action, empties, new) in enumerate(steps))
    ends = ", ".join(f"({b}, {cost}, {q('>' + ','.join(tail) if tail else '')}, {q(''.join(render(e, '') for e in tail))})" for b, (cost, tail) in enumerate(zip(ENDING, ENDING_ROLES, strict=True)))
    known = "CASE lower(trim(role)) " + " ".join(f"WHEN {q(a)} THEN {q(b)}" for a, b in ALIASES.items()) + " ELSE '?' END"
    head, middle, close = map(q, TEMPLATE)
    return f"""
WITH RECURSIVE steps(id, role, a, b, cost, action, names, empties, new) AS (VALUES {rows}), ends(b, cost, names, tail) AS (VALUES {ends}),
m AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, {known} AS known, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST) AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
walk AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS k, 0 AS b, CAST(0 AS BIGINT) AS cost, CAST([] AS INTEGER[]) AS path FROM m
  UNION ALL SELECT conv_id, k, b, min(cost), arg_min(path, cost * 10 + a) FROM (
    SELECT w.conv_id, w.k + 1 AS k, s.b, w.cost + s.cost AS cost, s.a, list_append(w.path, s.id) AS path FROM walk w JOIN m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.k = w.k + 1 JOIN steps s ON s.role = m.known AND s.a = w.b) GROUP BY conv_id, k, b),
best AS (SELECT w.conv_id, arg_min(w.path, (w.cost + e.cost) * 10 + w.b) AS path FROM walk w JOIN ends e ON e.b = w.b JOIN (SELECT DISTINCT conv_id, n FROM m) l ON l.conv_id IS NOT DISTINCT FROM w.conv_id AND l.n = w.k GROUP BY w.conv_id)
SELECT m.conv_id, m.turn, m.role, s.new AS new_role, s.action, s.action <> 'merge' AS starts_message, s.names || CASE WHEN k = n THEN e.names ELSE '' END AS inserted, CAST(s.cost + CASE WHEN k = n THEN e.cost ELSE 0 END AS BIGINT) AS cost,
  CASE WHEN s.action <> 'merge' AND k > 1 THEN {close} ELSE '' END || s.empties || CASE WHEN s.action = 'merge' THEN chr(10) || chr(10) ELSE {head} || s.new || {middle} END || text || CASE WHEN k = n THEN {close} || e.tail ELSE '' END AS rendered
FROM m JOIN best ON best.conv_id IS NOT DISTINCT FROM m.conv_id JOIN steps s ON s.id = path[k] JOIN ends e ON e.b = s.b"""


ORACLE = _oracle()

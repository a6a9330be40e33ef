"""Cheapest edits that bring a run of chat rows into the form: system at most first, then user and assistant in turns.

A row is (initial, mode): the first letter of its role, and what the row's fault asks for. Edits go by their initials:
D deletes a row, I inserts an empty one, K keeps a row, R gives it the other role. The roles that come out are those
of ``(s?(ua)+)?``; one of four states says what has come out last.
"""

from __future__ import annotations

START, SYSTEM, USER, ASSISTANT = range(4)
#: Modes: nothing wrong, truncated (costs 1 more if it stays), must be deleted.
FINE, TRUNCATED, DROP = range(3)
#: Costs of the edits.
DELETE, INSERT, REROLE = 3, 2, 2
#: Goal of a search that may end in any state the form allows.
DONE = 4
#: The role each state asks for next, and the state it leads to.
WANTED, AFTER = "uuau", (USER, USER, ASSISTANT, USER)
#: What is still to be inserted at the end.
CLOSING = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}

Row = tuple[str, int]


def search(rows: list[Row], entry: int = START, goal: int = DONE) -> tuple[int, str] | None:
    """(cost, edits) of the cheapest way from state ``entry`` over all rows to ``goal``, of equal ones the ASCII-least.

    Iterative-deepening A*: depth-first in ASCII order of the edits, under a bound on the cost that grows to the least
    cost the search before has shown to be needed. The table holds the states that failed, each with the cost it has
    been shown to need at least, so it is entered again only with more than it failed with. The first path that
    arrives is the answer. With a state as goal the edits end in that of the last row; with DONE insertions may follow.
    None if there is no way.
    """
    n = len(rows)
    if not _reachable(rows, entry, goal):
        return None
    forced = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        # Where the goal is START or SYSTEM, rows can only be deleted, but for one.
        forced[i] = forced[i + 1] + (DELETE if goal in (START, SYSTEM) or rows[i][1] == DROP else rows[i][1])
    failed: dict[tuple[int, int], int] = {}

    def needed(i: int, q: int) -> int:
        known = failed.get((i, q))
        if known is not None:
            return known
        if i == n:
            if goal == DONE:
                return INSERT * len(CLOSING[q])
            return 0 if q == goal else 1 << 60
        if goal in (START, SYSTEM) and q not in (START, goal):
            return 1 << 60
        return max(0, forced[i] - (DELETE if goal == SYSTEM and q == START else 0))

    def moves(i: int, q: int):
        """(edit, cost, next place, next state) in ASCII order."""
        if i < n:
            yield "D", DELETE, i + 1, q
        if i < n or goal == DONE:
            yield "I", INSERT, i, AFTER[q]
        if i < n and rows[i][1] != DROP:
            initial, mode = rows[i]
            if initial == WANTED[q]:
                yield "K", mode, i + 1, AFTER[q]
            elif initial == "s" and q == START:
                yield "K", mode, i + 1, SYSTEM
            if initial != WANTED[q]:
                yield "R", REROLE + mode, i + 1, AFTER[q]

    def descend(bound: int) -> str | None:
        path, stack, left = [], [], bound
        at = (0, entry)
        while True:
            if at[0] == n and (goal == DONE and at[1] in (START, ASSISTANT) or at[1] == goal):
                return "".join(path)
            stack.append([at, left, moves(*at), 1 << 60])
            while True:
                state, left, tries, least = stack[-1]
                for edit, cost, i, q in tries:
                    need = cost + needed(i, q)
                    if need <= left:
                        path.append(edit)
                        at, left = (i, q), left - cost
                        break
                    stack[-1][3] = least = min(least, need)
                else:
                    failed[state] = least
                    stack.pop()
                    if not stack:
                        return None
                    path.pop()
                    above = stack[-1]
                    above[3] = min(above[3], above[1] - left + least)
                    continue
                break

    bound = needed(0, entry)
    while True:
        found = descend(bound)
        if found is not None:
            return bound, found
        bound = failed[(0, entry)]


def _reachable(rows: list[Row], entry: int, goal: int) -> bool:
    if goal == START:
        return entry == START
    if goal == SYSTEM:
        return entry == SYSTEM or entry == START and any(initial == "s" and mode != DROP for initial, mode in rows)
    return goal == DONE or bool(rows) or entry == goal


#: Every way through a block of rows, by the state before and behind it.
WAYS = [(p, q) for p in (START, SYSTEM, USER, ASSISTANT) for q in (START, SYSTEM, USER, ASSISTANT) if p <= q or p == ASSISTANT and q == USER]


def ways(rows: list[Row]) -> list[tuple[int, str] | None]:
    """:func:`search` for each of WAYS."""
    return [search(rows, p, q) for p, q in WAYS]


def ranks(edits: list) -> list[int]:
    """Places in ascending order, equal ones alike; -1 where there is nothing.

    The edits of one block all end with that of its last row, so none is a beginning of another: for texts put
    together from blocks, the order of the places block by block is the order of the texts.
    """
    order = {e: k for k, e in enumerate(sorted({e for e in edits if e is not None}))}
    return [-1 if e is None else order[e] for e in edits]


def chain(blocks: list[tuple[list[int], list[int]]]) -> tuple[list[int], list[int], list[bytes]]:
    """(costs, ranks, states) for each of WAYS over these neighbouring blocks together.

    A block is (costs, ranks) by WAYS, -1 where there is no way. ``states`` are those before, between and behind the
    blocks on the best way.
    """
    costs, orders, states = [], [], []
    for entry, goal in WAYS:
        best = {entry: (0, (), (entry,))}
        for cost, rank in blocks:
            after: dict[int, tuple] = {}
            for k, (p, q) in enumerate(WAYS):
                if p in best and cost[k] >= 0:
                    total, order, path = best[p]
                    way = (total + cost[k], (*order, rank[k]), (*path, q))
                    after[q] = min(after.get(q, way), way)
            best = after
        total, order, path = best.get(goal, (-1, None, ()))
        costs.append(total)
        orders.append(order)
        states.append(bytes(path))
    return costs, ranks(orders), states


def finish(costs: list[int], rank: list[int]) -> tuple[int, int]:
    """(cost with what has to be inserted at the end, state behind the last row) of the best way from START."""
    ends = [(costs[k] + INSERT * len(CLOSING[q]), rank[k], q) for k, (p, q) in enumerate(WAYS) if p == START and costs[k] >= 0]
    cost, _, q = min(ends)
    return cost, q


def apply(edits: str, entry: int, roles: list[str]) -> list[tuple[int, str, str]]:
    """(row, edit, role) of every edit; the row of an insertion is the one before which it stands, or len(roles).

    A deleted row keeps its role here.
    """
    out, i, q = [], 0, entry
    for e in edits:
        if e == "D":
            out.append((i, e, roles[i]))
        elif e == "K":
            out.append((i, e, roles[i]))
            q = SYSTEM if q == START and roles[i][:1] == "s" else AFTER[q]
        else:
            out.append((i, e, "user" if WANTED[q] == "u" else "assistant"))
            q = AFTER[q]
        i += e != "I"
    return out

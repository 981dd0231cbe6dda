"""The cheapest edit of a run of turns, as a dynamic program over persistent audits.

An audit is the string of edits made so far.  Audits share their prefixes: each is a
node linked to the audit without its last edit, with its ancestors at distances 1, 2,
4, ... and a rolling hash of the whole string.  Two audits of equal cost are compared
by a binary search for their longest common prefix over those ancestors, so a step
costs a logarithm of the audit's length, not the length.  Audits that share a prefix
share its node; where equal hashes stand for different nodes, the strings themselves
are compared.

States are what the edited turns end with: 0 nothing, 1 a system turn (only as the
first one), 2 a user turn, 3 an assistant turn.  A conversation may end in 0 or 3.
"""

from __future__ import annotations

SYSTEM, USER, ASSISTANT, OTHER = range(4)       # kinds of a turn, by its role's initial
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)    # a turn's first fault

# fixed values: what the edits cost
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 1, 2, 5, 5
STATES = 4
FILLED = (2, 2, 3, 2)           # the state after an inserted or re-roled turn
KEPT = {(0, SYSTEM): 1, (0, USER): 2, (1, USER): 2, (3, USER): 2, (2, ASSISTANT): 3}
# inserts that end a conversation from each state, and the states it may end in
CLOSING = ("", "II", "I", "")

HASH_MODULUS, HASH_BASE = (1 << 61) - 1, 0x1F3D5B79A7C5E3
ADJACENT = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}


class Audit:
    """A string of edits: its last letter and links to its prefixes."""

    __slots__ = ("letter", "depth", "hash", "up")

    def __init__(self, before: "Audit | None" = None, letter: str = ""):
        self.letter = letter
        if before is None:
            self.depth, self.hash, self.up = 0, 0, ()
            return
        self.depth = before.depth + 1
        self.hash = (before.hash * HASH_BASE + ord(letter)) % HASH_MODULUS
        up, k = [before], 0
        while k < len(up[k].up):
            up.append(up[k].up[k])
            k += 1
        self.up = up

    def prefix(self, depth: int) -> "Audit":
        node, k = self, len(self.up) - 1
        while node.depth > depth:
            if k < len(node.up) and node.depth - (1 << k) >= depth:
                node = node.up[k]
            else:
                k -= 1
        return node

    def __str__(self) -> str:
        out, node = [], self
        while node.depth:
            out.append(node.letter)
            node = node.up[0]
        return "".join(reversed(out))


def precedes(x: Audit, y: Audit) -> bool:
    """Whether ``x`` is less than ``y`` as a string."""
    depth = min(x.depth, y.depth)
    a, b = x.prefix(depth), y.prefix(depth)
    if a.hash == b.hash:
        return x.depth < y.depth if a is b or str(a) == str(b) else str(x) < str(y)
    for k in range(len(a.up) - 1, -1, -1):      # up to the first edit in which they differ
        if k < len(a.up) and a.up[k].hash != b.up[k].hash:
            a, b = a.up[k], b.up[k]
    if a.up[0] is b.up[0]:
        return a.letter < b.letter
    return str(x) < str(y)      # a common prefix has one node: equal hashes, other strings


def offer(table: list, state: int, cost: int, audit: Audit, letter: str) -> None:
    """``audit`` and one more edit as a way to ``state``, kept if it is the best."""
    old = table[state]
    if old is None or cost < old[0]:
        table[state] = (cost, Audit(audit, letter))
    elif cost == old[0]:
        new = Audit(audit, letter)
        if precedes(new, old[1]):
            table[state] = (cost, new)


def inserted(table: list) -> list:
    """The table with all useful inserts before the next turn, cheapest states first."""
    table, done = list(table), 0
    while True:
        state = min((s for s in range(STATES) if table[s] is not None and not done >> s & 1),
                    key=lambda s: table[s][0], default=None)
        if state is None:
            return table
        done |= 1 << state
        cost, audit = table[state]
        if not done >> FILLED[state] & 1:
            offer(table, FILLED[state], cost + INSERT_COST, audit, "I")


def step(table: list, kind: int, fault: int) -> list:
    """The best (cost, audit) by state after one more turn."""
    out: list = [None] * STATES
    for state, way in enumerate(inserted(table)):
        if way is None:
            continue
        cost, audit = way
        offer(out, state, cost + DELETE_COST, audit, "D")
        if fault in (BLANK, DUPLICATE):
            continue
        cost += TRUNCATED_COST if fault == TRUNCATED else 0
        kept = KEPT.get((state, kind))
        if kept is not None:
            offer(out, kept, cost, audit, "K")
        offer(out, FILLED[state], cost + REROLE_COST, audit, "R")
    return out


def run(start: int, turns: list[tuple[int, int]]) -> list:
    """The best (cost, audit) by state after the turns (kind, fault), begun in ``start``."""
    table: list = [None] * STATES
    table[start] = (0, Audit())
    for kind, fault in turns:
        table = step(table, kind, fault)
    return table


def whole(turns: list[tuple[int, int]]) -> tuple[int, str]:
    """Cost and audit of a whole conversation."""
    ends = [(cost + INSERT_COST * len(CLOSING[s]), str(audit) + CLOSING[s])
            for s, (cost, audit) in ((s, w) for s, w in enumerate(run(0, turns)) if w is not None)]
    return min(ends)


def ways(turns: list[tuple[int, int]], first: bool) -> tuple[list, list, list]:
    """A piece of a conversation from each state (``first``: from none but 0) to each
    state: costs (None: no way), audits, and the audits' order among those of one start."""
    costs, audits, ranks = [], [], []
    for start in range(STATES):
        table = run(start, turns) if start == 0 or not first else [None] * STATES
        texts = [None if w is None else str(w[1]) for w in table]
        order = sorted(t for t in texts if t is not None)
        costs += [None if w is None else w[0] for w in table]
        audits += texts
        ranks += [None if t is None else order.index(t) for t in texts]
    return costs, audits, ranks


def chosen(pieces: list[tuple[list, list]]) -> tuple[list[int], str]:
    """The way (start * STATES + end) through each piece (costs, ranks) of one
    conversation, and the inserts that close it: the least cost by the costs that remain
    from each state on, then in order the least audit of the ways that keep to it."""
    remain = [[INSERT_COST * len(c) for c in CLOSING]]
    for costs, _ in reversed(pieces):
        after = remain[-1]
        remain.append([min((costs[s * STATES + e] + after[e] for e in range(STATES)
                            if costs[s * STATES + e] is not None and after[e] is not None), default=None)
                       for s in range(STATES)])
    remain.reverse()
    state, picks = 0, []
    for i, (costs, ranks) in enumerate(pieces):
        best = min((e for e in range(STATES) if costs[state * STATES + e] is not None and remain[i + 1][e] is not None
                    and costs[state * STATES + e] + remain[i + 1][e] == remain[i][state]),
                   key=lambda e: ranks[state * STATES + e])
        picks.append(state * STATES + best)
        state = best
    return picks, CLOSING[state]

"""Viterbi over the states of a repaired conversation, with coalescing survivors.

The states say what the repaired rows end with: nothing, a system row, a user row or an
assistant row; a conversation may end with nothing or an assistant row. Each state keeps
one survivor, the cheapest edits that reach it, among equally cheap ones those whose
initials are least in ASCII order. Survivors are leaves of a tree of back-pointers whose
nodes count the survivors that still refer to them, as children: a node without any is
freed, one with a single child joins it, and what all survivors share is final and handed
out. So the tree never has more than seven nodes, and only the edits on which survivors
still differ are held, one byte each.

Ties compare the whole unresolved suffixes: every step ends with one letter for its row, so
no string of a column is a prefix of another, and the order of two extended strings is the
order of the strings, then of what is added. Survivors therefore carry the rank of their
string among the column's, and comparing ranks is comparing the suffixes in full.

A survivor that another one beats whatever follows is dropped: ``GAP`` bounds what it
costs to go on from the other state instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import product

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {USER: "user", ASSISTANT: "assistant"}
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
# A row of the role may follow these states.
BEFORE = {SYSTEM: (NOTHING,), USER: (NOTHING, SYSTEM, ASSISTANT), ASSISTANT: (USER,)}
FILLED = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # state after an insertion
# GAP[p][q]: extra cost of q for any rows to come, at most: what a later system row kept from
# NOTHING costs to delete, insertions that bring q into step, or into a state to end with.
GAP = (
    (0, 10, 7, 2),
    (0, 0, 5, 0),
    (5, 5, 0, 5),
    (0, 10, 5, 0),
)
FINAL = {NOTHING: "", ASSISTANT: "", USER: "I", SYSTEM: "II"}


def _steps(kind: int | None, gone: bool, cut: bool) -> list[list[tuple[int, int, str]]]:
    """For each state after a row the (state before, cost, edits) that lead there, the best
    for each state before. ``kind`` is the state the row's own role gives, if any; ``gone``
    rows must be deleted, ``cut`` ones cost more unless deleted."""
    best: dict[tuple[int, int], tuple[int, str]] = {}

    def offer(start: int, end: int, cost: int, edits: str) -> None:
        best[start, end] = min(best.get((start, end), (cost, edits)), (cost, edits))

    for start, inserts in product(range(4), range(3)):
        here = start
        for _ in range(inserts):
            here = FILLED[here]
        cost, edits = INSERT * inserts, "I" * inserts
        offer(start, here, cost + DELETE, edits + "D")
        if gone:
            continue
        cost += TRUNCATED * cut
        if kind is not None and here in BEFORE[kind]:
            offer(start, kind, cost, edits + "K")
        for role in ROLES:
            if here in BEFORE[role]:
                offer(start, role, cost + REROLE, edits + "R")
    return [[(s, *best[s, e]) for s in range(4) if (s, e) in best] for e in range(4)]


STEPS = {
    key: _steps(*key)
    for key in product((None, SYSTEM, USER, ASSISTANT), (False, True), (False, True))
}
KINDS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}


def replayed(state: int, edits: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[int, str, str]]:
    """(state after it, role, text) of every row that ``edits`` leave or insert; ``rows``
    gives the role and text for each of the letters D, K and R."""
    for edit in edits:
        if edit == "I":
            state = FILLED[state]
            yield state, ROLES[state], ""
            continue
        role, text = next(rows)
        if edit == "K":
            state = KINDS[role[0]]
            yield state, role, text
        elif edit == "R":
            state = FILLED[state]
            yield state, ROLES[state], text


class _Node:
    """Edits since the parent; ``state`` where it is a survivor's leaf, else children."""

    __slots__ = ("parent", "edits", "children", "state")

    def __init__(self, parent: _Node | None, edits: str, state: int) -> None:
        self.parent, self.edits, self.children, self.state = parent, bytearray(edits, "ascii"), [], state


class Survivors:
    """Rows go in through ``step``; ``settled`` holds the edits that are final and not yet
    taken. With ``digest`` every survivor carries the SHA-256 of its repaired rows, so that
    their texts need not be held."""

    def __init__(self, digest: bool = True) -> None:
        self.root = _Node(None, "", NOTHING)
        start = hashlib.sha256() if digest else None
        # state -> (cost, rank, node, digest)
        self.at: dict[int, tuple] = {NOTHING: (0, 0, self.root, start)}
        self.settled = bytearray()

    def step(self, role: str, text: str, gone: bool, cut: bool) -> None:
        found = {}
        steps = STEPS[KINDS.get(role[:1]), gone, cut and not gone]
        for state, ways in enumerate(steps):
            best = None
            for start, cost, edits in ways:
                if start in self.at:
                    was = self.at[start]
                    way = (was[0] + cost, was[1], edits, start)
                    if best is None or way < best:
                        best = way
            if best is not None:
                found[state] = best
        alive = [
            s for s, way in found.items() if all(way[0] <= other[0] + GAP[s][q] for q, other in found.items())
        ]
        alive.sort(key=lambda s: found[s][1:3])
        followers = [found[s][3] for s in alive]
        before, self.at = self.at, {}
        for _, _, node, _ in before.values():
            node.state = None
        for rank, state in enumerate(alive):
            cost, _, edits, start = found[state]
            node = before[start][2]
            if followers.count(start) == 1:
                node.edits += edits.encode()
                node.state = state
            else:
                node.children.append(_Node(node, edits, state))
                node = node.children[-1]
            self.at[state] = (cost, rank, node, self._hashed(before[start][3], start, edits, role, text))
        for start, (_, _, node, _) in before.items():
            while not node.children and node.state is None:
                node.parent.children.remove(node)
                node = node.parent
        self._join(self.root)
        self.settled += self.root.edits
        self.root.edits.clear()

    def _join(self, node: _Node) -> None:
        """Only children become part of their parent: at most seven nodes are left."""
        while len(node.children) == 1:
            (only,) = node.children
            node.edits += only.edits
            node.children, node.state = only.children, only.state
            for child in node.children:
                child.parent = node
            if node.state is not None:
                cost, rank, _, digest = self.at[node.state]
                self.at[node.state] = (cost, rank, node, digest)
        for child in node.children:
            self._join(child)

    @staticmethod
    def _hashed(digest, state: int, edits: str, role: str, text: str):
        if digest is None or edits == "D":
            return digest
        digest = digest.copy()
        for after, out_role, out_text in replayed(state, edits, iter([(role, text)])):
            line = f"{out_role}:{out_text}"
            digest.update(("\n" + line if state != NOTHING else line).encode())
            state = after
        return digest

    def held(self) -> tuple[int, int]:
        """Nodes below the root and the letters in them: the edits that are still open."""
        below, nodes, letters = list(self.root.children), 0, 0
        while below:
            node = below.pop()
            below += node.children
            nodes, letters = nodes + 1, letters + len(node.edits)
        return nodes, letters

    def close(self) -> tuple[int, str | None]:
        """Settles the rest; the cost of all edits and the digest of the repaired rows."""
        ends = [(c + INSERT * len(FINAL[s]), r, s) for s, (c, r, _, _) in self.at.items()]
        cost, _, state = min(ends)
        _, _, node, digest = self.at[state]
        digest = self._hashed(digest, state, FINAL[state], "", "")
        rest = [FINAL[state].encode()]
        while node is not self.root:
            rest.append(bytes(node.edits))
            node = node.parent
        self.settled += b"".join(reversed(rest))
        return cost, digest.hexdigest() if digest is not None else None

    def taken(self) -> str:
        edits = self.settled.decode()
        self.settled.clear()
        return edits

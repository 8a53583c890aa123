"""Cheapest edits of a sequence of turns: the auction algorithm for shortest paths.

The lattice has a node for each place between rows and each state of the grammar ``(s?(ua)+)?``:
nothing yet, after the system turn, after a user turn, after an assistant turn. Arcs are edits.
Every node has a price, at most the length of an arc plus the price of its head (complementary
slackness). A path grows from the origin along arcs that meet this with equality; where none does,
the price of its last node goes up to the least it can be and the path steps back. When it arrives,
the price of the origin is its distance to the end, and the shortest paths are exactly the paths of
tight arcs, so the ASCII-least edits are read off without another search.
"""

from __future__ import annotations

from functools import lru_cache

NONE, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
#: Codes of rows: the role's initial plus four times the fault.
INITIALS = "sua"
FINE, TRUNCATED, BLANK, DUPLICATE = range(4)
INFINITE = 1 << 60
#: Rows in one lattice. Longer sequences are cut; the exact prices between two pieces carry over.
BLOCK = 64
KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2


def fix(state: int) -> int:
    """The state after a turn that is given a role or put in: the one that may follow."""
    return ASSISTANT if state == USER else USER


def keep(state: int, initial: int) -> int | None:
    """The state after a kept turn, or None if it may not stand here."""
    if initial == 0:
        return SYSTEM if state == NONE else None
    if initial == 1:
        return USER if state != USER else None
    return ASSISTANT if initial == 2 and state == USER else None


class Lattice:
    """Edits of the rows of ``codes``. ``exits`` are the prices behind the last row by state (None: no way on).

    Without exits the sequence ends here: with nothing, or after an assistant turn, and turns may
    still be put in.
    """

    def __init__(self, codes: bytes, exits: tuple | None = None):
        self.n = len(codes)
        self.arcs: list[list[tuple[str, int, int]]] = []  # (edit, cost, head); the end is node 4n + 4
        least = [0] * (self.n + 1)
        least[-1] = 0 if exits is None else min(e for e in exits if e is not None)
        self.end = end = 4 * self.n + 4
        for i in range(self.n - 1, -1, -1):
            fault = codes[i] >> 2
            least[i] = least[i + 1] + (DELETE if fault >= BLANK else min(DELETE, (fault == TRUNCATED) + (codes[i] & 3 == 3) * REROLE))
        for i, code in enumerate(codes):
            initial, fault = code & 3, code >> 2
            for q in STATES:
                out = [("D", DELETE, 4 * i + 4 + q), ("I", INSERT, 4 * i + fix(q))]
                if fault < BLANK:
                    if (to := keep(q, initial)) is not None:
                        out.append(("K", KEEP + (fault == TRUNCATED), 4 * i + 4 + to))
                    out.append(("R", REROLE + (fault == TRUNCATED), 4 * i + 4 + fix(q)))
                self.arcs.append(out)
        for q in STATES:
            if exits is None:
                self.arcs.append([("", 0, end)] * (q in (NONE, ASSISTANT)) + [("I", INSERT, 4 * self.n + fix(q))])
            else:
                self.arcs.append([] if exits[q] is None else [("", exits[q], end)])
        self.arcs.append([])
        # A first price that is slack everywhere: what each row must cost by itself.
        self.price = [least[v // 4] for v in range(end)] + [0]
        if exits is not None:
            self.price[4 * self.n : end] = [INFINITE if e is None else e for e in exits]
        ways = self._reaches(lambda v, cost, head: True)
        self.price = [p if way else INFINITE for p, way in zip(self.price, ways, strict=True)]

    def _reaches(self, open_arc) -> list[bool]:
        """Which nodes lead to the end over the arcs for which open_arc(tail, cost, head) holds."""
        found = [False] * self.end + [True]
        for i in range(self.n, -1, -1):
            for _ in STATES:  # turns put in lead from state to state of one place
                for v in range(4 * i, 4 * i + 4):
                    found[v] = found[v] or any(found[head] and open_arc(v, cost, head) for _, cost, head in self.arcs[v])
        return found

    def settle(self, state: int) -> int | None:
        """The distance from a state before the first row to the end, by auction; None if there is no way."""
        price, arcs, path = self.price, self.arcs, [state]
        if price[state] >= INFINITE:
            return None
        while (v := path[-1]) != self.end:
            best, to = INFINITE, -1
            for _, cost, head in arcs[v]:
                if cost + price[head] < best:
                    best, to = cost + price[head], head
            if price[v] < best:  # contraction
                price[v] = best
                if len(path) > 1:
                    path.pop()
            else:  # extension
                path.append(to)
        return price[state]

    def trace(self, state: int) -> tuple[str, int]:
        """The ASCII-least edits among the cheapest from a settled state, and the state behind the last row."""
        price = self.price
        tight = lambda v, cost, head: price[v] == cost + price[head]
        good = self._reaches(tight)
        v, edits = state, []
        while True:
            # In one state each edit has one head, and edits are listed in ASCII order, the end first.
            edit, _, head = next(a for a in self.arcs[v] if good[a[2]] and tight(v, a[1], a[2]))
            if head == self.end:
                return "".join(edits), v % 4
            edits.append(edit)
            v = head


def chained(codes: bytes, exits: tuple | None, entries=STATES) -> tuple[list[Lattice], tuple]:
    """Lattices of a sequence of any length, settled from the last to the first, and the prices of the entries."""
    cuts = range(0, max(len(codes), 1), BLOCK)
    found: list[Lattice] = []
    for at in reversed(cuts):
        lattice = Lattice(codes[at : at + BLOCK], exits)
        asked = STATES if at else entries
        exits = tuple(lattice.settle(q) if q in asked else None for q in STATES)
        found.append(lattice)
    return found[::-1], exits


def edits_from(lattices: list[Lattice], state: int) -> tuple[str, int]:
    out = []
    for lattice in lattices:
        edits, state = lattice.trace(state)
        out.append(edits)
    return "".join(out), state


@lru_cache(1 << 14)
def cheapest(codes: bytes) -> tuple[str, int]:
    """(edits, cost) of a whole conversation."""
    lattices, prices = chained(codes, None, (NONE,))
    return edits_from(lattices, NONE)[0], prices[NONE]


@lru_cache(1 << 10)
def crossing(codes: bytes) -> tuple:
    """Costs of a piece of a conversation, by entry and exit state; None where there is no way."""
    columns = []
    for to in STATES:
        exits = tuple(0 if q == to else None for q in STATES)
        columns.append(chained(codes, exits)[1])
    return tuple(tuple(c[q] for c in columns) for q in STATES)


def endings() -> tuple[tuple, list[str]]:
    """Behind the last row, by state: the price, and the turns to put in."""
    lattices, prices = chained(b"", None)
    return prices, [edits_from(lattices, q)[0] for q in STATES]


def before(costs: tuple, exits: tuple) -> tuple:
    """Prices before a piece from those behind it."""
    ways = [[c + e for c, e in zip(row, exits, strict=True) if c is not None and e is not None] for row in costs]
    return tuple(min(w) if w else None for w in ways)

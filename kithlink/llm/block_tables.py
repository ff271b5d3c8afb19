"""Four-Russians tables for the cheapest edits of a conversation's turns.

What the rest of a conversation costs at least is a vector over the states of its grammar
`(s?(ua)+)?`.  Less its smallest entry, such a vector is one of few, so the vector before a block of
BLOCK turns follows from the vector behind it and the turns' symbols by one lookup.
"""

from __future__ import annotations

from functools import cache

import numpy as np

# Symbols of turns: 0 must be deleted; 1 + 2 * role + truncated otherwise.
ROLES = "suao"
SYMBOLS = 1 + 2 * len(ROLES)
BLOCK = 4
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
# States: nothing yet, after s, after u, after a.  Where a role leads, and what an inserted turn is.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
STATES = 4
NEXT = {(START, "s"): AFTER_S, (START, "u"): AFTER_U, (AFTER_S, "u"): AFTER_U, (AFTER_U, "a"): AFTER_A, (AFTER_A, "u"): AFTER_U}
INSERTED = {START: AFTER_U, AFTER_S: AFTER_U, AFTER_U: AFTER_A, AFTER_A: AFTER_U}
ROLE_INTO = {AFTER_U: "u", AFTER_A: "a"}
NEVER = 1 << 20


def options(state: int, symbol: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of what can be done with a turn, in the order of the letters."""
    out = [("D", DELETE, state)]
    if symbol:
        role, extra = ROLES[(symbol - 1) // 2], TRUNCATED * ((symbol - 1) % 2)
        if (state, role) in NEXT:
            out.append(("K", KEEP + extra, NEXT[state, role]))
        out += [("R", REROLE + extra, to) for (s, r), to in NEXT.items() if s == state and r in "ua" and r != role]
    return out


def closed(costs: list[int]) -> tuple[int, ...]:
    """The costs when turns may be inserted first; two in a row at most, a third would lead back."""
    now = list(costs)
    for _ in range(2):
        now = [min(c, INSERT + now[INSERTED[s]]) for s, c in enumerate(now)]
    return tuple(min(c, NEVER) for c in now)


def before(vector: tuple[int, ...], symbol: int) -> tuple[int, ...]:
    """Costs from before a turn, given those from behind it."""
    return closed([min(cost + vector[to] for _, cost, to in options(s, symbol)) for s in range(STATES)])


def normal(vector: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    least = min(vector)
    return tuple(NEVER if c >= NEVER // 2 else c - least for c in vector), least


END = closed([0, NEVER, NEVER, 0])


class Tables:
    """The vectors, and the transitions of single turns and of blocks of turns."""

    def __init__(self):
        ends = [normal(END)[0]] + [tuple(0 if t == s else NEVER for t in range(STATES)) for s in range(STATES)]
        self.number: dict[tuple[int, ...], int] = {}
        self.vectors: list[tuple[int, ...]] = []
        open_ = list(ends)
        steps: dict[tuple[int, int], tuple[int, int]] = {}
        for v in open_:
            self._add(v)
        while open_:
            v = open_.pop()
            for symbol in range(SYMBOLS):
                to, least = normal(before(v, symbol))
                if to not in self.number:
                    self._add(to)
                    open_.append(to)
                steps[self.number[v], symbol] = (self.number[to], least)
        self.step = np.array([[steps[v, s][0] for s in range(SYMBOLS)] for v in range(len(self.vectors))], np.int32)
        self.more = np.array([[steps[v, s][1] for s in range(SYMBOLS)] for v in range(len(self.vectors))], np.int32)
        # blocks of 1, 2, .. BLOCK turns; the last turn of a block is met first and is its lowest digit
        jump, cost = self.step, self.more
        for _ in range(BLOCK - 1):
            # one more turn before the block, as the highest digit
            cost = np.concatenate([cost + self.more[jump, s] for s in range(SYMBOLS)], axis=1)
            jump = np.concatenate([self.step[jump, s] for s in range(SYMBOLS)], axis=1)
        self.jump, self.cost = jump, cost

    def _add(self, vector: tuple[int, ...]) -> None:
        self.number[vector] = len(self.vectors)
        self.vectors.append(vector)

    @property
    def end(self) -> int:
        return self.number[normal(END)[0]]

    def known(self, vector: list[int]) -> int:
        return self.number[normal(tuple(vector))[0]]

    def borders(self, symbols: np.ndarray, vector: int) -> tuple[list[int], int]:
        """The vectors at the block borders from the front (the first is that before all turns) and what they are less by.

        A run that is no multiple of BLOCK long has its short block in front.
        """
        at, less = [vector], 0
        whole = len(symbols) // BLOCK
        short = len(symbols) - whole * BLOCK
        if whole:
            digits = symbols[short:].reshape(whole, BLOCK) @ (SYMBOLS ** np.arange(BLOCK - 1, -1, -1))
            for block in digits[::-1].tolist():
                less += int(self.cost[at[-1], block])
                at.append(int(self.jump[at[-1], block]))
        if short:
            v = at[-1]
            for symbol in symbols[:short][::-1].tolist():
                less += int(self.more[v, symbol])
                v = int(self.step[v, symbol])
            at.append(v)
        return at[::-1], less

    def costs(self, symbols: np.ndarray) -> list[list[int]]:
        """Least cost of the turns from each state to each state."""
        columns = []
        for t in range(STATES):
            at, less = self.borders(symbols, self.number[tuple(0 if s == t else NEVER for s in range(STATES))])
            columns.append([min(NEVER, c + less) if c < NEVER else NEVER for c in self.vectors[at[0]]])
        return [[columns[t][s] for t in range(STATES)] for s in range(STATES)]

    @cache  # noqa: B019  (one table a process)
    def choice(self, behind: int, symbol: int, state: int) -> tuple[str, str, int]:
        """The letters of the cheapest edits up to and with a turn, first by ASCII, the roles inserted, and the state then.

        All ways from a state differ in their first letter or in what follows it, and a letter and a state tell the
        next state; so the first letter of a cheapest way that ASCII puts first begins the first of them.
        """
        vector = self.vectors[behind]
        here = before(vector, symbol)
        letters = roles = ""
        while True:
            ways = [(letter, to) for letter, cost, to in options(state, symbol) if cost + vector[to] == here[state]]
            if ways and ways[0][0] == "D":
                return letters + "D", roles, state
            if INSERT + here[INSERTED[state]] == here[state]:
                state = INSERTED[state]
                letters, roles = letters + "I", roles + ROLE_INTO[state]
                continue
            return letters + ways[0][0], roles, ways[0][1]

    def trace(self, symbols: np.ndarray, vector: int, state: int) -> tuple[list[tuple[str, str, int]], int]:
        """The choices for each turn, front to back, and the state behind the last."""
        at, _ = self.borders(symbols, vector)
        done = []
        short = len(symbols) % BLOCK
        cuts = ([0] if short else []) + list(range(short, len(symbols) + 1, BLOCK))
        for b, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:])):
            # the vectors inside this block, from its back border
            inside = [at[b + 1]]
            for symbol in symbols[lo + 1:hi][::-1].tolist():
                inside.append(int(self.step[inside[-1], symbol]))
            for symbol, behind in zip(symbols[lo:hi].tolist(), inside[::-1]):
                done.append(self.choice(behind, symbol, state))
                state = done[-1][2]
        return done, state

    @staticmethod
    def closing(state: int) -> str:
        """The roles inserted behind the last turn."""
        return {START: "", AFTER_S: "ua", AFTER_U: "a", AFTER_A: ""}[state]


@cache
def tables() -> Tables:
    return Tables()



"""A lexicon trie crossed with Levenshtein automata of one edit, as one table of states.

Entries are whole words or stems (any word that begins with them).  A state of the table is the set
of trie nodes that the characters read so far can stand at, with the edits spent; sets are built once
and many words then run through the table side by side.
"""

from __future__ import annotations

from collections import deque

import numpy as np

NONE, STEM_NEAR, WORD_NEAR, STEM, WORD = range(5)
OTHER = 0


class LexiconAutomaton:
    """`entries`: (text, is_stem, weight).  Entries shorter than `near_from` characters match exactly only."""

    def __init__(self, entries: list[tuple[str, bool, float]], near_from: int = 5):
        self.alphabet = {c: i + 1 for i, c in enumerate(sorted({c for e, _, _ in entries for c in e}))}
        children: list[dict[int, int]] = [{}]
        self.word_at: dict[int, float] = {}
        self.stem_at: dict[int, float] = {}
        long_enough: list[bool] = [False]
        near_ends: set[int] = set()
        for text, is_stem, weight in sorted(entries):
            node, path = 0, [0]
            for c in text:
                k = self.alphabet[c]
                if k not in children[node]:
                    children[node][k] = len(children)
                    children.append({})
                    long_enough.append(False)
                node = children[node][k]
                path.append(node)
            ends = self.stem_at if is_stem else self.word_at
            ends[node] = max(weight, ends.get(node, weight))
            if len(text) >= near_from:
                near_ends.add(node)
                for n in path:
                    long_enough[n] = True
        self.children, self.near = children, long_enough
        self._near_ends = near_ends
        self._compile()

    def _spread(self, states: set[tuple[int, int]]) -> frozenset[tuple[int, int]]:
        """With the states reached by leaving out one character of an entry."""
        more = {(c, 1) for n, e in states if e == 0 for c in self.children[n].values() if self.near[c]}
        return frozenset(s for s in states | more if s[1] == 0 or (s[0], 0) not in states)

    def _read(self, states: frozenset[tuple[int, int]], c: int) -> frozenset[tuple[int, int]]:
        out = set()
        for n, e in states:
            if c in self.children[n]:
                to = self.children[n][c]
                if e == 0 or self.near[to]:
                    out.add((to, e))
            if e == 0 and self.near[n]:
                out.add((n, 1))
                out.update((k, 1) for k in self.children[n].values() if self.near[k])
        return self._spread(out)

    def _stem(self, states: frozenset[tuple[int, int]]) -> tuple[int, float]:
        got = [(STEM, self.stem_at[n]) if e == 0 else (STEM_NEAR, self.stem_at[n])
               for n, e in states if n in self.stem_at and (e == 0 or n in self._near_ends)]
        return max(got, default=(NONE, 0.0))

    def _compile(self) -> None:
        """States are (set, best stem seen); a stem met without edits is final."""
        first = (self._spread({(0, 0)}), (NONE, 0.0))
        dead = (frozenset(), (NONE, 0.0))
        number = {dead: 0, first: 1}
        rows: list[list[int]] = [[0] * (len(self.alphabet) + 1)]
        todo, order = deque([first]), [dead, first]
        while todo:
            states, seen = todo.popleft()
            row = []
            for c in range(len(self.alphabet) + 1):
                to = self._read(states, c)
                best = max(seen, self._stem(to))
                if best[0] == STEM:
                    to = frozenset()
                key = (to, best)
                if key not in number:
                    number[key] = len(order)
                    order.append(key)
                    todo.append(key)
                row.append(number[key])
            rows.append(row)
        self.table = np.array(rows, np.int32)
        found = []
        for states, best in order:
            for n, e in states:
                if n in self.word_at and (e == 0 or n in self._near_ends):
                    best = max(best, (WORD if e == 0 else WORD_NEAR, self.word_at[n]))
            found.append(best)
        self.kind = np.array([k for k, _ in found], np.int8)
        self.weight = np.array([w for _, w in found], np.float64)
        # a state that only leads to itself needs no further reading
        self.settled = (self.table == np.arange(len(order))[:, None]).all(1)

    def run(self, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The state of each word after its last character; `symbols` are numbers of the alphabet."""
        state = np.ones(len(starts), np.int32)
        live = np.flatnonzero(lengths > 0)
        step = 0
        while len(live):
            state[live] = self.table[state[live], symbols[starts[live] + step]]
            step += 1
            live = live[(lengths[live] > step) & ~self.settled[state[live]]]
        return state

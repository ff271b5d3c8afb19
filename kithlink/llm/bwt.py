"""Equal substrings of a minimum length among short strings, from their Burrows-Wheeler transform."""

from __future__ import annotations

import numpy as np

from kithlink.llm.common import ragged

_PACK = 6


def _suffix_order(symbols: np.ndarray, left: np.ndarray) -> np.ndarray:
    """All suffixes in order; `left` is the number of symbols up to and with the next separator (symbol 0).

    A suffix ends with its separator, and separators go by place.  Ranks of prefixes are doubled until
    they are unique; only what is still tied is sorted again.
    """
    n = len(symbols)
    key = np.zeros(n, np.int64)
    for k in range(_PACK):
        key <<= 9
        key[:n - k] |= np.where(left[:n - k] > k, symbols[k:], 0)
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    opens = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
    length = _PACK
    longest = int(left.max())
    rank = np.empty(n, np.int64)
    while True:
        first = np.maximum.accumulate(np.where(opens, np.arange(n), 0))
        rank[order] = first
        if length >= longest:
            return order
        tied = np.flatnonzero(~(opens & np.append(opens[1:], True)))
        if not len(tied):
            return order
        sub = order[tied]
        after = np.where(left[sub] > length, rank[np.minimum(sub + length, n - 1)] + 1, 0)
        key = first[tied] * (n + 1) + after
        by = np.argsort(key, kind="stable")
        order[tied] = sub[by]
        key = key[by]
        opens = opens.copy()
        opens[tied[1:]] |= key[1:] != key[:-1]
        length *= 2


def repeats(strings: np.ndarray, sizes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places that share their next `least` bytes with another place: (class, string, offset) of each.

    `strings` holds the strings one after the other, `sizes` their lengths.  Intervals of suffixes that
    begin with the same bytes are extended backwards, breadth first, through the transform.  Intervals of
    strings of length l yield those of length l + 1, and a right border seen for the first time is one
    where the common prefix is l long; so common prefixes come by increasing length, and at `least` the
    search stops: places not parted by then agree in `least` bytes.
    """
    none = np.zeros(0, np.int64)
    m = len(sizes)
    if not m:
        return none, none, none
    ends = np.cumsum(sizes + 1)
    n = int(ends[-1])
    symbols = np.zeros(n, np.int64)
    symbols[ragged(ends - sizes - 1, sizes)] = strings.astype(np.int64) + 1
    left = np.repeat(ends, sizes + 1) - np.arange(n)
    order = _suffix_order(symbols, left)
    before = symbols[order - 1]  # of place 0 it is the last separator
    stable = np.argsort(before, kind="stable")
    to = np.empty(n, np.int64)
    to[stable] = np.arange(n)
    of = before[stable]
    same_next = np.append(of[1:] == of[:-1], False)
    following = np.full(n, n, np.int64)
    following[stable[:-1][same_next[:-1]]] = stable[1:][same_next[:-1]]
    previous = np.full(n, -1, np.int64)
    previous[stable[1:][same_next[:-1]]] = stable[:-1][same_next[:-1]]

    cut = np.zeros(n + 1, bool)
    cut[0] = cut[n] = True
    # strings of length 1: each separator is one of its own
    counts = np.bincount(symbols, minlength=257)
    upto = np.cumsum(counts)
    own = np.flatnonzero(counts[1:]) + 1
    lo = np.concatenate([np.arange(m), upto[own] - counts[own]])
    hi = np.concatenate([np.arange(m) + 1, upto[own]])
    cut[hi] = True
    for _ in range(1, least):
        if not len(lo):
            break
        width = hi - lo
        at = ragged(lo, width)
        known = before[at] > 0
        last = known & (following[at] >= np.repeat(hi, width))
        first = known & (previous[at] < np.repeat(lo, width))
        hi, lo = np.sort(to[at[last]]) + 1, np.sort(to[at[first]])
        new = ~cut[hi]
        hi, lo = hi[new], lo[new]
        cut[hi] = True
    group = np.cumsum(cut[:n])
    size = np.bincount(group)
    many = size[group] > 1
    place = order[many]
    string = np.searchsorted(ends, place, side="right")
    return group[many], string, place - (ends - sizes - 1)[string]

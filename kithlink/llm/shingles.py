"""Word shingles of many texts at once, as 64-bit hashes."""

from __future__ import annotations

import numpy as np

from kithlink.llm.common import RunHash, mix

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_STEP = np.uint64(0xD6E8FEB86659FD93)
_HASH: list[RunHash] = []


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word (A-Z in lower case) and the number of words of each text."""
    if not _HASH:
        _HASH.append(RunHash(256, 9))
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(ends) - 1, np.int64)
    letter = ~_BLANK[data]
    edge = np.zeros(n + 1, bool)
    edge[ends] = True
    first = letter.copy()
    first[1:] &= ~letter[:-1] | edge[1:-1]
    last = letter.copy()
    last[:-1] &= ~letter[1:] | edge[1:-1]
    at, to = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = _HASH[0].sums(_LOWER[data])
    cut = np.searchsorted(at, ends)
    return _HASH[0].runs(sums, at, to), np.diff(cut)


def shingle_sets(data: np.ndarray, ends: np.ndarray, words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text in ascending order, and len + 1 offsets.

    A text of fewer words has all of them as its one shingle; a text without words has none.
    """
    h, count = word_hashes(data, ends)
    run = np.minimum(count, words)
    shingles = np.where(count == 0, 0, count - run + 1)
    start = np.cumsum(count) - count
    total = int(shingles.sum())
    upto = np.concatenate([[0], np.cumsum(shingles)])
    at = np.arange(total) + np.repeat(start - upto[:-1], shingles)
    length = np.repeat(run, shingles)
    mixed = np.zeros(total, np.uint64)
    for k in range(words):
        here = k < length
        mixed = np.where(here, mixed * _STEP + h[np.minimum(at + k, max(len(h) - 1, 0))], mixed) if total else mixed
    mixed = mix(mixed + length.astype(np.uint64))
    for a, b in zip(upto[:-1].tolist(), upto[1:].tolist()):
        mixed[a:b].sort()
    keep = np.ones(total, bool)
    if total:
        keep[1:] = mixed[1:] != mixed[:-1]
        keep[upto[:-1][shingles > 0]] = True
    kept = np.concatenate([[0], np.cumsum(keep)])
    return mixed[keep], kept[upto]

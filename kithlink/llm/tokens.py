"""Token ids of a public byte-level vocabulary, word by word and many texts at once.

The vocabulary splits a text into words before it merges bytes, and a word's ids depend on the
word alone.  Words are found with array operations over the characters of many texts, and each
distinct word is merged once per worker.  Texts with characters outside the common planes,
apostrophes (whose suffixes are words of their own) or special tokens go to the tokenizer itself.
"""

from __future__ import annotations

import base64
import unicodedata

import numpy as np

from kithlink.llm.common import RunHash, ragged

LETTER, NUMBER, SPACE, OTHER, UNSURE = range(5)
PLANE = 0x3000
# Distinct words a worker remembers before it starts over.
MOST_WORDS = 250_000


def _classes() -> np.ndarray:
    out = np.full(PLANE, OTHER, np.uint8)
    for i in range(PLANE):
        c = chr(i)
        kind = unicodedata.category(c)
        if kind == "Cn":  # other versions of the character tables may know it
            out[i] = UNSURE
        elif kind[0] == "L":
            out[i] = LETTER
        elif kind[0] == "N":
            out[i] = NUMBER
        elif c.isspace():
            # the separators of files and records count as blanks in some tables only
            out[i] = UNSURE if 0x1C <= i <= 0x1F else SPACE
    out[ord("'")] = UNSURE
    return out


class Tokens:
    _made: dict[tuple[str, str], Tokens] = {}

    @classmethod
    def of(cls, vocabulary: str, ranks: str) -> Tokens:
        """One per worker process and vocabulary."""
        if (vocabulary, ranks) not in cls._made:
            cls._made[vocabulary, ranks] = cls(vocabulary, ranks)
        return cls._made[vocabulary, ranks]

    def __init__(self, vocabulary: str, ranks: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(vocabulary)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        with open(ranks, "rb") as f:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        # words are split here already
        self.merge = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=merges, special_tokens={}).encode_ordinary
        self.classes = _classes()
        self.hash = RunHash(PLANE, 4)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[int, int] = {}
        self.flat = np.zeros(1 << 16, np.int32)
        self.first = np.zeros(1 << 16, np.int64)
        self.count = np.zeros(1 << 16, np.int64)
        self.used = 0

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        kind = np.full(len(chars), UNSURE, np.uint8)
        low = chars < PLANE
        kind[low] = self.classes[chars[low]]
        unsure = np.concatenate([[0], np.cumsum(kind == UNSURE)])
        plain = (unsure[ends[1:]] == unsure[ends[:-1]])
        for i in np.flatnonzero(plain):
            plain[i] = not any(s in texts[i] for s in self.special)
        for i in np.flatnonzero(~plain):
            out[i] = np.array(self.whole.encode(texts[i], add_special_tokens=False).ids, np.int32)
        keep = np.flatnonzero(plain)
        if len(keep):
            own = ragged(ends[:-1][keep], np.diff(ends)[keep]) if len(keep) < len(texts) else slice(None)
            for i, ids in zip(keep, self._words(chars[own], kind[own], np.diff(ends)[keep])):
                out[i] = ids
        return out

    def _words(self, chars: np.ndarray, kind: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
        ends = np.cumsum(sizes)
        n = len(chars)
        if not n:
            return [np.zeros(0, np.int32) for _ in sizes]
        opens = np.zeros(n + 1, bool)  # a text starts here
        opens[ends - sizes] = True
        opens = opens[:n]
        before = np.empty(n, np.uint8)
        before[0], before[1:] = SPACE, kind[:-1]
        blank_before = np.empty(n, bool)
        blank_before[0], blank_before[1:] = False, chars[:-1] == 32
        follows = np.zeros(n, bool)  # not a blank, and of the same text
        follows[:-1] = (kind[1:] != SPACE) & ~opens[1:]
        space = kind == SPACE
        start = opens | np.where(space, (before != SPACE) | follows, (before != kind) & ~blank_before)
        at = np.flatnonzero(start)
        to = np.append(at[1:], n)
        h = self.hash.runs(self.hash.sums(chars), at, to)
        words, one, which = np.unique(h, return_index=True, return_inverse=True)
        place = self._places(words, at[one], to[one], chars)[which]
        counts = self.count[place]
        ids = self.flat[ragged(self.first[place], counts)]
        upto = np.concatenate([[0], np.cumsum(counts)])
        cut = upto[np.searchsorted(at, np.concatenate([[0], ends]))]
        return [ids[a:b] for a, b in zip(cut[:-1], cut[1:])]

    def _places(self, words: np.ndarray, at: np.ndarray, to: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """Where the ids of each distinct word are kept; new words are merged now."""
        if len(self.known) + len(words) > MOST_WORDS:
            self._forget()
        get = self.known.get
        place = np.array([get(w, -1) for w in words.tolist()], np.int64)
        new = np.flatnonzero(place < 0)
        if not len(new):
            return place
        length = to[new] - at[new]
        text = chars[ragged(at[new], length)].tobytes().decode("utf-32-le", "surrogatepass")
        cut = np.concatenate([[0], np.cumsum(length)]).tolist()
        merged = [self.merge(text[a:b]) for a, b in zip(cut[:-1], cut[1:])]
        counts = np.array([len(m) for m in merged], np.int64)
        base, total = len(self.known), int(counts.sum())
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while base + len(new) > len(self.first):
            self.first, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.count))
        self.flat[self.used:self.used + total] = [i for m in merged for i in m]
        self.first[base:base + len(new)] = self.used + np.cumsum(counts) - counts
        self.count[base:base + len(new)] = counts
        self.used += total
        place[new] = np.arange(base, base + len(new))
        self.known.update(zip(words[new].tolist(), place[new].tolist()))
        return place

"""Toxicity of documents: a learned lexicon, matched with one spelling edit, weighed by context.

Words and stems that mark toxic documents are learned from a bounded labelled sample and compiled
into one automaton.  Every word of a document runs through it; a match counts less inside quotation
marks or near words of reporting, and close matches strengthen each other.  A logistic model over the
sums gives the probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kithlink.llm import labelled
from kithlink.llm.automaton import STEM, STEM_NEAR, WORD, WORD_NEAR, LexiconAutomaton
from kithlink.llm.common import documents_only, pieces

PLANE = 0x3000
LINE, QUOTE = 10, ord('"')
OPENING, CLOSING = "“«„", "”»"
# Words that announce that somebody else's words follow.
REPORTING = ("said says say called calls quote quoted quotes wrote writes word words term means insult reported "
             "dit disait mot sagte sagt wort dijo dice palabra").split()
# Words to either side of a match that make its context.
WINDOW = 6
FEATURES = 9


@dataclass(frozen=True)
class Fitting:
    """Bounds of the fit.

    per_class: labelled documents of each class; candidates: words and stems looked at, the most
    telling first; entries: size of the lexicon.
    """
    per_class: int = 1500
    stem_chars: tuple[int, ...] = (3, 4, 5, 6, 7)
    candidates: int = 3000
    entries: int = 300
    least: int = 3
    purity: float = 0.9


def _tables() -> tuple[np.ndarray, np.ndarray]:
    lower = np.arange(PLANE + 1, dtype=np.uint32)
    word = np.zeros(PLANE + 1, bool)
    word[PLANE] = True  # characters beyond count as letters that no entry has
    for i in range(PLANE):
        c = chr(i)
        word[i] = c.isalnum()
        if len(c.lower()) == 1 and ord(c.lower()) < PLANE:
            lower[i] = ord(c.lower())
    return lower, word


LOWER, IS_WORD = _tables()


class Scorer:
    def __init__(self, entries: list[tuple[str, bool, float]]):
        self.automaton = LexiconAutomaton(entries)
        self.symbol = np.zeros(PLANE + 1, np.int32)
        for c, k in self.automaton.alphabet.items():
            self.symbol[min(ord(c), PLANE)] = k
        self.symbol = self.symbol[LOWER]
        self.reporting = LexiconAutomaton([(w, False, 1.0) for w in REPORTING], near_from=99)
        self.report_symbol = np.zeros(PLANE + 1, np.int32)
        for c, k in self.reporting.alphabet.items():
            self.report_symbol[ord(c)] = k
        self.report_symbol = self.report_symbol[LOWER]

    def features(self, texts: list[str]) -> np.ndarray:
        """One row per text, see `_sums`."""
        chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum([len(t) for t in texts]).astype(np.int64)
        chars = np.minimum(chars, PLANE)
        is_word = IS_WORD[chars]
        edge = np.zeros(len(chars) + 1, bool)
        edge[np.concatenate([[0], ends])] = True
        before = np.concatenate([[False], is_word[:-1]]) & ~edge[:-1]
        after = np.concatenate([is_word[1:], [False]]) & ~edge[1:]
        at = np.flatnonzero(is_word & ~before)
        length = np.flatnonzero(is_word & ~after) + 1 - at
        text = np.searchsorted(ends, at, side="right")
        words = np.bincount(text, minlength=len(texts))
        state = self.automaton.run(self.symbol[chars], at, length)
        kind = self.automaton.kind[state]
        hit = np.flatnonzero(kind)
        if not len(hit):
            return self._sums(len(texts), words, np.zeros(0, np.int64), kind[:0], np.zeros(0), np.zeros(0, bool), np.zeros(0))
        quoted = self._quoted(chars, at[hit], edge)
        told = np.zeros(len(hit), bool)
        near = np.zeros(len(hit))
        strong = kind >= WORD_NEAR
        for d in range(-WINDOW, WINDOW + 1):
            to = np.clip(hit + d, 0, len(at) - 1)
            same = (text[to] == text[hit]) & (to == hit + d) & (d != 0)
            near += same & strong[to]
            if d < 0:
                r = self.reporting.kind[self.reporting.run(self.report_symbol[chars], at[to], length[to])]
                told |= same & (r == WORD)
        return self._sums(len(texts), words, text[hit], kind[hit], self.automaton.weight[state[hit]], quoted | told, near)

    @staticmethod
    def _quoted(chars: np.ndarray, at: np.ndarray, edge: np.ndarray) -> np.ndarray:
        """Whether a place stands between quotation marks that open on its line."""
        opens = np.flatnonzero(edge[:-1] | np.concatenate([[True], chars[:-1] == LINE]))
        line = opens[np.searchsorted(opens, at, side="right") - 1]
        plain = np.concatenate([[0], np.cumsum(chars == QUOTE)])
        paired = np.concatenate([[0], np.cumsum(np.isin(chars, [ord(c) for c in OPENING]).astype(np.int64)
                                                - np.isin(chars, [ord(c) for c in CLOSING]))])
        return ((plain[at] - plain[line]) % 2 == 1) | (paired[at] > paired[line])

    @staticmethod
    def _sums(n: int, words: np.ndarray, text: np.ndarray, kind: np.ndarray, weight: np.ndarray, reported: np.ndarray,
              near: np.ndarray) -> np.ndarray:
        out = np.zeros((n, FEATURES))
        free = ~reported
        for i, k in enumerate((WORD, STEM, WORD_NEAR, STEM_NEAR)):
            out[:, i] = np.log1p(np.bincount(text, (kind == k) & free, n))
        exact = (kind >= STEM) & free
        out[:, 4] = np.log1p(np.bincount(text, reported & (kind >= WORD_NEAR), n))
        out[:, 5] = np.log1p(np.bincount(text, exact * weight, n))
        np.maximum.at(out[:, 6], text, exact * weight / 5)
        out[:, 7] = np.log1p(np.bincount(text, exact * near, n))
        out[:, 8] = np.sqrt(np.bincount(text, exact, n) / np.maximum(words, 20) * 20)
        return out


@dataclass
class Model:
    scorer: Scorer
    weights: np.ndarray
    centre: float
    entries: list[tuple[str, bool, float]]

    def scores(self, texts: list[str]) -> np.ndarray:
        z = self.scorer.features(texts) @ self.weights + self.centre
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton steps; both classes weigh the same."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    pull = np.diag([ridge * len(y) / 50] * x.shape[1] + [1e-6])
    w = np.zeros(x1.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        g = x1.T @ (share * (p - y)) + pull @ w
        h = (x1 * (share * p * (1 - p))[:, None]).T @ x1 + pull + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
    return w[:-1], float(w[-1])


def learn_lexicon(chosen: DataFrame, rule: Fitting) -> list[tuple[str, bool, float]]:
    """Words and stems of toxic documents that ordinary ones hardly have, by greedy cover.

    An entry is taken while it marks documents that the entries so far do not, so the words of a
    passage that happens to be copied among toxic documents are left out.  At most `candidates` rows
    and their documents come to the driver.
    """
    words = (chosen.select("doc_id", "y", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))).alias("w"))
             .where(F.length("w") >= 2))
    stems = [F.struct(F.substring("w", 1, n).alias("e"), F.lit(True).alias("stem"), (F.length("w") > n).alias("is"))
             for n in rule.stem_chars]
    terms = (words.select("doc_id", "y", F.explode(F.array(
        F.struct(F.col("w").alias("e"), F.lit(False).alias("stem"), F.lit(True).alias("is")), *stems)).alias("t"))
        .where("t.is").select("doc_id", "y", "t.e", "t.stem"))
    sizes = {r.y: r.n for r in chosen.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(1) or not sizes.get(0):
        return []
    a, b = F.col("a") / sizes[1], F.col("b") / sizes[0]
    told = (terms.groupBy("e", "stem").agg(F.countDistinct(F.when(F.col("y") == 1, F.col("doc_id"))).alias("a"),
                                           F.countDistinct(F.when(F.col("y") == 0, F.col("doc_id"))).alias("b"))
            .where((F.col("a") >= max(rule.least, sizes[1] / 200)) & (a / (a + b) >= rule.purity))
            .withColumn("gain", a - 4 * b)
            .orderBy(F.desc("gain"), "stem", "e").limit(rule.candidates))
    held = (terms.where("y = 1").join(F.broadcast(told), ["e", "stem"]).distinct()
            .groupBy("e", "stem", "a", "b").agg(F.collect_set("doc_id").alias("docs")).collect())
    left = {(r.e, r.stem): (set(r.docs), r.a / sizes[1], r.b / sizes[0]) for r in held}
    covered: dict[int, int] = {}
    out: list[tuple[str, bool, float]] = []
    while left and len(out) < rule.entries:
        # documents marked fewer than three times so far still count, less each time
        def worth(item) -> tuple:
            (e, stem), (docs, a, b) = item
            fresh = sum((1.0, 0.4, 0.15)[covered.get(d, 0)] for d in docs if covered.get(d, 0) < 3)
            return (fresh / sizes[1] - 3 * b, not stem, -len(e), e)

        best = max(left.items(), key=worth)
        (e, stem), (docs, a, b) = best
        if worth(best)[0] < max(0.002, 2 / sizes[1] if sizes[1] > 20 else 0):
            break
        out.append((e, stem, float(np.log((a + 0.002) / (b + 0.002)))))
        for d in docs:
            covered[d] = covered.get(d, 0) + 1
        del left[(e, stem)]
        # what a stem already matches adds nothing
        if stem:
            left = {k: v for k, v in left.items() if not k[0].startswith(e)}
    return sorted(out)


def fit(docs: DataFrame, labels: DataFrame, label: str, fold: Column, rule: Fitting = Fitting()) -> Model:
    """Lexicon and weights from a bounded sample of the labelled documents that `fold` admits."""
    chosen = labelled.sample(docs, labels, label, rule.per_class, fold)
    entries = learn_lexicon(chosen, rule)
    scorer = Scorer(entries)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, most=1_000_000):
            f = scorer.features(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(list(f))], ["d", "y", "f"])

    got = sorted((r.d, r.y, *r.f) for r in chosen.select("doc_id", "text", "y")
                 .mapInArrow(rows, "d long, y int, f array<double>").collect())
    prior = labelled.log_odds(labels, label, fold)
    data = np.array(got)
    if not got or data[:, 1].min() == data[:, 1].max():
        return Model(scorer, np.zeros(FEATURES), prior, entries)
    weights, centre = _logistic(data[:, 2:], data[:, 1])
    return Model(scorer, weights, centre + prior, entries)


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """One row per row of `docs`: doc_id and the probability of label 1, from the whole text.

    Null and empty texts have no match and get the score of such.  Repeated rows are scored as often
    as they stand there, other columns are not looked at, an empty table gives no rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, most=1_000_000):
            s = model.scores(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s)], ["doc_id", name])

    return documents_only(docs).mapInArrow(run, f"doc_id long, {name} double")

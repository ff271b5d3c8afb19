import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kithlink.llm import labelled, quality, toxicity
from kithlink.llm.automaton import STEM, STEM_NEAR, WORD, WORD_NEAR, LexiconAutomaton
from tests.llm.helpers import none, odd, prose


def test_answers_do_not_depend_on_the_batch():
    network = quality.Network(1)
    texts = [b"", b"x", b"The words of a text. " * 30, b"&&& " * 1000, bytes(range(256)) * 9]
    together = network.scores(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
    alone = [network.scores(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in texts]
    assert np.allclose(together, alone)
    # the last bytes of a long text count
    long = b"a" * 5000
    ends = [network.block_answers(*quality.blocks(np.frombuffer(t, np.uint8), np.array([0, len(t)]))).max(0) for t in (long, long + b"!Z?!")]
    assert not np.allclose(*ends)


def test_gradients_are_those_of_differences():
    rng = np.random.default_rng(0)
    network = quality.Network(2)
    network.w = {k: v.astype(np.float64) for k, v in network.w.items()}
    wide = 2 * quality.BLOCK + quality.WIDTH - quality.STRIDE
    chunks, first, y = rng.integers(0, 256, (5, wide)), np.array([0, 2]), np.array([1, 0])

    def loss():
        w = network.w
        win = network.windows(w["embed"][chunks].reshape(5, -1), 5)
        m = np.maximum((win @ w["filter"]).max(1) + w["filter0"], 0)
        top = np.maximum.reduceat(np.maximum(m @ w["hidden"] + w["hidden0"], 0), first)
        p = 1 / (1 + np.exp(-(top @ w["out"] + w["out0"])))
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    got = network.gradients(chunks, first, y)
    for name in ("filter", "hidden", "out", "embed"):
        at = np.unravel_index(np.abs(got[name]).argmax(), got[name].shape)
        kept = network.w[name][at]
        step = 1e-5
        network.w[name][at] = kept + step
        high = loss()
        network.w[name][at] = kept - step
        low = loss()
        network.w[name][at] = kept
        assert got[name][at] == pytest.approx((high - low) / (2 * step), rel=0.02)


def tables(spark, good, bad, label):
    rng = random.Random(6)
    rows = [(i, (good if i % 3 else bad)(rng), int(i % 3 > 0) if label == "quality" else int(i % 3 == 0)) for i in range(330)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    return docs, spark.createDataFrame([(i, y) for i, _, y in rows], f"doc_id long, {label} int"), {i: y for i, _, y in rows}


def accuracy(scores, truth, fold, spark):
    held = {r.doc_id for r in spark.createDataFrame([(i,) for i in truth], "doc_id long").where(fold).collect()}
    return np.mean([(r.score >= 0.3) == truth[r.doc_id] for r in scores.collect() if r.doc_id in held])


def test_quality_of_held_out_documents(spark):
    docs, labels, truth = tables(
        spark, lambda r: " ".join(prose(r, r.randrange(20, 200))).capitalize() + ".",
        lambda r: r.choice([lambda: " ".join(w + r.choice(["***", "$$$"]) for w in prose(r, 60)), lambda: " ".join(prose(r, 50)).upper() + "!!"])(),
        "quality")
    held = labelled.remainder("doc_id", 5) == 0
    network = quality.fit(docs, labels, "quality", ~held, quality.Fitting(steps=80))
    assert accuracy(quality.score(docs, network), truth, held, spark) > 0.95
    got = quality.score_rows(odd(spark), network)
    assert got.columns == [c for c in odd(spark).columns if c != "score"] + ["score"]
    rows = got.collect()
    assert len(rows) == 9 and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (1, 2)}) == 1
    assert quality.score(none(spark), network).collect() == []
    # without labels the score is one for all
    blank = quality.fit(docs, labels.where("false"), "quality", F.lit(True))
    assert len({r.score for r in quality.score(docs, blank).collect()}) == 1


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("seed", range(6))
def test_automaton_finds_what_edit_distances_say(seed):
    rng = random.Random(seed)
    word = lambda lo, hi: "".join(rng.choice("abc") for _ in range(rng.randrange(lo, hi)))
    entries = [(word(2, 8), rng.random() < 0.4, 1.0) for _ in range(8)]
    automaton = LexiconAutomaton(entries, near_from=4)
    words = [word(1, 10) for _ in range(300)] + [e for e, _, _ in entries]
    symbols = np.array([automaton.alphabet.get(c, 0) for w in words for c in w])
    size = np.array([len(w) for w in words])
    state = automaton.run(symbols, np.cumsum(size) - size, size)
    for w, kind in zip(words, automaton.kind[state]):
        stems, whole = [e for e, s, _ in entries if s], [e for e, s, _ in entries if not s]
        near_stem = any(edits(w[:k], e) <= 1 for e in stems if len(e) >= 4 for k in range(len(w) + 1))
        want = (WORD if w in whole else 0, STEM if any(w.startswith(e) for e in stems) else 0,
                WORD_NEAR if any(edits(w, e) <= 1 for e in whole if len(e) >= 4) else 0, STEM_NEAR if near_stem else 0)
        # an exact stem settles a word at once
        assert kind == (STEM if want[1] else max(want)) or (want[0] and kind == WORD)


def test_quoted_and_reported_words_count_apart():
    scorer = toxicity.Scorer([("idiot", False, 5.0)])
    plain, quoted, told, misspelt, clean = scorer.features(
        ["You idiot of a man", 'They read "you idiot" there', "the word idiot", "You idoit, idi0t", "You nice man"])
    assert plain[0] > 0 and plain[4] == 0
    assert quoted[0] == told[0] == 0 and quoted[4] > 0 and told[4] > 0
    assert misspelt[2] > 0 and not clean.any()


def test_toxicity_of_held_out_documents(spark):
    bad = ["idiot", "moron", "scumbag"]
    docs, labels, truth = tables(
        spark, lambda r: " ".join(prose(r, r.randrange(5, 100))),
        lambda r: " ".join([*prose(r, r.randrange(5, 100)), r.choice(bad), r.choice(["vequ", "lostra"]) + r.choice("abcdefgh"), *prose(r, 5)]),
        "toxic")
    held = labelled.remainder("doc_id", 4) == 2
    model = toxicity.fit(docs, labels, "toxic", ~held)
    assert accuracy(toxicity.score(docs, model), truth, held, spark) > 0.95
    rows = toxicity.score(odd(spark), model).collect()
    assert len(rows) == 9 and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(none(spark), model).collect() == []
    assert len({r.score for r in toxicity.score(docs, toxicity.fit(docs, labels.where("false"), "toxic", F.lit(True))).collect()}) == 1

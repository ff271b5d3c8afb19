import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from kithlink.llm.bwt import repeats
from kithlink.llm.substring_dedup import dedup_substrings
from tests.llm.helpers import none, odd


@pytest.mark.parametrize("seed", range(20))
def test_intervals_are_the_classes_of_equal_substrings(seed):
    rng = random.Random(seed)
    letters, least = rng.choice([2, 3, 26]), rng.choice([1, 2, 5, 9])
    strings = [bytes(rng.randrange(97, 97 + letters) for _ in range(rng.randrange(0, 40))) for _ in range(rng.randrange(1, 30))]
    strings += [strings[0]] * (seed % 3) + [b"a" * 20]
    places = defaultdict(set)
    for i, s in enumerate(strings):
        for j in range(len(s) - least + 1):
            places[s[j:j + least]].add((i, j))
    got = defaultdict(set)
    for g, i, j in zip(*repeats(np.frombuffer(b"".join(strings), np.uint8), np.array([len(s) for s in strings]), least)):
        got[g].add((i, j))
    assert {frozenset(v) for v in got.values()} == {frozenset(v) for v in places.values() if len(v) > 1}


def brute(rows, least):
    seen, out = set(), {}
    for i, text in sorted(rows):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - least + 1):
            if raw[p:p + least] in seen:
                gone[p:p + least] = b"\1" * least
            seen.add(raw[p:p + least])
        kept = bytes(x for x, g in zip(raw, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out[i] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def documents(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéñ") for _ in range(rng.randrange(2, 7))) for _ in range(150)]
    passages = [" ".join(rng.choices(words, k=rng.randrange(5, 60))) for _ in range(30)]
    rows = []
    for i in range(200):
        text = " ".join(rng.choice(passages) if rng.random() < 0.5 else " ".join(rng.choices(words, k=rng.randrange(5, 80)))
                        for _ in range(rng.randrange(0, 6)))
        if text and rng.random() < 0.3:
            k = rng.randrange(len(text))
            text = text[:k] + rng.choice(["X", "", "yy"]) + text[k + 1:]
        if rng.random() < 0.1:
            text = rng.choice(["ab ", "x", "Orre "]) * rng.randrange(1, 200) + text
        if rows and rng.random() < 0.1:
            text = rng.choice(rows)[1]
        rows.append((i, text if i % 50 else [None, ""][i // 50 % 2]))
    return rows


@pytest.mark.parametrize("settings", [{}, {"most": 2, "bucket": 20}])
def test_removes_what_starts_earlier(spark, settings):
    rows = documents(3)
    got = dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"), **settings).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == brute(rows, 100)


@pytest.mark.parametrize("most", [3000, 2])
def test_a_kgram_settled_in_parts_meets_all_its_contexts(spark, most):
    """One passage in three surroundings, each in many copies, so that a part of its k-gram can be one context alone."""
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    middle = word(150)
    kinds = [word(90) + middle + word(90) for _ in range(3)]
    rows = [(i, kinds[i * 3 // 90]) for i in range(90)] + [(i, word(200)) for i in range(90, 120)]
    # every row its own batch of texts, so that copies are not settled before the shuffle
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(40, "doc_id")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        got = dedup_substrings(docs, most=most, split=4).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert {r[0]: tuple(r[1:]) for r in got} == brute(rows, 100)


def test_odd_rows(spark):
    rows = dedup_substrings(odd(spark), keep_text=True).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert len(rows) == 9 and by[None][0].n_removed == 0 and by[1][0].n_bytes == by[2][0].n_bytes == 0
    # of "word word .." the first period and its 99 bytes more stay
    assert bytes(by[6][0].kept) == (b"word " * 60_000)[:5] and by[6][0].n_spans == 1
    assert len(by[5]) == 2 and by[5][0] == by[5][1]
    assert dedup_substrings(none(spark)).collect() == []

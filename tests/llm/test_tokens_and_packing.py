import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from kithlink.llm import packing
from kithlink.llm.queries import RANKS, VOCABULARY
from kithlink.llm.tokens import Tokens
from tests.llm.helpers import none, odd


def test_words_give_the_tokenizers_ids():
    texts = ["a  b", "  x", " ", "", "\n\nA b\n c\n", "don't 'small", "x　y", "<|endoftext|> a", "1 2x33 !!a!! \t\t b   c",
             "é à ñ\r\n\r\n x", "中文 字 \U0001F600 ok", "a\x1cb \x85c", "ABC def." * 50]
    whole = Tokenizer.from_file(VOCABULARY)
    want = [whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in Tokens.of(VOCABULARY, RANKS).encode(texts)] == want


def test_parts_of_a_long_text_give_the_same_ids():
    text = "Some words of a line.\nAnother line, 12 of them \n\n" * 60_000
    whole = Tokenizer.from_file(VOCABULARY).encode(text, add_special_tokens=False).ids
    parts = packing._parts(text)
    assert len(parts) > 1 and "".join(parts) == text
    assert [i for p in parts for i in Tokens.of(VOCABULARY, RANKS).encode([p])[0].tolist()] == whole


@pytest.mark.parametrize("seed", range(5))
def test_first_fit_is_that_of_a_plain_scan(seed):
    rng = random.Random(seed)
    lengths = [rng.randrange(1, 101) for _ in range(rng.randrange(1, 300))]
    bins, want = [], [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        for b, free in enumerate(bins):
            if free >= lengths[i]:
                break
        else:
            b = len(bins)
            bins.append(100)
        bins[b] -= lengths[i]
        want[i] = b
    assert packing.first_fit_decreasing(lengths, 100) == want


def check(rows, texts, sequence):
    whole = Tokenizer.from_file(VOCABULARY)
    pieces, room = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
        room[r.sequence_id].append((r.offset, r.length))
    for doc, text in texts.items():
        ids = np.array([*whole.encode(text, add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for start, length, crc, total in sorted(pieces[doc]):
            assert start == at and total == len(ids) and crc == zlib.crc32(ids[at:at + length].tobytes())
            at += length
        assert at == len(ids)
    for places in room.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= sequence


def test_packing_is_an_exact_round_trip(spark):
    rng = random.Random(4)
    texts = {i: " ".join(f"word{rng.randrange(900)}" for _ in range(rng.randrange(0, 700))) for i in range(120)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for groups in (4096, 10):
        rows = packing.pack(docs, VOCABULARY, RANKS, sequence=512, group_documents=groups).collect()
        check(rows, texts, 512)
    # the hash of a group's documents does not follow their order
    assert len({r.sequence_id >> 32 for r in rows}) == 12


def test_odd_rows(spark):
    rows = packing.pack(odd(spark), VOCABULARY, RANKS, keep_ids=True).collect()
    assert sum(r.doc_id == 5 for r in rows) == 2 and {r.doc_tokens for r in rows if r.doc_id in (1, 2)} == {1}
    assert any(r.doc_id is None for r in rows)
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in rows)
    assert packing.pack(none(spark), VOCABULARY, RANKS).collect() == []

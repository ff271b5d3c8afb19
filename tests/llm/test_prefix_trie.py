import random
from hashlib import sha256
from zlib import crc32

import duckdb
import pytest

from kithlink.llm import prefix_trie, queries

SCHEMA = "conv_id long, turn long, role string, text string, depth long, name string"


def plain(turns):
    """The nodes of the trie by walking every rebuilt conversation."""
    own = {}
    for c, t, r, x in turns:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(rows)] for c, rows in own.items()}
    full = {}
    for c in own:
        h = crc32(str(c).encode()) % 9
        source = c - (c % 5 if c >= 0 else -(-c % 5))
        full[c] = own.get(source, [])[:h] + own[c][h:]
    nodes = {}
    for c, rows in full.items():
        for d in range(len(rows) + 1):
            nodes.setdefault(tuple(rows[:d]), []).append(c)
    out = []
    for p, members in nodes.items():
        below = [q for q in nodes if q[:len(p)] == p]
        saved = sum((len(nodes[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members),
                    sum(len(q) == len(p) + 1 for q in below), sum(all(len(z) <= len(q) or z[:len(q)] != q for z in nodes) for q in below), saved,
                    sha256(",".join(str(c) for c in sorted(members) if full[c] == list(p)).encode()).hexdigest()))
    return sorted(out, key=str)


def made(spark, turns):
    got = prefix_trie.prefix_trie(spark.createDataFrame([(*t, 5, "n") for t in turns], SCHEMA))
    return sorted((tuple(r) for r in got.collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_is_what_walking_gives(spark, seed):
    rng = random.Random(seed)
    turns = []
    for c in rng.sample(range(-30, 60), 60):
        n = rng.choice([1, 2, 3, 7, 8, 9, 20, 40])
        turns += [(c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "é b", ""])) for t in range(n)]
    assert made(spark, turns) == plain(turns)


def test_nulls_ties_repeated_rows_and_long_turns(spark):
    turns = [(None, 1, "user", "lost"), (0, None, None, None), (0, 1, "user", "x"), (0, 1, "user", "x"), (0, 1, "assistant", "y"),
             (1, 1, "user", "word " * 50_000), (1, None, "user", ""), (5, 3, "u", "1:a"), (5, 4, "u1", ":a"), (6, 9, "user", "z")]
    turns += [(11, t, "user", "same") for t in range(300)] + [(16, t, "user", "same") for t in range(299)]
    assert made(spark, turns) == plain(turns)


def test_no_conversations(spark):
    assert made(spark, []) == []
    assert made(spark, [(None, 1, "user", "a")]) == []


def test_trie_is_what_sql_says(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet'")
    want = con.sql(queries.ORACLE_SQL["op12_prefix_trie"]).fetchall()
    got = queries.op12_prefix_trie(spark, folder).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)

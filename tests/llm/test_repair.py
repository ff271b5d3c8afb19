import random
import re
from hashlib import sha256
from zlib import crc32

import duckdb
import numpy as np
import pytest

from kithlink.llm import block_tables, queries, repair

SCHEMA = "conv_id long, turn long, role string, text string, pos long, cost string"
LEADS = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
ROLES = {"u": "user", "a": "assistant"}


def cheapest(rows):
    """(cost, audit, lines) by trying every edit of every row, least first; rows are (role, text, fault)."""
    ways = {"": (0, "", ())}

    def inserted(ways):
        for _ in range(4):
            for state, (cost, audit, lines) in list(ways.items()):
                for role in "ua":
                    if (to := LEADS.get((state, role))) and (cost + 5, audit + "I") < ways.get(to, (1 << 30, ""))[:2]:
                        ways[to] = (cost + 5, audit + "I", lines + (ROLES[role] + ":",))
        return ways
    for role, text, fault in rows:
        now = {}
        for state, (cost, audit, lines) in inserted(ways).items():
            more = 5 if fault == "truncated" else 0
            tries = [(state, cost + 2, audit + "D", lines)]
            if fault not in ("blank", "duplicate"):
                if (state, role[:1]) in LEADS:
                    tries.append((LEADS[state, role[:1]], cost + more, audit + "K", lines + (f"{role}:{text}",)))
                tries += [(LEADS[state, r], cost + 1 + more, audit + "R", lines + (f"{ROLES[r]}:{text}",)) for r in "ua" if (state, r) in LEADS]
            for to, *way in tries:
                if tuple(way[:2]) < now.get(to, (1 << 30, ""))[:2]:
                    now[to] = tuple(way)
        ways = now
    return min(way for state, way in inserted(ways).items() if state in ("", "a"))


def plain(turns):
    convs = {}
    for c, t, r, x in turns:
        rows = convs.setdefault(c, [])
        r, x = " " if r is None else r, " " if x is None else x
        kind = crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if kind == 0:
            continue
        x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
        rows += [(t is not None, t or 0, "user" if kind == 4 else r, x)] * (2 if kind == 3 else 1)
    out = []
    for c, rows in convs.items():
        rows.sort()
        seen, graded, numbers = set(), [], {t for known, t, _, _ in rows if known}
        for _, _, r, x in rows:
            ends = re.findall(r"[^\x20\x09-\x0D]", x)
            fault = "blank" if not ends else "duplicate" if (r, x) in seen else "truncated" if ends[-1] not in ".!?" else ""
            seen.add((r, x))
            graded.append((r, x, fault))
        cost, audit, lines = cheapest(graded)
        faults = [f for _, _, f in graded]
        out.append((c, max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
                    sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(graded, graded[1:])), cost, audit,
                    sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def made(spark, turns, segment=repair.SEGMENT):
    got = repair.repair_damaged(spark.createDataFrame([(*t, 3, "c") for t in turns], SCHEMA), segment)
    return sorted((tuple(r) for r in got.collect()), key=str)


def drawn(rng, conversations, longest):
    for c in range(conversations):
        for t in range(rng.randrange(1, longest)):
            yield (c, rng.choice([None, t, t, t, t + 1]), rng.choice(["user", "assistant", "assistant", "system", "User", "tool", "", "ant", None]),
                   rng.choice(["a.", "b", "c?", "d! ", " \t", "é.\n", f"{t}.", f"{t}.", f"{t}", None]))


@pytest.mark.parametrize("seed", [1, 2])
def test_reports_are_those_of_trying_every_edit(spark, seed):
    turns = list(drawn(random.Random(seed), 120, 14))
    assert made(spark, turns) == plain(turns)


def test_long_conversations_over_segments_of_segments(spark, monkeypatch):
    monkeypatch.setattr(repair, "GROUP", 3)
    turns = list(drawn(random.Random(3), 6, 90)) + [(99, t, "user" if t % 2 else "assistant", f"{t}.") for t in range(200)]
    assert made(spark, turns, segment=5) == plain(turns) == made(spark, turns)


def test_nulls_ties_repeated_rows_and_long_texts(spark):
    turns = [(None, None, None, None), (None, 1, "user", "q."), (1, 1, "user", "word " * 50_000 + "."), (1, 1, "user", "word " * 50_000 + "."),
             (2, 5, "assistant", "x."), (2, 5, "assistant", "x."), (2, None, "user", "y"), (3, 1, "", ""), (4, 900, "user", "a."), (4, 3, "assistant", "b.")]
    assert made(spark, turns) == plain(turns)
    assert made(spark, []) == []


def test_edits_rebuild_the_repaired_text(spark):
    turns = spark.createDataFrame([(*t, 3, "c") for t in drawn(random.Random(5), 30, 10)], SCHEMA)
    reports, edits = repair.repair(turns)
    lines = {}
    for r in sorted(edits.collect(), key=lambda r: r["at"]):
        lines.setdefault(r.conv_id, []).extend([r.lines] if r.lines is not None else [])
    for r in reports.collect():
        assert r.repaired_sha256 == sha256("\n".join(lines[r.conv_id]).encode()).hexdigest()


def test_tables_agree_with_single_steps():
    rng, t = random.Random(7), block_tables.tables()
    assert len(t.vectors) < 100 and t.jump.shape == (len(t.vectors), block_tables.SYMBOLS ** block_tables.BLOCK)
    for _ in range(500):
        symbols = np.array([rng.randrange(block_tables.SYMBOLS) for _ in range(rng.randrange(12))], np.int64)
        vector = block_tables.END
        for s in symbols[::-1].tolist():
            vector = block_tables.before(vector, s)
        at, less = t.borders(symbols, t.end)
        assert tuple(c + less for c in t.vectors[at[0]]) == vector
        cut = rng.randrange(len(symbols) + 1)
        behind, more = t.borders(symbols[cut:], t.end)
        rest = [c + more for c in t.vectors[behind[0]]]
        assert min(c + r for c, r in zip(t.costs(symbols[:cut])[0], rest)) == vector[0]


def test_repair_is_what_sql_says(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet'")
    want = con.sql(queries.ORACLE_SQL["op13_repair"]).fetchall()
    assert sorted(map(tuple, queries.op13_repair(spark, folder).collect()), key=str) == sorted(want, key=str)

import random

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from kithlink.llm import line_dedup, mixing, queries
from tests.llm.helpers import none, odd, prose


def test_patience_aligns_a_common_subsequence():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.choice([None, *range(rng.choice([3, 12]))]) for _ in range(rng.randrange(0, 15))] for _ in range(2))
        pairs = line_dedup.patience(a, b)
        assert all(a[i] == b[j] and a[i] is not None for i, j in pairs)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
    assert line_dedup.patience([1, 2, 3, 4], [1, 9, 3, 4]) == [(0, 0), (2, 2), (3, 3)]
    assert line_dedup.patience([7, 1, 2, 8], [1, 2]) == [(1, 0), (2, 1)]


def brute(docs, rare, least):
    """The removed lines of each document, by the definition."""
    lines = {i: [x.strip() for x in t.split("\n")] for i, t in docs}
    holders = {}
    for i, ls in sorted(lines.items()):
        for x in set(ls) - {""}:
            holders.setdefault(x, []).append(i)
    out = {}
    for i, ls in lines.items():
        shared = [x for x in set(ls) - {""} if len(holders[x]) > 1 and holders[x][0] != i]
        partners = {holders[x][0] for x in shared if len(holders[x]) <= rare}
        if shared and not partners:
            few = min(len(holders[x]) for x in shared)
            partners = {holders[x][0] for x in shared if len(holders[x]) == few}
        gone = set()
        for j in partners:
            gone |= set(line_dedup.repeated_lines([x or None for x in ls], [x or None for x in lines[j]], [len(x) for x in ls], least))
        out[i] = (sorted(gone), len(partners))
    return out


def test_removes_aligned_blocks_from_the_later_document(spark):
    rng = random.Random(8)
    pool = [" ".join(prose(rng, rng.randrange(2, 12))) for _ in range(60)]
    docs = []
    for i in range(80):
        ls = [rng.choice(pool) if rng.random() < 0.4 else " ".join(prose(rng, 9, 10 ** 6)) for _ in range(rng.randrange(1, 9))]
        k = rng.randrange(0, 50)
        docs.append((i, "\n".join(ls[:2] + pool[k:k + 3] + [""] + ls[2:])))
    want = brute(docs, 100, 40)
    got = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_removed, r.n_partners) for r in got} == {i: (len(g), n) for i, (g, n) in want.items()}
    for r in got:
        whole = dict(docs)[r.doc_id].split("\n")
        assert r.text == "\n".join(x for k, x in enumerate(whole) if k not in want[r.doc_id][0])
    assert sum(len(g) for g, _ in want.values()) > 50


def test_copies_of_common_lines_are_found_too(spark):
    text = "\n".join(f"line {k} of a passage that a good many documents hold" for k in range(4))
    got = line_dedup.dedup_lines(spark.createDataFrame([(i, text) for i in range(30)], "doc_id long, text string"), rare=5).collect()
    assert {r.doc_id: r.n_removed for r in got} == {i: 4 if i else 0 for i in range(30)}


def all_earlier(docs, least):
    """The lines that aligning with each earlier document would delete, and those of runs that one of them has."""
    lines = {i: [x.strip() or None for x in t.split("\n")] for i, t in docs}
    runs = {}
    for i, ls in lines.items():
        at = [k for k, x in enumerate(ls) if x]
        runs[i] = {tuple(ls[k] for k in at[a:b]): [] for a in range(len(at)) for b in range(a + 1, len(at) + 1)
                   if sum(len(ls[k]) for k in at[a:b]) >= least}
        for a in range(len(at)):
            for b in range(a + 1, len(at) + 1):
                if (key := tuple(ls[k] for k in at[a:b])) in runs[i]:
                    runs[i][key] += at[a:b]
    aligned, held = {}, {}
    for i, ls in lines.items():
        before = [j for j in lines if j < i]
        aligned[i] = {k for j in before for k in line_dedup.repeated_lines(ls, lines[j], [len(x or "") for x in ls], least)}
        held[i] = {k for key, places in runs[i].items() if any(key in runs[j] for j in before) for k in places}
    return aligned, held


def test_passages_are_held_against_all_earlier_documents(spark):
    rng = random.Random(8)
    pool = [" ".join(prose(rng, rng.randrange(1, 10))) for _ in range(60)]
    docs = []
    for i in range(80):
        ls = [rng.choice(pool) if rng.random() < 0.4 else " ".join(prose(rng, 9, 10 ** 6)) for _ in range(rng.randrange(1, 9))]
        k = rng.randrange(0, 50)
        docs.append((i, "\n".join(ls[:2] + pool[k:k + 3] + [" "] + ls[2:])))
    aligned, held = all_earlier(docs, 40)
    got = line_dedup.dedup_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    for r in got:
        assert aligned[r.doc_id] <= held[r.doc_id] and r.n_removed == len(held[r.doc_id])
        whole = dict(docs)[r.doc_id].split("\n")
        assert r.text == "\n".join(x for k, x in enumerate(whole) if k not in held[r.doc_id])
    assert sum(len(g) for g in held.values()) > 50


def test_hot_and_scattered_passages_go_from_all_later_documents(spark, tmp_path):
    one, two = ("\n".join(f"{name} line {k} of a passage that a great many documents hold" for k in range(2)) for name in ("first", "second"))
    docs = [(0, one), (1, two)] + [(i, f"{one}\nown words of {i}\n{two}\nshared by {i // 2} and one more document only") for i in range(2, 152)]
    # of a block whose lines stand alone in two earlier documents the first to hold it whole counts
    docs += [(200, "a short line, alone here"), (201, "another short line, alone"),
             (202, "a short line, alone here\nanother short line, alone"), (203, "x\na short line, alone here\nanother short line, alone")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    removed = {r.doc_id: r.n_removed for r in queries.op10_line_dedup(spark, str(tmp_path)).collect()}
    assert removed == {i: 0 if i < 2 or 200 <= i < 203 else 2 if i == 203 else 4 + i % 2 for i, _ in docs}


def test_odd_rows_of_passages(spark):
    got = line_dedup.dedup_passages(odd(spark), block_chars=10)
    assert {"score", "tokens", "cut_lines"} <= set(got.columns)
    rows = [(r.doc_id, r.text, r.n_lines, r.n_removed) for r in got.collect()]
    assert rows.count((5, "", 2, 2)) == 2 and (1, None, 0, 0) in rows and (2, "", 1, 0) in rows and (None, "no id", 1, 0) in rows
    assert len(rows) == 9 and line_dedup.dedup_passages(none(spark)).collect() == []


def test_odd_rows_of_lines(spark):
    got = line_dedup.dedup_lines(odd(spark), block_chars=10)
    assert {"score", "tokens", "cut_lines"} <= set(got.columns)
    rows = [(r.doc_id, r.text, r.n_lines, r.n_removed) for r in got.collect()]
    assert rows.count((5, "", 2, 2)) == 2 and (1, None, 0, 0) in rows and (2, "", 1, 0) in rows and (None, "no id", 1, 0) in rows
    assert len(rows) == 9 and line_dedup.dedup_lines(none(spark)).collect() == []


@pytest.fixture(scope="module")
def mixed(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(f"{d}{rng.randrange(40)}" for _ in range(rng.randrange(20, 60))), d)
            for i, d in enumerate(["en"] * 300 + ["fr"] * 100 + ["es"] * 50)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_rates_meet_the_targets(spark, mixed):
    got = mixing.mix_to_targets(mixed, "lang", weights={"en": 0.5, "fr": 0.25, "es": 0.25}).collect()
    expected = {d: sum(r.rate * r.tokens * r.shares[k] for r in got) for k, d in enumerate(["en", "es", "fr"])}
    total = sum(expected.values())
    assert all(r.rate >= 0 for r in got)
    assert np.allclose([expected[d] / total for d in ("en", "es", "fr")], [0.5, 0.25, 0.25], atol=1e-4)
    assert all(max(range(3), key=lambda k: r.shares[k]) == ["en", "es", "fr"].index(r.lang) for r in got)
    assert abs(sum(r.copies * r.tokens for r in got) / total - 1) < 0.15


def test_a_tiny_domain_does_not_shrink_the_others(spark, mixed):
    tiny = spark.createDataFrame([(9000, "xx0 xx1 xx2", "xx"), (9001, "", "empty")], mixed.schema)
    docs = mixed.unionByName(tiny)
    got = mixing.mix_to_targets(docs, "lang").collect()
    total = sum(r.tokens for r in got)
    assert abs(sum(r.rate * r.tokens for r in got) / total - 1) < 0.01
    told = {r.domain: r for r in mixing.report(spark.createDataFrame(got, "doc_id long, text string, lang string, tokens long, shares array<double>, "
                                                                     "rate double, copies long"), "lang").collect()}
    assert all(abs(told[d].drawn / told[d].target - 1) < 0.15 for d in ("en", "fr", "es"))
    # drawn at most once: the small ones whole, the large one at its target
    once = corpus_pipeline.mixed(spark, docs.withColumn("source", F.col("lang")).withColumn("n_chars", F.length("text")), "").collect()
    assert len(once) == len({r.doc_id for r in once}) and sum(len(r.text.split()) for r in once) > 0.8 * total
    kept = {d: sum(len(r.text.split()) for r in once if r.lang == d) for d in ("en", "fr", "es", "xx")}
    assert all(kept[d] == told[d].tokens for d in ("fr", "es", "xx")) and abs(kept["en"] / told["en"].target - 1) < 0.15


def test_sources_meet_their_targets_in_the_query(spark, tmp_path):
    """Texts that say nothing of their source, one that holds most of them, and more sources than domains."""
    rng = random.Random(5)
    rows = [(i, " ".join(prose(rng, 30)), "en", s) for i, s in enumerate(["hot"] * 1200 + ["a"] * 200 + ["b"] * 200 + [f"s{k}" for k in range(40)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    of = {i: s for i, _, _, s in rows}
    got = queries.op2_mixing(spark, str(tmp_path)).collect()
    part = {s: (30 * n) ** 0.7 for s, n in [("hot", 1200), ("a", 200), ("b", 200), *((f"s{k}", 1) for k in range(40))]}
    for s in ("hot", "a", "b"):
        drawn = sum(r.rate * r.tokens for r in got if of[r.doc_id] == s)
        assert abs(drawn / (30 * 1640 * part[s] / sum(part.values())) - 1) < 0.1
    few = mixing.mix_to_targets(docs, "source", weights={"hot": 0.25, "a": 0.25, "b": 0.25, mixing.REST: 0.25}, rule=mixing.Fitting(domains=4)).collect()
    rest = sum(r.rate * r.tokens for r in few if r.source[0] == "s")
    assert abs(rest / (30 * 1640) - 0.25) < 0.03


def test_projected_steps_solve_the_least_squares_problem(spark):
    """A target below what a mixed document must bring is missed as little as rates at zero allow."""
    rows = [(10, [1.0, 0.0])] * 5 + [(10, [0.0, 1.0])] * 5
    members = spark.createDataFrame(rows, "tokens long, shares array<double>")
    steps = mixing.fit_rates(members, np.array([0.0, 75.0]))
    got = members.select("shares", mixing.rate(steps).alias("r")).collect()
    assert {round(r.r, 6) for r in got if r.shares[0] == 1} == {0.0} and {round(r.r, 6) for r in got if r.shares[1] == 1} == {1.5}


def test_odd_rows_of_mixing(spark):
    got = mixing.mix_to_targets(odd(spark), "source").collect()
    assert len(got) == 9 and all(r.rate >= 0 and r.copies >= 0 for r in got)
    assert {r.tokens for r in got if r.doc_id in (1, 2, 3)} == {0}
    assert mixing.mix_to_targets(none(spark), "source").collect() == []
    unlabelled = mixing.mix_to_targets(odd(spark), "source",
                                       labelled=none(spark)).collect()
    assert {r.rate for r in unlabelled} == {1.0}

"""Unsupervised linkage inside one table against listed pairs of records."""

import datetime
import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kithlink.operators import blocking, em, em_within
from kithlink.operators.compare import AGREEMENTS

SCHEMA = ("rowid long, first_name string, last_name string, date_of_birth date, age_in_2020 int, middle_initial string, "
          "race string, sex string, sid string, dataset string")
LIMIT = 8


def people() -> list[tuple]:
    draw = random.Random(5)
    rows, rowid = [], 0
    # large years side by side, small ones next to a large one, far away and in between; no birth date
    for year, n in ((1950, 14), (1951, 12), (1952, 3), (1953, 11), (1970, 9), (1990, 2), (1991, 8), (None, 4)):
        for _ in range(n):
            rowid += 1
            birth = year and datetime.date(year, draw.choice([1, 12]), draw.choice([1, 2, 31]))
            rows.append((rowid * 7 % 101, draw.choice(["ANN", "ANNE", "BOB", None]), draw.choice(["LEE", "LEA", "KIM"]), birth, 30,
                         draw.choice(["J", None]), "W", draw.choice("MF"), f"s{rowid % 9}", draw.choice(["admin", "experiment"])))
    return rows + [(200 + i, *rows[0][1:]) for i in range(3)]


def blocks(rows: list[tuple]) -> dict[tuple[int, int], str]:
    """The lowest block of each pair of records that meet."""
    years = Counter(r[3].year for r in rows if r[3])
    home = {y: "small" if n <= LIMIT else str(y) for y, n in years.items()}
    near = {y: {home[z] for z in (y - 1, y, y + 1) if z in home} for y in home}
    found = {}
    for a, b in itertools.combinations([r for r in rows if r[3]], 2):
        y, z = a[3].year, b[3].year
        met = ({home[y]} & near[z]) | ({home[z]} & near[y])
        if met:
            found[min(a[0], b[0]), max(a[0], b[0])] = min(met)
    return found


@pytest.fixture(scope="module")
def members(spark):
    return em_within.one_table_members(blocking.profiles(spark.createDataFrame(people(), SCHEMA)), LIMIT)


def test_totals_count_each_pair_of_records_once(members):
    rows = {r[0]: r for r in people()}
    met = blocks(list(rows.values()))
    got = {(r.block, r.field): r for r in em_within.within_totals(members).collect()}
    for field, value in (("all", lambda r: ""), ("g_first", lambda r: r[1]), ("g_last", lambda r: r[2]), ("g_sex", lambda r: r[7]),
                         ("g_mi", lambda r: r[5]), ("g_month", lambda r: r[3].month)):
        known, full = Counter(), Counter()
        for (i, j), block in met.items():
            a, b = value(rows[i]), value(rows[j])
            if a is not None and b is not None:
                known[block] += 1
                full[block] += a == b
        assert {b: r.n_known for (b, f), r in got.items() if f == field} == dict(known)
        assert {b: r.n_full for (b, f), r in got.items() if f == field} == {b: full[b] for b in known}
    births = [r for (_, f), r in got.items() if f == "g_dob"]
    assert sum(r.n_known for r in births) == len(met) and all(r.n_full + r.n_partial <= r.n_known for r in births)


def test_pairs_and_patterns_hold_all_that_share_a_key(members):
    rows = {r[0]: r for r in people()}
    met = blocks(list(rows.values()))
    graded = em_within.within_graded(members)
    pairs = [(r.rowid1, r.rowid2, r.block) for r in graded.collect()]
    assert len(pairs) == len(set(pairs)) and all(i < j and met[i, j] == b for i, j, b in pairs)

    def shares(a, b):
        return a[2] == b[2] or a[3] == b[3] or (a[1] is not None and a[5] is not None and a[1] == b[1] and a[5] == b[5])

    wanted = Counter(b for (i, j), b in met.items() if shares(rows[i], rows[j]))
    patterns = em_within.within_patterns(members, graded, em_within.within_totals(members))
    unshared = (F.col("g_last") == 0) & (F.col("g_dob") == 0) & F.col("g_first").isNull() & F.col("g_sex").isNull()
    sums = {(r.block, r.rest): r.n for r in patterns.groupBy("block", unshared.alias("rest")).agg(F.sum("n_pairs").alias("n")).collect()}
    assert {b: n for (b, rest), n in sums.items() if not rest} == dict(wanted)
    everything = Counter(met.values())
    assert {b: sums.get((b, True), 0) + sums.get((b, False), 0) for b in everything} == dict(everything)


def test_one_table_without_rows(spark):
    none = em_within.one_table_members(blocking.profiles(spark.createDataFrame([], SCHEMA)), LIMIT)
    totals, graded = em_within.within_totals(none), em_within.within_graded(none)
    fitted = em.em_link(em_within.within_patterns(none, graded, totals), totals)
    assert totals.count() == 0 and em_within.within_matches(graded, fitted).count() == 0
    assert set(AGREEMENTS) <= set(fitted.columns)

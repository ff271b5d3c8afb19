"""Patterns of key groups made in tasks against the same pairs listed by a join."""

import datetime
import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kithlink.functions import similarity
from kithlink.operators import tiles
from kithlink.operators.blocking import CANDIDATE_KEYS, candidates_between, candidates_within
from kithlink.operators.compare import AGREEMENTS, AgreementRules, agreement_levels, compare_pairs
from kithlink.operators.em import BLOCK_KEYS

SCHEMA = ("block string, rowid long, copies long, first_name string, last_name string, date_of_birth date, "
          "middle_initial string, race string, sex string")
DAYS = [datetime.date(y, m, d) for y in (1, 1969, 1970, 1972, 9999) for m, d in ((1, 1), (2, 28), (12, 31))] + [datetime.date(1972, 2, 29), None]


def people(seed: int, first_id: int, n: int = 90) -> list[tuple]:
    draw = random.Random(seed)
    pick = draw.choice
    return [(pick(["1.1970", "1.1971", "é", None]), first_id + i, draw.randint(1, 3), pick(["ANN", "ANNE", "", "BOB", "ÄNNE", None]),
             pick(["LEE", "LEA", "KIMBERLEY", "KIMBERLY", None]), pick(DAYS), pick(["J", "", None]), pick(["W", None]), pick("MF"))
            for i in range(n)]


@pytest.fixture(scope="module")
def sides(spark):
    return spark.createDataFrame(people(1, 0), SCHEMA), spark.createDataFrame(people(2, 50), SCHEMA)


@pytest.mark.parametrize("tile_rows, batch, chunk", [(4_000, 10_000, tiles.CHUNK), (2, 16, 5)])
def test_patterns_are_those_of_listed_pairs(spark, sides, tile_rows, batch, chunk):
    listed = agreement_levels(candidates_between(*[s.where("block IS NOT NULL") for s in sides], BLOCK_KEYS, within=["block"]))
    want = listed.groupBy("block", *AGREEMENTS).agg(F.sum(F.col("copies1") * F.col("copies2")).alias("n_pairs")).collect()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = tiles.pattern_sums(*sides, BLOCK_KEYS, tile_rows=tile_rows, chunk=chunk).collect()
        pairs = tiles.graded_pairs(*sides, BLOCK_KEYS, ["rowid", "copies"], tile_rows=tile_rows, chunk=chunk).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    order = lambda rows: sorted(map(tuple, rows), key=repr)
    assert want and order(got) == order(want)
    columns = ["block", "rowid1", "copies1", "rowid2", "copies2", *AGREEMENTS]
    assert order(pairs) == order(listed.select(columns).collect())


def test_texts_are_compared_once_per_pair_of_values(monkeypatch):
    compared = []

    def batch(left, right):
        compared.extend(zip(left, right))
        return similarity.jaro_winkler_batch(left, right)

    monkeypatch.setattr(tiles, "jaro_winkler_batch", batch)
    codes, values = tiles._codes(pa.chunked_array([["ANN", "ANNE", None] * 40]))
    a, b = (np.array(x) for x in zip(*itertools.product(range(120), repeat=2)))
    level = tiles._text_levels(codes, values, a, b, AgreementRules())
    assert sorted(compared) == sorted(itertools.product(["ANN", "ANNE"], repeat=2))
    assert set(level[(a % 3 == 2) | (b % 3 == 2)]) == {tiles.MISSING} and set(level[(a % 3 == 0) & (b % 3 == 0)]) == {2}


def test_udf_compares_distinct_pairs_of_a_batch(monkeypatch):
    import pandas as pd
    seen = []

    def batch(left, right):
        seen.append(len(left))
        return np.arange(len(left), dtype=float)

    monkeypatch.setattr(similarity, "jaro_winkler_batch", batch)
    out = similarity._jaro_winkler.func(pd.Series(["A", "B", None, "A", "A"]), pd.Series(["B", "B", "B", "B", None]))
    assert seen == [2] and out[0] == out[3] != out[1] and pd.isna(out[2]) and pd.isna(out[4])


@pytest.mark.parametrize("tile_rows, batch, chunk", [(4_000, 10_000, tiles.CHUNK), (2, 16, 5)])
@pytest.mark.parametrize("least", [0.0, 0.7])
def test_similar_pairs_are_those_of_listed_pairs(spark, tile_rows, batch, chunk, least):
    rows = spark.createDataFrame(people(3, 0, 120), SCHEMA).withColumn("yob", F.year("date_of_birth"))
    rows = rows.withColumn("age_in_2020", 2020 - F.col("yob"))
    parts = [F.col(c) for c in ("first_name_sim", "last_name_sim", "dob_sim")]
    listed = (compare_pairs(candidates_within(rows, CANDIDATE_KEYS)).withColumn("score", F.round(sum(parts[1:], parts[0]) / 3, 6))
              .where(F.col("score") >= least).select("rowid1", "sex1", "rowid2", "sex2", "score"))
    want = sorted(map(tuple, listed.collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        found = tiles.similar_within(rows, CANDIDATE_KEYS, ["sex"], least, tile_rows, chunk)
        got = sorted(map(tuple, found.select("rowid1", "sex1", "rowid2", "sex2", "score").collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(want) > 100 and got == want


def test_edit_distances_are_those_of_spark(spark):
    texts = ["", "A", "ANNA", "HANNAH", "ÄNNE", "KIMBERLEY", "KIMBERLY", "1970-01-01", "1971-10-01", "\U0001f600A"]
    pairs = list(itertools.product(texts, texts))
    want = [r[0] for r in spark.createDataFrame(pairs, "a string, b string").select(F.levenshtein("a", "b")).collect()]
    left, right = (np.array([p[i] for p in pairs], object) for i in (0, 1))
    assert similarity.edit_distance_batch(left, right).tolist() == want
    assert similarity.edit_distance_batch(left[:0], right[:0]).tolist() == []


def test_only_wanted_patterns_leave_the_tasks(spark, folder):
    from kithlink.operators import em
    from kithlink.plans.workspace import Workspace
    w = Workspace(spark, folder)
    codes = em.matching_codes(w.fitted())
    made = em.block_pairs(w.members(), wanted=codes)
    assert made.count() == w.em_matches().count() < em.block_pairs(w.members()).count()
    columns = ["block", "rowid1", "rowid2", "score"]
    whole = em.with_posterior(em.block_pairs(w.members()), w.fitted()).select(*columns)
    assert sorted(map(tuple, w.em_matches().select(*columns).collect())) == sorted(map(tuple, whole.collect()))
    assert em.block_pairs(w.members(), wanted={}).count() == 0

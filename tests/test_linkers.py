import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kithlink.operators import blocking, compare, em, learn
from kithlink.plans.workspace import Workspace


def test_em_recovers_planted_parameters():
    rng = np.random.default_rng(1)
    n, share = 200_000, 0.05
    m, u = [.95, .9, .9, .85, .8], [.02, .05, .01, .3, .2]
    match = rng.random(n) < share
    levels = np.stack([np.where(rng.random(n) < np.where(match, a, b), 2.0, 0.0) for a, b in zip(m, u)], axis=1)
    patterns, counts = np.unique(levels, axis=0, return_counts=True)
    posterior, info = em.fit_mixture(patterns, counts.astype(float), np.zeros((5, 3)), 0.0, em.EmRules())
    assert info["converged"] and info["share"] == pytest.approx(share, abs=.005)
    assert info["m"][:, 2] == pytest.approx(m, abs=.03) and info["u"][:, 2] == pytest.approx(u, abs=.01)
    # more agreement never lowers the posterior
    full = posterior[(patterns == 2).all(axis=1)][0]
    assert full == posterior.max() and posterior[(patterns == 0).all(axis=1)][0] == posterior.min()


def test_a_missing_field_says_nothing():
    patterns = np.array([[2.0, 2.0], [2.0, np.nan], [0.0, np.nan], [0.0, 0.0]])
    posterior, _ = em.fit_mixture(patterns, np.array([30.0, 10, 50, 900]), np.zeros((2, 3)), 0.0, em.EmRules())
    assert posterior[0] > posterior[1] > posterior[2] > posterior[3]


def test_a_block_that_cannot_be_fitted_keeps_its_reason(spark, monkeypatch):
    counts = spark.createDataFrame([("b", 2, 2, 2, 2, 2, 2, 2, 2, -5)], "block string, " + ", ".join(
        f"{g} int" for g in compare.AGREEMENTS) + ", n_pairs long")
    totals = spark.createDataFrame([("b", "g_sex", None, 0, 1)], "block string, field string, n_full long, n_partial long, n_known long")
    row = em.em_link(counts, totals).first()
    assert row.posterior is None or 0 <= row.posterior <= 1


def test_a_block_that_cannot_be_fitted_is_no_block_without_matches(spark):
    fields = ", ".join(f"{g} int" for g in compare.AGREEMENTS)
    level = [2] * len(compare.AGREEMENTS)
    # without counts of one of its fields the fit of block b ends in an error, or in posteriors that are no numbers
    counts = spark.createDataFrame([("a", *level, 5), ("b", *level, None)], f"block string, {fields}, n_pairs long")
    totals = spark.createDataFrame([("a", "g_sex", 5, 0, 5), ("b", "g_sex", 5, 0, 5)],
                                   "block string, field string, n_full long, n_partial long, n_known long")
    fitted = em.em_link(counts, totals)
    assert {r.block: r.error is None for r in fitted.collect()} == {"a": True, "b": False}
    pairs = spark.createDataFrame([("a", 1, "x", "A", 2, "x", "B", 1, 1, *level)], "block string, rowid1 long, sid1 string, "
                                  f"dataset1 string, rowid2 long, sid2 string, dataset2 string, copies1 long, copies2 long, {fields}")
    with pytest.raises(Exception, match="block b was not fitted"):
        em.with_posterior(pairs, fitted).collect()
    assert em.with_posterior(pairs, fitted.where("block = 'a'")).count() <= 1


def test_agreement_of_missing_values_is_missing(spark):
    cols = ["first_name", "last_name", "middle_initial", "race", "sex"]
    schema = ", ".join(f"{c}{n} string" for c in cols for n in (1, 2)) + ", date_of_birth1 date, date_of_birth2 date"
    df = spark.createDataFrame([(None,) * 12], schema)
    assert set(compare.agreement_levels(df).select(*compare.AGREEMENTS).first()) == {None}


def test_copies_are_linked_as_a_star(spark):
    rows = [(i, "A", "B", None, 30, "C", "W", "M", "s", "admin_evaluation") for i in range(1, 6)]
    df = spark.createDataFrame(rows, "rowid long, first_name string, last_name string, date_of_birth date, age_in_2020 int,"
                               "middle_initial string, race string, sex string, sid string, dataset string")
    profile = blocking.profiles(df).first()
    assert (profile.rowid, profile.copies) == (1, 5)
    edges = blocking.copy_edges(df, spark.createDataFrame([(1,)], "rowid long"))
    assert sorted(tuple(r) for r in edges.collect()) == [(1, i) for i in range(2, 6)]
    assert blocking.copy_edges(df, spark.createDataFrame([(7,)], "rowid long")).count() == 0


def test_name_pairs_are_complete(spark):
    names = [("JOHN", "SMITH"), ("JON", "SMITH"), ("JOHN", "SMYTHE"), ("MARIA", "LOPEZ"), ("MARIO", "LOPEZ"), ("X", "Y")]
    df = spark.createDataFrame([(i, *n) for i, n in enumerate(names)], "rowid long, first_name string, last_name string")
    rules = blocking.CosineRules(bar=.3, common_penalty=0.0)
    got = {(r.name1, r.name2): r.cosine for r in blocking.cosine_name_pairs(df, rules).collect()}
    vectors = {r["name"]: {g["gram"]: g["w"] for g in r["grams"]} for r in blocking.name_vectors(df).collect()}
    want = {}
    for a in vectors:
        for b in vectors:
            dot = sum(w * vectors[b].get(g, 0.0) for g, w in vectors[a].items())
            if a < b and dot >= .3:
                want[(a, b)] = dot
    assert got == pytest.approx(want, abs=1e-8) and len(want) >= 3


def test_candidates_equal_the_union_of_the_keys_without_repeats(spark, folder):
    w = Workspace(spark, folder)
    e, a = w.sides()
    pairs = w.candidates().select("rowid1", "rowid2")
    union = None
    for key in blocking.CANDIDATE_KEYS:
        part = e.select(F.col("rowid").alias("rowid1"), *key).join(a.select(F.col("rowid").alias("rowid2"), *key), key)
        union = part.select("rowid1", "rowid2") if union is None else union.union(part.select("rowid1", "rowid2"))
    assert sorted(map(tuple, pairs.collect())) == sorted(map(tuple, union.distinct().collect()))


def test_blocked_share_equals_the_paired_share(spark):
    w = Workspace(spark, "/root/testdata/sf0.01")
    e, a = w.sides()
    matches = w.candidates().where("sid1 = sid2").select("rowid1", "rowid2")
    rules = blocking.learn_blocks(e, a, matches, recall=1.0).toPandas()
    assert rules.covered.iloc[-1] >= .9 * rules.labelled_matches.iloc[0]
    keys = [blocking.predicate_menu()[p] for p in rules.predicate]
    left, right = (d.select("rowid", *[k.alias(f"k{i}") for i, k in enumerate(keys)]).toPandas() for d in (e, a))
    both = left.merge(right, how="cross", suffixes=("1", "2"))
    hit = pd.concat([both[f"k{i}1"] == both[f"k{i}2"] for i in range(len(keys))], axis=1).any(axis=1)
    assert rules.realized_blocked_proportion.iloc[0] == pytest.approx(hit.mean())


def test_labelling_uses_the_whole_budget_once_per_pair(spark):
    pool = Workspace(spark, "/root/testdata/sf0.01").candidates()
    log = learn.active_label(pool, 45, 20).toPandas()
    assert sorted(log.label_ix) == list(range(1, 46))
    assert not log.duplicated(["rowid_1", "rowid_2"]).any() and list(log.columns) == learn.LOG_COLUMNS
    few = learn.active_label(pool.limit(7), 45, 20)
    assert few.count() == 7


def test_threshold_is_the_best_f1(spark):
    scored = spark.createDataFrame([(.9, 1.0), (.8, 1.0), (.7, 0.0), (.6, 1.0), (.1, 0.0)], "confidence_score double, target double")
    best = learn.tune_threshold(scored).where("is_best").first()
    assert best.threshold == .6 and best.f1 == pytest.approx(6 / 7) and best.cut == pytest.approx(.35)


def test_name_ranges_are_means_of_places(spark):
    # places 1..7; the frequent name draws the lower centre up, and DAVIS with it
    names = ["ADAMS", "BAKER", *["CLARK"] * 20, "DAVIS", "EVANS", "FRANK", "GREEN", None]
    df = spark.createDataFrame([(n,) for n in names], "last_name string")
    got = {r.last_name: r.name_cluster for r in blocking.last_name_ranges(df).collect()}
    assert got == {"ADAMS": 0, "BAKER": 0, "CLARK": 0, "DAVIS": 0, "EVANS": 1, "FRANK": 1, "GREEN": 1}
    assert blocking.last_name_ranges(df.limit(0)).count() == 0
    assert [tuple(r) for r in blocking.last_name_ranges(df.limit(1)).collect()] == [("ADAMS", 1)]

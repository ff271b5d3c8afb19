"""Many linkers in one job against plain loops over a small data set, and the two routes of the bootstrap."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from kithlink.operators import cluster, constraints, evaluate, runs
from kithlink.operators.compare import AGREEMENTS
from kithlink.plans import study

RULES = runs.RunRules()


@pytest.fixture(scope="module")
def datasets(spark):
    rng = random.Random(4)
    firsts, lasts = ["ANNA", "BEN", "CARLA", "DAVID", "ELLA"], ["MARTINEZ", "MARTINES", "OBRIEN", "SMITH", "SCHMIDT", "KOWALSKI"]
    rows, rowid = [], 0
    for side in ("training", "evaluation"):
        for person in range(60):
            first, last = rng.choice(firsts), rng.choice(lasts)
            born = datetime.date(1960 + rng.randrange(8), rng.randrange(1, 13), rng.randrange(1, 28))
            for n in range(rng.choice([1, 2, 2, 3])):
                role = f"experiment_{side}" if n == 0 and person % 3 else f"admin_{side}"
                name = first[:-1] if rng.random() < 0.1 else first
                day = born.replace(day=rng.randrange(1, 28)) if rng.random() < 0.1 else born
                rows.append(("7__50", rowid, f"{side}{person}", role, name, last, day, 2020 - day.year, rng.choice(["A", "B", None]), "W", "F"))
                rowid += 1
    return spark.createDataFrame(rows, "spec string, rowid long, sid string, dataset string, first_name string, last_name string, "
                                       "date_of_birth date, age_in_2020 int, middle_initial string, race string, sex string")


@pytest.fixture(scope="module")
def grid(spark):
    rules = study.GridRules(sizes=(7,), budgets=(12, 40), sample_sizes=(30, 15000), linkage_sample_sizes=(30, 15000), iterations=2)
    return study.of_data_sets(study.run_grid(spark, rules))


@pytest.fixture(scope="module")
def done(datasets, grid):
    return runs.run_all(datasets, grid, RULES)


def plain_weights(rows):
    """The prior and the weight of each field and level, counted one by one."""
    def odds(yes, all_yes, no, all_no):
        return round(math.log((yes + 0.5) / (all_yes + 1.5)) - math.log((no + 0.5) / (all_no + 1.5)), 9)
    yes, no = ([r for r in rows if r.label == v] for v in (1, 0))
    table = {}
    for g in AGREEMENTS:
        known = [[r for r in part if r[g] is not None] for part in (yes, no)]
        for level in runs.LEVELS:
            table[g, level] = odds(sum(r[g] == level for r in known[0]), len(known[0]), sum(r[g] == level for r in known[1]), len(known[1]))
    return round(math.log((len(yes) + 0.5) / (len(no) + 0.5)), 9), table


def plain_odds(model, row):
    total = model[0]
    for g in AGREEMENTS:
        total += model[1].get((g, row[g]), 0.0)
    return round(total, 6)


def test_logs_are_those_of_a_loop_over_each_pool(spark, datasets, grid, done):
    pools = runs.label_pools(runs.graded_pairs(datasets), runs.numbered_models(grid), RULES).collect()
    log = {}
    for r in done.log.collect():
        log.setdefault((r.framework, r.model_iter, r.budget, r.sample_size), []).append((r.label_ix, r.rowid1, r.rowid2, r.label))
    assert len(log) == 16
    for (framework, it, budget, sample), found in log.items():
        pool = [r for r in pools if r.framework == framework and r.model_iter == it and r["rank"] <= sample]
        assert len(pool) == min(sample, len([r for r in pools if r.framework == framework and r.model_iter == it]))
        asked, model = [], None
        while len(asked) < budget and len(asked) < len(pool):
            def doubt(r):
                if model:
                    return abs(plain_odds(model, r))
                known = [r[g] for g in AGREEMENTS if r[g] is not None]
                return abs(round(sum(known) / max(2 * len(known), 1), 9) - 0.5)
            left = sorted((r for r in pool if r not in asked), key=lambda r: (doubt(r), r.rowid1, r.rowid2))
            asked += left[:min(budget // RULES.rounds, budget - len(asked))]
            model = plain_weights(asked)
        assert sorted(found) == [(k + 1, r.rowid1, r.rowid2, r.label) for k, r in enumerate(asked)]


def test_both_fits_count_alike(spark, datasets):
    pairs = runs.graded_pairs(datasets).where("side = 'training'")
    frame = pairs.toPandas()
    table = runs.fitted(runs._level_matrix(frame), frame["label"].to_numpy(float), 1 - frame["label"].to_numpy(float))
    row = runs.weights(pairs, ["spec"], F.col("label"), 1 - F.col("label")).first()
    assert row.w == table[0, 0]
    assert [row[w] for w in runs.WEIGHTS] == list(table[1:, :3].ravel())
    odds = {(r.rowid1, r.rowid2): r.odds for r in pairs.crossJoin(runs.weights(pairs, ["spec"], F.col("label"), 1 - F.col("label")).drop("spec"))
            .withColumn("odds", runs.log_odds()).collect()}
    assert odds == dict(zip(zip(frame["rowid1"], frame["rowid2"]), runs.odds_of(table, runs._level_matrix(frame))))


def test_constrained_clusters_of_two_sides_are_the_best_partners(spark, datasets, done):
    """Experiment records meet admin records only, so a cluster keeps one of them: greedy order gives each admin record its best."""
    nodes = datasets.where(F.col("dataset").endswith("evaluation")).select(
        "rowid", "sid", F.when(F.col("dataset").startswith("exp"), constraints.EXPERIMENT).otherwise("ADMIN_EVALUATION").alias("dataset"),
        F.lit(None).cast("string").alias("uid_sid"), F.lit(1).cast("long").alias("copies"))
    rng = random.Random(9)
    kinds = {r.rowid: r.dataset for r in nodes.collect()}
    exp, adm = ([i for i, k in kinds.items() if (k == constraints.EXPERIMENT) == want] for want in (True, False))
    edges = [(e, a, rng.random()) for a in adm for e in rng.sample(exp, 3)]
    frame = spark.createDataFrame(edges, "rowid1 long, rowid2 long, phat double")
    greedy = constraints.constrained_clusters(frame.select(
        "rowid1", "rowid2", F.lit(constraints.EXPERIMENT).alias("dataset_1"), F.lit("ADMIN_EVALUATION").alias("dataset_2"), "phat",
        F.monotonically_increasing_id().alias("original_order")), nodes)
    of = {r.rowid: r.cluster_id for r in greedy.collect()}
    best = cluster.many_to_one(frame.select(F.col("rowid2").alias("rowid1"), F.col("rowid1").alias("rowid2"), F.col("phat").alias("score")), 0.0)
    for r in best.collect():
        assert of[r.rowid1] == of[r.rowid2]
    assert all(sum(of.get(e) == c for e in exp) <= 1 for c in set(of.values()))


def test_every_run_has_rows_figures_and_minutes(datasets, grid, done):
    evaluated = datasets.where(F.col("dataset").endswith("evaluation")).count()
    assert done.rows.count() == evaluated * grid.count()
    columns = done.columns.collect()
    assert len(columns) == grid.count()
    for r in columns:
        active = r.arm == "active"
        assert all((r[c] is not None) == active for c in ("cp_1s", "cp_1s__nem", "labeled_1s", "labeled_0s", "realized_blocked_proportion"))
        timed = [c for c in r.asDict() if c.startswith("runtime_") and r[c] is not None]
        assert len(timed) == {"active": 4, "supervised": 2, "unsupervised": 3}[r.arm] and all(r[c] >= 0 for c in timed)
    spec = ["arm", "framework", "budget", "sample_size", "model_iter"]
    best = {r.arm: r.f for r in evaluate.eval_summary(done.rows, spec).groupBy("arm").agg(F.max(F.least("tpr_any", "prc_any")).alias("f")).collect()}
    assert min(best.values()) > 0.8


def test_no_runs_and_no_pairs(spark, datasets, grid):
    empty = runs.run_all(datasets.where("false"), grid, RULES)
    assert empty.rows.collect() == [] and empty.columns.count() == grid.count()


def test_both_routes_of_the_bootstrap_agree(done):
    spec = ["arm", "spec", "framework", "budget", "sample_size", "model_iter"]
    routes = [evaluate.bootstrap_eval(done.rows, spec, ["spec"], iters=20, held_cells=cells).collect() for cells in (evaluate.HELD_CELLS, 0)]
    assert len(routes[0]) == 20 * done.columns.count()
    assert sorted(routes[0], key=str) == sorted(routes[1], key=str)

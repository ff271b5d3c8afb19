"""Many linkers in one job: every run of a grid is labelled, fitted, applied and clustered together.

A pair is compared once.  All that a model reads of it is its pattern of agreement levels, so a model
is one row of coefficients: a prior and a weight per field and level, the log odds of seeing that
level among matches and non-matches.  The weights come from counts whatever the arm:

active        labels asked for in rounds, always the pairs the model so far is least sure of
supervised    nine tenths of the labelled training pairs; the rest tunes the threshold
unsupervised  expected counts under the model itself, step by step

Coefficients of all runs are broadcast (a row per run of the grid) and meet distinct patterns, not
pairs.  Clusters are solved for all runs at once: a node is a number of run and record.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kithlink.functions.seeded import hash_mod, order_hash
from kithlink.operators import cluster, constraints
from kithlink.operators.blocking import CANDIDATE_KEYS, COMPARED, candidates_within
from kithlink.operators.compare import AGREEMENTS, agreement_levels, truth_labels
from kithlink.operators.scale import broadcast_up_to, seeded_rank, staged

LEVELS = (0, 1, 2)
WEIGHTS = [f"w_{g}_{level}" for g in AGREEMENTS for level in LEVELS]
TRAINING, EVALUATION = "training", "evaluation"
# A record's number is below this; a node is the model's number times it, plus the record's.
RECORDS = 1 << 40
DIGITS = 9


@dataclass(frozen=True)
class RunRules:
    """rounds: batches a label budget is asked in.  em_steps: steps of the unsupervised fit.
    em_cut, cut: least match probability of a link.  pct_train: share of labelled pairs to fit on."""
    seed: int = 3
    rounds: int = 4
    em_steps: int = 40
    em_cut: float = 0.85
    cut: float = 0.5
    pct_train: float = 0.9


# -- pairs ------------------------------------------------------------------------------

def graded_pairs(datasets: DataFrame) -> DataFrame:
    """Candidate pairs inside each side (admin and experiment records together) of each data set, compared once."""
    rows = datasets.select("spec", F.substring_index("dataset", "_", -1).alias("side"), "rowid", "sid", "dataset", *COMPARED)
    rows = rows.withColumn("yob", F.year("date_of_birth"))
    pairs = candidates_within(rows, [["spec", "side", *key] for key in CANDIDATE_KEYS])
    pairs = pairs.transform(agreement_levels).transform(truth_labels)
    both = F.col("dataset1") != F.col("dataset2")
    experiment = F.col("dataset1").startswith("experiment")
    return pairs.select(F.col("spec1").alias("spec"), F.col("side1").alias("side"), "rowid1", "rowid2", both.alias("both"),
                        F.when(both & experiment, F.col("rowid1")).when(both, F.col("rowid2")).alias("experiment"),
                        F.when(both, F.when(experiment, F.col("rowid2")).otherwise(F.col("rowid1"))).alias("admin"),
                        F.col("dataset1").startswith("admin").alias("_first_admin"), pattern().alias("pattern"), *AGREEMENTS,
                        (F.col("label") == "y").cast("int").alias("label"), "exact_match")


def pattern() -> Column:
    """The agreement levels as one text, a character each."""
    return F.concat(*[F.coalesce(F.col(g).cast("string"), F.lit("-")) for g in AGREEMENTS])


# -- coefficients -----------------------------------------------------------------------

def weights(rows: DataFrame, keys: list[str], yes: Column, no: Column) -> DataFrame:
    """(keys, w, w_field_level..): log odds from counted or expected labels; half a label is added to every count."""
    sums = rows.withColumns({"_y": yes, "_n": no}).groupBy(*keys).agg(
        F.sum("_y").alias("y"), F.sum("_n").alias("n"),
        *[F.sum(F.when(F.col(g) == level, F.col(s)).otherwise(0)).alias(f"{s}_{g}_{level}")
          for s in ("_y", "_n") for g in AGREEMENTS for level in LEVELS])

    def odds(g: str, level: int) -> Column:
        def share(s: str) -> Column:
            known = F.col(f"{s}_{g}_0") + F.col(f"{s}_{g}_1") + F.col(f"{s}_{g}_2")
            return (F.col(f"{s}_{g}_{level}") + 0.5) / (known + 1.5)
        return F.round(F.ln(share("_y")) - F.ln(share("_n")), DIGITS)

    prior = F.round(F.ln((F.col("y") + 0.5) / (F.col("n") + 0.5)), DIGITS)
    return sums.select(*keys, prior.alias("w"), *[odds(g, level).alias(f"w_{g}_{level}") for g in AGREEMENTS for level in LEVELS])


def log_odds() -> Column:
    """Of a match, for a row that has levels and coefficients; a missing level says nothing."""
    total = F.col("w")
    for g in AGREEMENTS:
        weight = F.lit(0.0)
        for level in LEVELS:
            weight = F.when(F.col(g) == level, F.col(f"w_{g}_{level}")).otherwise(weight)
        total = total + weight
    return F.round(total, 6)


def _level_matrix(frame: pd.DataFrame) -> np.ndarray:
    """Levels as 0..2, 3 where missing."""
    return frame[AGREEMENTS].fillna(3).to_numpy(np.int64)


def fitted(levels: np.ndarray, yes: np.ndarray, no: np.ndarray) -> np.ndarray:
    """`weights` for arrays: the prior, and a row of weights per field (0 for missing)."""
    table = np.zeros((len(AGREEMENTS) + 1, 4))
    table[0, 0] = round(math.log((yes.sum() + 0.5) / (no.sum() + 0.5)), DIGITS)
    for f in range(len(AGREEMENTS)):
        y, n = (np.bincount(levels[:, f], part, 4)[:3] for part in (yes, no))
        table[f + 1, :3] = np.round(np.log((y + 0.5) / (y.sum() + 1.5)) - np.log((n + 0.5) / (n.sum() + 1.5)), DIGITS)
    return table


def odds_of(table: np.ndarray, levels: np.ndarray) -> np.ndarray:
    total = np.full(len(levels), table[0, 0])
    for f in range(len(AGREEMENTS)):
        total = total + table[f + 1][levels[:, f]]
    return np.round(total, 6)


# -- the three arms ---------------------------------------------------------------------

POOL = ["spec", "framework", "model_iter"]
ACTIVE_RUN = [*POOL, "budget", "sample_size"]


def label_pools(pairs: DataFrame, grid: DataFrame, rules: RunRules) -> DataFrame:
    """Training pairs of each (data set, framework, iteration) in seeded order, up to the largest sample of the grid.

    Linkage takes pairs of an experiment and an admin record, deduplication pairs of admin records.
    """
    wanted = grid.where("budget > 0").groupBy(*POOL).agg(F.max("sample_size").alias("most"))
    rows = pairs.where(F.col("side") == TRAINING).withColumn(
        "framework", F.when(F.col("both"), F.lit("record_linkage")).when(F.col("_first_admin"), F.lit("deduplication")))
    # the wanted pools are rows of the grid
    rows = rows.join(F.broadcast(wanted), ["spec", "framework"])
    rows = rows.withColumn("_id", F.concat_ws("-", "model_iter", "rowid1", "rowid2"))
    return (seeded_rank(rows, POOL, "_id", rules.seed, "pool").where(F.col("rank") <= F.col("most"))
            .select(*POOL, "rank", "rowid1", "rowid2", *AGREEMENTS, "label", "exact_match"))


def label_logs(pools: DataFrame, grid: DataFrame, rules: RunRules) -> DataFrame:
    """The labels each active run asks for, in rounds; a group is one pool, which the sample size bounds.

    A round asks for the pairs with log odds nearest to 0, ties by record numbers; before the first labels, for those
    whose mean level is nearest to the middle.  The pool's own runs are looked up in the list of the grid's budgets.
    """
    by_framework: dict[str, list[tuple[int, int]]] = {}
    for r in grid.where("budget > 0").select("framework", "budget", "sample_size").distinct().collect():  # a few parameters
        by_framework.setdefault(r.framework, []).append((r.budget, r.sample_size))

    def ask(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["rowid1", "rowid2"]).reset_index(drop=True)
        levels, truth, rank = _level_matrix(frame), frame["label"].to_numpy(float), frame["rank"].to_numpy()
        known = (levels < 3).sum(1)
        middle = np.abs(np.round(np.where(levels < 3, levels, 0).sum(1) / np.maximum(2 * known, 1), DIGITS) - 0.5)
        parts = []
        for budget, sample in sorted(by_framework[frame["framework"].iloc[0]]):
            began = time.monotonic()
            open_, asked, table = rank <= sample, np.zeros(0, np.int64), None
            batch = -(-budget // rules.rounds)
            found = []
            for turn in range(rules.rounds):
                odds = None if table is None else odds_of(table, levels)
                doubt = middle if odds is None else np.abs(odds)
                left = np.flatnonzero(open_)
                picked = left[np.argsort(doubt[left], kind="stable")][:min(batch, budget - len(asked))]
                if not len(picked):
                    break
                found.append(pd.DataFrame({"at": picked, "round": turn + 1, "label_ix": len(asked) + 1 + np.arange(len(picked)),
                                           "match_odds": np.nan if odds is None else odds[picked]}))
                asked = np.concatenate([asked, picked])
                open_[picked] = False
                table = fitted(levels[asked], truth[asked], 1 - truth[asked])
            log = pd.concat(found) if found else pd.DataFrame({"at": [], "round": [], "label_ix": [], "match_odds": []}).astype("int64")
            rows = frame.iloc[log["at"].to_numpy(int)].reset_index(drop=True)
            rows = rows.assign(budget=budget, sample_size=sample, round=log["round"].to_numpy(), label_ix=log["label_ix"].to_numpy(),
                               match_odds=log["match_odds"].to_numpy(float), label_minutes=(time.monotonic() - began) / 60)
            parts.append(rows)
        return pd.concat(parts)[[f.split(" ")[0] for f in shape.split(", ")]]

    levels = ", ".join(f"{g} int" for g in AGREEMENTS)
    shape = ("spec string, framework string, model_iter int, budget int, sample_size int, label_ix int, round int, rowid1 long, rowid2 long, "
             f"label int, exact_match int, match_odds double, label_minutes double, {levels}")
    return pools.groupBy(*POOL).applyInPandas(ask, shape)


def active_models(log: DataFrame, rules: RunRules) -> DataFrame:
    cut = F.lit(round(math.log(rules.cut / (1 - rules.cut)), 6))
    return weights(log, ACTIVE_RUN, F.col("label"), 1 - F.col("label")).withColumn("cut", cut)


def supervised_models(pairs: DataFrame, grid: DataFrame, rules: RunRules) -> DataFrame:
    """Fitted on a seeded share of all labelled training pairs; the cut is the best bin of log odds on the others."""
    keys = ["spec", "model_iter"]
    wanted = grid.where("framework = ''").select(*keys).distinct()
    digest = order_hash(rules.seed, "train", F.col("model_iter"), F.col("rowid1"), F.col("rowid2"))
    rows = (pairs.where(F.col("side") == TRAINING).join(F.broadcast(wanted), "spec")
            .withColumn("_train", hash_mod(digest, 1000) < int(rules.pct_train * 1000)))
    models = staged(weights(rows.where("_train"), keys, F.col("label"), 1 - F.col("label")), "supervised-models")
    # tenths of log odds: per model a few hundred bins
    bins = (rows.where("NOT _train").join(F.broadcast(models), keys)
            .groupBy(*keys, F.floor(log_odds() * 10).cast("int").alias("bin"))
            .agg(F.sum("label").alias("hits"), F.count("*").alias("n")))
    model = Window.partitionBy(*keys)
    above = model.orderBy(F.col("bin").desc())
    curve = bins.select(*keys, "bin", F.sum("hits").over(above).alias("h"), F.sum("n").over(above).alias("k"), F.sum("hits").over(model).alias("all"))
    best = (curve.withColumn("f1", F.when(F.col("k") + F.col("all") > 0, 2 * F.col("h") / (F.col("k") + F.col("all"))))
            .groupBy(*keys).agg(F.max(F.struct("f1", (-F.col("bin")).alias("b"))).alias("_best")))
    return (models.join(best, keys, "left").withColumn("cut", F.coalesce(-F.col("_best.b") / 10.0, F.lit(0.0))).drop("_best"))


def unsupervised_models(pairs: DataFrame, grid: DataFrame, rules: RunRules) -> DataFrame:
    """Expectation and maximisation over pattern counts of the evaluation pairs; a group has a row per pattern."""
    frameworks = [r.framework for r in grid.where("budget = 0 AND framework <> ''").select("framework").distinct().collect()]
    rows = (pairs.where(F.col("side") == EVALUATION)
            .withColumn("framework", F.explode(F.array(*[F.lit(f) for f in sorted(frameworks)]).cast("array<string>")))
            .where(F.col("both") | (F.col("framework") == "deduplication")))
    counts = rows.groupBy("spec", "framework", *AGREEMENTS).agg(F.count("*").alias("n"))
    steps = rules.em_steps

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        levels, n = _level_matrix(frame), frame["n"].to_numpy(float)
        known = (levels < 3).sum(1)
        p = np.where(levels < 3, levels, 0).sum(1) / np.maximum(2 * known, 1)
        for _ in range(steps):
            table = fitted(levels, n * p, n * (1 - p))
            p = 1 / (1 + np.exp(-odds_of(table, levels)))
        return pd.DataFrame([[frame["spec"].iloc[0], frame["framework"].iloc[0], table[0, 0], *table[1:, :3].ravel()]],
                            columns=["spec", "framework", "w", *WEIGHTS])

    shape = "spec string, framework string, w double, " + ", ".join(f"{w} double" for w in WEIGHTS)
    cut = F.lit(round(math.log(rules.em_cut / (1 - rules.em_cut)), 6))
    return counts.groupBy("spec", "framework").applyInPandas(fit, shape).withColumn("cut", cut)


# -- application ------------------------------------------------------------------------

def numbered_models(grid: DataFrame) -> DataFrame:
    """The grid with `model`, a number; runs of the unsupervised arm differ in nothing and share one."""
    keys = ["arm", "spec", "framework", "budget", "sample_size", "_iter"]
    rows = grid.withColumn("_iter", F.when((F.col("budget") == 0) & (F.col("framework") != ""), 0).otherwise(F.col("model_iter")))
    # one row per run of the grid
    return rows.withColumn("model", F.dense_rank().over(Window.partitionBy(F.lit(1)).orderBy(*keys))).drop("_iter")


def scored_pairs(pairs: DataFrame, models: DataFrame) -> DataFrame:
    """(model, spec, framework, odds, pair columns) of the evaluation pairs each model may link.

    Models meet the distinct patterns of their data set; a pair is joined to them by its pattern.
    """
    rows = pairs.where(F.col("side") == EVALUATION)
    patterns = rows.select("spec", "pattern", *AGREEMENTS).distinct()
    odds = (patterns.join(F.broadcast(models), "spec").withColumn("odds", log_odds())
            .where((F.col("odds") >= F.col("cut")) | (F.col("framework") == "deduplication"))
            .select("spec", "pattern", "model", "arm", "framework", "cut", "odds"))
    return (rows.join(broadcast_up_to(odds), ["spec", "pattern"])
            .where(F.col("both") | (F.col("framework") == "deduplication"))
            .select("model", "arm", "spec", "framework", "cut", "odds", "rowid1", "rowid2", "experiment", "admin"))


def _node(column: str) -> Column:
    return F.col("model") * RECORDS + F.col(column)


def clusters(scored: DataFrame) -> DataFrame:
    """(model, rowid, cluster_id) of the linked records of every model.

    Linkage with labels: every admin record goes to its best experiment record.  For the supervised arm that is
    what the constrained clustering gives, as its edges join experiment records, of which a cluster has one at
    most, with admin records.  Deduplication with labels: average linkage at the cut.  Without labels: the
    connected components of all matches.
    """
    links = F.col("odds") >= F.col("cut")
    pairs_of_two = scored.where(links & (F.col("arm") != "unsupervised") & (F.col("framework") != "deduplication")).select(
        _node("admin").alias("rowid1"), _node("experiment").alias("rowid2"), F.col("odds").alias("score"))
    best = cluster.many_to_one(pairs_of_two, -math.inf)
    stars = (best.select(F.col("rowid1").alias("rowid"), F.col("rowid2").alias("cluster_id"))
             .unionByName(best.select(F.col("rowid2").alias("rowid"), F.col("rowid2").alias("cluster_id")).distinct()))
    # millionths of a probability: sums of them are exact in every order
    millionths = F.round(1_000_000 / (1 + F.exp(-F.col("odds"))))
    inside = scored.where((F.col("arm") != "unsupervised") & (F.col("framework") == "deduplication")).select(
        _node("rowid1").alias("rowid1"), _node("rowid2").alias("rowid2"), millionths.alias("score"))
    average = constraints.partition_clusters(inside.where("score > 0"), 500_000.0)
    matched = scored.where(links & (F.col("arm") == "unsupervised")).select(_node("rowid1").alias("rowid1"), _node("rowid2").alias("rowid2"))
    components = cluster.connected_components(matched)
    every = stars.unionByName(average.select("rowid", "cluster_id")).unionByName(components)
    return every.select(F.floor(F.col("rowid") / RECORDS).cast("int").alias("model"), (F.col("rowid") % RECORDS).alias("rowid"),
                        (F.col("cluster_id") % RECORDS).alias("cluster_id"))


@dataclass
class Runs:
    """Tables of a finished grid: rows to evaluate, and one row per run of what was counted and measured."""
    rows: DataFrame
    columns: DataFrame
    log: DataFrame
    models: DataFrame


def run_all(datasets: DataFrame, grid: DataFrame, rules: RunRules = RunRules()) -> Runs:
    """Every run of `grid` (arm, spec, framework, budget, sample_size, model_iter) on its data set.

    rows: arm, spec, framework, budget, sample_size, model_iter, rowid, sid, dataset, cluster_id.
    log: the labels of the active runs.  models: cut and coefficients; runs of the unsupervised arm share those of their first.
    columns: per run the candidate, label and block figures, and minutes.  Labelling is timed for each run; the other
    stages run for all runs of an arm at once and a run has its share of their time.
    """
    minutes: dict[str, float] = {}

    def timed(name: str, build: Callable[[], DataFrame]) -> DataFrame:
        began = time.monotonic()
        out = staged(build(), name)
        minutes[name] = (time.monotonic() - began) / 60
        return out

    grid = staged(numbered_models(grid), "grid")
    datasets = datasets.join(F.broadcast(grid.select("spec").distinct()), "spec", "left_semi")
    pairs = timed("graded", lambda: graded_pairs(datasets))
    pools = timed("pools", lambda: label_pools(pairs, grid, rules))
    log = timed("labels", lambda: label_logs(pools, grid, rules))
    named = grid.select("model", "arm", "spec", "framework", "budget", "sample_size", "model_iter")
    active = timed("active", lambda: active_models(log, rules).join(F.broadcast(named.where("budget > 0")), ACTIVE_RUN))
    supervised = timed("supervised", lambda: supervised_models(pairs, grid, rules).join(
        F.broadcast(named.where("framework = ''")), ["spec", "model_iter"]))
    unsupervised = timed("unsupervised", lambda: unsupervised_models(pairs, grid, rules).join(
        F.broadcast(named.where("budget = 0 AND framework <> '' AND model_iter = 0")), ["spec", "framework"]))
    columns = ["model", "arm", "spec", "framework", "cut", "w", *WEIGHTS]
    models = staged(active.select(*columns).unionByName(supervised.select(*columns)).unionByName(unsupervised.select(*columns)), "models")
    scored = timed("scored", lambda: scored_pairs(pairs, models))
    linked = timed("linked", lambda: clusters(scored))
    evaluated = datasets.where(F.col("dataset").endswith(EVALUATION)).select("spec", "rowid", "sid", "dataset")
    alone = F.when(F.col("dataset") == cluster.ADMIN_ROLE, cluster.UNLINKED_ADMIN).otherwise(cluster.UNLINKED_EXPERIMENT)
    rows = (evaluated.join(F.broadcast(grid), "spec").join(linked, ["model", "rowid"], "left")
            .withColumn("cluster_id", F.coalesce("cluster_id", alone.cast("bigint"))).drop("model"))
    fitted_models = models.drop("arm", "spec", "framework").join(F.broadcast(named.where(
        "model_iter = 0 OR budget > 0 OR framework = ''")), "model").drop("model")
    return Runs(rows, _run_columns(grid, pools, log, minutes), log, fitted_models)


def _run_columns(grid: DataFrame, pools: DataFrame, log: DataFrame, minutes: dict[str, float]) -> DataFrame:
    active = grid.where("budget > 0").select(*ACTIVE_RUN)
    # per run the first `sample_size` pairs of its pool
    sizes = active.select(*POOL, "sample_size").distinct()
    sampled = (pools.join(F.broadcast(sizes), POOL).where(F.col("rank") <= F.col("sample_size")).groupBy(*POOL, "sample_size")
               .agg(F.sum("label").alias("cp_1s"), F.count_if((F.col("label") == 1) & (F.col("exact_match") == 0)).alias("cp_1s__nem"),
                    (F.count("*") / F.col("sample_size")).alias("realized_blocked_proportion")))
    labels = log.groupBy(*ACTIVE_RUN).agg(
        F.sum("label").alias("labeled_1s"), (F.count("*") - F.sum("label")).alias("labeled_0s"), F.avg("label").alias("labeled_base_rate"),
        F.max("label_minutes").alias("runtime_min__label"))
    runs = dict.fromkeys(("active", "supervised", "unsupervised"), 1) | {r.arm: r.n for r in grid.groupBy("arm").agg(F.count("*").alias("n")).collect()}
    every = sum(runs.values())

    def per(arm: str, *stages: str) -> Column:
        return F.when(F.col("arm") == arm, F.lit(sum(minutes[s] for s in stages) / runs[arm]))

    predict = F.lit((minutes["scored"] + minutes["linked"]) / every)
    return (grid.drop("model").join(sampled, [*POOL, "sample_size"], "left").join(labels, ACTIVE_RUN, "left")
            .withColumns({
                "runtime_min__prepare_train": per("active", "graded", "pools"),
                "runtime_min__train": F.coalesce(per("active", "active"), per("supervised", "graded", "supervised")),
                "runtime_min__block": per("unsupervised", "graded"),
                "runtime_min__link": per("unsupervised", "unsupervised"),
                "runtime_min__predict": predict}))

"""Tables that several queries start from, derived from one folder of input tables.

Each derived table is written once per session to the scratch folder and read from there,
as the stages of the study share their inputs.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithlink.functions.seeded import hash_mod, order_hash
from kithlink.operators import (
    blocking, clean, cluster, compare, constraints, em, em_within, evaluate, learn, profile, report, results, runs, sampling, tiles)
from kithlink.operators.scale import lookup, scratch_folder, staged
from kithlink.plans import study
from kithlink.sources import fixtures

# Two ways to agree exactly: same last name and birth date, or same first name, middle
# initial and birth date.
EXACT_KEYS = [["last_name", "date_of_birth"], ["first_name", "middle_initial", "date_of_birth"]]

# The full-size study; on tables with fewer persons its quotas run short and take what there is.
STUDY = sampling.SamplingRules(shares_exact=(0.5, 0.25))

STUDY_SEED = 3
METRIC = "error_any"
# Blocks of up to this many records on side A are merged, per framework.
SMALL_BLOCK_LINKAGE = 4
SMALL_BLOCK_DEDUPLICATION = 8

# Derived tables that depend on the run grid.
OF_GRID = {"run_datasets", "run_columns", "run_labels", "run_models", "run_rows", "run_results", "run_bootstraps", "tests"}

# Derived tables by application, input folder, its state and name.
_STAGED: dict[tuple[str, str, str, str], DataFrame] = {}


def _state(spark: SparkSession, folder: str) -> str:
    """Sizes and times of what lies in the folder: tables derived from other contents are not used again."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    return ";".join(sorted(f"{f.getPath().getName()}:{f.getLen()}:{f.getModificationTime()}" for f in files))


class Workspace:
    def __init__(self, spark: SparkSession, folder: str, rules: study.GridRules = study.QUERY_GRID):
        self.spark = spark
        self.rules = rules
        self.folder = folder.rstrip("/")
        self.state = _state(spark, self.folder)

    def source(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{table}.parquet")

    def _key(self, name: str) -> tuple[str, str, str, str]:
        return self.spark.sparkContext.applicationId, self.folder, self.state, f"{name} {self.rules}" if name in OF_GRID else name

    def over(self, rules: study.GridRules) -> Workspace:
        """The same tables with the runs of another grid."""
        return Workspace(self.spark, self.folder, rules)

    def once(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        key = self._key(name)
        if key not in _STAGED:
            _STAGED[key] = staged(build(), name)
        return _STAGED[key]

    # records -----------------------------------------------------------------
    def raw_cases(self) -> DataFrame:
        return fixtures.raw_cases(self.spark, self.source("orders"))

    ARRIVAL = "ingest_order"

    def arriving(self) -> DataFrame:
        """Cases with their place in the order of arrival, which is that of their numbers."""
        return self.raw_cases().withColumn(self.ARRIVAL, F.col("casnbr").cast("long"))

    def raw_charges(self) -> DataFrame:
        return fixtures.raw_charges(self.spark, self.source("orders"), self.source("lineitem"))

    def cases(self) -> DataFrame:
        # read from files: in one stage with the cleaning, the code of the fixture grows past what Spark compiles
        return self.once("cases", lambda: clean.clean_cases(staged(self.arriving(), "raw_cases"), self.ARRIVAL))

    def persons(self) -> DataFrame:
        return self.once("persons", lambda: clean.preprocess(self.cases()))

    def profiled(self) -> DataFrame:
        return self.once("profiled", lambda: profile.stat_columns(self.persons()))

    def roles(self) -> DataFrame:
        return self.once("roles", lambda: fixtures.roles(self.profiled()))

    def role(self, dataset: str) -> DataFrame:
        return self.roles().where(f"dataset = '{dataset}'")

    # study data sets ----------------------------------------------------------
    def pool(self) -> DataFrame:
        return self.once("pool", lambda: sampling.sampling_pool(self.profiled(), STUDY))

    def ranked(self) -> DataFrame:
        return self.once("ranked", lambda: sampling.ranked_persons(self.pool(), STUDY))

    def takes(self) -> DataFrame:
        return sampling.take_table(self.pool(), self.ranked(), STUDY)

    def chosen(self) -> DataFrame:
        return self.once("chosen", lambda: sampling.quota_sample(self.ranked(), self.takes()))

    def moved(self) -> DataFrame:
        return self.once("moved", lambda: sampling.experiment_rows(
            self.pool(), self.chosen(), STUDY))

    def datasets(self) -> DataFrame:
        return self.once("datasets", lambda: sampling.datasets_of(self.pool(), self.chosen(), self.moved()))

    # exact-key linkage -------------------------------------------------------
    def edges(self) -> DataFrame:
        return self.once("edges", lambda: blocking.star_edges(self.roles(), EXACT_KEYS))

    def components(self) -> DataFrame:
        return self.once("components", lambda: cluster.connected_components(self.edges()))

    def linked(self) -> DataFrame:
        return cluster.assign_clusters(self.roles(), clusters=self.components())

    # candidates ---------------------------------------------------------------
    def profiles(self) -> DataFrame:
        return self.once("profiles", lambda: blocking.profiles(self.roles()))

    def sides(self) -> tuple[DataFrame, DataFrame]:
        rows = self.profiles()
        return tuple(rows.where(F.col("dataset") == r) for r in (cluster.EXPERIMENT_ROLE, cluster.ADMIN_ROLE))

    def candidates(self) -> DataFrame:
        """Pairs of an experiment and an admin profile; not written, as they outgrow the profiles they are made from."""
        return blocking.candidates_between(*self.sides(), blocking.CANDIDATE_KEYS)

    def candidates_one_table(self) -> DataFrame:
        return blocking.candidates_within(self.profiles(), blocking.CANDIDATE_KEYS)

    def scored(self, pairs: DataFrame) -> DataFrame:
        """Pairs with a plain score: mean of the three text similarities."""
        parts = [F.col(c) for c in ("first_name_sim", "last_name_sim", "dob_sim")]
        return compare.compare_pairs(pairs).withColumn("score", F.round(sum(parts[1:], parts[0]) / 3, 6))

    def name_ranges(self) -> DataFrame:
        return self.once("name_ranges", lambda: blocking.last_name_ranges(self.roles()))

    # unsupervised ---------------------------------------------------------------
    def members(self) -> DataFrame:
        return self.once("members", lambda: blocking.merge_small_blocks(
            blocking.block_members(*self.sides(), self.name_ranges()), SMALL_BLOCK_LINKAGE))

    def fitted(self) -> DataFrame:
        return self.once("fitted", lambda: em.em_link(
            em.pattern_counts(self.members()), em.field_totals(self.members())))

    def em_matches(self) -> DataFrame:
        """Not written, as they outgrow the records; the arm writes what connects them."""
        return em.em_matches(self.members(), self.fitted())

    def one_table_members(self) -> DataFrame:
        return self.once("one_table_members", lambda: em_within.one_table_members(
            lookup(self.profiles(), self.name_ranges(), ["last_name"], F.col("rowid")), SMALL_BLOCK_DEDUPLICATION))

    def one_table_graded(self) -> DataFrame:
        """All compared pairs; not written, as readers want a part of them."""
        return em_within.within_graded(self.one_table_members())

    def one_table_fitted(self) -> DataFrame:
        return self.once("one_table_fitted", lambda: em.em_link(self.one_table_patterns(), self.one_table_totals()))

    def one_table_totals(self) -> DataFrame:
        return self.once("one_table_totals", lambda: em_within.within_totals(self.one_table_members()))

    def one_table_patterns(self) -> DataFrame:
        return self.once("one_table_patterns", lambda: em_within.within_patterns(
            self.one_table_members(), None, self.one_table_totals()))

    def one_table_matches(self) -> DataFrame:
        """Not written, as `em_matches`."""
        fitted = self.one_table_fitted()
        graded = em_within.within_graded(self.one_table_members(), wanted=em.matching_codes(fitted))
        return em_within.within_matches(graded, fitted)

    # learning -------------------------------------------------------------------
    def label_pool(self) -> DataFrame:
        return self.once("label_pool", lambda: blocking.candidate_sample(self.candidates(), 1500, STUDY_SEED))

    def label_log(self) -> DataFrame:
        return self.once("label_log", lambda: learn.active_label(self.label_pool(), budget=80, batch=20))

    # constraint roles -----------------------------------------------------------
    def constraint_nodes(self) -> DataFrame:
        """Profiles in three upper-case roles; half the admin persons are training, with known id."""
        training = hash_mod(order_hash(STUDY_SEED, "role", F.col("sid")), 2) == 0
        role = (F.when(F.col("dataset") == cluster.EXPERIMENT_ROLE, constraints.EXPERIMENT)
                .when(training, constraints.TRAINING).otherwise("ADMIN_EVALUATION"))
        return self.once("constraint_nodes", lambda: self.profiles().withColumn("dataset", role).withColumn(
            "uid_sid", F.when(F.col("dataset") == constraints.TRAINING, F.col("sid"))))

    def constraint_edges(self) -> DataFrame:
        """Scored pairs of one table with the role of both ends, in an original order."""
        def build() -> DataFrame:
            rows = tiles.similar_within(self.constraint_nodes(), blocking.CANDIDATE_KEYS, ["dataset"], 0.7)
            return rows.select(
                "rowid1", "rowid2", F.col("dataset1").alias("dataset_1"), F.col("dataset2").alias("dataset_2"),
                F.col("score").alias("phat"), (F.col("rowid1") * 1000003 + F.col("rowid2")).alias("original_order"))
        return self.once("constraint_edges", build)

    # runs of the study grid -----------------------------------------------------
    def grid(self) -> DataFrame:
        return study.of_data_sets(study.run_grid(self.spark, self.rules))

    def run_datasets(self) -> DataFrame:
        """Data sets of the grid's sizes, which leave single records over for the experiment sets."""
        rules = sampling.SamplingRules(sample_sizes=self.rules.sizes)
        return self.once("run_datasets", lambda: sampling.build_datasets(self.profiled(), rules))

    def _run(self) -> None:
        """All runs of the grid, once; their tables go by four names."""
        if self._key("run_rows") in _STAGED:
            return
        done = runs.run_all(self.run_datasets(), self.grid())
        self.once("run_columns", lambda: study.evaluated_on_own(done.columns.drop("spec")))
        self.once("run_labels", lambda: done.log)
        self.once("run_models", lambda: done.models)
        self.once("run_rows", lambda: study.evaluated_on_own(done.rows.drop("spec")))

    def run_rows(self) -> DataFrame:
        self._run()
        return _STAGED[self._key("run_rows")]

    def run_columns(self) -> DataFrame:
        self._run()
        return _STAGED[self._key("run_columns")]

    def run_labels(self) -> DataFrame:
        self._run()
        return _STAGED[self._key("run_labels")]

    def run_models(self) -> DataFrame:
        self._run()
        return _STAGED[self._key("run_models")]

    def run_results(self) -> DataFrame:
        """One result row per run; the metrics are cut to nine places so that ties are ties."""
        def build() -> DataFrame:
            spec = ["arm", *study.EVAL_SPEC]
            summary = evaluate.eval_summary(self.run_rows(), spec)
            summary = summary.withColumns({c: F.round(c, 9) for c in summary.columns if c not in spec})
            return evaluate.attach_run_columns(summary, self.run_columns(), spec)
        return self.once("run_results", build)

    def run_bootstraps(self) -> DataFrame:
        def build() -> DataFrame:
            rows = evaluate.bootstrap_eval(self.run_rows(), ["arm", *study.EVAL_SPEC], ["ss_eval", "em_eval"],
                                           study.RESAMPLES)
            return rows.withColumns({c: F.round(c, 9) for c in ("tpr_any", "prc_any", "tnr_any", "error_any")})
        return self.once("run_bootstraps", build)

    def _collected(self, rows: DataFrame) -> DataFrame:
        return results.collect_results({arm: rows.where(F.col("arm") == arm).drop("arm") for arm in
                                        (study.ACTIVE, study.SUPERVISED, study.UNSUPERVISED)})

    def all_results(self) -> DataFrame:
        return self._collected(self.run_results()).transform(results.f1_scores).transform(results.total_runtime)

    def all_bootstraps(self) -> DataFrame:
        return self._collected(self.run_bootstraps()).transform(results.f1_scores, ("any",))

    def report_results(self) -> DataFrame:
        return report.report_input(results.first_runs(self.all_results(), study.RUNS_KEPT), "study")

    def report_bootstraps(self) -> DataFrame:
        return report.report_input(results.first_runs(self.all_bootstraps(), study.RUNS_KEPT), "study")

    def compared(self) -> DataFrame:
        points = report.point_estimates(self.report_results(), METRIC)
        flagged = report.bootstrap_flags(self.report_bootstraps(), points)
        return report.compared_arms(flagged, METRIC)

    def tests(self) -> DataFrame:
        return self.once("tests", lambda: report.significance_test(self.compared(), 0.05))

    def figure_results(self) -> DataFrame:
        rows = report.median_run(self.report_results(), report.FIGURE_GROUP, METRIC)
        report.check_runs_per_group(rows, report.FIGURE_GROUP)
        return report.confidence_intervals(rows, self.report_bootstraps())

    def folder_for(self, name: str) -> str:
        """A fresh folder for the output of one sink."""
        return f"{scratch_folder(self.spark)}/{name}-{uuid.uuid4().hex}"

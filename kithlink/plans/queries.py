"""Named queries over a folder of input tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kithlink.operators import (
    blocking, clean, cluster, compare, constraints, em, evaluate, learn, profile, report, results, runs, sampling)
from kithlink.plans import arms, study
from kithlink.plans.workspace import METRIC, STUDY, Workspace
from kithlink.sources import readers, writers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def named(name: str) -> Callable[[Callable[[Workspace], DataFrame]], Callable[[Workspace], DataFrame]]:
    def register(build: Callable[[Workspace], DataFrame]) -> Callable[[Workspace], DataFrame]:
        QUERIES[name] = lambda spark, folder: build(Workspace(spark, folder))
        return build
    return register


def rounded(df: DataFrame, columns: list[str], digits: int = 9) -> DataFrame:
    """Sums of doubles differ in the last bits between engines and task orders."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


# -- sources --------------------------------------------------------------------------

@named("raw_scan")
def _(w: Workspace) -> DataFrame:
    folder = w.folder_for("raw_csv")
    writers.write_csv(w.raw_charges(), folder)
    rows = readers.scan_raw_cases(w.spark, folder)
    return rows.groupBy(*clean.RAW_COLUMNS).agg(F.count("*").alias("n"))


@named("string_scan")
def _(w: Workspace) -> DataFrame:
    folder = w.folder_for("charges_csv")
    writers.write_csv(w.raw_charges().select("casnbr", "ingest_order", "sid", "name"), folder)
    return readers.scan_keyed_text(w.spark, folder, "casnbr", "ingest_order")


# -- cleaning -------------------------------------------------------------------------

@named("parse_dates")
def _(w: Workspace) -> DataFrame:
    return (w.raw_charges().transform(clean.parse_dates)
            .groupBy("casnbr", "casfildat", "date_of_birth").agg(F.count("*").alias("n")))


@named("filter_names")
def _(w: Workspace) -> DataFrame:
    return w.raw_cases().transform(clean.filter_names).select("casnbr", "name")


@named("normalise_missing")
def _(w: Workspace) -> DataFrame:
    return w.raw_cases().transform(clean.normalise_missing).select("casnbr", "sid", "race")


@named("filter_ids")
def _(w: Workspace) -> DataFrame:
    return (w.raw_charges().transform(clean.filter_ids)
            .groupBy("casnbr", "sid").agg(F.count("*").alias("n")))


@named("first_per_case")
def _(w: Workspace) -> DataFrame:
    rows = (w.raw_charges().transform(clean.parse_dates).transform(clean.filter_names)
            .transform(clean.normalise_missing).transform(clean.filter_ids))
    return clean.first_per_case(rows, "ingest_order").select(
        "sid", "casnbr", "name", "casfildat", "date_of_birth", "ingest_order")


@named("dense_rowid")
def _(w: Workspace) -> DataFrame:
    return clean.usable_rows(w.arriving(), w.ARRIVAL).transform(clean.number_rows).select("rowid", "sid", "casnbr")


@named("parse_name")
def _(w: Workspace) -> DataFrame:
    return (clean.usable_rows(w.arriving(), w.ARRIVAL).transform(clean.number_rows).transform(clean.parse_name)
            .select("rowid", "name", "last_name", "first_name", "middle_name"))


@named("filter_missing_names")
def _(w: Workspace) -> DataFrame:
    return w.cases().select("rowid", "last_name", "first_name")


@named("age_at_event")
def _(w: Workspace) -> DataFrame:
    return w.cases().select("rowid", "casfildat", "date_of_birth", "age")


@named("preprocess")
def _(w: Workspace) -> DataFrame:
    return clean.preprocess(w.cases())


@named("extract_lineage")
def _(w: Workspace) -> DataFrame:
    return clean.preprocess(w.cases()).where("lineage IS NOT NULL").select("rowid", "lineage")


@named("strip_lineage")
def _(w: Workspace) -> DataFrame:
    return clean.preprocess(w.cases()).select("rowid", "middle_name", "middle_initial")


# -- profiling ------------------------------------------------------------------------

@named("records_per_person")
def _(w: Workspace) -> DataFrame:
    return profile.records_per_person(w.persons())


@named("share_singletons")
def _(w: Workspace) -> DataFrame:
    return profile.share_singletons(w.persons()).select(F.round("share_singletons", 9).alias("share_singletons"))


@named("stat_columns")
def _(w: Workspace) -> DataFrame:
    return profile.stat_columns(w.persons()).select("rowid", "sid", *profile.STAT_COLUMNS)


@named("cluster_size_dist")
def _(w: Workspace) -> DataFrame:
    return profile.cluster_size_dist(w.persons())


@named("cluster_size_cutoff")
def _(w: Workspace) -> DataFrame:
    return profile.cluster_size_cutoff(w.persons(), 0.99)


@named("entity_class")
def _(w: Workspace) -> DataFrame:
    return profile.with_entity_class(w.profiled()).select("sid", "entity_class").distinct()


@named("collapse_mixed")
def _(w: Workspace) -> DataFrame:
    return profile.collapse_mixed(w.profiled()).select(
        "rowid", "sid", "name_dob", "n_records", "n_uq_namedob", "all_non_exact_match")


@named("date_parts")
def _(w: Workspace) -> DataFrame:
    return clean.date_parts(w.persons()).select("rowid", "age_in_2020", "yob", "mob", "dob")


# -- exact-key linkage ----------------------------------------------------------------

@named("distinct_pairs")
def _(w: Workspace) -> DataFrame:
    return w.edges()


@named("connected_components")
def _(w: Workspace) -> DataFrame:
    return cluster.connected_components(w.edges())


@named("assign_clusters")
def _(w: Workspace) -> DataFrame:
    return w.linked()


ANY = ["tpr_any", "prc_any", "tnr_any", "error_any"]
METRICS = [*ANY, "acc_any", "tpr_corr", "prc_corr", "tpr_pair", "prc_pair", "tnr_pair", "error_pair"]


@named("any_link")
def _(w: Workspace) -> DataFrame:
    names = ["tpr_any", "prc_any", "tnr_any", "acc_any"]
    return rounded(evaluate.metrics(w.linked(), [], names), names)


def _metric_query(query: str, metric: str) -> None:
    named(query)(lambda w: rounded(evaluate.metrics(w.linked(), [], [metric]), [metric]))


_metric_query("correct_links_recall", "tpr_corr")
_metric_query("correct_links_precision", "prc_corr")
_metric_query("pair_recall", "tpr_pair")
_metric_query("pair_precision", "prc_pair")
_metric_query("pair_tnr", "tnr_pair")


@named("exact_key_linkage")
def _(w: Workspace) -> DataFrame:
    return rounded(evaluate.eval_summary(w.linked(), []), METRICS)


# -- sampling and study design --------------------------------------------------------

@named("sampling_pool")
def _(w: Workspace) -> DataFrame:
    return sampling.sampling_pool(w.profiled(), STUDY).select("rowid", "sid", *profile.STAT_COLUMNS)


@named("size_policy")
def _(w: Workspace) -> DataFrame:
    rules = sampling.SamplingRules(max_cluster_size=None, max_cluster_share=0.99, drop_large_exact=True)
    kinds = profile.with_entity_class(w.profiled())
    exact, different = sampling.size_policy(kinds.where("entity_class = 'exact'"),
                                            kinds.where("entity_class = 'different'"), rules)
    return exact.unionByName(different).select("rowid", "sid", "entity_class")


@named("truncate_clusters")
def _(w: Workspace) -> DataFrame:
    exact = w.profiled().where(profile.entity_class() == "exact")
    return sampling.truncate_clusters(exact, 5, 4, 3).select("rowid", "sid")


@named("train_eval_split")
def _(w: Workspace) -> DataFrame:
    return sampling.train_eval_split(w.pool(), STUDY)


@named("quota_table")
def _(w: Workspace) -> DataFrame:
    return sampling.quota_table(w.pool(), STUDY)


@named("quota_sample")
def _(w: Workspace) -> DataFrame:
    return sampling.quota_sample(w.ranked(), w.takes()).select("spec", "side", "entity_class", "sid")


@named("admin_datasets")
def _(w: Workspace) -> DataFrame:
    return sampling.admin_datasets(w.pool(), w.chosen()).select("spec", "side", "rowid", "sid")


@named("eligible_singletons")
def _(w: Workspace) -> DataFrame:
    return sampling.eligible_singletons(w.pool(), w.chosen()).select("rowid", "sid")


@named("experiment_datasets")
def _(w: Workspace) -> DataFrame:
    return sampling.experiment_rows(w.pool(), w.chosen(), STUDY)


@named("build_datasets")
def _(w: Workspace) -> DataFrame:
    return sampling.build_datasets(w.profiled(), STUDY).select("spec", "dataset", "rowid", "sid", "name_dob")


def _written_datasets(w: Workspace) -> str:
    folder = w.folder_for("datasets_out")
    writers.write_datasets(w.datasets(), folder)
    return folder


@named("write_datasets")
def _(w: Workspace) -> DataFrame:
    return readers.scan_datasets(w.spark, _written_datasets(w)).select(
        "spec", "dataset", "rowid", "sid", "uid_sid", "first_name", "lineage")


@named("dataset_scan")
def _(w: Workspace) -> DataFrame:
    rows = readers.scan_datasets(w.spark, _written_datasets(w))
    return rows.where("dataset = 'admin_evaluation'").select("spec", "rowid", "date_of_birth", "age_in_2020")


@named("run_grid")
def _(w: Workspace) -> DataFrame:
    parts = F.split("spec", "__")
    datasets = w.datasets().withColumns({"spec_n": parts[0].cast("int"), "spec_share": parts[1].cast("int")})
    grid = study.run_grid(w.spark, study.GridRules())
    return study.runnable(grid, datasets)


# -- blocking and candidates ----------------------------------------------------------

@named("block_year_window")
def _(w: Workspace) -> DataFrame:
    return blocking.year_window_members(*w.sides()).select("block", "side", "rowid")


@named("block_name_kmeans")
def _(w: Workspace) -> DataFrame:
    return blocking.last_name_clusters(w.profiles())


@named("block_members")
def _(w: Workspace) -> DataFrame:
    names = w.once("name_clusters", lambda: blocking.last_name_clusters(w.profiles()))
    return blocking.block_members(*w.sides(), names).select("block", "side", "rowid")


@named("merge_small_blocks")
def _(w: Workspace) -> DataFrame:
    return w.members().select("block", "side", "rowid")


@named("block_name_ranges")
def _(w: Workspace) -> DataFrame:
    return w.name_ranges()


@named("block_range_members")
def _(w: Workspace) -> DataFrame:
    return blocking.block_members(*w.sides(), w.name_ranges()).select("block", "side", "rowid")


@named("block_listing")
def _(w: Workspace) -> DataFrame:
    return blocking.block_listing(w.members())


@named("block_cosine")
def _(w: Workspace) -> DataFrame:
    return blocking.cosine_name_pairs(w.persons())


def _similar_names(w: Workspace) -> DataFrame:
    names = w.once("name_pairs", lambda: blocking.cosine_name_pairs(w.persons()))
    return blocking.similar_name_candidates(w.persons(), names)


@named("block_dob_edit")
def _(w: Workspace) -> DataFrame:
    return blocking.dob_edit_filter(_similar_names(w), 3).select(
        F.least("rowid1", "rowid2").alias("rowid1"), F.greatest("rowid1", "rowid2").alias("rowid2"))


@named("block_age_backup")
def _(w: Workspace) -> DataFrame:
    # every seventh birth year is taken as unknown, so that the ages get to decide
    pairs = _similar_names(w)
    for n in ("1", "2"):
        birth = F.col(f"date_of_birth{n}")
        pairs = pairs.withColumn(f"date_of_birth{n}", F.when(F.year(birth) % 7 != 0, birth))
    return blocking.age_backup_filter(pairs, 3, 3).select(
        F.least("rowid1", "rowid2").alias("rowid1"), F.greatest("rowid1", "rowid2").alias("rowid2"))


@named("learn_blocks")
def _(w: Workspace) -> DataFrame:
    matches = w.label_log().where("label = 'y'").select(
        F.col("rowid_1").alias("rowid1"), F.col("rowid_2").alias("rowid2"))
    return blocking.learn_blocks(*w.sides(), matches)


@named("candidate_sample")
def _(w: Workspace) -> DataFrame:
    return w.label_pool().select("rowid1", "rowid2")


@named("candidate_stats")
def _(w: Workspace) -> DataFrame:
    return blocking.candidate_stats(w.candidates())


@named("canonical_pairs")
def _(w: Workspace) -> DataFrame:
    star = w.edges()
    mirrored = star.select(F.col("rowid2").alias("rowid1"), F.col("rowid1").alias("rowid2"))
    itself = w.roles().select(F.col("rowid").alias("rowid1"), F.col("rowid").alias("rowid2"))
    return blocking.canonical_pairs(star.unionByName(mirrored).unionByName(itself))


@named("stack_roles")
def _(w: Workspace) -> DataFrame:
    experiment = w.role(cluster.EXPERIMENT_ROLE)
    return blocking.stack_roles(w.roles(), experiment).select("rowid", "sid", "dataset")


# -- comparison -----------------------------------------------------------------------

@named("compare_pairs")
def _(w: Workspace) -> DataFrame:
    pairs = compare.compare_pairs(w.candidates()).select("rowid1", "rowid2", *compare.SIMILARITIES)
    return rounded(pairs, ["first_name_sim", "last_name_sim", "dob_sim"])


@named("compare_config")
def _(w: Workspace) -> DataFrame:
    """Experiment against admin records of one last name and birth date, as the variables declare."""
    rows = w.roles()
    sides = [compare.value_checks(compare.as_declared(rows.where(F.col("dataset") == role), source))
             for role, source in ((cluster.EXPERIMENT_ROLE, "experiment"), (cluster.ADMIN_ROLE, "admin_training"))]
    pairs = blocking.candidates_between(*[s.drop("n_invalid") for s in sides], [["last_name", "dob"]])
    return rounded(compare.compare_declared(pairs), ["first_name", "last_name"])


@named("value_checks")
def _(w: Workspace) -> DataFrame:
    """Checks on the texts as they arrive, before the cleaning has removed bad values."""
    raw = w.raw_charges().select(
        F.col("casnbr").alias("rowid"), F.concat_ws("-", *[F.substring("dob", *at) for at in ((7, 4), (1, 2), (4, 2))])
        .alias("dob"), F.col("sex").alias("gender"))
    declared = tuple(v for v in compare.STUDY_VARIABLES if v.check)
    return (compare.value_checks(raw, declared).groupBy("rowid", "dob", "gender", "n_invalid")
            .agg(F.count("*").alias("n")))


@named("agreement_levels")
def _(w: Workspace) -> DataFrame:
    return compare.agreement_levels(w.candidates()).select("rowid1", "rowid2", *compare.AGREEMENTS)


@named("pattern_counts")
def _(w: Workspace) -> DataFrame:
    return em.pattern_counts(w.members())


@named("field_totals")
def _(w: Workspace) -> DataFrame:
    return em.field_totals(w.members())


@named("truth_labels")
def _(w: Workspace) -> DataFrame:
    return compare.truth_labels(w.candidates()).select("rowid1", "rowid2", "label", "exact_match")


# -- unsupervised linkage -------------------------------------------------------------

@named("em_link")
def _(w: Workspace) -> DataFrame:
    return em.em_link(em.pattern_counts(w.members()), em.field_totals(w.members()))


@named("em_matches")
def _(w: Workspace) -> DataFrame:
    return w.em_matches().select("block", "rowid1", "rowid2", "score")


@named("match_rows")
def _(w: Workspace) -> DataFrame:
    return em.match_rows(w.edges(), w.roles())


@named("em_linkage")
def _(w: Workspace) -> DataFrame:
    """The unsupervised arm from blocks to metrics."""
    return rounded(evaluate.eval_summary(arms.records_from_matches(w.roles(), w.em_matches()), []), METRICS)


@named("one_table_members")
def _(w: Workspace) -> DataFrame:
    return w.one_table_members().select("block", "side", "rowid", "home")


@named("one_table_pairs")
def _(w: Workspace) -> DataFrame:
    return w.one_table_graded().select("block", "rowid1", "rowid2", *compare.AGREEMENTS)


@named("one_table_patterns")
def _(w: Workspace) -> DataFrame:
    return w.one_table_patterns()


@named("one_table_totals")
def _(w: Workspace) -> DataFrame:
    return w.one_table_totals()


@named("one_table_matches")
def _(w: Workspace) -> DataFrame:
    return w.one_table_matches().select("block", "rowid1", "rowid2", "score")


@named("em_deduplication")
def _(w: Workspace) -> DataFrame:
    """The unsupervised arm inside one table, from blocks to metrics."""
    linked = arms.records_from_matches(w.roles(), w.one_table_matches(), one_table=True)
    return rounded(evaluate.eval_summary(linked, []), METRICS)


# -- active and supervised linkage ----------------------------------------------------

@named("active_label")
def _(w: Workspace) -> DataFrame:
    return learn.active_label(w.label_pool(), budget=80, batch=20)


@named("label_log")
def _(w: Workspace) -> DataFrame:
    folder = w.folder_for("stages")
    writers.write_stage(w.label_log(), folder, "label_info")
    return w.spark.read.parquet(f"{folder}/label_info").select(*learn.LOG_COLUMNS)


@named("label_balance")
def _(w: Workspace) -> DataFrame:
    """Balance of the whole candidate set, as if every pair had been asked for."""
    return rounded(learn.label_balance(compare.truth_labels(w.candidates())), ["labeled_base_rate"])


@named("train_pairs")
def _(w: Workspace) -> DataFrame:
    labelled = learn.labelled_pairs(w.label_pool(), w.label_log())
    linker = learn.train_pairs(labelled, *w.sides())
    weights = [float(x) for x in linker.model.coefficients]
    rows = list(zip(["weight:" + c for c in compare.SIMILARITIES], weights))
    rows += [(f"block:{p}", float(i)) for i, p in enumerate(linker.predicates)]
    return w.spark.createDataFrame(rows, "part string, value double")


@named("score_pairs")
def _(w: Workspace) -> DataFrame:
    labelled = learn.labelled_pairs(w.label_pool(), w.label_log())
    scored = learn.score_pairs(learn.with_features(w.candidates()), learn.fit_pairs(labelled))
    return scored.select("rowid1", "rowid2", "confidence_score")


@named("tune_threshold")
def _(w: Workspace) -> DataFrame:
    split = learn.train_share(learn.with_features(w.candidates()), learn.SupervisedRules())
    model = learn.fit_pairs(split.where("in_training"))
    return learn.tune_threshold(learn.score_pairs(split.where("NOT in_training"), model))


@named("active_linkage")
def _(w: Workspace) -> DataFrame:
    """The active arm on two tables, from labels to metrics."""
    linked = arms.active_linkage(w.roles(), w.label_pool(), w.label_log(), w.candidates())
    return rounded(evaluate.eval_summary(linked, []), METRICS)


@named("active_deduplication")
def _(w: Workspace) -> DataFrame:
    """The active arm on one table, from labels to metrics."""
    linked = arms.active_deduplication(w.roles(), w.label_pool(), w.label_log(), w.candidates_one_table())
    return rounded(evaluate.eval_summary(linked, []), METRICS)


@named("supervised_linkage")
def _(w: Workspace) -> DataFrame:
    """The supervised arm: trained on training records, measured on persons without any."""
    nodes = w.constraint_nodes()
    pairs = blocking.candidates_within(nodes, blocking.CANDIDATE_KEYS)
    linked = arms.supervised_linkage(w.roles(), nodes, pairs)
    trained = nodes.where(F.col("dataset") == constraints.TRAINING).select("sid").distinct()
    return rounded(evaluate.eval_summary(linked.join(trained, "sid", "left_anti"), []), METRICS)


# -- constraints and clustering -------------------------------------------------------

@named("valid_links")
def _(w: Workspace) -> DataFrame:
    return constraints.valid_links(w.constraint_edges()).select("rowid1", "rowid2", "valid")


def _constraint_members(w: Workspace) -> DataFrame:
    parts = cluster.connected_components(w.constraint_edges())
    return w.constraint_nodes().join(parts, "rowid")


@named("valid_clusters")
def _(w: Workspace) -> DataFrame:
    return constraints.valid_clusters(_constraint_members(w)).select("cluster_id", "valid")


@named("unique_id_rule")
def _(w: Workspace) -> DataFrame:
    return constraints.valid_clusters(_constraint_members(w)).select("cluster_id", "valid_ids")


@named("link_priority")
def _(w: Workspace) -> DataFrame:
    return constraints.link_priority(w.constraint_edges()).select("rowid1", "rowid2", "priority")


@named("constrained_clusters")
def _(w: Workspace) -> DataFrame:
    return constraints.constrained_clusters(w.constraint_edges(), w.constraint_nodes())


@named("partition_clusters")
def _(w: Workspace) -> DataFrame:
    edges = w.scored(w.candidates_one_table()).select("rowid1", "rowid2", "score")
    return constraints.partition_clusters(edges, 0.7)


@named("many_to_one")
def _(w: Workspace) -> DataFrame:
    edges = w.scored(w.candidates()).select(
        F.col("rowid2").alias("rowid1"), F.col("rowid1").alias("rowid2"), "score")
    return cluster.many_to_one(edges, 0.7)


@named("split_pair")
def _(w: Workspace) -> DataFrame:
    pairs = w.scored(w.candidates()).select(F.array("rowid1", "rowid2").alias("pair"),
                                            F.col("score").alias("confidence_score"))
    return cluster.split_pair(pairs)


@named("explode_clusters")
def _(w: Workspace) -> DataFrame:
    """Cluster lists as a linker returns them; the lists here are the blocks of one birth date."""
    lists = (w.edges().groupBy(F.col("rowid1").alias("cluster_id"))
             .agg(F.sort_array(F.collect_list("rowid2")).alias("records"))
             .withColumn("scores", F.transform("records", lambda r: (r % 100) / F.lit(100.0))))
    return cluster.explode_clusters(lists)


@named("stack_clustered")
def _(w: Workspace) -> DataFrame:
    linked = w.linked()
    sides = [linked.where(F.col("dataset") == r) for r in (cluster.EXPERIMENT_ROLE, cluster.ADMIN_ROLE)]
    return cluster.stack_clustered(*sides)


# -- evaluation of the runs -----------------------------------------------------------

RUN_SPEC = ["arm", *study.EVAL_SPEC]


@named("eval_summary")
def _(w: Workspace) -> DataFrame:
    return rounded(evaluate.eval_summary(w.run_rows(), RUN_SPEC), METRICS)


@named("eval_summary_ext")
def _(w: Workspace) -> DataFrame:
    """Candidate, label and block figures of each run beside its metrics, and how many of its stages were timed."""
    rows = w.run_results()
    timed = sum((F.col(c).isNotNull() & (F.col(c) >= 0)).cast("int") for c in rows.columns if c.startswith(results.RUNTIME_PREFIX))
    return rows.select(*RUN_SPEC, *ANY, "cp_1s", "cp_1s__nem", "labeled_1s", "labeled_0s", timed.alias("n_runtimes"),
                       *[F.round(c, 6).alias(c) for c in ("labeled_base_rate", "realized_blocked_proportion")])


@named("run_models")
def _(w: Workspace) -> DataFrame:
    """Cut and coefficients of every fitted model, a row each."""
    return w.run_models().select("arm", "spec", "framework", "budget", "sample_size", "model_iter", F.round("cut", 6).alias("cut"),
                                 *[F.round(c, 6).alias(c) for c in ("w", *runs.WEIGHTS)])


@named("label_rounds")
def _(w: Workspace) -> DataFrame:
    """What each round of labels of the active runs asked for: pairs, matches among them, and how sure the model was."""
    doubt = F.abs("match_odds")
    return w.run_labels().groupBy(*runs.ACTIVE_RUN, "round").agg(
        F.count("*").alias("n_labels"), F.sum("label").alias("n_matches"), F.sum(F.col("exact_match").cast("long")).alias("n_exact"),
        F.round(F.min(doubt), 6).alias("least_doubt"), F.round(F.max(doubt), 6).alias("most_doubt"),
        F.min("rowid1").alias("first_rowid"), F.max("rowid2").alias("last_rowid"))


@named("bootstrap_eval")
def _(w: Workspace) -> DataFrame:
    """The full number of resamples for the runs of one arm."""
    rows = w.run_rows().where(F.col("arm") == study.SUPERVISED)
    return rounded(evaluate.bootstrap_eval(rows, RUN_SPEC, ["ss_eval", "em_eval"], study.RESAMPLES), ANY)


@named("bootstrap_eval_all_arms")
def _(w: Workspace) -> DataFrame:
    return w.run_bootstraps()


# -- results and reports --------------------------------------------------------------

@named("hms_minutes")
def _(w: Workspace) -> DataFrame:
    """Seconds of the day of every event as a duration text, and back to minutes."""
    seconds = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    text = (F.when(F.col("event_id") % 5 == 0, seconds.cast("string"))
            .otherwise(F.concat_ws(":", F.hour("ts"), F.minute("ts"), F.second("ts"))))
    rows = w.source("events").select("event_id", text.alias("runtime"))
    return rounded(results.hms_minutes(rows, "runtime"), ["runtime"])


@named("runtime_columns")
def _(w: Workspace) -> DataFrame:
    """Nested statistics per user: total duration texts of two tasks, and a count to leave out."""
    events = w.source("events").groupBy("user_id").agg(
        F.sum(F.minute("ts")).alias("m"), F.sum(F.second("ts")).alias("s"), F.count("*").alias("n"))

    def text(*parts) -> Column:
        return F.concat_ws(":", *[p.cast("string") for p in parts])

    stats = events.select("user_id", F.create_map(
        F.lit("blocking"), F.create_map(F.lit("runtime__main"), text(F.lit(0), F.col("m"), F.col("s")),
                                        F.lit("n_rows"), F.col("n").cast("string")),
        F.lit("scoring"), F.create_map(F.lit("runtime_scoring__main"), text(F.col("n"), F.col("m"), F.lit(0)),
                                       F.lit("n_rows"), F.col("n").cast("string"))).alias("stats"))
    wide = results.runtime_columns(stats, ["user_id"], ["runtime__main", "runtime_scoring__main"])
    return rounded(wide, ["runtime_min", "runtime_scoring_min"])


@named("spec_from_path")
def _(w: Workspace) -> DataFrame:
    """Results written under names that spell the specification, read back with one glob."""
    folder = w.folder_for("result_files")
    name = F.concat(F.lit("result__sst_"), F.col("ss_train"), F.lit("__emt_"), F.col("em_train"), F.lit("__budget_"),
                    F.col("budget"), F.lit("__sample_size_"), F.col("sample_size"), F.when(F.col("framework") != "", F.concat(
                        F.lit("__type_"), F.col("framework"))).otherwise(F.lit("")), F.lit("__iter_"), F.col("model_iter"))
    rows = w.run_results().select(
        F.concat(F.lit("arm_"), F.col("arm"), F.lit("__"), name).alias("file"), "arm", "tpr_any", "prc_any")
    rows.write.partitionBy("file").csv(folder, header=True)
    schema = rows.drop("file").schema
    return readers.scan_results(w.spark, f"{folder}/file=arm_*", schema)


@named("write_results")
def _(w: Workspace) -> DataFrame:
    folder = w.folder_for("results_out")
    writers.write_results(w.all_results(), w.all_bootstraps(), folder)
    spec = ["algorithm", *study.EVAL_SPEC]
    results_back = w.spark.read.parquet(f"{folder}/results").select(*spec, "error_any")
    rows = w.spark.read.parquet(f"{folder}/bootstrapped_results").groupBy(*spec).agg(
        F.count("*").alias("n_resamples"), F.min("error_any").alias("lowest"))
    return results_back.join(rows, spec)


@named("collect_results")
def _(w: Workspace) -> DataFrame:
    return results.in_order(w.all_results()).select("algorithm", *study.EVAL_SPEC, *METRICS, "labeled_1s")


@named("f1_scores")
def _(w: Workspace) -> DataFrame:
    return rounded(w.all_results().select("algorithm", *study.EVAL_SPEC, "f1_any", "f1_corr"), ["f1_any", "f1_corr"])


@named("total_runtime")
def _(w: Workspace) -> DataFrame:
    # minutes differ from run to run, that they were measured does not
    return w.all_results().select("algorithm", *study.EVAL_SPEC, (F.col("runtime_min") > 0).alias("measured"))


@named("first_runs")
def _(w: Workspace) -> DataFrame:
    return results.first_runs(w.all_bootstraps(), study.RUNS_KEPT).select("algorithm", *study.EVAL_SPEC, "bs_iter", "error_any")


@named("report_input")
def _(w: Workspace) -> DataFrame:
    rows = w.report_results()
    return rows.select("task", "n_admin_rows", "algorithm", *study.EVAL_SPEC, "error_any")


@named("arm_labels")
def _(w: Workspace) -> DataFrame:
    return report.arm_labels(w.report_results()).select("intervention", *study.EVAL_SPEC)


@named("median_run")
def _(w: Workspace) -> DataFrame:
    return report.median_run(w.report_results(), report.FIGURE_GROUP, METRIC).select(
        "algorithm", *study.EVAL_SPEC, METRIC, "is_median")


@named("best_worst_run")
def _(w: Workspace) -> DataFrame:
    rows = report.arm_labels(w.report_results())
    return report.best_worst_run(rows, report.POINT_GROUP, METRIC).select(
        "intervention", *study.EVAL_SPEC, "is_best", "is_worst")


@named("worst_case_flag")
def _(w: Workspace) -> DataFrame:
    return report.point_estimates(w.report_results(), METRIC).select(
        "intervention", *study.EVAL_SPEC, "is_median", "is_worst_case_scenario")


@named("bootstrap_flags")
def _(w: Workspace) -> DataFrame:
    points = report.point_estimates(w.report_results(), METRIC)
    return report.bootstrap_flags(w.report_bootstraps(), points).select(
        "intervention", *study.EVAL_SPEC, "bs_iter", METRIC, "is_median", "is_worst_case_scenario")


COMPARED_KEYS = ["framework", "ss_train", "budget", "comparison_alg", "model_iter__optimized",
                 "model_iter__comparison", "bs_iter"]


@named("arm_comparison")
def _(w: Workspace) -> DataFrame:
    return w.over(study.COMPARED_GRID).compared().select(*COMPARED_KEYS, f"{METRIC}__optimized", f"{METRIC}__comparison")


@named("performance_difference")
def _(w: Workspace) -> DataFrame:
    return rounded(w.compared().select(*COMPARED_KEYS, "performance_difference"), ["performance_difference"])


@named("comparison_kinds")
def _(w: Workspace) -> DataFrame:
    return w.compared().select(*COMPARED_KEYS, "median_comparison", "worst_case_scenario_comparison",
                               "crossproduct_comparison")


@named("significance_test")
def _(w: Workspace) -> DataFrame:
    return rounded(report.significance_test(w.compared(), 0.05), ["performance_difference_at_pctl"], 6)


@named("share_significant")
def _(w: Workspace) -> DataFrame:
    return rounded(report.share_significant(w.tests()), ["significantly_better"])


def _report(w: Workspace) -> DataFrame:
    columns = [(s, b) for s in study.QUERY_GRID.sizes for b in study.QUERY_GRID.budgets]
    return report.significance_report(w.tests(), columns)


@named("significance_report")
def _(w: Workspace) -> DataFrame:
    return _report(w)


@named("report_sink")
def _(w: Workspace) -> DataFrame:
    folder = w.folder_for("report")
    writers.write_report(_report(w), folder)
    return w.spark.read.parquet(folder)


@named("confidence_intervals")
def _(w: Workspace) -> DataFrame:
    rows = report.confidence_intervals(w.report_results(), w.report_bootstraps())
    bounds = [f"{m}__{side}_bound" for m in report.CI_METRICS for side in ("lower", "upper")]
    return rounded(rows.select("algorithm", *study.EVAL_SPEC, *bounds), bounds, 6)


@named("figure_points")
def _(w: Workspace) -> DataFrame:
    parts = [report.figure_points(report.figure_subset(w.report_results(), defaults), ["error", "prc", "tpr"], "corr")
             .withColumn("defaults", F.lit(defaults)) for defaults in (True, False)]
    return parts[0].unionByName(parts[1])


@named("benchmark_lines")
def _(w: Workspace) -> DataFrame:
    rows = w.figure_results()
    parts = []
    for lines in ("mean", "median", "first", "all"):
        part = report.benchmark_lines(rows, METRIC, lines, study.LINKAGE, None if lines == "mean" else "all")
        for c, kind in (("model_iter", "int"), (f"{METRIC}__lower_bound", "double"), (f"{METRIC}__upper_bound", "double")):
            if c not in part.columns:
                part = part.withColumn(c, F.lit(None).cast(kind))
        parts.append(part.withColumn("lines", F.lit(lines)))
    out = reduce(DataFrame.unionByName, parts)
    return rounded(out, [METRIC, f"{METRIC}__lower_bound", f"{METRIC}__upper_bound"], 6)


@named("sample_size_means")
def _(w: Workspace) -> DataFrame:
    means = report.sample_size_means(w.report_results(), ["error", "prc", "tpr"], "any")
    return rounded(means, ["error_any", "prc_any", "tpr_any"], 6)


@named("stage_outputs")
def _(w: Workspace) -> DataFrame:
    """Block members, predicted matches and clusters as they land on disk."""
    folder = w.folder_for("stages")
    stages = {"blocks": w.members().select("rowid"), "predicted_matches": w.edges().select(F.col("rowid1").alias("rowid")),
              "predicted_clusters": w.components().select("rowid")}
    for name, df in stages.items():
        writers.write_stage(df, folder, name)
    back = [w.spark.read.parquet(f"{folder}/{name}").withColumn("stage", F.lit(name)) for name in stages]
    return reduce(DataFrame.unionByName, back).groupBy("stage", "rowid").agg(F.count("*").alias("n"))


@named("run_ledger")
def _(w: Workspace) -> DataFrame:
    """Minutes of three stages, and one run that fails."""
    folder = w.folder_for("ledger")

    def fail() -> None:
        cluster.assign_clusters(w.roles())

    for stage, action in (("block", lambda: w.members().count()), ("link", lambda: w.edges().count()),
                          ("evaluate", lambda: evaluate.eval_summary(w.linked(), []).count()), ("cluster", fail)):
        writers.timed(w.spark, folder, stage, "exact keys", action)
    # minutes and the wording of the failure differ from run to run
    return writers.scan_ledger(w.spark, folder).select(
        "stage", "spec", "failed", (F.col("minutes") >= 0).alias("timed"), F.col("message").isNotNull().alias("explained"))

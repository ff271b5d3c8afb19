"""Comparison of the arms: run flags, paired differences, tests, report and figure tables.

Groups here are runs of a study grid, so windows over them are small by construction; the
large input is the bootstrap table, which is only joined and grouped.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kithlink.functions.numbers import half_even
from kithlink.operators.results import RUNTIME_PREFIX

ACTIVE, SUPERVISED, UNSUPERVISED = "active", "supervised", "unsupervised"
DEDUPLICATION, LINKAGE = "deduplication", "record_linkage"
OPTIMIZED = f"{ACTIVE} (optimized)"
DEFAULT = f"{ACTIVE} (default)"
# Candidate sample sizes of the default and the optimised active arm.
DEFAULT_SAMPLES = {DEDUPLICATION: 1500, LINKAGE: 15000}
OPTIMIZED_SAMPLE = 150000
TREATMENT = {SUPERVISED: ["ss_train"], UNSUPERVISED: ["ss_train", "framework"],
             ACTIVE: ["ss_train", "framework", "budget"]}
COMPARISONS = {f"default_{ACTIVE}": (DEFAULT, TREATMENT[ACTIVE]),
               UNSUPERVISED: (UNSUPERVISED, TREATMENT[UNSUPERVISED]),
               SUPERVISED: (SUPERVISED, TREATMENT[SUPERVISED])}
QUESTIONS = {f"default_{ACTIVE}": "Is the optimised active arm better than the default active arm?",
             UNSUPERVISED: "Is the optimised active arm better than the unsupervised arm?",
             SUPERVISED: "Is the supervised arm better than the optimised active arm?"}
KINDS = ["Median comparison", "Worst-case comparison", "Share of all possible comparisons"]
FIGURE_GROUP = ["task", "algorithm", "framework", "ss_train", "ss_eval", "em_train", "em_eval", "budget", "sample_size"]


def report_input(df: DataFrame, task: str) -> DataFrame:
    """Runtime columns go; the task is named, the size repeated, a missing framework is ''.

    The empty text, unlike NULL, is a value that joins and groups.
    """
    return (df.drop(*[c for c in df.columns if RUNTIME_PREFIX in c])
            .withColumns({"task": F.lit(task), "n_admin_rows": F.col("ss_train"),
                          "framework": F.when(F.col("algorithm") == SUPERVISED, "")
                          .otherwise(F.col("framework"))}))


def arm_labels(df: DataFrame) -> DataFrame:
    """Runs of the default and optimised arms, with `intervention` naming the arm."""
    size = F.col("sample_size")
    default = reduce(lambda a, b: a | b, [
        (F.col("algorithm") == f"{ACTIVE} ({f})") & (size == n) for f, n in DEFAULT_SAMPLES.items()])
    arm = F.regexp_extract("algorithm", "^([a-z]+) ?", 1)
    return (df.where((size == 0) | (size == OPTIMIZED_SAMPLE) | default)
            .withColumn("intervention", F.when(size == OPTIMIZED_SAMPLE, F.concat(arm, F.lit(" (optimized)")))
                        .when(size == 0, arm).otherwise(F.concat(arm, F.lit(" (default)")))))


def _first_by(group: list[str], value: Column) -> Column:
    place = F.row_number().over(Window.partitionBy(*group).orderBy(value.asc_nulls_last(), "model_iter"))
    return (place == 1) & value.isNotNull()


def median_run(df: DataFrame, group: list[str], metric: str) -> DataFrame:
    """`is_median`: the run nearest to the median of its group, the first one on ties."""
    medians = df.groupBy(*group).agg(F.median(metric).alias("_median"))
    near = F.abs(F.col(metric) - F.col("_median"))
    return (df.join(medians, group).withColumn("_dist", near)
            .withColumn("is_median", _first_by(group, F.col("_dist"))).drop("_median", "_dist"))


def check_runs_per_group(df: DataFrame, group: list[str]) -> None:
    """No group may have more rows than there are model runs."""
    most = df.groupBy(*group).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if most > df.select("model_iter").distinct().count():
        raise ValueError(f"a group has {most} rows, more than there are model runs")


def best_worst_run(df: DataFrame, group: list[str], metric: str) -> DataFrame:
    """`is_best` and `is_worst`; low values are good when the metric is an error."""
    low, high = F.col(metric), -F.col(metric)
    best, worst = (low, high) if "error" in metric else (high, low)
    return df.withColumns({"_best": best, "_worst": worst}).withColumns({
        "is_best": _first_by(group, F.col("_best")), "is_worst": _first_by(group, F.col("_worst"))}) \
        .drop("_best", "_worst")


def worst_case_flag(df: DataFrame) -> DataFrame:
    """The optimised arm at its worst, or another arm at its best."""
    optimized = F.col("intervention") == OPTIMIZED
    return df.withColumn("is_worst_case_scenario",
                         (F.col("is_worst") & optimized) | (F.col("is_best") & ~optimized))


POINT_GROUP = ["intervention", "ss_train", "framework", "budget"]


def point_estimates(results: DataFrame, metric: str) -> DataFrame:
    return (arm_labels(results).transform(median_run, POINT_GROUP, metric)
            .transform(best_worst_run, POINT_GROUP, metric).transform(worst_case_flag)
            .drop("is_best", "is_worst"))


def bootstrap_flags(bootstraps: DataFrame, points: DataFrame) -> DataFrame:
    """Bootstrap rows of the labelled arms with the flags of their run; one flag row per run."""
    keys = [*POINT_GROUP, "model_iter"]
    flags = points.select(*keys, "is_median", "is_worst_case_scenario")
    labelled = arm_labels(bootstraps)
    flagged = labelled.join(flags, keys)
    before, after = labelled.count(), flagged.count()
    if before != after:
        raise ValueError(f"{before} bootstrap rows became {after} when their flags were attached")
    return flagged


def arm_comparison(flagged: DataFrame, metric: str) -> DataFrame:
    """Optimised arm beside each other arm, matched on that arm's treatment keys and bs_iter."""
    more = [metric, "model_iter", "is_median", "is_worst_case_scenario"]
    own = flagged.where(F.col("intervention") == OPTIMIZED).select(
        *TREATMENT[ACTIVE], "bs_iter", *[F.col(c).alias(f"{c}__optimized") for c in more])
    parts = []
    for name, (intervention, keys) in COMPARISONS.items():
        other = flagged.where(F.col("intervention") == intervention).select(
            *keys, "bs_iter", *[F.col(c).alias(f"{c}__comparison") for c in more])
        parts.append(own.join(other, [*keys, "bs_iter"], "left").withColumn("comparison_alg", F.lit(name)))
    return reduce(DataFrame.unionByName, parts)


def performance_difference(df: DataFrame, metric: str) -> DataFrame:
    """Positive when the question asked of the comparison is answered yes."""
    own, other = F.col(f"{metric}__optimized"), F.col(f"{metric}__comparison")
    if "error" in metric:
        own, other = other, own
    # the supervised arm is asked about itself, the other comparisons about the optimised arm
    return df.withColumn("performance_difference", F.when(F.col("comparison_alg") == SUPERVISED, other - own)
                         .otherwise(own - other))


def comparison_kinds(df: DataFrame) -> DataFrame:
    """Does a row belong to the median, the worst-case, the all-runs comparison?"""
    def both(flag: str) -> Column:
        return F.coalesce(F.col(f"{flag}__optimized") & F.col(f"{flag}__comparison"), F.lit(False))

    return df.withColumns({"median_comparison": both("is_median"),
                           "worst_case_scenario_comparison": both("is_worst_case_scenario"),
                           "crossproduct_comparison": F.lit(True)})


def compared_arms(flagged: DataFrame, metric: str) -> DataFrame:
    return (arm_comparison(flagged, metric).transform(performance_difference, metric)
            .transform(comparison_kinds)
            .select("framework", "ss_train", "budget", "comparison_alg", "model_iter__optimized",
                    "model_iter__comparison", "bs_iter", f"{metric}__optimized", f"{metric}__comparison",
                    "performance_difference", "median_comparison", "worst_case_scenario_comparison",
                    "crossproduct_comparison"))


def significance_test(compared: DataFrame, level: float = 0.05) -> DataFrame:
    """One-sided bootstrap test per pair of runs: is the difference at the level still positive?"""
    return (compared.where("model_iter__comparison IS NOT NULL")
            .groupBy("framework", "ss_train", "budget", "comparison_alg", "model_iter__optimized",
                     "model_iter__comparison")
            .agg(F.percentile("performance_difference", level).alias("performance_difference_at_pctl"),
                 *[F.bool_or(c).alias(c) for c in ("median_comparison", "worst_case_scenario_comparison",
                                                   "crossproduct_comparison")])
            .withColumn("significantly_better",
                        F.coalesce(F.col("performance_difference_at_pctl") > 0, F.lit(False))))


def share_significant(tests: DataFrame) -> DataFrame:
    return (tests.groupBy("framework", "ss_train", "budget", "comparison_alg")
            .agg(F.avg(F.col("significantly_better").cast("double")).alias("significantly_better")))


def significance_report(tests: DataFrame, columns: list[tuple[int, int]]) -> DataFrame:
    """Question x (size, budget) per framework and kind of comparison, as texts.

    `columns` are the (size, budget) pairs of the grid.  A table with any share strictly between
    0 and 1 is written in percent, another one with a star for yes.
    """
    yes = F.col("significantly_better").cast("double")
    keys = ["framework", "ss_train", "budget", "comparison_alg"]
    cells = (tests.where("median_comparison").select(*keys, yes.alias("v"), F.lit(KINDS[0]).alias("comparison"))
             .unionByName(tests.where("worst_case_scenario_comparison")
                          .select(*keys, yes.alias("v"), F.lit(KINDS[1]).alias("comparison")))
             .unionByName(share_significant(tests)
                          .select(*keys, yes.alias("v"), F.lit(KINDS[2]).alias("comparison")))
             .groupBy(*keys, "comparison").agg(F.avg("v").alias("v")))
    # one table per framework and kind: a few dozen cells
    in_percent = F.max((F.col("v") > 0) & (F.col("v") < 1)).over(Window.partitionBy("framework", "comparison"))
    percent = F.concat(half_even(F.col("v") * 100).cast("int").cast("string"), F.lit("%"))
    text = F.when(in_percent, percent).otherwise(F.when(F.col("v") == 1, "*").otherwise(""))
    question = F.create_map(*[F.lit(x) for kv in QUESTIONS.items() for x in kv])[F.col("comparison_alg")]

    def place(values: list[str], column: str) -> Column:
        return F.array_position(F.array(*[F.lit(v) for v in values]), F.col(column)).cast("int")

    return (cells.withColumns({"text": text, "question": question,
                               "column": F.concat_ws("_", F.col("ss_train").cast("string"), F.col("budget").cast("string"))})
            .groupBy("framework", "question", "comparison")
            .pivot("column", [f"{s}_{b}" for s, b in columns]).agg(F.first("text", ignorenulls=True))
            .withColumns({"question_order": place(list(QUESTIONS.values()), "question"),
                          "comparison_order": place(KINDS, "comparison")})
            .orderBy("framework", "question_order", "comparison_order"))


# -- figure tables --------------------------------------------------------------------

CI_METRICS = ["tpr_any", "prc_any", "tnr_any", "error_any", "f1_any"]
CI_SPEC = ["task", "algorithm", "ss_train", "ss_eval", "em_train", "em_eval", "model_iter", "framework",
           "sample_size", "budget"]
BUDGET_POSITION = {20: 1, 40: 2, 80: 3, 200: 4, 500: 5, 1000: 6}


def confidence_intervals(results: DataFrame, bootstraps: DataFrame, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Results with the bootstrap interval of each metric."""
    bounds = bootstraps.groupBy(*CI_SPEC).agg(*[
        F.percentile(m, F.array(F.lit(low), F.lit(high))).alias(m) for m in CI_METRICS])
    wide = bounds.select(*CI_SPEC, *[F.col(m)[i].alias(f"{m}__{side}_bound") for m in CI_METRICS
                                     for i, side in enumerate(("lower", "upper"))])
    return results.join(wide, CI_SPEC, "left")


def figure_subset(df: DataFrame, defaults: bool) -> DataFrame:
    """Runs a main figure shows: the default or the optimised active arm, and the other arms."""
    size = F.col("sample_size")
    if not defaults:
        return df.where(size.isin(OPTIMIZED_SAMPLE, 0))
    default = reduce(lambda a, b: a | b, [
        (F.col("algorithm") == f"{ACTIVE} ({f})") & (size == n) for f, n in DEFAULT_SAMPLES.items()])
    return df.where((size == 0) | default)


def metric_names(metrics: list[str], scope: str) -> list[str]:
    """Metric columns of a scope; there is no per-person error, the pair error stands for it."""
    return [f"{m}_{scope}".replace("error_corr", "error_pair") for m in metrics]


def _budget_position() -> Column:
    return F.create_map(*[F.lit(x) for kv in BUDGET_POSITION.items() for x in kv])[F.col("budget")]


def figure_points(df: DataFrame, metrics: list[str], scope: str) -> DataFrame:
    """Scatter rows of the active arm: budget position, and whether both labels were seen ten times."""
    enough = ~F.coalesce((F.col("labeled_1s") < 10) | (F.col("labeled_0s") < 10), F.lit(False))
    return (df.where(F.col("algorithm").contains(ACTIVE))
            .withColumns({"meets_label_requirements": enough, "budget_map": _budget_position()})
            .withColumn("framework__meets_label_requirements", F.concat_ws(
                " ", "framework", F.when(F.col("meets_label_requirements"), "True").otherwise("False")))
            .select("ss_train", "budget", "model_iter", "budget_map", "meets_label_requirements",
                    "framework__meets_label_requirements", *metric_names(metrics, scope)))


def benchmark_lines(df: DataFrame, metric: str, lines: str, framework: str, band: str | None = None) -> DataFrame:
    """Reference values per size: mean, median, first or all runs of the other two arms.

    `band` 'all' adds the bootstrap interval of each line, 'median_only' that of the median run.
    """
    rows = df.where(F.col("algorithm").isin(SUPERVISED, f"{UNSUPERVISED} ({framework})"))
    group = ["algorithm", "ss_train"]
    if lines == "mean":
        return rows.groupBy(*group).agg(F.avg(metric).alias(metric))
    if lines == "median":
        rows = rows.where("is_median")
    elif lines == "first":
        firsts = rows.groupBy(*group).agg(F.min("model_iter").alias("model_iter"))
        rows = rows.join(firsts, [*group, "model_iter"], "left_semi")
    elif lines != "all":
        raise ValueError(f"unknown benchmark lines {lines}")
    bounds = [f"{metric}__lower_bound", f"{metric}__upper_bound"]
    if band == "median_only":
        rows = rows.withColumns({b: F.when(F.col("is_median"), F.col(b)) for b in bounds})
    return rows.select(*group, "model_iter", metric, *(bounds if band else []))


def sample_size_means(df: DataFrame, metrics: list[str], scope: str) -> DataFrame:
    """Mean metrics of the active arm by budget, size and candidate sample size."""
    names = metric_names(metrics, scope)
    return (df.where(F.col("algorithm").contains(ACTIVE))
            .withColumn("specification", F.concat(F.lit("Sample size: "), F.format_number("sample_size", 0)))
            .groupBy("budget", "ss_train", "specification").agg(*[F.avg(m).alias(m) for m in names])
            .withColumn("budget_map", _budget_position()))

"""The run grid of a study: which linker runs on which data set, how often."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEDUPLICATION, LINKAGE = "deduplication", "record_linkage"
ACTIVE, SUPERVISED, UNSUPERVISED = "active", "supervised", "unsupervised"


@dataclass(frozen=True)
class GridRules:
    """The full-size grid; frameworks, budgets and candidate sample sizes apply to the active arm."""

    sizes: tuple[int, ...] = (5000, 50000, 200000)
    shares_exact: tuple[int, ...] = (50,)
    budgets: tuple[int, ...] = (20, 40, 80, 200, 500, 1000)
    frameworks: tuple[str, ...] = (DEDUPLICATION, LINKAGE)
    sample_sizes: tuple[int, ...] = (1500, 15000, 150000, 300000)
    linkage_sample_sizes: tuple[int, ...] = (15000, 150000)
    iterations: int = 10


def run_grid(spark: SparkSession, rules: GridRules) -> DataFrame:
    """One row per run; combinations that do no work are left out.  Parameters only."""
    rows = []
    for size, share, it in product(rules.sizes, rules.shares_exact, range(rules.iterations)):
        rows.append((SUPERVISED, size, share, "", 0, 0, it))
        for framework in rules.frameworks:
            rows.append((UNSUPERVISED, size, share, framework, 0, 0, it))
            for budget, sample in product(rules.budgets, rules.sample_sizes):
                if framework == DEDUPLICATION or sample in rules.linkage_sample_sizes:
                    rows.append((ACTIVE, size, share, framework, budget, sample, it))
    return spark.createDataFrame(
        rows, "arm string, ss_train int, em_train int, framework string, budget int, sample_size int, model_iter int")


def runnable(grid: DataFrame, datasets: DataFrame) -> DataFrame:
    """Runs whose evaluation sets exist, with the records of both sides.

    The counts have one row per specification and the grid is a parameter table.
    """
    counts = (datasets.groupBy(F.col("spec_n").alias("ss_train"), F.col("spec_share").alias("em_train"))
              .agg(F.count_if(F.col("dataset") == "admin_evaluation").alias("n_admin"),
                   F.count_if(F.col("dataset") == "experiment_evaluation").alias("n_experiment")))
    return grid.join(counts.where("n_admin > 0 AND n_experiment > 0"), ["ss_train", "em_train"])


# The grid the named queries run.  Its sizes leave single records over on tables of a few thousand persons, without which
# no experiment record lacks a partner; it has one more iteration than a study keeps.
QUERY_GRID = GridRules(sizes=(1000, 2000, 4000), budgets=(20, 1000), sample_sizes=(1500, 15000, 150000), iterations=6)
# The grid the arms are compared over: all budgets, samples and iterations of the study, on data sets of the same sizes.
COMPARED_GRID = GridRules(sizes=QUERY_GRID.sizes)
RUNS_KEPT = 5
RESAMPLES = 1000
EVAL_SPEC = ["ss_train", "em_train", "ss_eval", "em_eval", "framework", "budget", "sample_size", "model_iter"]


def of_data_sets(grid: DataFrame) -> DataFrame:
    """The grid with `spec`, the name of the data set a run trains and is evaluated on."""
    return grid.withColumn("spec", F.concat_ws("__", F.col("ss_train").cast("string"), F.col("em_train").cast("string")))


def evaluated_on_own(df: DataFrame) -> DataFrame:
    """A run is evaluated on the evaluation sets of the specification it was trained on."""
    return df.withColumns({"ss_eval": F.col("ss_train"), "em_eval": F.col("em_train")})

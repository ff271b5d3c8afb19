"""Results of the three arms as one table, with derived scores and runtimes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithlink.functions.dates import minutes_from_duration
from kithlink.functions.numbers import f1, nan_to_null

SORT_ORDER = ["em_train", "em_eval", "ss_train", "ss_eval", "budget", "model_iter", "algorithm", "sample_size"]
RUNTIME_PREFIX = "runtime_"


def collect_results(arms: dict[str, DataFrame]) -> DataFrame:
    """Outer union of the arms' results; `algorithm` is the arm with its framework, if it has one."""
    labelled = [
        nan_to_null(df).withColumn("algorithm", F.when(F.coalesce("framework", F.lit("")) == "", F.lit(arm))
                                   .otherwise(F.concat(F.lit(arm + " ("), F.col("framework"), F.lit(")"))))
        for arm, df in arms.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), labelled)


def f1_scores(df: DataFrame, scopes: tuple[str, ...] = ("any", "corr")) -> DataFrame:
    return df.withColumns({f"f1_{s}": f1(F.col(f"prc_{s}"), F.col(f"tpr_{s}")) for s in scopes})


def total_runtime(df: DataFrame) -> DataFrame:
    """Sum of all runtime columns, a missing stage counting as nothing."""
    parts = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in df.columns if c.startswith(RUNTIME_PREFIX)]
    return df.withColumn("runtime_min", sum(parts, F.lit(0.0)))


def in_order(df: DataFrame) -> DataFrame:
    return df.orderBy(*SORT_ORDER, *(["bs_iter"] if "bs_iter" in df.columns else []))


def first_runs(df: DataFrame, n: int = 5) -> DataFrame:
    """The first `n` model runs of every specification."""
    return df.where(F.col("model_iter") <= n - 1)


def hms_minutes(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, minutes_from_duration(F.col(column)))


def runtime_columns(stats: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """(keys, stats map of maps) to one minutes column per runtime entry.

    `names` are the entries to expect, as written in the map; `__main` becomes `_min`.
    """
    entries = (stats.select(*keys, F.explode("stats").alias("_task", "_values"))
               .select(*keys, F.explode("_values").alias("_name", "_value"))
               .where(F.col("_name").contains("runtime"))
               .withColumn("_name", F.regexp_replace("_name", "__main", "_min"))
               .withColumn("_value", minutes_from_duration(F.col("_value"))))
    wanted = [n.replace("__main", "_min") for n in names]
    return entries.groupBy(*keys).pivot("_name", wanted).agg(F.max("_value"))

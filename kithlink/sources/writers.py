"""Sinks of the stages: datasets, stage outputs, results, reports and the run ledger."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithlink.operators.profile import STAT_COLUMNS

LEDGER_SCHEMA = "stage string, spec string, minutes double, failed boolean, message string, at timestamp"


def dataset_rows(df: DataFrame) -> DataFrame:
    """Person columns with role and specification; only training data keeps the known id."""
    kept = df.drop(*[c for c in STAT_COLUMNS if c in df.columns])
    return kept.withColumn("uid_sid", F.when(F.col("dataset") == "admin_training", F.col("uid_sid")))


def write_datasets(df: DataFrame, folder: str) -> None:
    dataset_rows(df).write.mode("overwrite").partitionBy("dataset", "spec").parquet(folder)


def write_csv(df: DataFrame, folder: str) -> None:
    """CSV with a header; blanks at the ends of a text stay."""
    df.write.mode("overwrite").csv(folder, header=True, ignoreLeadingWhiteSpace=False,
                                   ignoreTrailingWhiteSpace=False)


def write_stage(df: DataFrame, folder: str, name: str) -> None:
    """Predicted clusters, predicted matches, label log or block members of one stage."""
    df.write.mode("overwrite").parquet(f"{folder}/{name}")


def write_results(results: DataFrame, bootstraps: DataFrame, folder: str) -> None:
    """Results and their bootstrap rows as two tables."""
    results.write.mode("overwrite").parquet(f"{folder}/results")
    bootstraps.write.mode("overwrite").parquet(f"{folder}/bootstrapped_results")


def write_report(report: DataFrame, folder: str) -> None:
    """One folder per framework."""
    report.write.mode("overwrite").partitionBy("framework").parquet(folder)


def append_ledger(spark: SparkSession, folder: str, stage: str, spec: str, minutes: float,
                  error: str | None = None) -> None:
    row = spark.createDataFrame([(stage, spec, minutes, error is not None, error)],
                                "stage string, spec string, minutes double, failed boolean, message string")
    row.withColumn("at", F.current_timestamp()).write.mode("append").parquet(folder)


def timed(spark: SparkSession, folder: str, stage: str, spec: str, action: Callable[[], None]) -> None:
    """Run one action and append its minutes; a failure is a ledger row, not a lost study."""
    start = time.monotonic()
    error = None
    try:
        action()
    except Exception as e:  # the ledger keeps the reason and the other runs go on
        error = f"{type(e).__name__}: {str(e)[:200]}"
    append_ledger(spark, folder, stage, spec, (time.monotonic() - start) / 60, error)


def scan_ledger(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(LEDGER_SCHEMA).parquet(folder)

"""Session settings the operators are written for; a cluster may set its own."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cpus: str = "8", app: str = "kithlink") -> SparkSession:
    """A local session for tests and the benchmark."""
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName(app)
             .config("spark.driver.memory", "16g")
             .config("spark.ui.enabled", "false")
             .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.sql.adaptive.skewJoin.enabled", "true")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.sql.execution.arrow.pyspark.enabled", "true")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark

"""Vectors that take part in a search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithlink.operators.scale import staged


def usable(table: DataFrame, vec_id: str, vector: str, zero: bool) -> DataFrame:
    """vec_id long, v array<double>: rows with an id and a vector whose components are all finite numbers.

    Zero vectors are left out unless `zero`.  Vectors of another length than most (ties: the longer)
    cannot be compared and are left out.  Of rows that repeat an id, one of the vectors speaks for it.
    """
    v = F.col(vector).cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = (table.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v"))
            .where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & F.coalesce(finite, F.lit(False))))
    if not zero:
        rows = rows.where(F.exists("v", lambda x: x != 0))
    rows = staged(rows.groupBy("vec_id").agg(F.min("v").alias("v")), "vectors")
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return rows.where(F.size("v") == (lengths.d if lengths else 0))

"""A bounded sample of labelled documents for fitting a classifier."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kithlink.llm.common import documents_only


def remainder(doc_id: str, parts: int) -> Column:
    """crc32 of the id's text, modulo `parts`; a null id counts as 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts, F.lit(0))


def log_odds(labels: DataFrame, label: str, fold: Column) -> float:
    """Of label 1 among the admitted labels; a fit on equally many of both classes is shifted by it."""
    n = {r.y: r.n for r in labels.where(fold).groupBy(F.col(label).cast("int").alias("y")).agg(F.count("*").alias("n")).collect()}
    return math.log((n.get(1, 0) + 1) / (n.get(0, 0) + 1))


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, fold: Column) -> DataFrame:
    """Up to `per_class` labelled documents of each class that `fold` admits: doc_id, text, y.

    Taken in the order of a hash of the id, so the sample is spread over the table and the same on
    every run.  Labels other than 0 and 1, and null ids, take no part.
    """
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
             .where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & fold)
             .groupBy("doc_id").agg(F.max("y").alias("y")))
    chosen = reduce(DataFrame.unionByName, [
        known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)])
    # at most two classes of per_class rows
    return documents_only(docs).join(F.broadcast(chosen), "doc_id")

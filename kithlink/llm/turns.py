"""Places of turns in their conversations, without one task per conversation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kithlink.operators.scale import staged


def placed_turns(turns: DataFrame, conv: str, order: Sequence[str], keep: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The turns in the order of (conv, *order), nulls first, and the spans of each conversation.

    Rows: conv, *keep, _at (grows with the order), _part.  Spans: conv, _part, _n (rows there) and _shift; a row is the
    (_at + _shift)th of its conversation, from 1, with the _shift of its span.  Rows are dealt by ranges, so a
    conversation of any length is cut wherever a range ends, and the spans of one are as many as ranges at most.
    """
    rows = staged(turns.repartitionByRange(conv, *order).sortWithinPartitions(conv, *order)
                  .withColumn("_at", F.monotonically_increasing_id()).select(conv, *keep, "_at"), "turns")
    rows = rows.withColumn("_part", F.shiftright("_at", 33))
    spans = rows.groupBy(conv, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(conv).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return rows, spans.select(conv, "_part", "_n", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift"))

"""Chat formatting by perspective rotation: a dialogue once per participant.

In each rendering one participant is the assistant, the others are users with their names, and
the loss mask covers what the assistant says with its end mark.  The renderings are kept as one
row per turn and perspective with its place in the whole, so a dialogue of any length is never
one row or one task; the rendered dialogue is its segments in the order of `start`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

OPEN, NAME, BODY, CLOSE = "<|", " name=", "|>\n", "<|end|>\n"
SYSTEM = "system"
UNNAMED = "unknown"
# Turns whose places are summed before the sums of such blocks are.
BLOCK_TURNS = 64


def _speaker(role: str) -> Column:
    named = F.trim(F.coalesce(F.col(role).cast("string"), F.lit("")))
    return F.when(named == "", F.lit(UNNAMED)).otherwise(named)


def rotate_perspectives(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                        text: str = "text") -> DataFrame:
    """One row per turn and perspective: conv_id, perspective, turn, seq, shown_as, speaker, segment,
    start, length, mask_start, mask_length (characters of the rendered dialogue; the mask is 0 long
    for turns of others).

    A participant is a distinct speaker other than "system"; system turns stand as such in every
    rendering and are masked out.  A dialogue of system turns alone has no participant and no row.
    Null or blank roles speak as "unknown", null texts are empty, turns without a number come last,
    equal turns go by speaker and text, and repeated rows are kept.  Rows without a conversation id
    form one dialogue with a null id.  Other columns are not looked at.  An empty table gives no rows.
    """
    said = turns.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), _speaker(role).alias("speaker"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("said"))
    people = (said.where(F.col("speaker") != SYSTEM).select("conv_id", F.col("speaker").alias("perspective")).distinct()
              .withColumnRenamed("conv_id", "_conv"))
    own = F.col("speaker") == F.col("perspective")
    shown = F.when(own, F.lit("assistant")).when(F.col("speaker") == SYSTEM, F.lit(SYSTEM)).otherwise(F.lit("user"))
    named = F.when(F.col("shown_as") == "user", F.concat(F.lit(NAME), F.col("speaker"))).otherwise(F.lit(""))
    body = F.concat("said", F.lit(CLOSE))
    rows = (said.join(people, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
            .withColumn("shown_as", shown)
            .withColumn("_head", F.concat(F.lit(OPEN), F.col("shown_as"), named, F.lit(BODY)))
            .withColumn("segment", F.concat("_head", body))
            .withColumn("length", F.length("segment").cast("long"))
            .withColumn("_block", F.coalesce(F.floor(F.col("turn") / BLOCK_TURNS), F.lit((1 << 62)))))
    # places: inside a block of turns, then over the blocks of a rendering
    order = [F.col("turn").asc_nulls_last(), "speaker", "said"]
    inside = Window.partitionBy("conv_id", "perspective", "_block").orderBy(*order)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    blocks = (rows.groupBy("conv_id", "perspective", "_block")
              .agg(F.sum("length").alias("_chars"), F.count("*").alias("_turns")))
    over = Window.partitionBy("conv_id", "perspective").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col("conv_id").alias("_c"), F.col("perspective").alias("_p"), F.col("_block").alias("_b"),
                           F.coalesce(F.sum("_chars").over(over), F.lit(0)).alias("_chars_before"),
                           F.coalesce(F.sum("_turns").over(over), F.lit(0)).alias("_turns_before"))
    placed = (rows.withColumn("_in", F.coalesce(F.sum("length").over(before), F.lit(0)))
              .withColumn("_nth", F.row_number().over(inside))
              .join(blocks, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("perspective") == F.col("_p"))
                    & (F.col("_block") == F.col("_b"))))
    start = F.col("_chars_before") + F.col("_in")
    return placed.select(
        "conv_id", "perspective", "turn", (F.col("_turns_before") + F.col("_nth") - 1).alias("seq"), "shown_as", "speaker",
        "segment", start.alias("start"), "length",
        (start + F.length("_head")).alias("mask_start"),
        F.when(own, F.length(body)).otherwise(0).cast("long").alias("mask_length"))

"""Conversation structure repair: the cheapest edits that make a conversation's roles read `(s?(ua)+)?`.

Conversations are cut into segments of turns.  A segment's symbols go block by block through the
tables of `block_tables`; what a conversation of many segments costs from each state on, and the
state each segment starts in, are worked out over segments of segments.  Every segment is then
traced on its own: the vectors at its block borders come by lookup from the back, each block is
expanded backward, and edits are chosen front to back.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kithlink.llm import block_tables as tables
from kithlink.llm.turns import placed_turns
from kithlink.operators.scale import lookup, staged

# Turns of a segment, and segments (of segments) put together in one group.
SEGMENT = 2048
GROUP = 512
# Above this many rows, those of one repeated turn are spread over tasks.
HOT_ROWS = 10_000
BLANKS = " \t\n\x0b\x0c\r"
STOPS = ".!?"
# A null stands for one space; no id reads like that.
NULL = " "
NOTHING = sha256(b"").hexdigest()
_LEGAL = {"su", "ua", "au"}


def _said(turns: DataFrame) -> DataFrame:
    text = [F.coalesce(F.col(c).cast("string"), F.lit(NULL)).alias(c) for c in ("role", "text")]
    return turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *text)


def damage(turns: DataFrame) -> DataFrame:
    """The rows with planted faults, by crc32 of `conv_id:turn` modulo 20 (nulls: one space): 0 drops a row, 1 empties
    its text, 2 takes . ! ? out of it, 3 repeats the row, 4 makes its role user.  Equal rows have equal faults."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(NULL)) for c in ("conv_id", "turn")])
    rows = _said(turns).withColumn("_kind", F.crc32(key.cast("binary")) % 20).where("_kind <> 0")
    text = F.when(F.col("_kind") == 1, F.lit("")).when(F.col("_kind") == 2, F.translate("text", STOPS, "")).otherwise(F.col("text"))
    return (rows.withColumn("text", text).withColumn("role", F.when(F.col("_kind") == 4, F.lit("user")).otherwise(F.col("role")))
            .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.when(F.col("_kind") == 3, 2).otherwise(1))))
            .drop("_kind", "_copy"))


def _symbols(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """conv, at, pos, role (s u a o), and the first fault of each turn."""
    placed = (rows.join(spans.drop("_n"), ["conv", "_part"])
              .select("conv", F.col("_at").alias("at"), (F.col("_at") + F.col("_shift")).alias("pos"), "initial", "last", "said"))
    again = (placed.groupBy("conv", "said").agg(F.min("pos").alias("first"), F.count("*").alias("_rows")).where("_rows > 1"))
    known = lookup(placed, again, ["conv", "said"], F.col("pos"), rows_col="_rows", hot_rows=HOT_ROWS)
    fault = (F.when(F.col("last") == "", F.lit("blank")).when(F.col("first") < F.col("pos"), F.lit("duplicate"))
             .when(~F.col("last").isin(*STOPS), F.lit("truncated")).otherwise(F.lit("")))
    role = F.array_position(F.array(*map(F.lit, "sua")), F.col("initial"))
    place = F.when(role == 0, len(tables.ROLES) - 1).otherwise(role - 1)
    return known.select("conv", "at", "pos", fault.alias("fault"), F.substring(F.lit(tables.ROLES), place.cast("int") + 1, F.lit(1)).alias("role"),
                        F.when(fault.isin("blank", "duplicate"), 0)
                        .otherwise(1 + 2 * place + F.when(fault == "truncated", 1).otherwise(0)).cast("int").alias("symbol"))


def _segments(turns: DataFrame, size: int) -> DataFrame:
    """conv, seg, last, symbols, roles, ats, next_role: the turns of each segment in order."""
    seg = F.floor((F.col("pos") - 1) / size)
    rows = (turns.groupBy("conv", seg.cast("long").alias("seg"))
            .agg(F.sort_array(F.collect_list(F.struct("pos", "at", "symbol", "role"))).alias("rows")))
    # one row per segment of a conversation
    order = Window.partitionBy("conv").orderBy("seg")
    return (rows.select("conv", "seg", F.col("rows.symbol").alias("symbols"), F.array_join("rows.role", "").alias("roles"), F.col("rows.at").alias("ats"))
            .withColumn("next_role", F.coalesce(F.lead(F.substring("roles", 1, 1)).over(order), F.lit("")))
            .withColumn("last", F.col("next_role") == ""))


def _costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    t = tables.tables()
    for batch in batches:
        costs = [sum(t.costs(np.array(s, np.int64)), []) for s in batch.column("symbols").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("seg"), pa.array(costs, pa.list_(pa.int64()))], ["conv", "seg", "costs"])


def _matrices(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.int64).reshape(-1, tables.STATES, tables.STATES)


def _grouped(parts: DataFrame) -> DataFrame:
    return parts.withColumn("grp", F.floor(F.col("seg") / GROUP).cast("long"))


def _rights(parts: DataFrame) -> DataFrame:
    """conv, seg, right: the least costs of all that follows a segment, from (conv, seg, costs)."""
    parts = staged(parts, "segment-costs")
    if (parts.agg(F.max("seg")).first()[0] or 0) == 0:
        return parts.select("conv", "seg", F.array(*[F.lit(c).cast("long") for c in tables.END]).alias("right"))

    def together(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("seg")
        total = None
        for m in _matrices(frame["costs"]):
            total = m if total is None else np.minimum(tables.NEVER, (total[:, :, None] + m[None]).min(1))
        return pd.DataFrame({"conv": frame["conv"].iloc[:1], "seg": frame["grp"].iloc[:1], "costs": [total.ravel().tolist()]})

    above = _rights(_grouped(parts).groupBy("conv", "grp").applyInPandas(together, "conv string, seg long, costs array<long>"))

    def back(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("seg", ascending=False)
        right, out = np.array(frame["right"].iloc[0], np.int64), []
        for m in _matrices(frame["costs"]):
            out.append(right.tolist())
            right = np.minimum(tables.NEVER, (m + right[None]).min(1))
        return pd.DataFrame({"conv": frame["conv"], "seg": frame["seg"], "right": out})

    return (_grouped(parts).join(above.withColumnRenamed("seg", "grp"), ["conv", "grp"])
            .groupBy("conv", "grp").applyInPandas(back, "conv string, seg long, right array<long>"))


def _starts(parts: DataFrame) -> DataFrame:
    """conv, seg, start: the state each segment starts in, from (conv, seg, goes), the state behind it by the state before."""
    parts = staged(parts, "segment-states")
    if (parts.agg(F.max("seg")).first()[0] or 0) == 0:
        return parts.select("conv", "seg", F.lit(tables.START).alias("start"))

    def together(frame: pd.DataFrame) -> pd.DataFrame:
        state = list(range(tables.STATES))
        for goes in frame.sort_values("seg")["goes"]:
            state = [int(goes[s]) for s in state]
        return pd.DataFrame({"conv": frame["conv"].iloc[:1], "seg": frame["grp"].iloc[:1], "goes": [state]})

    above = _starts(_grouped(parts).groupBy("conv", "grp").applyInPandas(together, "conv string, seg long, goes array<int>"))

    def forth(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("seg")
        state, out = int(frame["start"].iloc[0]), []
        for goes in frame["goes"]:
            out.append(state)
            state = int(goes[state])
        return pd.DataFrame({"conv": frame["conv"], "seg": frame["seg"], "start": out})

    return (_grouped(parts).join(above.withColumnRenamed("seg", "grp"), ["conv", "grp"])
            .groupBy("conv", "grp").applyInPandas(forth, "conv string, seg long, start int"))


def _goes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    t = tables.tables()
    for batch in batches:
        out = []
        for symbols, right in zip(batch.column("symbols").to_pylist(), batch.column("right").to_pylist()):
            vector = t.known(right)
            out.append([t.trace(np.array(symbols, np.int64), vector, s)[1] for s in range(tables.STATES)])
        yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("seg"), pa.array(out, pa.list_(pa.int32()))], ["conv", "seg", "goes"])


_TRACED = "conv string, seg long, audit string, cost long, illegal long, ats array<long>, edits array<string>"


def _trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per segment its edits; per turn 'roles inserted before|letter and role|roles inserted behind'."""
    t = tables.tables()
    for batch in batches:
        audits, costs, illegal, edits = [], [], [], []
        for symbols, roles, next_role, right, state in zip(*(batch.column(c).to_pylist() for c in ("symbols", "roles", "next_role", "right", "start"))):
            done, end = t.trace(np.array(symbols, np.int64), t.known(right), state)
            behind = "" if next_role else t.closing(end)
            audit = "".join(letters for letters, _, _ in done) + "I" * len(behind)
            truncated = sum(1 for s, (letters, _, _) in zip(symbols, done) if s and s % 2 == 0 and letters[-1] != "D")
            audits.append(audit)
            costs.append(tables.REROLE * audit.count("R") + tables.DELETE * audit.count("D") + tables.INSERT * audit.count("I")
                         + tables.TRUNCATED * truncated)
            row = roles + next_role
            illegal.append(sum(row[i:i + 2] not in _LEGAL for i in range(len(row) - 1)))
            said = [f"{inserted}|{letters[-1]}{tables.ROLE_INTO.get(to, '')}|" for letters, inserted, to in done]
            said[-1] += behind
            edits.append(said)
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv"), batch.column("seg"), pa.array(audits, pa.string()), pa.array(costs, pa.int64()), pa.array(illegal, pa.int64()),
             batch.column("ats"), pa.array(edits, pa.list_(pa.string()))], ["conv", "seg", "audit", "cost", "illegal", "ats", "edits"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's lines, newline-joined, for rows sorted by conversation and place."""
    key, running = None, None
    for batch in batches:
        done = []
        for conv, line in zip(batch.column("conv").to_pylist(), batch.column("lines")):
            if conv == key:
                running.update(b"\n")
            else:
                if key is not None:
                    done.append((key, running.hexdigest()))
                key, running = conv, sha256()
            running.update(line.as_py().encode())
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], pa.string()) for i in (0, 1)], ["conv", "sha"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], pa.string()) for v in (key, running.hexdigest())], ["conv", "sha"])


def _inserted(roles: Column) -> Column:
    """Lines of inserted turns, from their initials."""
    return F.transform(F.filter(F.split(roles, ""), lambda r: r != ""), lambda r: F.when(r == "u", F.lit("user:")).otherwise(F.lit("assistant:")))


def repair(turns: DataFrame, segment: int = SEGMENT) -> tuple[DataFrame, DataFrame]:
    """(reports, edits): per conversation what is wrong and the cheapest edits, per turn what becomes of it.

    reports: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.
    edits: conv_id, at (grows with the order), role, text, edit, lines (the repaired `role:text` that stand for the turn
    with those inserted around it, newline-joined; null if there are none).

    Turns go by number, those without one first; equal numbers by role, then text.  Null roles and texts are one
    space; rows without a conv_id are one conversation with a null id.  Repeated rows count as duplicates, texts
    of any length count whole, other columns are not looked at, and an empty table gives no rows.
    A digest reads a conversation's text in order, so the repaired text of one conversation goes through one
    task, which keeps only the digest's state; everything else splits long conversations.
    """
    said = _said(turns).withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit(NULL))).drop("conv_id")
    size = F.octet_length("role").cast("string")
    said = (said.withColumn("initial", F.substring("role", 1, 1))
            .withColumn("last", F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1)))
            .withColumn("said", F.md5(F.concat(size, F.lit(":"), "role", "text").cast("binary"))))
    rows, spans = placed_turns(said, "conv", ["turn", "role", "text"], ["turn", "role", "text", "initial", "last", "said"])
    symbols = staged(_symbols(rows, staged(spans, "spans")), "symbols")
    segments = staged(_segments(symbols, segment), "segments")
    # conversations of one segment end with it; the others are put together over their segments
    many = segments.where((F.col("seg") > 0) | ~F.col("last"))
    if many.isEmpty():
        ready = segments.withColumn("right", F.array(*[F.lit(c).cast("long") for c in tables.END])).withColumn("start", F.lit(tables.START))
    else:
        rights = staged(_rights(many.select("conv", "seg", "symbols").mapInArrow(_costs, "conv string, seg long, costs array<long>")), "rights")
        goes = many.join(rights, ["conv", "seg"]).select("conv", "seg", "symbols", "right").mapInArrow(_goes, "conv string, seg long, goes array<int>")
        found = rights.join(_starts(goes), ["conv", "seg"])
        ready = (segments.join(found, ["conv", "seg"], "left")
                 .withColumn("right", F.coalesce("right", F.array(*[F.lit(c).cast("long") for c in tables.END])))
                 .withColumn("start", F.coalesce("start", F.lit(tables.START))))
    traced = staged(ready.select("conv", "seg", "symbols", "roles", "next_role", "ats", "right", "start").mapInArrow(_trace, _TRACED), "traced")
    each = traced.select("conv", F.explode(F.arrays_zip("ats", "edits")).alias("_e")).select("conv", F.col("_e.ats").alias("_at"), F.col("_e.edits").alias("edit"))
    parts = F.split("edit", r"\|")
    now = F.when(F.substring(parts[1], 1, 1) == "R", F.when(F.substring(parts[1], 2, 1) == "u", F.lit("user")).otherwise(F.lit("assistant"))).otherwise(F.col("role"))
    own = F.when(F.substring(parts[1], 1, 1) == "D", F.array().cast("array<string>")).otherwise(F.array(F.concat(now, F.lit(":"), F.col("text"))))
    lines = F.concat(_inserted(parts[0]), own, _inserted(parts[2]))
    edits = (rows.select("conv", "_at", "role", "text").join(each, ["conv", "_at"])
             .select("conv", F.col("_at").alias("at"), "role", "text", "edit", F.when(F.size(lines) > 0, F.array_join(lines, "\n")).alias("lines")))
    digests = (edits.where(F.col("lines").isNotNull()).select("conv", "at", "lines").repartition("conv").sortWithinPartitions("conv", "at")
               .select("conv", "lines").mapInArrow(_digests, "conv string, sha string"))
    numbers = (rows.where(F.col("turn").isNotNull()).select("conv", "turn").distinct().groupBy("conv")
               .agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps")))
    faults = symbols.groupBy("conv").agg(*[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")])
    sums = traced.groupBy("conv").agg(
        F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seg", "audit"))), lambda s: s["audit"]), "").alias("audit"))
    reports = (faults.join(sums, "conv").join(numbers, "conv", "left").join(digests, "conv", "left")
               .select(_id(), F.coalesce("gaps", F.lit(0)).alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit",
                       F.coalesce("sha", F.lit(NOTHING)).alias("repaired_sha256")))
    return reports, edits.select(_id(), "at", "role", "text", "edit", "lines")


def _id() -> Column:
    return F.when(F.col("conv") != NULL, F.col("conv")).cast("long").alias("conv_id")


def repair_damaged(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """The reports on conversations after `damage`; those it leaves without rows have zeros and no edits."""
    reports, _ = repair(damage(turns), segment)
    every = turns.select(F.col("conv_id").cast("long").alias("_id")).distinct()
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return (every.join(reports, F.col("_id").eqNullSafe(F.col("conv_id")), "left")
            .select(F.col("_id").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"),
                    F.coalesce("repaired_sha256", F.lit(NOTHING)).alias("repaired_sha256")))

"""Link and pair metrics per specification, and their paired bootstrap.

All pairs of experiment and admin records of one person or one cluster are counted, never
listed: records are first summed per (specification, person, cluster), and every metric is a
sum over those cells.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kithlink.functions.numbers import ratio
from kithlink.functions.seeded import hash_mod
from kithlink.operators.cluster import ADMIN_ROLE, EXPERIMENT_ROLE
from kithlink.operators.scale import dense_number, lookup, staged

# Fixed value: first seed of the bootstrap; draw i uses this plus i.
BOOTSTRAP_SEED = 333
SLOTS_PER_ROW = 4096
DRAWS_PER_TASK = 4_000_000
PATTERNS_PER_BUCKET = 2_000
# Records, and cells of patterns x runs, up to which every task of a bootstrap holds the outcomes.
HELD_CELLS = 2_000_000


def _numbered_runs(df: DataFrame, spec: list[str]) -> DataFrame:
    """(spec, _run): a number per specification, so that records are shuffled by one integer.

    One row per run of the study grid.
    """
    every = Window.partitionBy(F.lit(1)).orderBy(*spec)
    return staged(df.select(*spec).distinct().withColumn("_run", F.row_number().over(every)), "runs")


def _with_run(df: DataFrame, runs: DataFrame, spec: list[str]) -> DataFrame:
    named = runs.select("_run", *[F.col(c).alias(f"_of_{c}") for c in spec])
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in spec]
    return df.join(F.broadcast(named), same).drop(*[f"_of_{c}" for c in spec])


def _person_facts(df: DataFrame, spec: list[str]) -> DataFrame:
    """One row per (specification, person) with everything the metrics are sums of."""
    experiment = F.col("dataset") == EXPERIMENT_ROLE
    admin = F.col("dataset") == ADMIN_ROLE
    cells = (df.where(experiment | admin)
             .groupBy(*spec, "sid", F.when(F.col("cluster_id") >= 0, F.col("cluster_id")).alias("cluster"))
             .agg(F.count_if(experiment).alias("e"), F.count_if(admin).alias("a")))
    linked = cells.where(F.col("cluster").isNotNull())
    clusters = linked.groupBy(*spec, "cluster").agg(
        F.sum("e").alias("cluster_e"), F.sum("a").alias("cluster_a"), F.count("*").alias("cells"),
        F.min(F.when(F.col("a") > 0, F.col("sid"))).alias("first_sid"),
        F.max(F.when(F.col("a") > 0, F.col("sid"))).alias("last_sid"))
    placed = lookup(linked, clusters, [*spec, "cluster"], F.col("sid"), how="inner", rows_col="cells")
    # unlinked records meet nobody; they stay out of the join, where they would be one hot key
    loose = cells.where(F.col("cluster").isNull()).withColumns({
        "cluster_e": F.lit(0), "cluster_a": F.lit(0), "cells": F.lit(0),
        "first_sid": F.lit(None).cast("string"), "last_sid": F.lit(None).cast("string")})
    made = (F.col("e") > 0) & (F.col("cluster_a") > 0)
    right = (F.col("first_sid") == F.col("sid")) & (F.col("last_sid") == F.col("sid"))
    return placed.unionByName(loose).groupBy(*spec, "sid").agg(
        F.sum("e").alias("e"), F.sum("a").alias("a"),
        F.sum(F.when(F.col("cluster_a") > 0, F.col("e")).otherwise(0)).alias("e_linked"),
        F.sum(F.when(F.col("cluster_e") == 0, F.col("a")).otherwise(0)).alias("a_unlinked"),
        F.sum(F.when(F.col("cluster").isNotNull(), F.col("e") * F.col("a")).otherwise(0)).alias("pairs_right"),
        F.sum(F.col("a") * F.col("cluster_e")).alias("pairs_made"),
        (F.min("cluster") == F.max("cluster")).alias("one_cluster"),
        F.max(F.col("cluster").isNull()).alias("any_loose"),
        F.max(made).alias("any_made"),
        F.min(F.when(made, right)).alias("all_right"))


def _total(value: Column, where: Column | None = None) -> Column:
    return F.sum(value if where is None else F.when(where, value).otherwise(0))


def _metric_columns() -> dict[str, Column]:
    e, a, linked = F.col("e"), F.col("a"), F.col("e_linked")
    expected = a > 0
    both = (e > 0) & (a > 0)
    found_all = F.coalesce(F.col("one_cluster") & ~F.col("any_loose"), F.lit(False))
    return {
        "tpr_any": ratio(_total(linked, expected), _total(e, expected)),
        "prc_any": ratio(_total(linked, expected), _total(linked)),
        "tnr_any": ratio(_total(e - linked, ~expected), _total(e, ~expected)),
        "acc_any": ratio(_total(F.when(expected, linked).otherwise(e - linked)), _total(e)),
        "tpr_corr": F.avg(F.when(both, found_all.cast("double"))),
        "prc_corr": F.avg(F.when(F.col("any_made"), F.col("all_right").cast("double"))),
        "tpr_pair": ratio(_total(F.col("pairs_right")), _total(e * a)),
        "prc_pair": ratio(_total(F.col("pairs_right")), _total(F.col("pairs_made"))),
        "tnr_pair": ratio(_total(F.col("a_unlinked"), e == 0), _total(a, e == 0)),
    }


def metrics(df: DataFrame, spec: list[str], names: list[str] | None = None) -> DataFrame:
    """Chosen metrics per specification; records need sid, dataset and cluster_id."""
    columns = _metric_columns()
    chosen = [columns[n].alias(n) for n in (names or list(columns))]
    if not spec:
        return _person_facts(df, []).agg(*chosen)
    runs = _numbered_runs(df, spec)
    rows = _with_run(df.select(*spec, "rowid", "sid", "dataset", "cluster_id"), runs, spec).drop(*spec)
    return _person_facts(rows, ["_run"]).groupBy("_run").agg(*chosen) \
        .join(F.broadcast(runs), "_run").drop("_run")


def with_error_rates(df: DataFrame, scopes: tuple[str, ...] = ("any", "pair")) -> DataFrame:
    """False positive rate, false negative rate and their sum from tnr and tpr."""
    for s in scopes:
        df = df.withColumns({f"fpr_{s}": 1 - F.col(f"tnr_{s}"), f"fnr_{s}": 1 - F.col(f"tpr_{s}")}) \
               .withColumn(f"error_{s}", F.col(f"fpr_{s}") + F.col(f"fnr_{s}"))
    return df


def eval_summary(df: DataFrame, spec: list[str]) -> DataFrame:
    """One row per specification, all specifications in one job."""
    return metrics(df, spec).transform(with_error_rates).select(
        *spec, "tpr_any", "prc_any", "tnr_any", "error_any", "acc_any", "tpr_corr", "prc_corr",
        "tpr_pair", "prc_pair", "tnr_pair", "error_pair")


def attach_run_columns(summary: DataFrame, runs: DataFrame, spec: list[str]) -> DataFrame:
    """Candidate, label and runtime columns of each run beside its metrics."""
    return summary.join(runs, spec, "left")


def experiment_outcomes(df: DataFrame, spec: list[str]) -> DataFrame:
    """Per experiment record: does it have a partner in admin, and was it linked to admin?"""
    admin = df.where(F.col("dataset") == ADMIN_ROLE)
    rows = df.where(F.col("dataset") == EXPERIMENT_ROLE).select(*spec, "rowid", "sid", "cluster_id")
    with_sid = admin.select(*spec, "sid").distinct().withColumn("in_admin", F.lit(True))
    with_cluster = (admin.where(F.col("cluster_id") >= 0).select(*spec, "cluster_id").distinct()
                    .withColumn("pred_in_admin", F.lit(True)))
    known = lookup(rows, with_sid, [*spec, "sid"], F.col("rowid"))
    linked = lookup(known.where(F.col("cluster_id") >= 0), with_cluster, [*spec, "cluster_id"], F.col("rowid"))
    loose = known.where(~(F.col("cluster_id") >= 0) | F.col("cluster_id").isNull()) \
                 .withColumn("pred_in_admin", F.lit(None).cast("boolean"))
    return linked.unionByName(loose).select(
        *spec, "rowid", "sid", F.coalesce("in_admin", F.lit(False)).alias("in_admin"),
        F.coalesce("pred_in_admin", F.lit(False)).alias("pred_in_admin"))


def _place(bs_iter: Column, slot: Column, n: Column, seed: int) -> Column:
    """The record drawn for a slot of an iteration, out of 0..n-1."""
    return hash_mod(F.md5(F.concat_ws(":", (bs_iter + seed).cast("string"), slot.cast("string")).cast("binary")), n)


def _draws(sizes: DataFrame, data: list[str], iters: int, seed: int) -> DataFrame:
    """(data set, bs_iter, slot rank): n draws with replacement out of 0..n-1 per iteration.

    The chunks are few small rows that each expand to thousands of draws, so the number of
    partitions follows the draws and not the size of the rows that are shuffled.
    """
    total = (sizes.agg(F.sum("n")).first()[0] or 0) * iters
    partitions = max(sizes.sparkSession.sparkContext.defaultParallelism, -(-total // DRAWS_PER_TASK))
    chunks = (sizes.withColumn("bs_iter", F.explode(F.sequence(F.lit(0), F.lit(iters - 1))))
              .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / SLOTS_PER_ROW))))
              .repartition(partitions, "bs_iter", "chunk"))
    first = F.col("chunk") * SLOTS_PER_ROW
    last = F.least(first + SLOTS_PER_ROW, F.col("n")) - 1
    slots = chunks.withColumn("slot", F.explode(F.sequence(first, last)))
    return slots.select(*data, "bs_iter", _place(F.col("bs_iter"), F.col("slot"), F.col("n"), seed).alias("place"))


def _count_outcomes(drawn: DataFrame, patterns: DataFrame, data: list[str]) -> DataFrame:
    """(_run, bs_iter, n0..n3): draws per run and outcome code.

    Draw counts (iterations x patterns) times outcome indicators (patterns x runs) is a matrix
    product; it is cut along the patterns into buckets of bounded size and the parts are summed.
    """
    buckets = max(1, -(-patterns.count() // PATTERNS_PER_BUCKET))
    bucket = F.pmod(F.xxhash64(*data, "_pattern"), F.lit(buckets))
    keys = [*data, "_bucket"]

    def product(draws: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if draws.empty:
            return pd.DataFrame({c: [] for c in ("_run", "bs_iter", "n0", "n1", "n2", "n3")})
        place = pd.Series(np.arange(len(known)), index=known["_pattern"])
        iters, row = np.unique(draws["bs_iter"].to_numpy(), return_inverse=True)
        cell = row * len(known) + place[draws["_pattern"]].to_numpy()
        weights = np.bincount(cell, draws["_n"].to_numpy(), len(iters) * len(known)).reshape(len(iters), -1)
        owner = np.repeat(np.arange(len(known)), known["_runs"].str.len())
        runs, run = np.unique(np.concatenate(known["_runs"].to_list()), return_inverse=True)
        codes = np.concatenate(known["_codes"].to_list())
        out = {"_run": np.tile(runs, len(iters)), "bs_iter": np.repeat(iters, len(runs))}
        for c in range(4):
            hits = np.zeros((len(known), len(runs)))
            hits[owner[codes == c], run[codes == c]] = 1
            out[f"n{c}"] = np.rint(weights @ hits).astype(np.int64).ravel()
        return pd.DataFrame(out)

    parts = (drawn.withColumn("_bucket", bucket).groupBy(*keys)
             .cogroup(patterns.withColumn("_bucket", bucket).groupBy(*keys))
             .applyInPandas(product, "_run int, bs_iter int, n0 long, n1 long, n2 long, n3 long"))
    return parts.groupBy("_run", "bs_iter").agg(*[F.sum(f"n{c}").alias(f"n{c}") for c in range(4)])


@dataclass(frozen=True)
class _Held:
    """Outcomes of one data set: the pattern at each place, the runs, and a 0/1 table (patterns x runs) per outcome code."""
    place: np.ndarray
    runs: np.ndarray
    hits: list[np.ndarray]


def _hold(placed: DataFrame, patterns: DataFrame, data: list[str], sizes: list[Row]) -> list[_Held]:
    """The outcome tables of all data sets, in the order of `sizes`; the caller has checked how large they are."""
    where, known = placed.toPandas(), patterns.toPandas()
    out = []
    for size in sizes:
        def of(frame: pd.DataFrame, size: Row = size) -> pd.DataFrame:
            return frame[np.logical_and.reduce([frame[c] == size[c] for c in data])]
        mine, codes = of(where), of(known).reset_index(drop=True)
        number = pd.Series(np.arange(len(codes)), index=codes["_pattern"])
        place = np.zeros(size["n"], np.int64)
        place[mine["place"].to_numpy()] = number[mine["_pattern"]].to_numpy()
        owner = np.repeat(np.arange(len(codes)), codes["_runs"].str.len())
        runs, run = np.unique(np.concatenate(codes["_runs"].to_list()), return_inverse=True)
        code = np.concatenate(codes["_codes"].to_list())
        hits = [np.zeros((len(codes), len(runs))) for _ in range(4)]
        for c in range(4):
            hits[c][owner[code == c], run[code == c]] = 1
        out.append(_Held(place, runs, hits))
    return out


def _count_in_tasks(spark: SparkSession, held: list[_Held], iters: int, seed: int) -> DataFrame:
    """(_run, bs_iter, n0..n3): every task draws whole iterations and counts them against the outcomes it holds.

    Draws are made and digested row by row by Spark and go straight into counts: no table of draws exists, and none is
    shuffled or joined.
    """
    total = iters * sum(len(h.place) for h in held)
    tasks = min(iters, max(spark.sparkContext.defaultParallelism, -(-total // DRAWS_PER_TASK)))
    known = spark.sparkContext.broadcast(held)
    sets = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(len(h.place)).cast("long").alias("n")) for d, h in enumerate(held)])
    chunks = (spark.range(0, iters, 1, tasks).select(F.col("id").alias("bs_iter"), F.explode(sets).alias("_s")).select("bs_iter", "_s.*")
              .withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / SLOTS_PER_ROW)))))
    first = F.col("chunk") * SLOTS_PER_ROW
    slots = chunks.withColumn("slot", F.explode(F.sequence(first, F.least(first + SLOTS_PER_ROW, F.col("n")) - 1)))
    draws = slots.select("bs_iter", "d", _place(F.col("bs_iter"), F.col("slot"), F.col("n"), seed).alias("place"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, drawn = None, None

        def outcome() -> pa.RecordBatch:
            mine = known.value[key[1]]
            sums = [np.rint(drawn @ hits).astype(np.int64) for hits in mine.hits]
            columns = [pa.array(mine.runs.astype(np.int32)), pa.array(np.full(len(mine.runs), key[0], np.int32)), *map(pa.array, sums)]
            return pa.RecordBatch.from_arrays(columns, ["_run", "bs_iter", "n0", "n1", "n2", "n3"])

        for batch in batches:
            it, d, place = (batch.column(c).to_numpy() for c in ("bs_iter", "d", "place"))
            edges = np.flatnonzero((it[1:] != it[:-1]) | (d[1:] != d[:-1])) + 1
            for lo, hi in zip([0, *edges], [*edges, len(it)]):
                if (now := (int(it[lo]), int(d[lo]))) != key:
                    if key is not None:
                        yield outcome()
                    key, drawn = now, np.zeros(len(known.value[now[1]].hits[0]))
                drawn += np.bincount(known.value[key[1]].place[place[lo:hi]], minlength=len(drawn))
        if key is not None:
            yield outcome()

    return draws.mapInArrow(count, "_run int, bs_iter int, n0 long, n1 long, n2 long, n3 long")


def bootstrap_eval(df: DataFrame, spec: list[str], data: list[str], iters: int = 1000,
                   seed: int = BOOTSTRAP_SEED, held_cells: int = HELD_CELLS) -> DataFrame:
    """Any-link metrics of `iters` resamples of the experiment records, per specification.

    `data` are the specification columns that name the evaluated data set.  All runs on it
    share the draws, so differences between runs are paired.  Draws are counted per pattern
    of outcomes over the runs.  While records and patterns x runs are at most `held_cells`, whatever the
    iterations, tasks hold them and draw on their own; larger tables are joined with the draws by shuffle.
    """
    spark = df.sparkSession
    runs = _numbered_runs(df, spec)
    rows = _with_run(df.select(*spec, "rowid", "sid", "dataset", "cluster_id"), runs, spec)
    outcomes = staged(experiment_outcomes(rows, ["_run"])
                      .join(F.broadcast(runs.select("_run", *data)), "_run"), "outcomes")
    records = dense_number(outcomes.select(*data, "sid", "rowid").distinct(), [*data, "sid", "rowid"], "_number")
    # one row per evaluated data set
    sizes = staged(records.groupBy(*data).agg(F.min("_number").alias("_first"), F.count("*").alias("n")), "sizes")
    places = records.join(F.broadcast(sizes.select(*data, "_first")), data) \
        .select(*data, "rowid", (F.col("_number") - F.col("_first")).alias("place"))
    code = F.col("in_admin").cast("int") * 2 + F.col("pred_in_admin").cast("int")
    by_record = staged(outcomes.groupBy(*data, "rowid")
                 .agg(F.sort_array(F.collect_list(F.struct("_run", code.alias("code")))).alias("_codes"))
                 .withColumn("_pattern", F.md5(F.to_json("_codes").cast("binary"))), "patterns")
    patterns = staged(by_record.groupBy(*data, "_pattern").agg(F.first("_codes").alias("_c"))
                      .select(*data, "_pattern", F.col("_c.code").alias("_codes"), F.col("_c._run").alias("_runs")), "patterns")
    placed = staged(places.join(by_record.select(*data, "rowid", "_pattern"), [*data, "rowid"])
                    .select(*data, "place", "_pattern"), "places")
    cells = patterns.agg(F.sum(F.size("_runs"))).first()[0] or 0
    known = sizes.orderBy(*data).collect()
    if cells and max(cells, sum(r["n"] for r in known)) <= held_cells:
        counted = _count_in_tasks(spark, _hold(placed, patterns, data, known), iters, seed)
    else:
        drawn = (_draws(sizes.select(*data, "n"), data, iters, seed).join(placed.hint("shuffle_hash"), [*data, "place"])
                 .groupBy(*data, "bs_iter", "_pattern").agg(F.count("*").alias("_n")))
        counted = _count_outcomes(drawn, patterns, data)
    n00, n01, n10, n11 = (F.col(f"n{c}") for c in range(4))
    return (counted.select("_run", "bs_iter", ratio(n11, n10 + n11).alias("tpr_any"),
                           ratio(n11, n01 + n11).alias("prc_any"), ratio(n00, n00 + n01).alias("tnr_any"))
            .join(F.broadcast(runs), "_run")
            .transform(with_error_rates, ("any",))
            .select(*spec, "bs_iter", "tpr_any", "prc_any", "tnr_any", "error_any"))
